"""Row predicates over a findings table that came from somewhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import checksums
from cloakframe.functions.strategies import CARD_TYPES, EMAIL_TYPES, SSN_TYPES


def reject_reason(f: Column | None = None) -> Column:
    """Why a span cannot be a finding, or null."""
    get = (lambda c: F.col(c)) if f is None else (lambda c: f[c])
    return (
        F.when(~get("confidence").between(0.0, 1.0), "confidence outside 0..1")
        .when((get("start") < 0) | (get("end") < 0), "negative position")
        .when(get("start") >= get("end"), "start not before end")
    )


def validate_findings(findings: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` and ``valid``: Luhn for cards, area/group/serial for SSNs, top-level domain
    for e-mail addresses, and null for types without a rule."""
    t, v = F.col("pii_type"), F.col("value")
    valid = (
        F.when(t.isin(*CARD_TYPES), checksums.luhn(v))
        .when(t.isin(*SSN_TYPES), checksums.ssn(v))
        .when(t.isin(*EMAIL_TYPES), checksums.email_tld(v))
    )
    return findings.withColumns({"reject_reason": reject_reason(), "valid": valid})
