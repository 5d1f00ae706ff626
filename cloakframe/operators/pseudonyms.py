"""Consistent replacements: the table of what was replaced by what, and its use.

The rewrite itself never needs this table, because a replacement is a function of type, value and
seed.  The table is for audit, for re-identification under control, and for mappings made elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.strategies import replace_pseudonym
from cloakframe.operators.lookup import lookup
from cloakframe.policy import Replace


def distinct_values(findings: DataFrame) -> DataFrame:
    return findings.select("pii_type", "value").distinct()


def pseudonym_map(findings: DataFrame, options: Replace = Replace()) -> DataFrame:
    return distinct_values(findings).withColumn(
        "replacement", replace_pseudonym(F.col("pii_type"), F.col("value"), options))


def with_pseudonyms(findings: DataFrame, mapping: DataFrame, **how) -> DataFrame:
    """Adds ``replacement`` from a mapping table; a value without an entry becomes ``[TYPE_FAKE]``."""
    joined = lookup(findings, mapping.select("pii_type", "value", "replacement"), ["pii_type", "value"], "left", **how)
    return joined.select(
        *findings.columns,
        F.coalesce("replacement", F.concat(F.lit("["), F.col("pii_type"), F.lit("_FAKE]"))).alias("replacement"),
    )
