"""The whole pipeline over a table: read once, rewrite inside the row, write once.  No shuffle, no
Python worker; a text is analysed where it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.strategies import is_own, rewriter
from cloakframe.functions.text import let, splice, with_computed
from cloakframe.operators.detect import GROUPS, with_groups
from cloakframe.operators.resolve import kept_spans
from cloakframe.policy import Policy


def analysed(policy: Policy) -> Column:
    """struct(found, kept) over the columns of ``with_groups``: how many findings the analysis reported,
    and the spans to rewrite."""
    return let(
        F.col(GROUPS),
        lambda c: F.struct(
            F.aggregate(c, F.lit(0), lambda n, g: n + F.size(g)).alias("found"),
            kept_spans(c, policy).alias("kept"),
        ),
    )


def rewritten(text: Column, spans: Column, policy: Policy) -> Column:
    make = rewriter(policy)
    return splice(text, spans, lambda s: make(s["pii_type"], s["value"]))


def unfit(text: Column, policy: Policy) -> Column:
    """Why a text cannot be analysed, or null."""
    why = F.when(~F.call_function("is_valid_utf8", text), F.lit("not valid UTF-8"))
    if policy.max_chars is not None:
        why = why.when(F.length(text) > policy.max_chars, F.lit(f"longer than {policy.max_chars} characters"))
    return why


def rewrite_text(df: DataFrame, text_col: str, policy: Policy | None = None, keep_failed_text: bool = False) -> DataFrame:
    """``df`` with ``text_col`` rewritten and the run columns added: pii_found, pii_anonymized, entries
    (what was rewritten and where, never the value), status (``skipped`` for a missing or empty
    text, which stays as it is, ``failed`` with the reason in error, else ``ok``) and error.

    A row fails on its own: its text cannot be analysed (``unfit``), or its strategy has no replacement for a finding.
    What may still hold personal data is withheld: the text becomes null, or stays with ``keep_failed_text``.
    """
    policy = policy or Policy()
    text = F.col(text_col)
    make = rewriter(policy)

    def result(a: Column) -> Column:
        # a replacement that is null would take the whole text with it
        missing = F.filter(F.transform(a["kept"], lambda s: F.when(
            make(s["pii_type"], s["value"]).isNull(), s["pii_type"])), lambda t: t.isNotNull())
        return F.struct(
            rewritten(text, a["kept"], policy).alias("text"),
            a["found"].alias("pii_found"),
            F.size(a["kept"]).alias("pii_anonymized"),
            F.transform(a["kept"], lambda s: F.struct(
                s["pii_type"].alias("pii_type"), s["start"].alias("position"), s["detector"].alias("detector"),
            )).alias("entries"),
            *([F.get(missing, F.lit(0)).alias("missing")] if is_own(policy) else [F.lit(None).cast("string").alias("missing")]),
        )

    given = df.withColumn("_cf_unfit", unfit(text, policy)).withColumn("_cf_fit", F.when(F.col("_cf_unfit").isNull(), text))
    analysis = with_groups(given, "_cf_fit", policy).withColumn("_cf_analysis", analysed(policy))
    done = with_computed(analysis, "_r", let(F.col("_cf_analysis"), result))
    error = F.coalesce(F.col("_cf_unfit"), F.concat(F.lit("no replacement for "), F.col("_r.missing")))
    failed = error.isNotNull()
    kept = text if keep_failed_text else F.lit(None).cast("string")
    return done.select(
        *[F.when(failed, kept).otherwise(F.col("_r.text")).alias(c) if c == text_col else F.col(c) for c in df.columns],
        F.when(failed, 0).otherwise(F.col("_r.pii_found")).alias("pii_found"),
        F.when(failed, 0).otherwise(F.col("_r.pii_anonymized")).alias("pii_anonymized"),
        F.when(failed, F.slice("_r.entries", 1, 0)).otherwise(F.col("_r.entries")).alias("entries"),
        F.when(failed, "failed").when(F.coalesce(text, F.lit("")) == "", "skipped").otherwise("ok").alias("status"),
        error.alias("error"),
    )
