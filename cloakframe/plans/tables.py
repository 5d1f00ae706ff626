"""Several text columns of one table, row status, and findings from outside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.strategies import rewriter
from cloakframe.functions.text import code_points, let, piece, splice
from cloakframe.operators import folds
from cloakframe.operators.detect import GROUPS, detect, with_groups
from cloakframe.operators.person import detect_denied, detect_gazetteer
from cloakframe.operators.resolve import kept_spans, merge_table, resolve_table, survives_lists
from cloakframe.operators.validate import reject_reason
from cloakframe.plans.rewrite import rewrite_text
from cloakframe.policy import Policy
from cloakframe.sources.staging import staged


def long_form(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, col, text): one row per non-empty cell of the chosen columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("text")) for c in columns])
    return (
        df.select(*ids, F.explode(cells).alias("_c")).select(*ids, "_c.col", "_c.text")
        .where(F.coalesce("text", F.lit("")) != "")
    )


def rewrite_columns(df: DataFrame, columns: list[str] | None = None, policy: Policy | None = None) -> DataFrame:
    """Rewrites each chosen column inside its row (all columns when None); the others stay, and so does
    the order.  Adds pii_found and pii_anonymized over all columns, status and error: a cell that fails is withheld and
    fails its row, the other cells of the row are rewritten."""
    from cloakframe.sources.tables import checked_columns

    policy = policy or Policy()
    columns = checked_columns(df, columns)
    out, found, applied, errors = df, F.lit(0), F.lit(0), []
    for i, c in enumerate(columns):
        out = rewrite_text(out.withColumn(c, F.col(c).cast("string")), c, policy)
        out = out.withColumnsRenamed({"pii_found": f"_found{i}", "pii_anonymized": f"_applied{i}", "error": f"_error{i}"}).drop(
            "entries", "status")
        found, applied = found + F.col(f"_found{i}"), applied + F.col(f"_applied{i}")
        errors.append(F.concat(F.lit(f"{c}: "), F.col(f"_error{i}")))
    error = F.coalesce(*errors) if errors else F.lit(None).cast("string")
    return out.select(*df.columns, found.alias("pii_found"), applied.alias("pii_anonymized"),
                      F.when(error.isNotNull(), "failed").otherwise("ok").alias("status"), error.alias("error"))


def spliced(df: DataFrame, text_col: str, ids: list[str], kept: DataFrame, policy: Policy,
            stripe: int = folds.STRIPE) -> DataFrame:
    """``df`` with the spans ``kept`` (disjoint in a text, none beyond its end) rewritten in ``text_col``, and ``_n``, how
    many there were.  ``ids`` name one text each.

    Spans meet their text by stripe: a text of one stripe is rewritten in its row; a longer one is cut into stripes,
    each gets its own spans, and the pieces are put together again, so no row holds the spans of a whole long text.
    """
    make = rewriter(policy)
    at = F.floor(F.col("start") / stripe).cast("long")
    last = F.floor((F.col("end") - 1) / stripe).cast("long")
    # a span that reaches into a further stripe takes its part of it, and leaves its replacement in the first
    parts = kept.select(*ids, "start", "end", make(F.col("pii_type"), F.col("value")).alias("_new"),
                        at.alias("_first"), F.explode(F.sequence(at, F.greatest(last, at))).alias("_stripe"))
    local = F.struct(
        F.greatest(F.col("start") - F.col("_stripe") * stripe, F.lit(0)).cast("int").alias("start"),
        F.least(F.col("end") - F.col("_stripe") * stripe, F.lit(stripe)).cast("int").alias("end"),
        F.when(F.col("_stripe") == F.col("_first"), F.col("_new")).otherwise("").alias("new"))
    spans = parts.groupBy(*ids, "_stripe").agg(
        F.array_sort(F.collect_list(local)).alias("_s"), F.count_if(F.col("_stripe") == F.col("_first")).alias("_m"))

    rows = df.select(*ids, F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("_row"),
                     F.col(text_col).alias("_text"))
    long = F.coalesce(F.length("_text") > stripe, F.lit(False))

    def cut(text: Column) -> Column:
        each = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / stripe).cast("int"))
        return let(code_points(text), lambda p: F.transform(each, lambda i: piece(p, i * stripe, F.lit(stripe))))

    def done(pieces: DataFrame, on: list[str]) -> DataFrame:
        none = F.array().cast("array<struct<start:int,end:int,new:string>>")
        return pieces.join(spans if "_stripe" in on else spans.where("_stripe = 0").drop("_stripe"), on, "left").withColumn(
            "_text", let(F.coalesce("_s", none), lambda s: splice(F.col("_text"), s, lambda x: x["new"])))

    short = done(rows.where(~long), ids).select("_row", "_text", F.coalesce("_m", F.lit(0)).alias("_n"))
    pieces = rows.where(long).select(*ids, "_row", F.posexplode(cut(F.col("_text"))).alias("_stripe", "_text")).select(
        *ids, F.when(F.col("_stripe") == 0, F.col("_row")).alias("_row"), F.col("_stripe").cast("long").alias("_stripe"), "_text")
    whole = done(pieces, [*ids, "_stripe"]).groupBy(*ids).agg(
        F.first("_row", ignorenulls=True).alias("_row"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_stripe", "_text"))), lambda x: x["_text"]), "").alias("_text"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("_n")).select("_row", "_text", "_n")
    both = short.unionByName(whole)
    return both.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in df.columns], "_n")


def rewrite_with(df: DataFrame, text_col: str, ids: list[str], findings: DataFrame, policy: Policy | None = None,
                 keep_failed_text: bool = False) -> DataFrame:
    """Rewrites ``text_col`` by a findings table.  ``ids`` name one text each.

    A text with an impossible finding (bad span, bad confidence, beyond its end) is failed: its text is
    withheld, or kept as it is with ``keep_failed_text``, and the other texts are not affected.
    """
    policy = policy or Policy()
    sizes = df.select(*ids, F.length(text_col).alias("_len"))
    judged = staged(findings.join(sizes, ids).withColumn(
        "_why", F.coalesce(reject_reason(), F.when(F.col("end") > F.col("_len"), F.lit("beyond the text")))), "judged")
    bad = judged.where(F.col("_why").isNotNull()).groupBy(*ids).agg(F.min("_why").alias("error"))
    good = judged.where(F.col("_why").isNull()).drop("_len", "_why").join(bad, ids, "left_anti")
    done = spliced(df, text_col, ids, resolve_table(good, ids, policy), policy).join(bad, ids, "left")
    failed = F.col("error").isNotNull()
    kept_text = F.col(text_col) if keep_failed_text else F.lit(None).cast("string")
    return done.select(
        *[F.when(failed, kept_text).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in df.columns],
        F.col("_n").cast("int").alias("pii_anonymized"), F.when(failed, "failed").otherwise("ok").alias("status"), "error",
    )


FINDING = ["pii_type", "value", "start", "end", "confidence", "detector", "shape", "ord"]


def rewrite_known(df: DataFrame, text_col: str, ids: list[str], policy: Policy | None = None,
                  gazetteer: DataFrame | None = None, denied: DataFrame | None = None) -> DataFrame:
    """Rewrites what the patterns find, the names of ``gazetteer`` (key, pii_type) and the values of ``denied`` (value), in
    one plan: all findings are resolved together, so a name inside an address is part of it, and spliced once.
    ``ids`` name one text each.  Adds pii_found, pii_anonymized and status."""
    policy = policy or Policy()
    found = [detect(df, text_col, ids, policy, with_context=False).select(*ids, *FINDING)]
    if gazetteer is not None:
        found.append(detect_gazetteer(df, text_col, ids, gazetteer, policy, with_context=False).select(*ids, *FINDING))
    if denied is not None:
        found.append(detect_denied(df, text_col, ids, denied, with_context=False).select(*ids, *FINDING))
    every = staged(reduce(DataFrame.unionByName, found), "findings")
    # what a deny table lists is rewritten whatever is allowed
    listed = every.where((F.col("detector") == "deny_list") | survives_lists(F.col("value"), policy))
    done = spliced(df, text_col, ids, merge_table(listed, ids), policy)
    counts = every.groupBy(*ids).agg(F.count("*").alias("_found"))
    text = F.col(text_col)
    return done.join(counts, ids, "left").select(
        *df.columns, F.coalesce("_found", F.lit(0)).cast("int").alias("pii_found"), F.col("_n").cast("int").alias("pii_anonymized"),
        F.when(F.coalesce(text, F.lit("")) == "", "skipped").otherwise("ok").alias("status"))


def resolved_findings(df: DataFrame, text_col: str, ids: list[str], policy: Policy | None = None) -> DataFrame:
    """One row per span that the pipeline would rewrite."""
    policy = policy or Policy()
    spans = with_groups(df, text_col, policy).select(
        *ids, let(F.col(GROUPS), lambda c: kept_spans(c, policy)).alias("_k"))
    return (
        spans.select(*ids, F.explode_outer("_k").alias("_k")).where(F.col("_k").isNotNull()).select(*ids, "_k.*")
    )
