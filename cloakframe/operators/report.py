"""Run reports and audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.strategies import strategy_name
from cloakframe.policy import Policy
from cloakframe.sources.staging import staged


def count_found_per_doc(done: DataFrame, ids: list[str]) -> DataFrame:
    """Found before filtering and rewritten after it, summed over the texts of one id."""
    llm = F.sum("llm_pii_found") if "llm_pii_found" in done.columns else F.lit(0).cast("bigint")
    return done.groupBy(*ids).agg(
        F.sum("pii_found").alias("pii_found"), F.sum("pii_anonymized").alias("pii_anonymized"),
        llm.alias("llm_pii_found"))


def run_totals(done: DataFrame) -> DataFrame:
    """One row: rows, failed rows, findings (second pass included), second-pass findings, findings per
    row."""
    llm = F.col("llm_pii_found") if "llm_pii_found" in done.columns else F.lit(0)
    ok = F.col("status") != "failed"
    total = F.sum(F.when(ok, F.col("pii_anonymized")).otherwise(0))
    return done.agg(
        F.count("*").alias("rows_processed"), F.count_if(~ok).alias("rows_failed"),
        F.coalesce(total, F.lit(0)).alias("total_pii_found"), F.coalesce(F.sum(llm), F.lit(0)).alias("llm_pii_found"),
        F.round(total / F.count("*"), 1).alias("pii_per_row"))


def corpus_summary(done: DataFrame) -> DataFrame:
    return done.agg(
        F.count_if(F.col("status") != "failed").alias("successful"), F.count("*").alias("total"),
        F.coalesce(F.sum("pii_anonymized"), F.lit(0)).alias("total_pii"))


def entity_frequency(findings: DataFrame, by: str | None = None) -> DataFrame:
    """Findings per type; with ``by`` also per value of that column, with subtotals."""
    if by is None:
        return findings.groupBy("pii_type").agg(F.count("*").alias("n"))
    return findings.rollup(by, "pii_type").agg(F.count("*").alias("n"))


def first_errors(done: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` failed texts, and one more row (without a key) saying how many others there are."""
    failed = staged(done.where(F.col("status") == "failed").select(F.col(key).cast("string").alias(key), "error"), "failed")
    rest = failed.agg(F.count("*").alias("_n")).where(F.col("_n") > n).select(
        F.lit(None).cast("string").alias(key),
        F.concat(F.lit("... and "), F.col("_n") - n, F.lit(" more errors")).alias("error"))
    return failed.orderBy(key, "error").limit(n).unionByName(rest)


def audit_entries(done: DataFrame, ids: list[str], policy: Policy, timestamp: str) -> DataFrame:
    """One row per rewritten span: never the value; the hash column is kept for the format and empty."""
    return (
        done.select(*ids, F.explode("entries").alias("_e"))
        .select(*ids, "_e.pii_type", "_e.position", F.lit(strategy_name(policy)).alias("strategy"),
                F.lit(timestamp).alias("timestamp"), F.lit(None).cast("string").alias("hash"),
                "_e.detector")
    )


def audit_log(done: DataFrame, ids: list[str], policy: Policy, timestamp: str) -> DataFrame:
    """One nested record per text, built from the row's own spans without a shuffle."""
    strategy = strategy_name(policy)
    entries = F.transform("entries", lambda e: F.struct(
        e["pii_type"].alias("pii_type"), e["position"].alias("position"), F.lit(strategy).alias("strategy"),
        F.lit(timestamp).alias("timestamp"), F.lit(None).cast("string").alias("hash")))
    return done.select(
        *ids, F.lit(timestamp).alias("timestamp"), F.lit(strategy).alias("strategy"),
        F.col("pii_anonymized").alias("total_anonymized"), entries.alias("entries"))
