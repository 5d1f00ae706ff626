"""The corpus pipeline: quality rules, toxicity, near duplicates, secrets, packing.

Each stage takes what its predecessor kept and calls one operator.  All but the last return the columns of
``documents``; extra columns pass through the filtering stages as they are, whatever their names.  Models are fitted on the stage's own input and the
table ``labels``.  Null and empty texts fail the quality rules (no words), so later stages rarely see them; each
operator defines them all the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import circulant, decision_lists, packing, secret_scan, toxicity
from cloakframe.llm.common import table
from cloakframe.sources.staging import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rules or that a learned rule rejects."""
    rules = decision_lists.learn(docs, table(spark, sf_dir, "labels"))
    return decision_lists.judged(docs, rules).where("kept").select("row.*")


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the chain calls toxic."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, chain).where(~F.col("is_toxic")).select("row.*")


#: The least Jaccard similarity of near duplicates in the corpus, in per cent.
NEAR = 80


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each group of near duplicates, that of the smallest id, once; rows without id or words stay."""
    return circulant.one_of_each(docs, similarity=NEAR)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; no text is dropped."""
    found = secret_scan.with_spans(docs)
    text = secret_scan.redacted(F.col("row.text"), F.col("spans"))
    return found.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each text, or piece of a long one, goes: one row for each piece."""
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality),
    ("toxicity", non_toxic),
    ("near duplicates", unique),
    ("secrets", without_secrets),
    ("packing", packs),
]

#: Learned stages cannot be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
