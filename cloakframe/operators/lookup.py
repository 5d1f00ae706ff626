"""Joins against lookup tables of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.sources.staging import staged

BROADCAST_BYTES = 32 << 20
SALTS = 16
#: A key with more than one in so many rows is hot, so there are fewer hot keys than this, however large the table.
HOT_SHARE = 1_000


def measured_bytes(*tables: DataFrame) -> int:
    """Exact size of the values of all lookup tables together, from one aggregate row."""
    def sizes(df: DataFrame) -> DataFrame:
        per_row = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(16))
        return df.select(per_row.cast("bigint").alias("b"))

    return reduce(DataFrame.union, map(sizes, tables)).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()["b"]


def salted(facts: DataFrame, table: DataFrame, on: list[str], salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: rows of ``facts`` with a hot key (null among them) are dealt over ``salts``, and the
    table's row of such a key is repeated for each; all other keys have the one salt 0, on both sides.

    Hot keys are told by counts of their hashes, added up before the shuffle; fewer than ``HOT_SHARE`` hashes of eight
    bytes come out of it, so they are broadcast whatever the size of ``facts``.  Another key with the hash of a hot one is
    salted too, on both sides alike.
    """
    others = [c for c in facts.columns if c not in on] or list(on)
    hashed = facts.withColumn("_hash", F.xxhash64(*on))
    counts = hashed.groupBy("_hash").agg(F.count("*").alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") * HOT_SHARE > facts.count()).select("_hash", F.lit(True).alias("_hot")))
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*others), F.lit(salts))).otherwise(0).cast("int")
    repeats = F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(0))
    left = hashed.join(hot, "_hash", "left").withColumn("_salt", dealt).drop("_hash", "_hot")
    right = table.withColumn("_hash", F.xxhash64(*on)).join(hot, "_hash", "left").withColumn("_salt", F.explode(repeats))
    return left, right.drop("_hash", "_hot")


def lookup(facts: DataFrame, table: DataFrame, on: list[str], how: str = "inner",
           broadcast_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Joins ``facts`` to ``table``, whose ``on`` values are unique.

    The table is broadcast only when its measured size is within ``broadcast_bytes``.  Beyond that both sides are
    shuffled, and a hot key is dealt over ``salts`` tasks, so that a value which makes up a third of all facts does not
    end in one task; only the table's rows of hot keys are repeated.  ``facts`` are staged for it, as they are read
    twice.  With ``salts=1`` (a key names one row of ``facts``) it is a plain join.
    """
    if measured_bytes(table) <= broadcast_bytes:
        return facts.join(F.broadcast(table), on, how)
    if salts == 1:
        return facts.join(table, on, how)
    left, right = salted(staged(facts, "facts"), table, on, salts)
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookups(facts: DataFrame, tables: list[tuple[DataFrame, list[str]]], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left joins to several tables, measured together by one job; one by one only if they don't fit together."""
    fit = measured_bytes(*[t for t, _ in tables]) <= broadcast_bytes
    for table, on in tables:
        facts = facts.join(F.broadcast(table), on, "left") if fit else lookup(facts, table, on, "left", broadcast_bytes)
    return facts


def apply_list_tables(findings: DataFrame, allow_values: DataFrame, allow_domains: DataFrame, deny_values: DataFrame,
                      broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The allow and deny lists as tables of any size: a denied value stays, an allowed one goes."""
    listed = deny_values.select(F.col("value").alias("_value"), F.lit(True).alias("_denied")).unionByName(
        allow_values.select(F.col("value").alias("_value"), F.lit(False).alias("_denied")))
    # in both lists: denied
    values = listed.groupBy("_value").agg(F.max("_denied").alias("_denied"))
    domains = allow_domains.select(F.col("value").alias("_domain")).distinct().withColumn("_in", F.lit(True))
    keyed = findings.withColumns({"_value": F.col("value"), "_domain": F.get(F.split("value", "@", -1), F.lit(1))})
    f = lookups(keyed, [(values, ["_value"]), (domains, ["_domain"])], broadcast_bytes)
    allowed = (F.col("_denied").isNotNull() & ~F.col("_denied")) | F.coalesce("_in", F.lit(False))
    return f.where(F.coalesce("_denied", F.lit(False)) | ~allowed).select(*findings.columns)
