"""What the corpus operators share: tables, samples, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words: space and the control characters from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
_GAP_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null, empty and white texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def hash_sample(df: DataFrame, key: str, at_most: int, seed: int = 0) -> DataFrame:
    """About ``at_most`` rows, chosen by a hash of ``key``: the same rows at every run and on every
    cluster.  The whole table where it has no more rows than that.  Rows without a key never count."""
    df = df.where(F.col(key).isNotNull())
    n = df.count()
    if n <= at_most:
        return df
    share = int(at_most / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < share)
