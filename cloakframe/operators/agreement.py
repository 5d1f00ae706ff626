"""Which findings of two detectors overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(a: DataFrame, b: DataFrame, ids: list[str], cell: int = 64) -> DataFrame:
    """Pairs of overlapping spans of ``a`` and ``b`` (type, start, end of both).

    Spans are matched cell by cell of the text, so the join key is (ids, cell) and only neighbours meet;
    a pair that shares several cells is reported in the first of them.
    """

    def celled(df: DataFrame, tag: str) -> DataFrame:
        first = F.floor(F.col("start") / cell)
        last = F.floor((F.col("end") - 1) / cell)
        return df.select(
            *ids, F.col("pii_type").alias(f"{tag}_type"), F.col("start").alias(f"{tag}_start"),
            F.col("end").alias(f"{tag}_end"), first.alias(f"_{tag}_first"),
            F.explode(F.sequence(first, last)).alias("_cell"))

    return (
        celled(a, "a").join(celled(b, "b"), [*ids, "_cell"])
        .where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
               & (F.col("_cell") == F.greatest("_a_first", "_b_first")))
        .drop("_cell", "_a_first", "_b_first")
    )
