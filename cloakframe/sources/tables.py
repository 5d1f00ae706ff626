"""Reading: tables, header CSV and folders of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.operators.lookup import lookup
from cloakframe.sources.staging import staged


#: So many rows of a table of short rows make one task, as a row can become a text that takes a millisecond of regexes.
ROWS_PER_TASK = 20_000


def read_table(spark: SparkSession, path: str, *columns: str, rows_per_task: int | None = None) -> DataFrame:
    """A parquet table, only the named columns.

    The work per byte of text is high, so a table needs many splits.  Spark cuts files by bytes and never inside a row
    group: a table of keys that become texts has few bytes a row, so millions of rows can be one task's work.  With
    ``rows_per_task`` the rows, of which the file footers tell the number, are dealt over as many tasks as that asks for,
    where the files have fewer splits.  The session setting ``cloakframe.input.partitions`` asks for a shuffle of every
    input into so many partitions; it is off by default.
    """
    df = spark.read.parquet(path)
    rows = df.count() if rows_per_task else 0
    df = df.select(*columns) if columns else df
    spread = spark.conf.get("cloakframe.input.partitions", None)
    if spread:
        return df.repartition(int(spread))
    tasks = -(-rows // rows_per_task) if rows_per_task else 0
    return df.repartition(tasks) if tasks > max(1, df.rdd.getNumPartitions()) else df


#: Where a row stood in its input: file, where its block begins in the file, and a number that grows inside the block.
ORDER = "row_order"


def scan_csv(spark: SparkSession, path: str, line_breaks: bool = True, row_order: bool = False) -> DataFrame:
    """Header CSV; every cell is a string.  Quoted cells may hold line breaks, unless ``line_breaks`` is off: a file
    is then split over tasks, else it is one task's work.  ``row_order`` adds the column ``ORDER``, by which the input's
    order can be had again after any shuffle."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=line_breaks, quote='"', escape='"',
                        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=False)
    return with_order(df) if row_order else df


def with_order(scan: DataFrame) -> DataFrame:
    """A file scan with ``ORDER``.  A block of a file is read in order by one task, so the generated numbers grow with the
    rows of a block, whatever task reads it; files follow their paths."""
    return scan.select("*", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq")).alias(ORDER))


def numbered(df: DataFrame, name: str = "row_number") -> DataFrame:
    """``df`` with ``ORDER`` replaced by row numbers from 0 over all files: counts by block are added up, and only that
    table, a row for each block of input, is sorted as a whole."""
    block = [F.col(f"{ORDER}.file").alias("_file"), F.col(f"{ORDER}.block").alias("_block")]
    rows = staged(df.select("*", *block), "rows")
    counts = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min(f"{ORDER}.seq").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return lookup(rows, starts, ["_file", "_block"]).select(
        *[c for c in df.columns if c != ORDER], (F.col("_start") + F.col(f"{ORDER}.seq") - F.col("_first")).alias(name))


def checked_columns(df: DataFrame, columns: list[str] | None) -> list[str]:
    """The chosen columns, or all; an unknown name fails before anything runs."""
    if columns is None:
        return list(df.columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Columns not found: {missing}")
    return list(columns)


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("CSV file is empty")
    return df


def scan_text_corpus(spark: SparkSession, path: str, recursive: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """(path, text): one row per ``*.txt`` file, its whole text."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=recursive)
        return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    reader = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
        .option("recursiveFileLookup", recursive).load(path)
    )
    return reader.select("path", F.decode("content", encoding).alias("text"))
