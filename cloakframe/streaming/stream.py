"""The same plan over a folder that keeps receiving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators.detect import detect
from cloakframe.operators.pseudonyms import pseudonym_map
from cloakframe.plans.rewrite import rewrite_text
from cloakframe.policy import Policy, Replace


def read_stream(spark: SparkSession, folder: str, glob: str, files_per_batch: int = 1000) -> DataFrame:
    """A file-source stream with the schema of the files that are there.

    ``glob`` names files of ``folder``, or folders in it that hold the files themselves, as Spark writes a table.  The file
    source goes into folders that its path names, and ``pathGlobFilter`` looks at names of files only, so the pattern is
    part of the path: it then stands for both.  A plain name becomes a pattern too, as the source takes a path that is none
    for a folder.
    """
    pattern = glob if any(c in glob for c in "*?[{") else f"{glob[:-1]}[{glob[-1]}]"
    path = f"{folder.rstrip('/')}/{pattern}"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_rewrite(stream: DataFrame, text_col: str, target: str, checkpoint: str,
                     policy: Policy | None = None) -> StreamingQuery:
    """Stateless: every batch is rewritten row by row and appended to ``target``."""
    return (
        rewrite_text(stream, text_col, policy).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def entity_counts(found: DataFrame, ts_col: str, window: str = "1 hour") -> DataFrame:
    """Findings per type and event-time window."""
    return (
        found.groupBy(F.window(ts_col, window).alias("_w"), "pii_type").agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "pii_type", "n")
    )


def stream_counts(stream: DataFrame, text_col: str, ts_col: str, target: str, checkpoint: str,
                  policy: Policy | None = None, window: str = "1 hour") -> StreamingQuery:
    """The counts of every batch, one folder per batch; ``read_counts`` adds them up.

    Nothing is ever late: a row counts in its window whenever it comes, and no state is kept.  A batch that is
    repeated overwrites its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        counts = entity_counts(detect(batch, text_col, [ts_col], policy, with_context=False), ts_col, window)
        counts.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_counts(spark: SparkSession, target: str) -> DataFrame:
    """(window_start, window_end, pii_type, n) over all batches so far."""
    return spark.read.parquet(target).groupBy("window_start", "window_end", "pii_type").agg(F.sum("n").alias("n"))


def stream_pseudonyms(stream: DataFrame, text_col: str, target: str, checkpoint: str, policy: Policy | None = None,
                      options: Replace = Replace()) -> StreamingQuery:
    """The pseudonym table of every batch, one folder per batch.

    A replacement depends on its value alone, so batches agree without state; a repeated batch overwrites
    its own folder, and readers take ``distinct`` over the folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        mapping = pseudonym_map(detect(batch, text_col, [], policy, with_context=False), options)
        mapping.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
