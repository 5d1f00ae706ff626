"""Writing: rewritten tables, the untouched input, audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def output_path(path: Column, suffix: str = "_anonymized") -> Column:
    """``dir/name.ext`` -> ``dir/name<suffix>.ext``."""
    return F.regexp_replace(path, r"^(.*/)?([^/]+?)(\.[^./]*)?$", f"$1$2{suffix}$3")


def audit_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^(.*/)?([^/]+?)(\.[^./]*)?$", "$1$2_audit.json")


def under(path: Column, input_dir: str, output_dir: str | None = None) -> Column:
    """The place of a file of ``input_dir`` below the output folder, its relative path kept."""
    source = input_dir.rstrip("/")
    target = (output_dir or source + "_anonymized").rstrip("/")
    return F.concat(F.lit(target), F.substring(path, F.locate(source, path) + len(source), F.length(path)))


def sink_text(done: DataFrame, target: str, path_col: str = "path", text_col: str = "text", mode: str = "errorifexists") -> None:
    """Rewritten documents with the path each would have, as a table: one row per document."""
    done.withColumn("out_path", output_path(F.col(path_col))).write.mode(mode).parquet(target)


def sink_csv(done: DataFrame, columns: list[str], target: str, mode: str = "errorifexists",
             order_by: str | None = None) -> None:
    """The input's columns in their order, with a header.  ``order_by`` names a column with the rows' order, for
    instance ``tables.ORDER``, as ``scan_csv`` adds it: files and the rows in them then follow it, by a range sort."""
    done = done.orderBy(order_by) if order_by else done
    done.select(*columns).write.mode(mode).csv(target, header=True, quote='"', escape='"', emptyValue="",
                                               ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def sink_backup(original: DataFrame, target: str) -> None:
    """The input as it was, next to the output; an existing copy is never overwritten."""
    original.write.mode("errorifexists").parquet(target.rstrip("/") + "/_original")


def sink_audit(log: DataFrame, target: str, mode: str = "errorifexists") -> None:
    log.write.mode(mode).option("ignoreNullFields", False).json(target)
