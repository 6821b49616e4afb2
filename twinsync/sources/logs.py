"""Log text: problems per level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How errors and fatal errors are marked in a log line.
ERROR_MARK = "ERROR"
FATAL_MARKS = ["[FATAL]", "[FTL]"]


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder of log files: ``value``, ``file``."""
    return spark.read.text(path).withColumn("file", F.input_file_name())


def fatal_lines(lines: DataFrame) -> DataFrame:
    hit = F.lit(False)
    for mark in FATAL_MARKS:
        hit = hit | F.contains("value", F.lit(mark))
    return lines.where(hit)


def log_health(lines: DataFrame) -> DataFrame:
    """One row: how many lines there are, with errors and with fatal errors."""
    fatal = F.lit(False)
    for mark in FATAL_MARKS:
        fatal = fatal | F.contains("value", F.lit(mark))
    error = F.contains("value", F.lit(ERROR_MARK))
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(error).alias("errors"),
        F.count_if(fatal).alias("fatal"),
        F.count_if(error | fatal).alias("problems"),
    ).withColumn("healthy", F.col("problems") == 0)
