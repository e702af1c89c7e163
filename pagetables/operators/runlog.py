"""The run log as a table: (ts, page_id, level, stage, message, metadata JSON)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.variants import compact_json

STAGES = ["Ingestion", "Cleaning", "Extraction", "Validator"]


def log_filter(run_log: DataFrame, debug: bool = False) -> DataFrame:
    """Without DEBUG rows, unless asked for."""
    return run_log if debug else run_log.where(F.col("level") != "DEBUG")


def log_lines(run_log: DataFrame) -> DataFrame:
    """+ line: `[time] [level] [stage] message | metadata`."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    compact = compact_json("metadata")
    line = F.format_string("[%s] [%s] [%s] %s", time, "level", "stage", "message")
    return run_log.withColumn(
        "line", F.concat(line, F.coalesce(F.concat(F.lit(" | "), compact), F.lit("")))
    )


def log_summary(run_log: DataFrame) -> DataFrame:
    """(stage, level, n)."""
    return run_log.groupBy("stage", "level").agg(F.count("*").alias("n"))


def stage_times(run_log: DataFrame) -> DataFrame:
    """Milliseconds from a page's first to its last log row, per stage and in total."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))

    def span(condition=None):
        value = ms if condition is None else F.when(condition, ms)
        return F.coalesce(F.max(value) - F.min(value), F.lit(0))

    return run_log.groupBy("page_id").agg(
        *[span(F.col("stage") == s).alias(f"{s.lower()}_ms") for s in STAGES],
        span().alias("total_ms"),
    )
