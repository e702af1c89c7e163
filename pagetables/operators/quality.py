"""Acceptance, rejections and quality figures over successful pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rate(accepted, total):
    return F.when(total > 0, F.round(accepted / total * 100, 1))


def acceptance_rate(validated: DataFrame, by: list[str]) -> DataFrame:
    """Accepted share in percent, one decimal, per group (per page, per type, over all)."""
    ok = F.col("accepted")
    return (
        validated.where(F.col("idx").isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.when(ok, 1)).alias("accepted"),
            F.count(F.when(~ok, 1)).alias("rejected"),
            _rate(F.count(F.when(ok, 1)), F.count("*")).alias("acceptance_rate"),
        )
    )


def rejection_reasons(validated: DataFrame) -> DataFrame:
    """(reason, n)."""
    rejected = validated.where(F.col("idx").isNotNull() & F.col("reason").isNotNull())
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


def rejection_details(validated: DataFrame) -> DataFrame:
    """(page_id, idx, type, reason)."""
    rejected = validated.where(F.col("idx").isNotNull() & F.col("reason").isNotNull())
    return rejected.select("page_id", "idx", "type", "reason")


def quality_metrics(page_validation: DataFrame) -> DataFrame:
    """(page_id, extractor_quality, validator_quality, overall_quality); failed pages 0."""
    good = F.col("stage").isNull()
    extracted = F.col("n_accepted") + F.col("n_rejected")
    extractor = F.when(good & (extracted > 0), 100.0).otherwise(0.0)
    validator = F.when(
        good & (extracted > 0), F.col("n_accepted") / extracted * 100
    ).otherwise(0.0)
    return page_validation.select(
        "page_id",
        extractor.alias("extractor_quality"),
        validator.alias("validator_quality"),
        (extractor * validator / 100).alias("overall_quality"),
    )


def type_summary(validated: DataFrame) -> DataFrame:
    """Entities by type and outcome with totals: rollup, null standing for all."""
    outcome = F.when(F.col("accepted"), "accepted").otherwise("rejected")
    rows = validated.where(F.col("idx").isNotNull()).withColumn("outcome", outcome)
    return rows.rollup("type", "outcome").agg(F.count("*").alias("n"))


def seconds_text(ms: Column) -> Column:
    """Milliseconds as seconds with one decimal; a tie is settled by the binary value, as
    scripts do, so 0.25 gives 0.3 and 2122978.55 gives 2122978.5."""
    seconds = ms.cast("double") / F.lit(1000.0)
    tenths = (seconds - F.floor(seconds)) * 10
    up = F.when(tenths - F.floor(tenths) >= 0.5, 1).otherwise(0)
    n = F.floor(seconds) * 10 + F.floor(tenths) + up
    whole = F.floor(n / 10).cast("string")
    return F.concat(whole, F.lit("."), (n % 10).cast("string"), F.lit("s"))


def stats_view(stage_times: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Times in seconds with one decimal, and tokens with thousands separators."""
    times = [c for c in stage_times.columns if c.endswith("_ms")]
    shown = stage_times.select(
        "page_id",
        *[seconds_text(F.col(c)).alias(c.removesuffix("_ms")) for c in times],
    )
    if usage is None:
        return shown
    tokens = usage.select("page_id", F.format_number("total_tokens", 0).alias("tokens"))
    return shown.join(tokens, "page_id", "left")
