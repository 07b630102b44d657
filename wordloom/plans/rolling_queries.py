"""Queries of the rolling totals (problem 2) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import rolling
from wordloom.sources.tables import table


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """All windows, from the state after two runs of arrivals."""
    state = rolling.rolling_state(table(spark, folder, "ai_usage"), batches=2)
    return rolling.report(state).select(
        F.col("entity").alias("provider"),
        F.date_format("day", "yyyy-MM-dd").alias("usage_day"),
        "window_days",
        *[f"sum_{a}" for a in rolling.AMOUNTS],
        *[F.round(f"avg_{a}", 6).alias(f"avg_{a}") for a in rolling.AMOUNTS],
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Windows without tokens, from the state after two runs of arrivals."""
    state = rolling.rolling_state(table(spark, folder, "ai_usage"), batches=2)
    return (
        rolling.report(state)
        .filter(sum(F.col(f"sum_{a}") for a in rolling.AMOUNTS) == 0)
        .select(F.col("entity").alias("provider"), F.date_format("day", "yyyy-MM-dd").alias("usage_day"), "window_days")
    )


_SQL = """
WITH one AS (
  SELECT id, min(provider) AS provider, min(CAST(created_at AS DATE)) AS day,
         min(coalesce(input_tokens, 0)) AS i, min(coalesce(output_tokens, 0)) AS o
  FROM ai_usage WHERE created_at IS NOT NULL GROUP BY id
), daily AS (
  SELECT provider, day, sum(i) AS i, sum(o) AS o FROM one GROUP BY provider, day
), spine AS (
  SELECT provider, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT provider, CAST(min(day) AS TIMESTAMP) AS lo, CAST(max(day) AS TIMESTAMP) AS hi FROM daily GROUP BY provider)
), w AS (SELECT 7 AS window_days UNION ALL SELECT 30), r AS (
  SELECT s.provider, s.day, w.window_days, CAST(coalesce(sum(d.i), 0) AS BIGINT) AS si, CAST(coalesce(sum(d.o), 0) AS BIGINT) AS so
  FROM spine s CROSS JOIN w LEFT JOIN daily d
    ON d.provider = s.provider AND d.day <= s.day AND d.day > s.day - w.window_days
  GROUP BY s.provider, s.day, w.window_days
)
"""

QUERIES = {"p2_rolling": p2_rolling, "p2_found": p2_found}
ORACLES = {
    "p2_rolling": _SQL
    + """SELECT provider, strftime(day, '%Y-%m-%d') AS usage_day, window_days, si AS sum_input_tokens, so AS sum_output_tokens,
    round(si / CAST(window_days AS DOUBLE), 6) AS avg_input_tokens, round(so / CAST(window_days AS DOUBLE), 6) AS avg_output_tokens FROM r""",
    "p2_found": _SQL
    + "SELECT provider, strftime(day, '%Y-%m-%d') AS usage_day, window_days FROM r WHERE si + so = 0",
}
