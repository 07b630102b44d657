"""Changes to tables as pure functions: old table in, new table out.

Parquet tables take no updates; a change is a join with the keys it touches. Keys may repeat
(rows delivered twice): all rows of a key change alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added by name; columns the rows lack are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def patch(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each listed column takes the change's value unless that is null; changes have unique keys."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, table[key] == new["_key"], "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else table[c] for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Without the rows whose ``key`` is in the first column of ``keys``."""
    return table.join(keys.select(F.col(keys.columns[0]).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that meet the condition take the values."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def replace_host(table: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """A host rewritten where the URL holds it (found whatever its case, replaced as spelt)."""
    return update_where(table, F.col(column).ilike(f"%{old}%"), {column: F.replace(F.col(column), F.lit(old), F.lit(new))})


def delete_feeds(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Feeds with all that hangs on them: episodes, their jobs and usage; usage of the feed alone
    keeps its row without the feed. ``gone`` has the ids."""
    feeds = delete(tables["feeds"], gone, "id")
    out = tables["episodes"].join(gone.select(F.col("id").alias("feed_id")), "feed_id", "left_semi").select("id").distinct()
    episodes = tables["episodes"].join(gone.select(F.col("id").alias("feed_id")), "feed_id", "left_anti")
    lost = out.select(F.col("id").alias("episode_id"))
    usage = tables["ai_usage"].join(lost, "episode_id", "left_anti")
    mark = gone.select(F.col("id").alias("_feed")).distinct()
    usage = usage.join(mark, usage.feed_id == mark["_feed"], "left").withColumn("feed_id", F.when(F.col("_feed").isNull(), F.col("feed_id"))).drop("_feed")
    return {"feeds": feeds, "episodes": episodes, "jobs": tables["jobs"].join(lost, "episode_id", "left_anti"), "ai_usage": usage}


def backfill(source: DataFrame, condition: Column, columns: dict[str, Column]) -> DataFrame:
    """Insert-select: new rows for the source rows that meet the condition."""
    return source.filter(condition).select(*[v.alias(k) for k, v in columns.items()])


def copy_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """A table rebuilt with a list of columns; those it lacks are null."""
    return table.select(*[F.col(c) if c in table.columns else F.lit(None).alias(c) for c in columns])


def affected(table: DataFrame, keys: DataFrame, key: str) -> int:
    """How many rows a change by ``keys`` touches; 0 means that nothing was found."""
    return table.join(keys.select(F.col(keys.columns[0]).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_semi").count()


def claim(jobs: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """The jobs after the first ``k`` in rank are set running; ``claimed`` marks them."""
    taken = ranks.filter(F.col("claim_rank") <= k).select(F.col("job_id").alias("_job"))
    out = jobs.join(taken, F.col("id") == F.col("_job"), "left").withColumn("claimed", F.col("_job").isNotNull()).drop("_job")
    return update_where(out, F.col("claimed"), {"status": F.lit("running")})
