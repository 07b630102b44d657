"""Read models over feeds, episodes, jobs and usage: joins, aggregates, windows, top-k.

Rows may be delivered twice; ``once`` keeps one of identical rows after the columns a query
needs are chosen, so that no text is shuffled for it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import scalars as S

SIDE_JOBS = ("image", "describe")
#: Jobs closest to the end of the pipeline first.
CLAIM_ORDER = {"describe": 0, "image": 0, "tts": 1, "summarize": 2, "clean": 3, "scrape": 4, "pdf": 4}


def once(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def at(moment: str | dt.datetime) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def usage_by(usage: DataFrame, *keys: str, since: Column | None = None, ordered: bool = False) -> DataFrame:
    """Calls and tokens by ``keys``, in their order if asked; ``since`` bounds the time from below."""
    rows = once(usage, "id", *keys, "input_tokens", "output_tokens", "created_at")
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )
    return sums.orderBy(*keys) if ordered else sums


def usage_of_episodes(usage: DataFrame) -> DataFrame:
    """The calls of each episode in the order of time, with running token totals."""
    rows = once(usage, "id", "episode_id", "stage", "provider", "model", "input_tokens", "output_tokens", "created_at").filter("episode_id is not null")
    upto = W.partitionBy("episode_id").orderBy("created_at", "id").rowsBetween(W.unboundedPreceding, 0)
    return rows.select(
        "episode_id",
        "id",
        "stage",
        "provider",
        "model",
        F.row_number().over(W.partitionBy("episode_id").orderBy("created_at", "id")).alias("call_no"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).over(upto).alias("tokens_so_far"),
    )


def feed_list(feeds: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every feed with its number of episodes, the newest feed first; counted before the join, feeds
    without any kept."""
    counts = once(episodes, "id", "feed_id").groupBy("feed_id").agg(F.count("*").cast("int").alias("episode_count"))
    rows = feeds.join(counts, feeds.id == counts.feed_id, "left").select(
        feeds.id.alias("feed_id"), "slug", "title", "created_at", F.coalesce("episode_count", F.lit(0)).alias("episode_count")
    )
    return rows.orderBy(F.col("created_at").desc(), "feed_id")


def retry_times(jobs: DataFrame, now: Column) -> DataFrame:
    """(episode_id, retry_at): the earliest queued job of the main pipeline still ahead."""
    rows = once(jobs, "id", "episode_id", "job_type", "status", "run_after")
    ahead = rows.filter((F.col("status") == "queued") & (F.col("run_after") > now) & ~F.col("job_type").isin(*SIDE_JOBS))
    return ahead.groupBy("episode_id").agg(F.min("run_after").alias("retry_at"))


def newest_of_feeds(episodes: DataFrame, jobs: DataFrame, now: Column, k: int = 100) -> DataFrame:
    """The ``k`` newest episodes of each feed, with the time of the next retry."""
    rows = once(episodes, "id", "feed_id", "title", "status", "created_at")
    place = F.row_number().over(W.partitionBy("feed_id").orderBy(F.col("created_at").desc(), "id"))
    top = rows.withColumn("place", place).filter(F.col("place") <= k)
    retry = retry_times(jobs, now).withColumnRenamed("episode_id", "id")
    return top.join(retry, "id", "left").select("feed_id", "place", F.col("id").alias("episode_id"), "title", "status", "created_at", "retry_at")


def status_counts(feeds: DataFrame, episodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counts: one pass over each table, joined as single rows."""
    f = feeds.select("id").distinct().agg(F.count("*").alias("feeds"))
    e = once(episodes, "id", "status").agg(
        F.count("*").alias("episodes"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("failed")
    )
    j = once(jobs, "id", "status").agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))
    return f.join(e).join(j)  # one row each


def active_jobs(jobs: DataFrame, episodes: DataFrame, feeds: DataFrame) -> DataFrame:
    """Queued and running jobs with their episode and feed; running first, then by time."""
    active = once(jobs, "id", "episode_id", "job_type", "status", "attempts", "run_after").filter(F.col("status").isin("queued", "running"))
    e = once(episodes, "id", "title", "feed_id").select(F.col("id").alias("episode_id"), F.col("title").alias("episode_title"), "feed_id")
    f = feeds.select(F.col("id").alias("feed_id"), F.col("slug").alias("feed_slug"))
    return (
        active.join(e, "episode_id")
        .join(f, "feed_id")
        .orderBy(F.when(F.col("status") == "running", 0).otherwise(1), F.col("run_after").asc_nulls_first(), "id")
        .select(F.col("id").alias("job_id"), "job_type", "status", "attempts", "run_after", "episode_id", "episode_title", "feed_slug")
    )


def claim_ranks(jobs: DataFrame, now: Column) -> DataFrame:
    """The order in which queued jobs that are due would be taken."""
    due = once(jobs, "id", "episode_id", "job_type", "status", "run_after", "created_at").filter((F.col("status") == "queued") & (F.col("run_after") <= now))
    rank = F.coalesce(*[F.when(F.col("job_type") == k, v) for k, v in CLAIM_ORDER.items()], F.lit(5))
    due = due.withColumn("priority", rank)
    # a global order without one task: ranks within a priority and a day, on top of counts before
    key = ["priority", F.to_date("run_after")]
    sizes = due.groupBy(F.col("priority").alias("p"), F.to_date("run_after").alias("d")).agg(F.count("*").alias("n"))
    before = sizes.select("p", "d", F.coalesce(F.sum("n").over(W.orderBy("p", "d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.row_number().over(W.partitionBy(*key).orderBy("run_after", "created_at", "id"))
    ranked = due.withColumn("inner", inner)
    joined = ranked.join(before, (ranked.priority == before.p) & (F.to_date(ranked.run_after) == before.d))
    return joined.select(F.col("id").alias("job_id"), "episode_id", "job_type", "priority", (F.col("before") + F.col("inner")).alias("claim_rank"))


def latest_failed_job(jobs: DataFrame, default: str = "scrape") -> DataFrame:
    """(episode_id, job_type) of each episode's newest failed job; ``default`` where none failed."""
    rows = once(jobs, "id", "episode_id", "job_type", "status", "created_at")
    newest = F.max_by("job_type", F.when(F.col("status") == "error", F.struct("created_at", "id")))
    return rows.groupBy("episode_id").agg(F.coalesce(newest, F.lit(default)).alias("job_type"))


def feed_items(episodes: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` newest published episodes of each feed."""
    rows = once(episodes, "id", "feed_id", "title", "summarize", "description", "source_url", "sections_json", "audio_url", "audio_bytes", "duration_secs", "pub_date", "status")
    done = rows.filter((F.col("status") == "done") & F.col("audio_url").isNotNull())
    place = F.row_number().over(W.partitionBy("feed_id").orderBy(F.col("pub_date").desc_nulls_last(), "id"))
    return done.withColumn("place", place).filter(F.col("place") <= k)


def rendered_items(episodes: DataFrame, k: int = 50) -> DataFrame:
    """The feed's items as they are written out."""
    sections = S.parse_sections_json(F.col("sections_json"))
    return feed_items(episodes, k).select(
        "feed_id",
        "place",
        F.col("id").alias("episode_id"),
        S.xml_escape(S.display_title(F.col("title"), F.col("summarize"))).alias("item_title"),
        S.xml_escape(S.item_description(F.col("description"), F.col("source_url"), sections)).alias("item_description"),
        S.rfc2822(F.col("pub_date")).alias("item_date"),
        S.xml_escape(F.col("audio_url")).alias("item_url"),
        "audio_bytes",
        "duration_secs",
    )


def rss_documents(feeds: DataFrame, episodes: DataFrame, k: int = 50) -> DataFrame:
    """(feed_id, n_items, rss): one document a feed; at most ``k`` items meet in a row."""
    item = F.concat(
        F.lit("<item><title>"), F.col("item_title"), F.lit("</title><description>"), F.col("item_description"), F.lit('</description><enclosure url="'),
        F.col("item_url"), F.lit('" length="'), F.coalesce(F.col("audio_bytes").cast("string"), F.lit("0")), F.lit('" type="audio/mpeg"/><guid isPermaLink="false">'),
        F.col("episode_id"), F.lit("</guid><pubDate>"), F.col("item_date"), F.lit("</pubDate><itunes:duration>"),
        F.coalesce(F.col("duration_secs").cast("string"), F.lit("0")), F.lit("</itunes:duration></item>"),
    )
    items = rendered_items(episodes, k).groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct("place", item.alias("xml")))).alias("items"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>'),
        S.xml_escape(F.col("title")), F.lit("</title><description>"), S.xml_escape(F.coalesce("description", F.lit(""))), F.lit("</description>"),
    )
    body = F.coalesce(F.array_join(F.col("items.xml"), ""), F.lit(""))
    joined = feeds.join(items, feeds.id == items.feed_id, "left")
    return joined.select(feeds.id.alias("feed_id"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.concat(head, body, F.lit("</channel></rss>")).alias("rss"))


def progress(episodes: DataFrame) -> DataFrame:
    """By status: episodes, chunks spoken and planned, those with text."""
    rows = once(
        episodes.withColumn("has_text", F.col("cleaned_text").isNotNull() | F.col("transcript").isNotNull()), "id", "status", "tts_chunks_done", "tts_chunks_total", "has_text"
    )
    return rows.groupBy("status").agg(
        F.count("*").alias("episodes"), F.sum("tts_chunks_done").alias("chunks_done"), F.sum("tts_chunks_total").alias("chunks_total"), F.count_if("has_text").alias("with_text")
    )


def orphans(feeds: DataFrame, episodes: DataFrame, jobs: DataFrame, usage: DataFrame) -> DataFrame:
    """(child, parent, n): distinct child rows whose parent is missing."""

    def missing(child: DataFrame, key: str, parent: DataFrame, names: tuple[str, str]) -> DataFrame:
        held = once(child, "id", key).filter(F.col(key).isNotNull())
        gone = held.join(parent.select(F.col("id").alias(key)).distinct(), key, "left_anti")
        return gone.agg(F.count("*").alias("n")).select(F.lit(names[0]).alias("child"), F.lit(names[1]).alias("parent"), "n")

    return (
        missing(episodes, "feed_id", feeds, ("episodes", "feeds"))
        .unionByName(missing(jobs, "episode_id", episodes, ("jobs", "episodes")))
        .unionByName(missing(usage, "episode_id", episodes, ("ai_usage", "episodes")))
        .unionByName(missing(usage, "feed_id", feeds, ("ai_usage", "feeds")))
    )
