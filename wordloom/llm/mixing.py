"""Problem 9: a collection in which each source has its target share.

Expected copies: of a total T, source s should give ``share_s T`` tokens; each of its
documents is expected ``share_s T / tokens_s`` times, at most ``max_repeats``. What a short
source cannot give is handed to the others in proportion to their shares, until no more
sources run short. Unless given, T is the largest total at which sources that hold ``REACH``
of the shares of all sources with text still get their whole share.

Systematic sampling: within a source, documents stand in order of size (then of a hash), their
expected copies are summed up from the first, one random offset is added, and a document comes
out once for each integer boundary its interval crosses - never more than ``max_repeats``
times, and spread evenly over all sizes. The prefix sum is taken in two steps: over buckets of
sizes and hashes, then within a bucket. A size class of a source has as many buckets as its
documents need, so no task orders more than about ``BUCKET`` of them, whatever a source holds.

Cases: documents of other or null sources and those without tokens are left out; a source
without text reaches 0; no target, or no text at all, gives no rows; equal texts under several
ids are several documents; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.tokens import RANKS, with_tokens
from wordloom.session import written
from wordloom.sources.tables import table

#: Documents of one source and size class that a task orders; more are dealt into buckets by hash.
BUCKET = 20_000
#: Rows of the table of buckets up to which it is broadcast; a larger one is joined by a shuffle.
FEW_BUCKETS = 200_000
#: See largest_total.
REACH = 0.9
SEED = 9


def expected_copies(sources: list[tuple[str, float, int, int]], total: float) -> dict[str, float]:
    """Copies expected of each document, by source. sources: (name, share, max_repeats, tokens)."""
    copies = {name: 0.0 for name, *_ in sources}
    open_ = {name: (share, repeats, tokens) for name, share, repeats, tokens in sources if tokens and share > 0}
    left = total
    while open_ and left > 0:
        shares = sum(share for share, _, _ in open_.values())
        short = [n for n, (share, repeats, tokens) in open_.items() if left * share / shares >= repeats * tokens]
        if not short:
            copies.update({n: left * share / shares / tokens for n, (share, _, tokens) in open_.items()})
            break
        for n in short:
            share, repeats, tokens = open_.pop(n)
            copies[n] = float(repeats)
            left -= repeats * tokens
    return copies


def largest_total(sources: list[tuple[str, float, int, int]], reach: float) -> float:
    """The largest total at which sources holding ``reach`` of the non-empty shares get theirs."""
    have = sorted((repeats * tokens / share, share) for _, share, repeats, tokens in sources if tokens and share > 0)
    whole, lost = sum(share for _, share in have), 0.0
    for most, share in have:
        lost += share
        if lost > (1 - reach) * whole + 1e-12:
            return most * whole
    return 0.0


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, path: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(collection: doc_id, source, n_tokens, copies; report by source)."""
    spark = documents.sparkSession
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    names = F.broadcast(wanted.select("source"))  # the target table does not grow
    sized = written(with_tokens(documents.join(names, "source", "left_semi"), path), "p9-sized")
    size_class = F.floor(F.log2(F.col("n_tokens") + F.lit(1.0)) * 8)
    order = F.xxhash64("doc_id", F.lit(seed))
    sized = sized.withColumn("size_class", size_class.cast("int")).withColumn("h", order)
    classes = sized.groupBy("source", "size_class").agg(F.count("*").alias("n"))
    salts = {(r["source"], r["size_class"]): math.ceil(r["n"] / BUCKET) for r in classes.filter(F.col("n") > BUCKET).collect()}  # sources x size classes at most
    salt = F.coalesce(*[F.when((F.col("source") == s) & (F.col("size_class") == c), F.pmod("h", F.lit(k))) for (s, c), k in salts.items()], F.lit(0))
    sized = sized.withColumn("bucket", F.struct("size_class", salt.cast("int").alias("salt")))
    buckets = written(sized.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")), "p9-buckets")
    known = {r["source"]: r["tokens"] for r in buckets.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    goals = [(r["source"], r["target_share"] or 0.0, r["max_repeats"] or 0, known.get(r["source"], 0)) for r in wanted.collect()]
    copies = expected_copies(goals, largest_total(goals, REACH) if total is None else float(total))
    rates = spark.createDataFrame([(s, share, repeats, tokens, copies[s]) for s, share, repeats, tokens in goals], "source string, target_share double, max_repeats int, available_tokens bigint, expected double")
    rates = F.broadcast(rates)
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = written(buckets.select("source", "bucket", before.alias("before")).join(rates, "source"), "p9-starts")
    if starts.count() <= FEW_BUCKETS:
        starts = F.broadcast(starts)
    place = F.row_number().over(W.partitionBy("source", "bucket").orderBy("n_tokens", "h", "doc_id"))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    upto = (F.col("before") + F.col("place")) * F.col("expected") + offset
    drawn = (
        sized.withColumn("place", place)
        .join(starts, ["source", "bucket"])
        .select("doc_id", "source", "n_tokens", "max_repeats", (F.floor(upto) - F.floor(upto - F.col("expected"))).cast("int").alias("copies"))
        .withColumn("copies", F.least("copies", "max_repeats"))
        .filter("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("n_copies"), F.count("*").alias("n_documents"))
    report = rates.join(got, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        "available_tokens",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )
    whole = F.sum("tokens").over(W.partitionBy())  # one row a target
    report = report.withColumn("reached_share", F.round(F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)), 6))
    return drawn, report


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The collection: each document drawn, and how many times it is used."""
    return mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached, by source."""
    return mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLES: dict[str, str] = {}
