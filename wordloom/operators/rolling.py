"""Versioned rolling totals: sums and daily averages over trailing periods.

State of one version lies in the shared folder and can be loaded again:

* ``ledger``  - what each id counts for (entity, day, amounts), in segments by version and by
  bucket of ids; a version only adds its own segment, and reads the buckets its arrivals hit;
* ``rolling`` - one row for each entity and calendar day from its first to its last day,
  with the day's own amounts and the totals of every trailing window.

``advance`` takes one run of arrivals to the next version. Arrivals become signed differences
by (entity, day): a new id adds its amounts; an id that returns with other values takes back
the old ones and adds the new, a correction; one that returns unchanged adds nothing. Then

* a difference on a day up to the last known one is added to the windows of its own day and of
  the ``window - 1`` days behind it; all other rows keep the totals of the version before;
* for each day after the last known one, the totals are those of the day before, plus the
  day's arrivals, minus the amounts of the day that leaves the window.

Cases: a row without a time is not counted; one without id cannot be told from another, counts
by itself and can't be corrected; missing amounts are 0; a missing entity is an entity of its
own; of several rows of an id in one run the least (by time, entity, amounts) counts, over runs
the last one; an entity's days reach from its first to its last day with a row, also after
corrections; no rows give no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.session import dropped, shared_folder, written

WINDOWS = (7, 30)
AMOUNTS = ("input_tokens", "output_tokens")
#: Ids of one bucket of the ledger, where ids are numbers in the order of arrival; others are dealt by hash.
BUCKET = 1_000_000
BUCKETS = 64


@dataclass
class RollingState:
    """One version. ``rolling`` has entity, day, n_rows, the amounts, and <amount>_<window>."""

    version: int
    folder: str | None
    rolling: DataFrame | None


def load(spark: SparkSession, folder: str, version: int) -> RollingState:
    """The state that ``advance`` wrote as ``version``."""
    return RollingState(version, folder, spark.read.parquet(f"{folder}/rolling/version={version}"))


def bucket_of(rows: DataFrame, key: str) -> Column:
    number = dict(rows.dtypes)[key] in ("bigint", "int", "smallint")
    return F.floor(F.col(key) / BUCKET) if number else F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def one_row_per_id(rows: DataFrame, key: str, entity: str, at: str, amounts: tuple[str, ...]) -> DataFrame:
    """(id, entity, day, amounts...) with each id once."""
    first = F.min(F.struct(F.col(at).alias("at"), F.col(entity).alias("entity"), *[F.coalesce(F.col(a), F.lit(0)).alias(a) for a in amounts]))
    return (
        rows.filter(F.col(at).isNotNull())
        .groupBy(F.col(key).alias("id"), F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("alone"))
        .agg(first.alias("r"))
        .select("id", F.col("r.entity").alias("entity"), F.to_date("r.at").alias("day"), *[F.col(f"r.{a}").alias(a) for a in amounts])
    )


def spine(bounds: DataFrame, columns: list[str]) -> DataFrame:
    """(entity, day, zeros) for the days from lo to hi of each entity, both counted."""
    days = bounds.filter("lo <= hi").select("entity", F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.select("entity", "day", *[F.lit(0).cast("long").alias(c) for c in columns])


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


def differences(fresh: DataFrame, ledger: DataFrame | None, amounts: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(signed differences by (entity, day); the rows that change the ledger)."""
    values = ["entity", "day", *amounts]
    if ledger is None:
        signed, changed = fresh.select(*values, F.lit(1).alias("n_rows")), fresh.filter(F.col("id").isNotNull())
    else:
        hit = ledger.join(fresh.select(F.col("id").alias("_id"), F.col("bucket").alias("_b")).filter("_id is not null"), (F.col("id") == F.col("_id")) & (F.col("bucket") == F.col("_b")), "left_semi")
        last = hit.groupBy("id").agg(F.max_by(F.struct(*values), "version").alias("old"))
        both = fresh.join(last, "id", "left").withColumn("new", F.struct(*values))
        both = both.filter(F.col("old").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
        each = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("new").alias("v")), F.when(F.col("old").isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("v")))))
        parts = both.select(each.alias("x")).filter("x is not null")
        signed = parts.select("x.v.entity", "x.v.day", *[(F.col("x.sign") * F.col(f"x.v.{a}")).alias(a) for a in amounts], F.col("x.sign").alias("n_rows"))
        changed = both.filter(F.col("id").isNotNull()).select("id", *values, "bucket")
    signed = signed.select("entity", "day", *[F.col(c).cast("long").alias(c) for c in ("n_rows", *amounts)])
    return summed(signed, "entity", "day"), changed


def totals_of(amounts: tuple[str, ...], windows: tuple[int, ...]) -> list[tuple[str, str, int]]:
    return [(f"{a}_{w}", a, w) for w in windows for a in amounts]


def corrected(old: DataFrame, delta: DataFrame, bounds: DataFrame, amounts: tuple[str, ...], windows: tuple[int, ...]) -> DataFrame:
    """The known days with the differences on them added; also the days from a new first day on."""
    columns = ["n_rows", *amounts]
    reach = F.explode(F.sequence(F.lit(0), F.lit(max(windows) - 1))).alias("k")
    near = delta.select("*", reach).select(
        "entity",
        F.date_add("day", F.col("k")).alias("day"),
        *[F.when(F.col("k") == 0, F.col(c)).otherwise(0).alias(c) for c in columns],
        *[F.when(F.col("k") < w, F.col(a)).otherwise(0).alias(t) for t, a, w in totals_of(amounts, windows)],
    )
    earlier = spine(bounds.select("entity", F.col("first").alias("lo"), F.date_sub("old_first", 1).alias("hi")), old.columns[2:])
    every = summed(old.unionByName(near).unionByName(earlier), "entity", "day")
    known = bounds.select(F.col("entity").alias("_e"), F.least("first", "old_first").alias("_lo"), F.col("old_last").alias("_hi")).filter("_hi is not null")
    return every.join(known, F.col("entity").eqNullSafe(F.col("_e")) & F.col("day").between(F.col("_lo"), F.col("_hi"))).select(*old.columns)


def carried(known: DataFrame | None, delta: DataFrame, bounds: DataFrame, amounts: tuple[str, ...], windows: tuple[int, ...]) -> DataFrame:
    """The days after the last known one: the day before, plus arrivals, minus the day that leaves."""
    columns = ["n_rows", *amounts]
    new = bounds.select("entity", F.coalesce(F.date_add("old_last", 1), "first").alias("lo"), F.col("last").alias("hi"))
    ends = new.filter("lo <= hi").select(F.col("entity").alias("_e"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))

    def within(rows: DataFrame) -> DataFrame:
        return rows.join(ends, F.col("entity").eqNullSafe(F.col("_e")) & F.col("day").between(F.col("_lo"), F.col("_hi")), "left_semi")

    days = summed(spine(new, columns).unionByName(within(delta)), "entity", "day")
    changes = days.select("entity", "day", *columns, *[F.col(a).alias(t) for t, a, _ in totals_of(amounts, windows)])
    spent = days.select("entity", "day", *amounts)
    if known is not None:
        spent = spent.unionByName(known.select("entity", "day", *amounts))
    for w in windows:
        leaves = spent.select(
            "entity",
            F.date_add("day", w).alias("day"),
            *[F.lit(0).cast("long").alias(c) for c in columns],
            *[(-F.col(a) if v == w else F.lit(0).cast("long")).alias(t) for t, a, v in totals_of(amounts, windows)],
        )
        changes = changes.unionByName(within(leaves))
    if known is not None:
        start = known.join(ends, F.col("entity").eqNullSafe(F.col("_e")) & (F.col("day") == F.date_sub("_lo", 1)), "left_semi")
        changes = changes.unionByName(start.withColumns({c: F.lit(0).cast("long") for c in columns}))
    steps = summed(changes, "entity", "day")
    upto = W.partitionBy("entity").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    chain = steps.select("entity", "day", *columns, *[F.sum(t).over(upto).alias(t) for t, _, _ in totals_of(amounts, windows)])
    return within(chain)


def advance(
    state: RollingState,
    arrivals: DataFrame,
    key: str = "id",
    entity: str = "provider",
    at: str = "created_at",
    amounts: tuple[str, ...] = AMOUNTS,
    windows: tuple[int, ...] = WINDOWS,
) -> RollingState:
    """The next version, after ``arrivals``, written to the state's folder."""
    spark = arrivals.sparkSession
    folder = state.folder or f"{shared_folder(spark)}/rolling-{uuid.uuid4().hex}"
    version = state.version + 1
    fresh = one_row_per_id(arrivals, key, entity, at, amounts)
    fresh = fresh.withColumn("bucket", bucket_of(fresh, "id"))
    ledger = spark.read.parquet(f"{folder}/ledger") if state.version else None
    delta, changed = differences(fresh, ledger, amounts)
    changed.withColumn("version", F.lit(version)).repartition("bucket").write.partitionBy("version", "bucket").mode("append").parquet(f"{folder}/ledger")
    delta.write.parquet(f"{folder}/delta/version={version}")
    delta = spark.read.schema(delta.schema).parquet(f"{folder}/delta/version={version}")
    hits = delta.groupBy(F.col("entity").alias("_n")).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    steps: list[DataFrame] = []
    if state.rolling is None:
        bounds = hits.select(F.col("_n").alias("entity"), F.lit(None).cast("date").alias("old_last"), "first", "last")
        rolling = carried(None, delta, bounds, amounts, windows)
    else:
        old = state.rolling
        reach = old.groupBy("entity").agg(F.min("day").alias("old_first"), F.max("day").alias("old_last"))
        bounds = reach.join(hits, F.col("entity").eqNullSafe(F.col("_n")), "full").select(
            F.when(F.col("old_last").isNotNull(), F.col("entity")).otherwise(F.col("_n")).alias("entity"), "old_first", "old_last", "first", "last"
        )
        bounds = written(bounds, "rolling-bounds")
        known = written(corrected(old, delta, bounds, amounts, windows), "rolling-known")
        every = written(known.unionByName(carried(known, delta, bounds, amounts, windows)), "rolling-every")
        steps = [bounds, known, every]
        ends = every.filter("n_rows > 0").groupBy(F.col("entity").alias("_e")).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
        rolling = every.join(ends, F.col("entity").eqNullSafe(F.col("_e")) & F.col("day").between(F.col("_lo"), F.col("_hi")), "left_semi")
    rolling.write.parquet(f"{folder}/rolling/version={version}")
    for step in steps:
        dropped(step)
    return load(spark, folder, version)


def rolling_state(rows: DataFrame, batches: int = 1, key: str = "id", **args) -> RollingState:
    """The state after all rows, taken in ``batches`` runs of ``key`` (the order of arrival)."""
    state = RollingState(0, None, None)
    lo, hi = rows.agg(F.min(key), F.max(key)).first() if batches > 1 else (None, None)
    if lo is None or hi == lo:
        return advance(state, rows, key=key, **args)
    step = (hi - lo + 1) / batches
    cuts = [lo + round(step * i) for i in range(1, batches)]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = F.lit(True) if low is None else F.col(key) >= low
        if high is not None:
            part = part & (F.col(key) < high)
        if low is None:
            part = part | F.col(key).isNull()
        state = advance(state, rows.filter(part), key=key, **args)
    return state


def report(state: RollingState, amounts: tuple[str, ...] = AMOUNTS, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """One row for each entity, day and window with sums and averages a day."""
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(w).alias("window_days"),
                    *[F.col(f"{a}_{w}").alias(f"sum_{a}") for a in amounts],
                    *[(F.col(f"{a}_{w}") / F.lit(float(w))).alias(f"avg_{a}") for a in amounts],
                )
                for w in windows
            ]
        )
    )
    return state.rolling.select("entity", "day", each.alias("w")).select(
        "entity", "day", "w.window_days", *[f"w.sum_{a}" for a in amounts], *[f"w.avg_{a}" for a in amounts]
    )
