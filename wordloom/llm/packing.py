"""Problem 8: texts of varying length packed into training rows of fixed capacity.

Vector best-fit: a row has three capacities - tokens, number of documents, attention cost (the
sum of squared lengths, as a row's documents attend within themselves; ``COST`` of the capacity
squared, so that it binds where a row would hold few long texts). A row opened with a long piece
may always spend the same part of the square of the room beside it, so that a text as long as
the row has its row, and a long one can be filled up with short ones. Items come by
descending length; each goes to the open row that keeps every constraint and whose residual
vector, weighted, is the shortest after the item is in; with none, a row is opened.

A text longer than the capacity is cut into pieces of exactly the capacity and a rest; any
other text stays whole. The items are dealt by hash into shards of about ``SHARD_ITEMS``, each
packed by one task: a shard holds thousands of rows, of which a handful at most stay open.

Cases: null, empty and blank texts have no token and no place; equal texts under several ids
are several items; no documents give no rows; a document id twice is two items; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.tokens import RANKS, with_tokens
from wordloom.sources.tables import table

#: Items a task packs.
SHARD_ITEMS = 20_000
#: Documents a row may hold for each 16 tokens of capacity, and the part of capacity squared
#: its attention may cost.
TOKENS_A_DOCUMENT = 16
COST = 0.75
#: Weights of tokens, documents and attention cost in the residual norm.
WEIGHTS = (1.0, 0.05, 0.1)


def capacities(size: int) -> np.ndarray:
    """Tokens, documents, and the attention that no row exceeds (see ``attention_left`` for what a
    row may spend)."""
    return np.array([size, max(1, size // TOKENS_A_DOCUMENT), size * size], dtype=float)


def attention_left(size: float, opened: float) -> float:
    """The attention that a row may still spend beside the piece it was opened with."""
    return max(COST * size * size - opened * opened, COST * (size - opened) ** 2)


def best_fit(sizes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """(row of each item, number of rows)."""
    limit, weights = capacities(size), np.array(WEIGHTS)
    row = np.empty(len(sizes), dtype=np.int64)
    room = np.empty((64, 3))  # residual capacities of the open rows
    name = np.empty(64, dtype=np.int64)
    n_open = n_rows = 0
    least = int(sizes.min()) if len(sizes) else 0
    for i in np.argsort(-sizes, kind="stable"):
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        left = room[:n_open] - need
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            norm = ((left[fits] / limit) ** 2 * weights).sum(axis=1)
            k = int(fits[np.argmin(norm)])
            room[k] = left[k]
        else:
            if n_open == len(room):
                room, name = np.concatenate([room, np.empty_like(room)]), np.concatenate([name, np.empty_like(name)])
            k = n_open
            room[k], name[k] = limit - need, n_rows
            room[k, 2] = attention_left(size, float(sizes[i]))
            n_open, n_rows = n_open + 1, n_rows + 1
        row[i] = name[k]
        if room[k, 0] < least or room[k, 1] < 1 or room[k, 2] < least * least:  # full for every item left
            n_open -= 1
            room[k], name[k] = room[n_open], name[n_open]
    return row, n_rows


def pieces(documents: DataFrame, limits: DataFrame, path: str = RANKS) -> DataFrame:
    """(purpose, capacity, doc_id, piece_no, token_start, n_tokens) of every text and capacity."""
    rows = limits.filter((F.col("unit") == "tokens") & F.col("purpose").startswith("training_row") & (F.col("max_size") > 0))
    sizes = [F.struct(F.lit(r["purpose"]).alias("purpose"), F.lit(int(r["max_size"])).cast("int").alias("capacity")) for r in rows.select("purpose", "max_size").distinct().collect()]  # a few capacities
    each = with_tokens(documents, path).select("doc_id", "n_tokens", F.explode(F.array(*sizes) if sizes else F.expr("cast(array() as array<struct<purpose:string,capacity:int>>)")).alias("c"))
    each = each.select("doc_id", "n_tokens", "c.purpose", "c.capacity")
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.col("capacity").cast("bigint")))
    return each.select("purpose", "capacity", "doc_id", "n_tokens", cut.alias("token_start")).select(
        "purpose",
        "capacity",
        "doc_id",
        F.expr("cast(token_start div capacity as int)").alias("piece_no"),
        "token_start",
        F.least(F.col("n_tokens") - F.col("token_start"), F.col("capacity").cast("bigint")).alias("n_tokens"),
    )


_PLACED = "purpose string, capacity int, row_id string, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint"


def packed(documents: DataFrame, limits: DataFrame, path: str = RANKS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The row of every piece."""
    n_shards = max(1, math.ceil(documents.count() / shard_items))
    items = pieces(documents, limits, path).withColumn("shard", F.pmod(F.xxhash64("purpose", "doc_id", "piece_no"), F.lit(n_shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        frame = pa.Table.from_batches(held).to_pandas()
        for (purpose, capacity, shard), own in frame.groupby(["purpose", "capacity", "shard"], sort=True):
            own = own.sort_values(["n_tokens", "doc_id", "piece_no"])
            row, _ = best_fit(own["n_tokens"].to_numpy(), int(capacity))
            out = own[["purpose", "capacity", "doc_id", "piece_no", "token_start", "n_tokens"]].assign(row_id=[f"{purpose}-{shard}-{r}" for r in row])
            yield pa.RecordBatch.from_pandas(out[[f.split()[0] for f in _PLACED.split(", ")]], schema=_SCHEMA, preserve_index=False)

    return items.repartition(2 * n_shards, "purpose", "shard").mapInArrow(run, _PLACED)


_SCHEMA = pa.schema(
    [("purpose", pa.string()), ("capacity", pa.int32()), ("row_id", pa.string()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("token_start", pa.int64()), ("n_tokens", pa.int64())]
)


def p8_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every training row: its documents (and pieces), its tokens and its filling."""
    placed = packed(table(spark, folder, "documents"), table(spark, folder, "text_limits"))
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "piece_no", "token_start", "n_tokens")))
    return (
        placed.groupBy("purpose", "capacity", "row_id")
        .agg(parts.alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
        .withColumn("filling", F.round(F.col("n_tokens") / F.col("capacity"), 6))
    )


def p8_filling(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity: rows, tokens, the mean filling, the rows that volume alone needs, and how
    often each constraint decides: rows that can take no piece more, not even the shortest there
    is, for want of tokens, of documents, of attention (a row may count for several)."""
    rows = p8_rows(spark, folder)
    sizes = F.transform("documents", lambda d: d.n_tokens.cast("double"))
    spent = F.aggregate(sizes, F.lit(0.0), lambda acc, n: acc + n * n)
    size, largest = F.col("capacity").cast("double"), F.array_max(sizes)
    beside = F.greatest(F.lit(COST) * size * size - largest * largest, F.lit(COST) * (size - largest) * (size - largest))
    rows = rows.select("purpose", "capacity", "n_tokens", "n_pieces", "filling", (beside + largest * largest - spent).alias("attention"), F.array_min(sizes).alias("shortest"))
    least = rows.groupBy(F.col("purpose").alias("_p"), F.col("capacity").alias("_c")).agg(F.min("shortest").alias("least"))
    rows = rows.join(least, (F.col("purpose") == F.col("_p")) & (F.col("capacity") == F.col("_c")))
    return rows.groupBy("purpose", "capacity").agg(
        F.count("*").alias("n_rows"),
        F.sum("n_tokens").alias("n_tokens"),
        F.round(F.avg("filling"), 6).alias("mean_filling"),
        F.ceil(F.sum("n_tokens") / F.max("capacity")).alias("least_rows"),
        F.count_if(F.col("capacity") - F.col("n_tokens") < F.col("least")).alias("full_by_tokens"),
        F.count_if(F.col("n_pieces") >= F.greatest(F.lit(1), F.floor(F.col("capacity") / TOKENS_A_DOCUMENT))).alias("full_by_documents"),
        F.count_if(F.col("attention") < F.col("least") * F.col("least")).alias("full_by_attention"),
    )


QUERIES = {"p8_rows": p8_rows, "p8_filling": p8_filling}
ORACLES: dict[str, str] = {}
