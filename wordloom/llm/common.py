"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_FIELDS = ("cleaned_text", "transcript")
#: Rows handed to Python at once; texts and what is made of them stay small in memory.
CHUNK = 500


def long_texts(episodes: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(episode_id, *keep, field, text): one row for each non-null text value.

    Rows delivered twice stay twice; every operator reduces its small results instead of
    shuffling whole texts.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return (
        episodes.select(F.col("id").alias("episode_id"), *keep, F.explode(each).alias("v"))
        .select("episode_id", *keep, "v.field", "v.text")
        .filter(F.col("text").isNotNull())
    )


def map_batches(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` with plain lists: columns in, columns out, at most CHUNK rows a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                out = function(batch.slice(at, CHUNK).to_pydict())
                yield pa.RecordBatch.from_pydict(out, schema=target)

    target = arrow_schema(df, schema)
    return df.mapInArrow(run, schema)


_ARROW = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    """The Arrow form of "name type, ..."."""
    return pa.schema([(n, _ARROW[t]) for n, t in (part.split() for part in schema.split(", "))])
