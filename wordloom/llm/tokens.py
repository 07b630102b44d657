"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import map_batches

#: Where the public vocabulary lies on every machine; a parameter of each operator.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The byte-level tokenizer of a rank file, once a process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | None, path: str = RANKS) -> int:
    return len(encoding(path).encode_ordinary(text)) if text and not text.isspace() else 0


def with_tokens(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have a token; blank texts have none."""

    def count(batch: dict[str, list]) -> dict[str, list]:
        return {"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": [n_tokens(t, path) for t in batch["text"]]}

    rows = documents.select("doc_id", "source", "text").filter(F.col("text").isNotNull())
    return map_batches(rows, count, "doc_id bigint, source string, n_tokens bigint").filter("n_tokens > 0")
