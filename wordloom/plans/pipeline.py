"""The document pipeline: text stages over the Document record, with a pluggable provider.

Language, speech and image services are outside the engine; a provider gives each stage as a
column expression. ``LocalProvider`` is deterministic and needs no service.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.functions import text as X

STAGES = ("clean", "summarize", "describe", "speech")
DESCRIPTION_CHARS = 400
READ_CHARS = 8000


class Provider(Protocol):
    """What a service must offer; each method maps columns to a column."""

    def clean(self, text: Column) -> Column: ...

    def summarize(self, text: Column, focus: Column) -> Column: ...

    def describe(self, text: Column) -> Column: ...

    def seconds(self, text: Column) -> Column: ...


class LocalProvider:
    """Rules instead of models: citations out, leading sentences, speaking time by words."""

    def clean(self, text: Column) -> Column:
        out = F.regexp_replace(text, r"\s*\[\d+(?:\s*[,–-]\s*\d+)*\]", "")
        out = F.regexp_replace(out, r"\s*\((?:[\p{Lu}][^()]{0,60}? et al\.,? )\d{4}[a-z]?\)", "")
        out = F.regexp_replace(out, r"\s*\(?[Ss]ee (?:Fig|Figure|Table)\.? \d+\)?", "")
        return S.collapse_blank_lines(out)

    def summarize(self, text: Column, focus: Column) -> Column:
        """The leading quarter of the sentences, those that name the focus first in mind."""
        pieces = X.split_sentences(text)
        keep = F.greatest(F.ceil(F.size(pieces) * 0.25).cast("int"), F.lit(1))
        about = F.filter(pieces, lambda s: F.coalesce(F.contains(F.lower(s), F.lower(focus)), F.lit(False)))
        chosen = F.when(F.size(about) > 0, about).otherwise(pieces)
        return S.strip(F.array_join(F.slice(chosen, 1, keep), ""))

    def describe(self, text: Column) -> Column:
        pieces = F.slice(X.split_sentences(F.substring(text, 1, READ_CHARS)), 1, 3)
        return F.substring(S.normalize_whitespace(F.array_join(pieces, "")), 1, DESCRIPTION_CHARS)

    def seconds(self, text: Column) -> Column:
        return S.speaking_seconds(S.word_count(text))


def documents_of(episodes: DataFrame) -> DataFrame:
    """(id, title, source_type, raw_text, focus, wants_summary) of the episodes with a text."""
    columns = ("id", "title", "source_type", "raw_text", "summarize_focus", "summarize")
    rows = episodes.select(*columns).filter("raw_text is not null")
    return rows.select("id", "title", "source_type", "raw_text", F.col("summarize_focus").alias("focus"), (F.coalesce("summarize", F.lit(0)) != 0).alias("wants_summary"))


def staged(documents: DataFrame, provider: Provider, stop_after: str = "speech") -> DataFrame:
    """The documents after the stages up to ``stop_after``, row by row: repeated rows stay repeated,
    so that no text is shuffled to fold them."""
    if stop_after not in STAGES:
        raise ValueError(f"{stop_after!r} is no stage")
    upto = STAGES[: STAGES.index(stop_after) + 1]
    out = documents.withColumn("cleaned_text", provider.clean(F.col("raw_text")))
    spoken = F.col("cleaned_text")
    if "summarize" in upto:
        out = out.withColumn("transcript", F.when(F.col("wants_summary"), provider.summarize(F.col("cleaned_text"), F.col("focus"))))
        spoken = F.coalesce("transcript", "cleaned_text")
    out = out.withColumn("word_count", S.word_count(spoken))
    if "describe" in upto:
        out = out.withColumn("description", provider.describe(spoken))
    if "speech" in upto:
        out = out.withColumn("duration_secs", F.floor(provider.seconds(spoken)).cast("int"))
    return out.drop("raw_text", "focus", "wants_summary")


def run(documents: DataFrame, provider: Provider, stop_after: str = "speech") -> DataFrame:
    """``staged``, with one row an id; this shuffles the texts."""
    return staged(documents, provider, stop_after).dropDuplicates(["id"])
