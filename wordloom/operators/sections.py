"""Ordered parts of texts: timelines, chapters, roles, context, caches (window operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.functions import text as X

SECTION_PAUSE = 1.5


def _sections(column: str) -> Column:
    """array<struct<title, body>>: a text without headers is one section without title."""
    found = X.parse_sections(F.col(column))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col(column).alias("body"))))


def exploded_sections(texts: DataFrame, column: str = "text") -> DataFrame:
    """(id, section_no, title, body)."""
    return texts.filter(F.col(column).isNotNull()).select("id", F.posexplode(_sections(column)).alias("section_no", "s")).select("id", "section_no", "s.title", "s.body")


def spoken_chunks(texts: DataFrame, column: str = "text") -> DataFrame:
    """(id, section_no, title, piece_no, chunk, last_section, seconds): the chunks of each text, a
    row's own, without an exchange.

    Blank sections are not spoken; where all are, their bodies together are the one chunk.
    """
    parts = texts.filter(F.col(column).isNotNull()).select("id", _sections(column).alias("parts"))
    numbered = F.transform("parts", lambda s, i: F.struct(i.alias("section_no"), s.title.alias("title"), s.body.alias("body")))
    spoken = F.filter(numbered, lambda s: S.strip(s.body) != "")
    bodies = F.array_join(F.transform("parts", lambda s: s.body), "\n\n")
    blank = F.array(F.struct(F.lit(0).alias("section_no"), F.get("parts", F.lit(0)).title.alias("title"), bodies.alias("body")))
    each = parts.select("id", (F.size("parts") - 1).alias("last_section"), F.explode(F.when(F.size(spoken) > 0, spoken).otherwise(blank)).alias("s"))
    chunks = each.select("id", "last_section", "s.section_no", "s.title", F.posexplode(X.speech_chunks(F.col("s.body"))).alias("piece_no", "chunk"))
    return chunks.select("id", "section_no", "title", "piece_no", "chunk", "last_section", S.speaking_seconds(S.word_count(F.col("chunk"))).alias("seconds"))


def in_order(chunks: DataFrame) -> DataFrame:
    """``spoken_chunks``, each row once, with chunk_no and pause in place of piece_no and last_section.

    ``pause`` marks the last chunk of each section but the last; seconds follow the words. The
    chunk's text may be left out before.
    """
    in_section = W.partitionBy("id", "section_no")
    last = (F.col("piece_no") == F.max("piece_no").over(in_section)) & (F.col("section_no") < F.col("last_section"))
    number = F.row_number().over(W.partitionBy("id").orderBy("section_no", "piece_no")) - 1
    kept = [c for c in chunks.columns if c not in ("piece_no", "last_section")]
    return chunks.select(*kept, number.alias("chunk_no"), last.alias("pause"))


def speech_plan(texts: DataFrame, column: str = "text") -> DataFrame:
    """(id, section_no, title, chunk, seconds, chunk_no, pause): what is spoken, in order."""
    return in_order(spoken_chunks(texts, column))


def timeline(plan: DataFrame) -> DataFrame:
    """(id, section_no, title, start_secs): where each section starts."""
    before = W.partitionBy("id").orderBy("chunk_no").rowsBetween(W.unboundedPreceding, -1)
    length = F.col("seconds") + F.when(F.col("pause"), SECTION_PAUSE).otherwise(0.0)
    placed = plan.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0.0)))
    firsts = placed.groupBy("id", "section_no").agg(F.first("title").alias("title"), F.min("start").alias("start_secs"))
    return firsts.select("id", "section_no", F.coalesce("title", F.lit("Introduction")).alias("title"), F.round("start_secs", 6).alias("start_secs"))


def chapters(episodes: DataFrame) -> DataFrame:
    """(id, chapter_no, title, start_ms, end_ms): each chapter ends where the next one starts."""
    each = episodes.select("id", "duration_secs", F.posexplode(S.parse_sections_json(F.col("sections_json"))).alias("chapter_no", "s"))
    ms = each.select("id", "chapter_no", "s.title", S.to_milliseconds(F.col("s.start_secs")).alias("start_ms"), (F.col("duration_secs").cast("long") * 1000).alias("total"))
    after = F.lead("start_ms").over(W.partitionBy("id").orderBy("chapter_no"))
    return ms.select("id", "chapter_no", "title", "start_ms", F.greatest(F.coalesce(after, "total", F.lit(0)), "start_ms").alias("end_ms"))


def cleaned_pieces(texts: DataFrame, column: str = "text") -> DataFrame:
    """(id, section_no, title, k, piece, ending): the pieces of each text, a row's own, with the
    end of each that the next one gets as its context."""
    pieces = exploded_sections(texts, column).select("id", "section_no", "title", F.posexplode(X.split_section(F.col("body"))).alias("k", "piece")).filter("piece <> ''")
    return pieces.withColumn("ending", S.tail(F.col("piece"), X.CONTEXT_CHARS))


def with_roles(pieces: DataFrame) -> DataFrame:
    """``cleaned_pieces``, each row once, with piece_no, starts_section, role and context in
    place of k and ending.

    The role is open, close or continue; the context is the end of the piece before, unless a
    section starts. The piece's text may be left out before.
    """
    order = W.partitionBy("id").orderBy("section_no", "k")
    numbered = pieces.withColumn("piece_no", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(W.partitionBy("id")))
    starts = F.row_number().over(W.partitionBy("id", "section_no").orderBy("k")) == 1
    role = F.when(F.col("piece_no") == 0, "open").when(F.col("piece_no") == F.col("n") - 1, "close").otherwise("continue")
    context = F.when(~F.col("starts_section"), F.lag("ending").over(order))
    kept = [c for c in pieces.columns if c not in ("k", "ending")]
    return numbered.withColumn("starts_section", starts).select(*kept, "piece_no", "starts_section", role.alias("role"), context.alias("context"))


def cleaning_plan(texts: DataFrame, column: str = "text") -> DataFrame:
    """(id, section_no, title, piece, piece_no, starts_section, role, context)."""
    return with_roles(cleaned_pieces(texts, column))


def reassembled(pieces: DataFrame, intro: str | None = None) -> DataFrame:
    """(id, text): pieces in order, a header where a titled section starts; empty ones left out."""
    head = F.when(F.col("starts_section") & F.col("title").isNotNull(), F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"))).otherwise("")
    kept = pieces.filter(S.strip(F.col("piece")) != "").select("id", "piece_no", F.concat(head, "piece").alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "t"))), lambda x: x.t)
    text = F.array_join(F.concat(F.array(F.lit(intro)), F.col("parts")) if intro else F.col("parts"), "\n\n")
    return kept.groupBy("id").agg(parts.alias("parts")).select("id", text.alias("text"))


def split_by_cache(plan: DataFrame, cache: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of rows whose content key is in the cache (id, chunk_no, content_key)."""
    keyed = plan.withColumn("content_key", S.cache_key(*[F.col(k) for k in key]))
    on = ["id", "chunk_no", "content_key"]
    return keyed.join(cache.select(*on).distinct(), on, "left_semi"), keyed.join(cache.select(*on).distinct(), on, "left_anti")


def page_ranges(papers: DataFrame, width: int = 4) -> DataFrame:
    """(id, first_page, last_page) of runs of ``width`` pages; ``n_pages`` is a column."""
    first = F.explode(F.expr(f"if(n_pages > 0, sequence(1, n_pages, {width}), array())"))
    return papers.select("id", first.alias("first_page"), "n_pages").select("id", "first_page", F.least(F.col("first_page") + width - 1, F.col("n_pages")).alias("last_page"))
