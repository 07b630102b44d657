"""Document sources and sinks: uploads, JSON documents, object keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.sources.tables import DOCUMENT

FILE_BYTES = 50 * 1024 * 1024
TEXT_BYTES = 10 * 1024 * 1024


def binary_uploads(spark: SparkSession, path: str, most: int = FILE_BYTES) -> DataFrame:
    """(path, title, length, content, accepted) of files; larger ones are listed without content."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= most
    return files.select("path", S.file_stem(F.col("path"), (".pdf",)).alias("title"), "length", F.when(fits, F.col("content")).alias("content"), fits.alias("accepted"))


def text_uploads(spark: SparkSession, path: str, most: int = TEXT_BYTES) -> DataFrame:
    """(path, title, text, accepted) of text and markdown files in UTF-8."""
    files = spark.read.format("binaryFile").load(path).filter(F.lower("path").rlike(r"\.(md|markdown|txt)$"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    ok = (F.col("length") <= most) & text.isNotNull() & (S.strip(text) != "")
    return files.select("path", S.file_stem(F.col("path")).alias("title"), F.when(ok, text).alias("text"), F.coalesce(ok, F.lit(False)).alias("accepted"))


def submitted_texts(rows: DataFrame, most: int = TEXT_BYTES) -> DataFrame:
    """Rows (title, text) whose both are not blank and whose text is within the size."""
    named = rows.withColumns({"title": S.not_blank(F.col("title")), "text": S.not_blank(F.col("text"))})
    return named.filter(F.col("title").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= most))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON lines source; a malformed line is an error, the type defaults to pdf."""
    rows = spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)
    return rows.withColumn("source_type", F.coalesce("source_type", F.lit("pdf")))


def to_json_documents(documents: DataFrame) -> DataFrame:
    """One pretty JSON text a document, without its null fields."""
    return documents.select(F.to_json(F.struct(*documents.columns), {"pretty": "true", "ignoreNullFields": "true"}).alias("value"))


def fetched_pages(pages: DataFrame) -> DataFrame:
    """Routes fetched pages (url, final_url, content_type, body) by what they are: html or pdf."""
    pdf = S.looks_like_pdf(F.col("final_url")) | F.lower("content_type").startswith("application/pdf")
    return pages.withColumn("kind", F.when(F.coalesce(pdf, F.lit(False)), "pdf").otherwise("html"))


FATAL_CONVERSION = "ltx_ERROR undefined"


def first_valid_page(first: Column, second: Column, marker: str = FATAL_CONVERSION) -> Column:
    """The first of two pages that came and was converted."""
    return F.coalesce(*[F.when(p.isNotNull() & ~p.contains(marker), p) for p in (first, second)])


def audio_key(episode_id: Column, data: Column) -> Column:
    return F.concat(F.lit("episodes/"), episode_id, F.lit("/"), S.content_key(data), F.lit(".mp3"))


def cover_key(episode_id: Column, mime: Column) -> Column:
    return F.concat(F.lit("episodes/"), episode_id, F.lit("/cover."), S.image_extension(mime))


def key_of_url(url: Column, hosts: list[str]) -> Column:
    """The object key of a public URL under any of its hosts."""
    prefix = "|".join(h.replace(".", r"\.") for h in hosts)
    return F.regexp_replace(url, rf"^https?://(?:{prefix})/", "")


def page_count(stdout: Column) -> Column:
    """The page count a PDF tool prints."""
    return F.nullif(F.regexp_extract(stdout, r"(?m)^Pages:\s*(\d+)", 1), F.lit("")).cast("int")


def expired_caches(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Cache folders (name, modified) not touched for some hours."""
    return files.filter(F.col("name").endswith("_chunks") & (F.col("modified") < now - F.make_dt_interval(hours=F.lit(hours))))
