"""Names, titles, addresses and service records: small rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import scalars as S

# The title an upload has until one is found, and the least bytes of a paper's text.
UPLOAD_TITLE = "PDF Upload"
PAPER_BYTES = 500
PAGE_WIDTHS = (2, 3, 4)

OUTLINE = "struct<intro_line:string,sections:array<struct<title:string,start_anchor:string>>,main_body_end_anchor:string>"
REPLY = (
    "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>,"
    "usageMetadata:struct<promptTokenCount:bigint,candidatesTokenCount:bigint>>"
)


def padded(n: Column, width: int) -> Column:
    """A number with leading zeros; never cut."""
    return F.lpad(n.cast("string"), F.greatest(F.lit(width), F.length(n.cast("string"))), F.lit("0"))


def chunk_name(n: Column, key: Column) -> Column:
    return F.concat(F.lit("chunk-"), padded(n, 4), F.lit("-"), key, F.lit(".mp3"))


def cover_name(image: Column, mime: Column) -> Column:
    """The key of a feed's image: the hash of its bytes and the extension of its type."""
    return F.concat(F.lit("cover-"), S.content_key(image), F.lit("."), S.image_extension(mime))


def page_name(n: Column, width: int) -> Column:
    return F.concat(F.lit("page-"), padded(n, width), F.lit(".jpg"))


def page_path(n: Column, there: Column) -> Column:
    """The page's file among the names ``there``, by the least padding; else the least padded name."""
    names = [page_name(n, w) for w in PAGE_WIDTHS]
    return F.coalesce(*[F.when(F.array_contains(there, x), x) for x in names], names[0])


def image_text(cleaned: Column, transcript: Column) -> Column:
    return F.coalesce(cleaned, transcript)


def final_title(source_type: Column, title: Column, extracted: Column) -> Column:
    """An upload keeps the title its user gave; all others take the extracted one."""
    return F.when((source_type == "pdf") & (title != UPLOAD_TITLE), title).otherwise(extracted)


def submission_title(source_type: Column, url: Column) -> Column:
    return F.coalesce(F.when(source_type == "arxiv", F.concat(F.lit("arXiv:"), S.arxiv_id_of_abstract(url))), url)


def rss_address(base: str, token: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/feed/"), token, F.lit("/rss.xml"))


def feed_address(base: str, token: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/feeds/"), token)


def chapters_address(base: str, token: Column, episode: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/feed/"), token, F.lit("/episodes/"), episode, F.lit("/chapters.json"))


def cover_brief(title: Column, description: Column) -> Column:
    return F.when(S.not_blank(description).isNull(), title).otherwise(F.concat(title, F.lit(". "), description))


def has_sections(sections_json: Column) -> Column:
    """Whether the sections are a readable list with an entry."""
    return F.coalesce(F.size(S.parse_sections_json(sections_json)) > 0, F.lit(False))


def paper_fault(text: Column) -> Column:
    """Why a paper's text is refused, or null."""
    return F.when(F.coalesce(F.octet_length(S.strip(text)), F.lit(0)) < PAPER_BYTES, "suspiciously short content")


def paper_title(listed: Column, read: Column, paper_id: Column) -> Column:
    """The title of the listing, else that of the page, else the paper's id."""
    return F.coalesce(listed, F.nullif(read, F.lit("")), F.concat(F.lit("arXiv:"), paper_id))


def article_fault(url: Column, content_type: Column) -> Column:
    """Why a page is no article: it turned out to be a PDF; or null."""
    pdf = S.looks_like_pdf(url) | F.coalesce(content_type.startswith("application/pdf"), F.lit(False))
    return F.when(pdf, "a PDF, not an article")


def window_days(value: Column) -> Column:
    """A number of days; null, for all time, where it is missing or no number."""
    return value.try_cast("bigint")


def json_or_null(c: Column) -> Column:
    """A JSON text passed through as it is; null where it can't be read."""
    return F.when(F.get_json_object(c, "$").isNotNull(), c)


def outline(c: Column) -> Column:
    """An outline's record, fenced or not; null where it can't be read, lacks its sections, or a
    section lacks a field. intro_line and main_body_end_anchor may be missing."""
    parsed = F.from_json(S.strip_code_fence(c), OUTLINE)
    whole = F.forall(parsed.sections, lambda s: s.title.isNotNull() & s.start_anchor.isNotNull())
    return F.when(whole, parsed)


def reply(c: Column) -> Column:
    """struct(text, fault, input_tokens, output_tokens) of a service's reply: the parts' texts put
    together, missing counters are 0; an empty text is a fault that names the finish reason."""
    parsed = F.from_json(c, REPLY)
    first = F.get(parsed.candidates, F.lit(0))
    text = F.array_join(F.transform(first.content.parts, lambda p: p.text), "")
    fault = F.when(text.isNull(), "no parts").when(text == "", F.concat(F.lit("empty: "), F.coalesce(first.finishReason, F.lit("unknown"))))
    usage = parsed.usageMetadata
    return F.struct(
        F.nullif(text, F.lit("")).alias("text"),
        fault.alias("fault"),
        F.coalesce(usage.promptTokenCount, F.lit(0)).alias("input_tokens"),
        F.coalesce(usage.candidatesTokenCount, F.lit(0)).alias("output_tokens"),
    )


def fixed_width(*columns: tuple[Column, int]) -> Column:
    """One line of a table: texts to the left, negative widths to the right; nothing is cut."""

    def cell(c: Column, width: int) -> Column:
        c = c.cast("string")
        room = F.greatest(F.lit(abs(width)), F.length(c))
        return F.lpad(c, room, F.lit(" ")) if width < 0 else F.rpad(c, room, F.lit(" "))

    return F.concat_ws(" ", *[cell(c, w) for c, w in columns])


def line_offsets(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line_no, offset) of each line of a table's texts: where it begins, in bytes.

    Only the lines' lengths are shuffled, by ``key``, which names one text.
    """
    sizes = F.transform(F.split(F.col(column), "\n"), lambda x: F.octet_length(x) + 1)
    each = texts.filter(F.col(column).isNotNull()).select(key, F.posexplode(sizes).alias("line_no", "n"))
    before = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return each.select(key, "line_no", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("offset"))
