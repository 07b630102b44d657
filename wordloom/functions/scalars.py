"""Scalar functions, Column to Column, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without the white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s++\z", "")


def xml_escape(c: Column) -> Column:
    """The five XML entities; the ampersand first, so that nothing is escaped twice."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def render_markdown_headers(c: Column) -> Column:
    """HTML of a text whose lines may be headers of one to three marks (three entities escaped)."""
    safe = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for level in (3, 2, 1):
        safe = F.regexp_replace(safe, rf"(?m)^#{{{level}}}\s+(.+)$", rf"<h{level}>$1</h{level}>")
    return safe


def display_title(title: Column, summarize: Column) -> Column:
    return F.when(F.coalesce(summarize, F.lit(0)) != 0, F.concat(title, F.lit(" (Summary)"))).otherwise(title)


def url_path(url: Column) -> Column:
    """The URL without query and fragment."""
    return F.regexp_extract(url, r"^[^?#]*", 0)


def looks_like_pdf(url: Column) -> Column:
    return F.lower(url_path(url)).endswith(".pdf")


def detect_source_type(url: Column) -> Column:
    """arxiv, pdf or article, by the URL alone."""
    arxiv = url.rlike(r"arxiv\.org/(?:abs|html|pdf)/") | url.contains("ar5iv.org")
    return F.when(arxiv, "arxiv").when(looks_like_pdf(url), "pdf").when(url.isNotNull(), "article")


def detect_input_type(source: Column) -> Column:
    """The batch variant: a file name ending in .pdf wins over the host."""
    return F.when(F.lower(source).endswith(".pdf"), "pdf").when(source.rlike(r"arxiv\.org|ar5iv\.org"), "arxiv").when(source.isNotNull(), "article")


def _first_match(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def arxiv_id_of_abstract(url: Column) -> Column:
    """The paper id of an abstract page, up to the next slash or question mark."""
    return _first_match(url, [r"arxiv\.org/abs/([^/?]+)", r"ar5iv\.org/abs/([^/?]+)"])


def arxiv_id(url: Column) -> Column:
    """The paper id of any page of a paper; the kinds of page are tried in order."""
    kinds = [r"arxiv\.org/abs/", r"arxiv\.org/html/", r"arxiv\.org/pdf/", r"ar5iv\.org/abs/", r"ar5iv\.org/html/"]
    return F.regexp_replace(_first_match(url, [k + r"([^/?#]+)" for k in kinds]), r"\.pdf$", "")


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def collapse_blank_lines(c: Column) -> Column:
    """Lines without trailing blanks, at most one blank line between them, no edges."""
    c = F.regexp_replace(c, r"(?m)[ \t\r]+$", "")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def tail(c: Column, n: int) -> Column:
    """The last ``n`` characters, trimmed."""
    return strip(F.right(c, F.lit(n)))


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def strip_code_fence(c: Column) -> Column:
    """The inside of a fenced block, or the text as it is."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def file_stem(c: Column, suffixes: tuple[str, ...] = (".md", ".markdown", ".txt")) -> Column:
    """A base name without the listed suffixes, each as often as it stands there."""
    c = F.regexp_extract(c, r"[^/\\]*$", 0)
    for s in suffixes:
        c = F.regexp_replace(c, rf"(?i)(?:{s.replace('.', chr(92) + '.')})+$", "")
    return c


def image_extension(mime: Column) -> Column:
    return F.when(mime == "image/png", "png").when(mime.isin("image/jpeg", "image/jpg"), "jpg").when(mime == "image/webp", "webp").otherwise("bin")


def is_true(c: Column) -> Column:
    return c.isin("true", "1")


def images_wanted(c: Column) -> Column:
    """On unless it says false or 0; also where nothing is said."""
    return ~F.coalesce(c.isin("false", "0"), F.lit(False))


def not_blank(c: Column) -> Column:
    """The trimmed text, or null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def title_and_text(c: Column) -> Column:
    """struct(title, text) of an extraction whose first line may be ``TITLE: ...``."""
    titled = c.startswith("TITLE: ") & c.contains("\n")
    title = strip(F.regexp_extract(c, r"^TITLE: ([^\n]*)\n", 1))
    text = strip(F.regexp_replace(c, r"^TITLE: [^\n]*\n", ""))
    return F.struct(F.when(titled, title).otherwise("Untitled PDF").alias("title"), F.when(titled, text).otherwise(c).alias("text"))


def atom_title(xml: Column) -> Column:
    """The first title behind the first entry, on one line."""
    found = F.regexp_extract(xml, r"(?s)<entry>.*?<title>(.*?)</title>", 1)
    return F.nullif(strip(F.replace(found, F.lit("\n"), F.lit(" "))), F.lit(""))


def rfc2822(at: Column) -> Column:
    """``Tue, 14 Apr 2026 14:59:47 +0000`` of a time in UTC; empty where there is none."""
    return F.coalesce(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss '+0000'"), F.lit(""))


def clock(seconds: Column, hours: Column) -> Column:
    """``h:mm:ss`` or ``m:ss``; negative times count as 0, fractions are dropped."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60), s % 60
    return F.when(hours, F.format_string("%d:%02d:%02d", h, m % 60, r)).otherwise(F.format_string("%d:%02d", m, r))


def duration_label(seconds: Column) -> Column:
    """``m:ss``, never hours; ``--:--`` where the duration is not known."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    return F.when(s == 0, "--:--").otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def to_milliseconds(seconds: Column) -> Column:
    return F.greatest(seconds * 1000, F.lit(0)).cast("long")


def max_output_tokens(n_chars: Column) -> Column:
    return F.least(F.greatest(F.floor(n_chars / 3) + 2048, F.lit(4096)), F.lit(32768))


def speaking_seconds(n_words: Column) -> Column:
    """150 words a minute."""
    return n_words / F.lit(150.0) * F.lit(60.0)


def content_key(data: Column) -> Column:
    """The first eight bytes of a SHA-256, in hex."""
    return F.substring(F.sha2(data, 256), 1, 16)


def cache_key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)))


# The signs that mark mathematical text.
MATH_SIGNS = "∑∫∂∇∞≤≥≠≈→⇒⊆⊇∈∉∀∃⋅×±"
MATH_PER_THOUSAND = 15.0


def math_density(c: Column) -> Column:
    """Signs, Greek letters and backslashes in a thousand words."""
    signs = F.regexp_count(c, F.lit(f"[{MATH_SIGNS}Α-ω\\\\]"))
    return signs * F.lit(1000.0) / F.greatest(word_count(c), F.lit(1))


# What an upstream's error says when it is down or over its limits.
OUTAGE_SIGNS = ("503", "service unavailable", "overloaded", "unavailable", "429", "too many requests", "rate limit", "resource_exhausted", "quota")


def is_outage(message: Column) -> Column:
    return F.lower(message).rlike("|".join(OUTAGE_SIGNS))


def square_crop(width: Column, height: Column) -> Column:
    """struct(side, x, y) of the centred square."""
    side = F.least(width, height)
    return F.struct(side.alias("side"), F.floor((width - side) / 2).alias("x"), F.floor((height - side) / 2).alias("y"))


SECTIONS = "array<struct<title:string,start_secs:double>>"


def parse_sections_json(c: Column) -> Column:
    """The sections of a JSON text; null where it is malformed or a field is missing."""
    parsed = F.from_json(c, SECTIONS)
    return F.when(F.forall(parsed, lambda s: s.title.isNotNull() & s.start_secs.isNotNull()), parsed)


def sections_to_json(sections: Column) -> Column:
    return F.when(F.size(sections) > 0, F.to_json(sections))


def chapter_list(sections: Column) -> Column:
    """One line a section; hours for all where the last section starts after an hour."""
    hours = F.element_at(sections, -1).start_secs >= 3600
    lines = F.transform(sections, lambda s: F.concat(clock(s.start_secs, hours), F.lit(" "), s.title, F.lit("\n")))
    return F.when(F.size(sections) > 0, F.array_join(lines, ""))


def chapters_json(sections: Column) -> Column:
    """The chapters document of a podcast; an empty list where there are none."""
    chapters = F.transform(F.coalesce(sections, F.expr(f"cast(array() as {SECTIONS})")), lambda s: F.struct(s.start_secs.alias("startTime"), s.title.alias("title")))
    return F.to_json(F.struct(F.lit("1.2.0").alias("version"), chapters.alias("chapters")))


def item_description(description: Column, url: Column, sections: Column) -> Column:
    """The description, its source unless named in it, and the chapters."""
    base = F.coalesce(description, url, F.lit("PDF upload"))
    named = F.when(url.isNotNull() & ~base.contains(url), F.concat(base, F.lit("\n\nSource: "), url)).otherwise(base)
    return F.concat(named, F.coalesce(F.concat(F.lit("\n\nChapters:\n"), chapter_list(sections)), F.lit("")))
