"""Text operators: sentences, packing, sections, anchors, markup, pronunciation, HTML.

Built-in expressions wherever they can say it; Arrow-batched functions where a scan carries
state (long sentences, sentence packing of oversized paragraphs, HTML trees).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.scalars import strip, xml_escape

CHUNK_BYTES = 3600
SENTENCE_BYTES = 900
SECTION_BYTES = 25_000
CONTEXT_CHARS = 400

_TEXTS = T.ArrayType(T.StringType())
_PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

# Words whose point ends no sentence (a single letter's never does).
SPOKEN_ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "rev", "hon", "gen", "etc", "vs", "cf", "approx", "inc", "ltd", "corp", "co")

# A sentence: one character, then - never given back - anything that is no terminator, or a
# point that ends none (between digits, behind a lone letter or an abbreviation), then one
# terminator; or the rest of the text.
_SENTENCE = (
    r"(?s).(?:[^.!?]|(?<=[0-9])\.(?=[0-9])|(?<=(?<!\p{IsAlphabetic})\p{IsAlphabetic})\.|(?<=(?<!\p{IsAlphabetic})(?i:"
    + "|".join(SPOKEN_ABBREVIATIONS)
    + r"))\.)*+(?:[!?]|\.)|.+"
)


def split_sentences(c: Column) -> Column:
    """array<string>; the pieces put together are the text."""
    return F.regexp_extract_all(c, F.lit(_SENTENCE), F.lit(0))


# The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = ";:,\n"


class _Places:
    """Where a text can be cut: byte offsets of its characters, and its blanks in order."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.at = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode()) for c in text)]
        self.blanks = [i for i, c in enumerate(text) if c in WHITE]

    def within(self, start: int, most: int) -> int:
        """The end of the longest piece from ``start`` of at most ``most`` bytes."""
        return bisect_right(self.at, self.at[start] + most) - 1

    def last_blank(self, start: int, end: int) -> int | None:
        k = bisect_left(self.blanks, end) - 1
        return self.blanks[k] if k >= 0 and self.blanks[k] >= start else None

    def behind_blanks(self, start: int, end: int) -> int:
        """The first place from ``start`` that is no blank, at most ``end``."""
        return end - len(self.text[start:end].lstrip(WHITE))

    def filled(self, start: int, size: int, places: list[int]) -> int | None:
        """The first of ``places`` before which at least ``size`` bytes stand, blanks at the end not counted."""
        for place in places[bisect_left(places, bisect_left(self.at, self.at[start] + size)) :]:
            if self.at[start + len(self.text[start:place].rstrip(WHITE))] - self.at[start] >= size:
                return place
        return None


def _at_words(text: str, most: int) -> Iterator[str]:
    """Cut at the last blank within the size, else behind ``most`` characters."""
    places, start = _Places(text), 0
    while places.at[-1] - places.at[start] > most:
        cut = places.last_blank(start, places.within(start, most))
        cut = min(start + most, len(text)) if cut is None else cut
        yield text[start:cut].rstrip(WHITE) + ". "
        start = places.behind_blanks(cut, len(text))
    if start < len(text):
        yield text[start:]


def _at_separators(text: str, most: int) -> Iterator[str]:
    """Cut at the first separator past half the size; where none comes within the size, at its last blank."""
    places, start = _Places(text), 0
    separators = [i for i, c in enumerate(text) if c in SEPARATORS]
    while start < len(text):
        cut = places.filled(start, most // 2, separators)
        full = bisect_left(places.at, places.at[start] + most)  # the piece that reaches the size ends here
        after = None if cut is None else cut + 1
        if full <= len(text) and (cut is None or cut >= full):
            blank = places.last_blank(start, places.within(start, most))
            if blank is not None:
                cut, after = blank, places.behind_blanks(blank, full)
        if cut is None:
            yield text[start:]
            return
        yield text[start:cut].rstrip(WHITE) + ". "
        start = after


def long_sentence_pieces(sentence: str, most: int = SENTENCE_BYTES) -> list[str]:
    """A sentence cut to pieces of at most ``most`` bytes (but for one word longer than that).

    Past half the size it is cut at ; : , or a line break, which becomes a full stop; else at
    the last blank within the size; else at ``most`` characters.
    """
    if len(sentence.encode()) <= most:
        return [sentence]
    return [piece for part in _at_separators(sentence, most) for piece in _at_words(part, most)]


def spoken_sentences(sentences: list[str]) -> list[str]:
    """A text's sentences with the long ones cut."""
    return [p for x in sentences for p in long_sentence_pieces(x)]


def packed(pieces: list[str], most: int = CHUNK_BYTES) -> list[str]:
    """Greedy packing of texts into texts of at most ``most`` bytes; a longer piece is alone."""
    upto = [0, *accumulate(len(p.encode()) for p in pieces)]
    out, start = [], 0
    while start < len(pieces):
        end = max(bisect_right(upto, upto[start] + most) - 1, start + 1)
        out.append("".join(pieces[start:end]))
        start = end
    return [x for x in out if x]


@F.pandas_udf(T.ArrayType(_TEXTS))
def cut_long_sentences(paragraphs: pd.Series) -> pd.Series:
    """The sentences of each paragraph with the long ones cut."""
    return paragraphs.map(lambda ps: None if ps is None else [spoken_sentences(list(p)) for p in ps])


def pack(pieces: Column, most: int = CHUNK_BYTES) -> Column:
    """``packed`` of an array column."""
    return F.pandas_udf(lambda c: c.map(lambda x: None if x is None else packed(list(x), most)), _TEXTS)(pieces)


def speech_chunks(c: Column, most: int = CHUNK_BYTES) -> Column:
    """The chunks a text is spoken in; a short text is one, its sentences uncut."""

    def chunks(texts: pd.Series, sentences: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [t] if len(t.encode()) <= most else packed(spoken_sentences(list(x)), most) for t, x in zip(texts, sentences)])

    long = F.when(F.octet_length(c) > most, split_sentences(c)).when(c.isNotNull(), F.expr("cast(array() as array<string>)"))
    return F.pandas_udf(chunks, _TEXTS)(c, long)


def apply_lexicon(c: Column, entries: list[tuple[str, str]]) -> Column:
    """Whole words replaced in one pass, case kept in mind; the first entry of a term wins.

    A word is a run of ASCII letters, digits and underscores; terms are such words.
    """
    first: dict[str, str] = {}
    for term, spoken in entries:
        first.setdefault(term, spoken)
    if not first:
        return c
    words = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    tokens = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(words, t), t)), "")


def section_titles(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?m)^[^\S\n]*## (?!#)(.*)$"), F.lit(1))


_HEADER = r"[^\S\n]*## (?!#)"


def parse_sections(c: Column) -> Column:
    """array<struct<title, body>> of a text with ``## `` headers; empty without any.

    Text before the first header is a section without title; a body opens with its title.
    One pass cuts the text before each header line; a part that is no header's is the opening.
    """
    parts = F.split(c, rf"(?md)^(?={_HEADER})")

    def section(part: Column) -> Column:
        title = F.when(part.rlike(rf"(?d)\A{_HEADER}"), strip(F.regexp_extract(part, rf"(?d)\A{_HEADER}([^\n]*)", 1)))
        rest = strip(F.when(title.isNull(), part).otherwise(F.regexp_replace(part, r"\A[^\n]*\n?", "")))
        body = F.when(title.isNull(), rest).when(rest == "", title).otherwise(F.concat(title, F.lit("\n\n"), rest))
        return F.struct(title.alias("title"), body.alias("body"))

    found = F.transform(parts, section)
    some = F.filter(found, lambda s: s.title.isNotNull() | (s.body != ""))
    return F.when(F.exists(found, lambda s: s.title.isNotNull()), some).otherwise(
        F.when(c.isNotNull(), F.expr("cast(array() as array<struct<title:string,body:string>>)"))
    )


def build_ssml(c: Column) -> Column:
    """Paragraphs and sentences marked for speech, long sentences cut; blank ones are dropped."""
    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")

    def marked(sentences: Column) -> Column:
        kept = F.filter(F.transform(sentences, strip), lambda s: s != "")
        return F.concat(F.lit("<p>"), F.array_join(F.transform(kept, lambda s: F.concat(F.lit("<s>"), xml_escape(s), F.lit("</s>"))), ""), F.lit("</p>"))

    spoken = F.array_join(F.transform(cut_long_sentences(F.transform(paragraphs, split_sentences)), marked), "")
    return F.concat(F.lit("<speak>"), F.when(spoken == "", "<p><s></s></p>").otherwise(spoken), F.lit("</speak>"))


ANCHOR_PREFIXES = (60, 40, 25, 15)
ANCHOR_LEAST = 10


def _anchors(anchor: Column) -> list[Column]:
    short = F.ltrim(anchor)
    cut = [F.substring(short, 1, n) for n in ANCHOR_PREFIXES]
    return [anchor, *[F.when(F.octet_length(a) >= ANCHOR_LEAST, a) for a in cut]]


def find_anchor(text: Column, anchor: Column) -> Column:
    """The first place (from 1) of the anchor, or of its longest prefix found; null without."""
    return F.coalesce(*[F.nullif(F.instr(text, a), F.lit(0)) for a in _anchors(anchor)])


def rfind_anchor(text: Column, anchor: Column) -> Column:
    """The last place (from 1), as ``find_anchor``."""
    turned = F.reverse(text)

    def last(a: Column) -> Column:
        at = F.nullif(F.instr(turned, F.reverse(a)), F.lit(0))
        return F.length(text) - at - F.length(a) + 2

    return F.coalesce(*[last(a) for a in _anchors(anchor)])


SLICE_LEAST = 300


def locate_sections(text: Column, titles_and_anchors: Column, end_anchor: Column) -> Column:
    """array<struct<title, body>> of an outline: array<struct<title, start_anchor>>.

    Anchors are searched for from behind the one before. Null where one is missing or a
    section is shorter than SLICE_LEAST bytes: the outline does not fit the text.
    """
    start = F.struct(F.lit(1).alias("cursor"), F.expr("cast(array() as array<struct<title:string,at:int>>)").alias("found"), F.lit(True).alias("ok"))

    def step(acc: Column, s: Column) -> Column:
        rest = F.substring(text, acc.cursor, F.length(text))
        at = find_anchor(rest, s.start_anchor)
        place = (acc.cursor + at - 1).cast("int")
        after = (place + F.least(F.length(s.start_anchor), F.length(rest) - at + 1)).cast("int")
        hit = acc.ok & at.isNotNull()
        found = F.when(hit, F.array_append(acc.found, F.struct(s.title.alias("title"), place.alias("at")))).otherwise(acc.found)
        return F.struct(F.when(hit, after).otherwise(acc.cursor).alias("cursor"), found.alias("found"), hit.alias("ok"))

    walked = F.aggregate(titles_and_anchors, start, step)
    last = F.element_at(walked.found, -1).at
    tail = rfind_anchor(text, end_anchor)
    end = F.when(tail > last, tail).otherwise(F.length(text) + 1)

    def cut(s: Column, i: Column) -> Column:
        upto = F.coalesce(F.get(walked.found, i + 1).at, end)
        return F.struct(s.title.alias("title"), F.substring(text, s.at, upto - s.at).alias("body"))

    parts = F.transform(walked.found, cut)
    thin = F.exists(parts, lambda p: F.octet_length(strip(p.body)) < SLICE_LEAST)
    return F.when((F.size(titles_and_anchors) > 0) & walked.ok & ~thin, parts)


def _paragraph_parts(paragraph: str, most: int) -> Iterator[str]:
    """A long paragraph cut behind its last ``. `` within the size, else behind a line break,
    else at the start of a character."""
    places, start = _Places(paragraph), 0
    stops = [i + 2 for i in range(len(paragraph) - 1) if paragraph.startswith(". ", i)]
    breaks = [i + 1 for i, c in enumerate(paragraph) if c == "\n"]
    while places.at[-1] - places.at[start] > most:
        end = cut = places.within(start, most)
        for ends, least in ((breaks, start + 1), (stops, start + 2)):  # the better kind is asked last
            k = bisect_right(ends, end) - 1
            if k >= 0 and ends[k] >= least:
                cut = ends[k]
        yield paragraph[start:cut].strip(WHITE)
        start = places.behind_blanks(cut, len(paragraph))
    yield paragraph[start:].strip(WHITE)


def paragraph_pieces(section: str, most: int = SECTION_BYTES) -> list[str]:
    """A section cut at blank lines into pieces of at most ``most`` bytes.

    Paragraphs are joined as far as they fit; one that is longer stands in parts of its own.
    """
    if len(section.encode()) <= most:
        return [section.strip(WHITE)]
    paragraphs = [x for x in (p.strip("\n") for p in section.split("\n\n")) if x]
    upto = [0, *accumulate(len(p.encode()) + 2 for p in paragraphs)]
    out, start = [], 0
    while start < len(paragraphs):
        end = bisect_right(upto, upto[start] + most + 2) - 1
        if end == start:
            out += _paragraph_parts(paragraphs[start], most)
            start += 1
        else:
            out.append("\n\n".join(paragraphs[start:end]).strip(WHITE))
            start = end
    return [x for x in out if x]


@F.pandas_udf(_TEXTS)
def split_section(sections: pd.Series) -> pd.Series:
    return sections.map(lambda s: None if s is None else paragraph_pieces(s))


# Elements and classes of a paper's HTML that are not spoken, and its blocks.
SILENT_CLASSES = ("ltx_bibliography", "ltx_biblist", "ltx_bibitem", "ltx_ERROR", "ltx_pagination", "ltx_authors", "ltx_dates", "ltx_classification")
SILENT_ELEMENTS = {"cite", "nav", "footer", "script", "style", "figure", "table"}
BLOCK_ELEMENTS = {"p", "section", "article", "div", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
BLOCK_CLASSES = ("ltx_para", "ltx_paragraph", "ltx_section", "ltx_subsection", "ltx_abstract")
VOID_ELEMENTS = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Text of a page or paper: silent parts left out, blocks apart, formulas by their text."""

    def __init__(self, paper: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.paper, self.inside, self.parts = paper, not paper, []
        self.open: list[tuple[str, bool, bool, bool]] = []  # (name, silent, block, article)
        self.title, self.page_title, self._in = "", "", None

    def handle_starttag(self, tag, attrs):
        kind = dict(attrs)
        classes = kind.get("class") or ""
        silent = tag in SILENT_ELEMENTS or any(c in classes for c in SILENT_CLASSES)
        article = self.paper and tag == "article" and "ltx_document" in classes
        block = tag in BLOCK_ELEMENTS or any(c in classes for c in BLOCK_CLASSES)
        if tag == "title":
            self._in = "page"
        if tag == "h1" and ("ltx_title_document" in classes or not self.paper) and not self.title:
            self._in = "title"
        if tag == "math":
            if kind.get("alttext") and self.speaks():
                self.parts.append(f" {kind['alttext']} ")
            silent = True
        if tag in VOID_ELEMENTS:
            if tag == "br":
                self.parts.append("\n")
            return
        self.open.append((tag, silent, block, article))
        if article:
            self.inside = True
        if block and self.speaks():
            self.parts.append("\n\n")

    def handle_endtag(self, tag):
        if tag in ("title", "h1"):
            self._in = None
        if not any(o[0] == tag for o in self.open):
            return
        while self.open:
            name, _, block, article = self.open.pop()
            if block and self.speaks():
                self.parts.append("\n\n")
            if article:
                self.inside = False
            if name == tag:
                return

    def speaks(self) -> bool:
        return self.inside and not any(o[1] for o in self.open)

    def handle_data(self, data):
        if self._in == "page":
            self.page_title += data
            return
        if self._in == "title":
            self.title += data
        if self.speaks():
            self.parts.append(" ".join(("\x00" + data + "\x00").split()).replace("\x00 ", " ").replace(" \x00", " ").replace("\x00", ""))


def html_text(page: str | None, paper: bool = False) -> tuple[str, str] | None:
    """(title, text); None for a paper's page without its article."""
    if page is None:
        return None
    reader = _Reader(paper)
    reader.feed(page)
    reader.close()
    lines = [" ".join(x.split()) for x in "".join(reader.parts).split("\n")]
    text, blank = [], True
    for line in lines:
        if line or not blank:
            text.append(line)
        blank = not line
    body = "\n".join(text).strip()
    if paper and not any(p.strip() for p in reader.parts):
        return None
    return " ".join((reader.title or reader.page_title).split()), body


def _frame(pages: pd.Series, paper: bool) -> pd.DataFrame:
    out = [html_text(p, paper) or (None, None) for p in pages]
    return pd.DataFrame(out, columns=["title", "text"])


@F.pandas_udf(_PAGE)
def article_text(pages: pd.Series) -> pd.DataFrame:
    """A web page's title and readable text."""
    return _frame(pages, False)


@F.pandas_udf(_PAGE)
def paper_text(pages: pd.Series) -> pd.DataFrame:
    """A converted paper's title and text; nulls where the page has no paper."""
    return _frame(pages, True)
