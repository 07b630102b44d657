"""Problem 4: noise in the text of scanned pages.

Lines: page numbers are told by their form, running headers by repeating the document's title,
a journal's or its authors' names at the page edge. Hyphens: a line that ends in a hyphen is
joined with the next line of text; the collection's words say whether the whole word is
written with or without it. Misread letters: each word has an anagram hash (the sum of its
letters' powers); a confusable pair of letter groups changes it by a fixed difference. Rare
words are joined, in SQL, with the frequent words whose hash differs by one or two such
differences, checked by putting the right letters in, and the most frequent variant ranks
first. Rare words that are two known words run together are told by joining their parts.

Word counts cover every different ``raw_text`` of the collection once: copies of a scan and rows
delivered twice don't make its misreadings frequent. Nothing is broadcast that grows with it.

Cases: null, empty and unwrapped texts have no defects; a line has one row for each kind, page
furniture no other kind; repeated rows give one result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import map_batches
from wordloom.session import written
from wordloom.sources.tables import table

# How scanned letters are misread (wrong, right).
CONFUSIONS = [
    ("c", "e"), ("ä", "a"), ("l", "i"), ("0", "o"), ("ri", "n"), ("5", "s"), ("f", "t"), ("1", "l"), ("1", "i"), ("cl", "d"), ("ii", "u"),
    ("b", "h"), ("rn", "m"), ("9", "g"), ("vv", "w"), ("li", "h"), ("t", "f"), ("m", "rn"), ("8", "b"), ("ö", "o"), ("ü", "u"), ("6", "b"),
]
#: A variant, or both parts of words run together, must be so many times (words run together: twice
#: that) as frequent as the word, however often that is seen.
RATIO = 8
#: Letters are folded to so many codes before their powers are summed.
FOLD = 2048
PRIME = 2**31 - 1
#: Longest line of a page, and the part of a scanned text's lines of some length that may be longer
#: (tables, pasted rows).
WRAP, WIDER = 110, 0.2
#: A variant at two differences must be so many times as frequent as the word, of so many letters.
TWICE, TWICE_LETTERS = RATIO * RATIO, 6
#: Words of more than 1 / HOT of all words, at most HOT, are looked up apart.
HOT = 1000

_PAGE_NUMBER = regex.compile(
    r"(?:(?:page|p\.|pg\.|seite|s\.|página|pág\.|стр\.|σελ\.)\s*)?[\[(\-–—~•|.\s]*[0-9lIO]{1,4}[\])\-–—~•|.\s]*(?:(?:of|/|von|de)\s*\d{1,4})?|[-–—(\[\s]*[ivxlc]{1,7}[-–—)\].\s]*", regex.I
)
_JOURNAL = regex.compile(
    r"(?:quarterly|bulletin|annals|proceedings|journal|review|transactions|letters|archives?|gazette|notes|reports?|studies|magazine|yearbook|acta|revue|revista|zeitschrift)\b", regex.I
)
_SMALL_WORDS = {"of", "and", "the", "for", "in", "on", "&", "et", "al", "de", "la", "und", "der", "y", "e"}
_EDGE_NUMBER = regex.compile(r"^\s*[0-9lIO]{1,4}(?:\s{2,}|\s*[|·•–—]\s*)|(?:\s{2,}|\s*[|·•–—]\s*)[0-9lIO]{1,4}\s*$")
_HYPHEN = regex.compile(r"([\p{L}\p{M}0-9]+(?:-[\p{L}\p{M}0-9]+)*)([-¬‐­])\s*$")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:-[\p{L}\p{M}\p{N}]+)*")
_SKIP = regex.compile(r"\S*(?:://|www\.|\w\.\w+/)\S*|\S+@\S+|\S+\.(?:example|com|org|net|html?)\b\S*")
_TORN = regex.compile(r"\S*\p{L}(?:(?![\x00-\x7F])\p{S})+\p{L}\S*")
_JOIN = regex.compile(r"([\p{L}\p{M}])(-|[¬‐­])[^\S\n]*\n[^\S\n]*(?=\p{Ll})")


def letters(text: str) -> str:
    return regex.sub(r"[^\p{L}\p{N}]+", " ", text).strip().lower()


def is_scan(text: str) -> bool:
    """Lines wrapped at a page's width.

    Some wider lines are let pass where most lines of some length run on in the next line, as
    wrapped lines do and paragraphs of a line each do not.
    """
    lines = text.split("\n")
    some = [i for i, line in enumerate(lines) if line and not line.isspace()]
    body = [i for i in some if len(lines[i]) >= 35]
    wide = sum(len(lines[i]) > WRAP for i in some)
    if len(some) < 3 or len(body) - wide < 2:
        return False
    runs_on = sum(i + 1 < len(lines) and bool(lines[i + 1].strip()) for i in body)
    return wide == 0 or (wide <= WIDER * len(body) and 2 * runs_on >= len(body))


def furniture(line: str, title: str) -> str:
    """'page_number', 'running_header' or '' for a line of text."""
    s = line.strip()
    if _PAGE_NUMBER.fullmatch(s) and any(c.isalnum() for c in s) and not regex.fullmatch(r"[A-Za-z]|.*\s{2,}.*", s):
        if s.lower() not in ("i", "mix", "mild", "civil", "vivid", "livid", "civic", "ill", "dim"):
            return "page_number"
    bare = _EDGE_NUMBER.sub(" ", line).strip()
    if not bare or bare[-1] in ".!?,;:":
        return ""
    if title and letters(bare) == title:
        return "running_header"
    words = [w for w in bare.split() if any(c.isalpha() for c in w)]
    if not words or len(words) > 10:
        return ""
    names = [w for w in words if w.lower().strip(".,") not in _SMALL_WORDS]
    if names and all(w[0].isupper() or w[0].isdigit() for w in names):
        if len(words) > 2 and _JOURNAL.search(bare) and any(w.lower() in ("of", "for", "de", "für", "on") for w in words):
            return "running_header"
        if regex.fullmatch(r"\p{Lu}[\p{L}.\p{N}]+(?: \p{Lu}[\p{L}.]+)?(?:,? (?:and|&|und|et|y) \p{Lu}[\p{L}.\p{N}]+(?: \p{Lu}[\p{L}.]+)?| et al\.?)", bare):
            return "running_header"
        if len(names) > 2 and bare.isupper():
            return "running_header"
    return ""


# --- words of the collection -------------------------------------------------


def word_counts(episodes: DataFrame) -> DataFrame:
    """(word, n) over the different raw texts; words broken over lines are counted whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if "-\n" in text or "¬\n" in text:
                    text = _JOIN.sub(lambda m: m.group(1), text)
                seen.update(_WORD.findall(text.lower()))
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    return (
        episodes.select("raw_text")
        .filter(F.col("raw_text").isNotNull())
        .distinct()
        .mapInArrow(count, "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def anagram_hash(word: str) -> int:
    """The sum of the fifth powers of a word's letters (code points below ``FOLD``), each modulo
    ``PRIME``, so that words of any length stay within 64 bits; letters that fold together only
    add candidates, which are checked letter by letter.
    """
    return sum(pow(ord(c) % FOLD, 5, PRIME) for c in word)


def hash_column(word: str) -> Column:
    """``anagram_hash`` in SQL."""
    code = f"cast(ascii(c) as bigint) % {FOLD}"
    powers = F.expr(f"transform(split({word}, ''), c -> {code})")
    return F.aggregate(powers, F.lit(0).cast("bigint"), lambda acc, c: acc + c * c * c * c * c % PRIME)


def stepped(words: DataFrame) -> DataFrame:
    """``words`` (word, own, form) at each confusion whose wrong letters the form holds: wrong,
    right, and the hash ``h`` that the form has with it put right."""
    steps = F.array(
        *[
            F.struct(F.lit(w).alias("wrong"), F.lit(r).alias("right"), F.lit(anagram_hash(r) - anagram_hash(w)).alias("d"))
            for w, r in CONFUSIONS
        ]
    )
    return (
        words.select("word", "own", "form", hash_column("form").alias("h0"), F.explode(steps).alias("s"))
        .filter("contains(form, s.wrong)")
        .select("word", "own", "form", F.col("s.wrong").alias("wrong"), F.col("s.right").alias("right"), (F.col("h0") + F.col("s.d")).alias("h"))
    )


_PUT = "concat(substr(form, 1, i - 1), right, substr(form, i + length(wrong)))"


def ranked(steps: DataFrame, known: DataFrame, ratio: int) -> DataFrame:
    """(word, correction, n): the most frequent known word that a step reaches, checked letter by
    letter and at least ``ratio`` times as frequent."""
    fits = (
        steps.join(known.select(F.col("word").alias("variant"), F.col("n").alias("often"), "h"), "h")
        .filter(F.col("often") >= ratio * F.greatest("own", F.lit(1)))
        .filter(F.expr(f"exists(sequence(1, length(form)), i -> substr(form, i, length(wrong)) = wrong and {_PUT} = variant)"))
    )
    best = fits.groupBy("word").agg(F.max(F.struct("often", "variant")).alias("b"))
    return best.select("word", F.col("b.variant").alias("correction"), F.col("b.often").alias("n"))


def corrections(counts: DataFrame, suspects: DataFrame) -> DataFrame:
    """(word, correction, n): the highest ranked variant of each suspect word that has one.

    ``suspects`` has words; only those rare beside a variant are misread. Variants at one
    difference come first; words without one are asked for two differences, with more evidence.
    """
    known = counts.filter((F.col("n") >= RATIO) & (F.length("word") >= 3)).select("word", "n", hash_column("word").alias("h"))
    rare = suspects.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("own"), F.col("word").alias("form"))
    rare = rare.filter((F.length("word") >= 3) & F.col("word").rlike(r"\p{L}"))
    one = written(ranked(stepped(rare), known, RATIO), "p4-one")
    left = rare.filter((F.length("word") >= TWICE_LETTERS) & (F.col("own") < RATIO)).join(one.select("word"), "word", "left_anti")
    places = F.filter(F.sequence(F.lit(1), F.length("form")), lambda i: F.col("form").substr(i, F.length("wrong")) == F.col("wrong"))
    put = stepped(left).withColumn("i", F.explode(places)).select("word", "own", F.expr(_PUT).alias("form")).distinct()
    return one.unionByName(ranked(stepped(put), known, TWICE))


def looked_up(words: DataFrame, fixes: DataFrame, counts: DataFrame) -> DataFrame:
    """``words`` without the most frequent words of the collection that have no correction: they
    meet none, and a task need not hold all places of such a word."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(total / HOT, HOT)).select("word").join(fixes.select("word"), "word", "left_anti")
    plain = [r["word"] for r in hot.collect()]
    return words.filter(~F.col("word").isin(plain)) if plain else words


def run_together(counts: DataFrame, suspects: DataFrame, fixed: DataFrame) -> DataFrame:
    """(word, correction): suspect words that are two known (or corrected) words in one."""
    usual = counts.filter((F.col("n") >= 2 * RATIO) & F.col("word").rlike(r"^\p{L}+$"))
    parts = usual.select(F.col("word").alias("part"), F.col("word").alias("fine"), "n").unionByName(
        fixed.select(F.col("word").alias("part"), F.col("correction").alias("fine"), "n")
    )
    rare = suspects.join(counts, "word", "left").filter((F.length("word") >= 5) & F.col("word").rlike(r"^[\p{L}\p{M}0-9]+$"))
    rare = rare.select("word", F.coalesce("n", F.lit(0)).alias("own")).join(fixed.select("word"), "word", "left_anti")
    cut = rare.select("word", "own", F.explode(F.expr("sequence(1, length(word) - 2)")).alias("i")).select(
        "word", "own", F.expr("substr(word, 1, i)").alias("a"), F.expr("substr(word, i + 1)").alias("b")
    ).filter("length(a) > 1 or a in ('a', 'i')")
    left = parts.select(F.col("part").alias("a"), F.col("fine").alias("fa"), F.col("n").alias("na"))
    right = parts.select(F.col("part").alias("b"), F.col("fine").alias("fb"), F.col("n").alias("nb"))
    both = cut.join(left, "a").join(right, "b").filter(F.least("na", "nb") >= 2 * RATIO * F.greatest("own", F.lit(1)))
    best = both.groupBy("word").agg(F.max(F.struct(F.least("na", "nb").alias("n"), F.concat_ws(" ", "fa", "fb").alias("c"))).alias("b"))
    return best.select("word", F.col("b.c").alias("correction"))


# --- lines -------------------------------------------------------------------

_LINES = "episode_id string, line_no int, kind string, whole string, apart string, words array<string>"


def read_lines(pages: DataFrame) -> DataFrame:
    """One row for each non-blank line of the scanned texts.

    kind: 'page_number', 'running_header' or 'text'; a line that ends in a hyphen has the word
    joined (``whole``) and with its hyphen (``apart``); ``words`` are the line's words as they
    are judged: a word broken over two lines belongs to the first, joined; the parts of a word
    torn by symbols of a wrong decoding are no words.
    """

    def read(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"episode_id": [], "line_no": [], "kind": [], "whole": [], "apart": [], "words": []}
        for eid, text, title in zip(batch["id"], batch["raw_text"], batch["title"]):
            if not is_scan(text):
                continue
            lines = text.split("\n")
            name = letters(title or "")
            kinds = ["" if not x.strip() else furniture(x, name) or "text" for x in lines]
            body = [i for i, k in enumerate(kinds) if k == "text"]
            carried = ""
            for at, i in enumerate(body):
                line = _SKIP.sub(" ", lines[i].lower())
                words = _WORD.findall(line)
                if carried and words:
                    words = words[1:]
                carried, whole, apart = "", None, None
                m = _HYPHEN.search(line.rstrip())
                if m and at + 1 < len(body):
                    after = _WORD.match(_SKIP.sub(" ", lines[body[at + 1]].lower()).lstrip())
                    if after:
                        carried = after.group()
                        whole = m.group(1) + carried
                        apart = m.group(1) + "-" + carried
                        if m.group(2) in "¬­":
                            apart = ""
                        words = [*words[:-1], whole]
                elif m:
                    whole, apart = m.group(1), m.group(1) + "-"
                    words = words[:-1]
                torn = {w for token in _TORN.findall(line) for w in _WORD.findall(token)}
                for column, value in zip(out, (eid, i + 1, "text", whole, apart, sorted(set(words) - torn))):
                    out[column].append(value)
            for i, kind in enumerate(kinds):
                if kind and kind != "text":
                    for column, value in zip(out, (eid, i + 1, kind, None, None, [])):
                        out[column].append(value)
        return out

    return map_batches(pages.select("id", "raw_text", "title").filter("raw_text is not null"), read, _LINES)


def evidence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, breaks: whole, apart, hyphenated; fixes: word, correction; counts: word, n)."""
    episodes = table(spark, folder, "episodes")
    lines = written(read_lines(episodes.filter("source_type = 'pdf'")), "p4-lines")
    counts = written(word_counts(episodes), "p4-words")
    ends = lines.filter("whole is not null").select("whole", "apart").distinct()
    joined = counts.select(F.col("word").alias("whole"), F.col("n").alias("n_whole"))
    split = counts.select(F.col("word").alias("apart"), F.col("n").alias("n_apart"))
    # a compound is written with its hyphen where the collection has it so more often than in one
    breaks = ends.join(joined, "whole", "left").join(split, "apart", "left").select(
        "whole", "apart", (F.coalesce("n_apart", F.lit(0)) > 2 * F.coalesce("n_whole", F.lit(0))).alias("hyphenated")
    )
    used = lines.filter("kind = 'text'").select(F.explode("words").alias("word"))
    compounds = breaks.filter("hyphenated").select(F.col("whole").alias("word")).distinct()
    suspects = written(used.groupBy("word").count().select("word").join(compounds, "word", "left_anti"), "p4-suspects")
    fixed = written(corrections(counts, suspects), "p4-fixed")
    fixes = fixed.select("word", "correction").unionByName(run_together(counts, suspects, fixed.filter("length(word) >= 4")))
    return lines, breaks, written(fixes, "p4-fixes"), counts


_NUMERAL = r"^(?=.*[0-9])(?=.*[lo])[0-9lo]{2,5}$"


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every defect of a line of a scanned text."""
    lines, breaks, fixes, counts = evidence(spark, folder)
    edge = lines.filter("kind <> 'text'").select("episode_id", "line_no", "kind")
    ends = lines.filter("whole is not null").select("episode_id", "line_no", "whole", "apart")
    hyphen = ends.join(breaks, ["whole", "apart"]).filter("not hyphenated").select("episode_id", "line_no", F.lit("hyphen_break").alias("kind"))
    words = lines.filter("kind = 'text'").select("episode_id", "line_no", F.explode("words").alias("word"))
    misread = looked_up(words, fixes, counts).join(fixes.select("word").distinct(), "word", "left_semi").unionByName(words.filter(F.col("word").rlike(_NUMERAL)).select("word", "episode_id", "line_no"))
    misread = misread.select("episode_id", "line_no", F.lit("misread").alias("kind"))
    return edge.unionByName(hyphen).unionByName(misread).distinct()


def rebuilt(text: str, title: str | None, fixes: dict[str, str], compounds: set[str]) -> str:
    """Continuous paragraphs: no page furniture, whole words, corrections put in."""
    lines = text.split("\n")
    name = letters(title or "")
    paragraphs: list[str] = []
    blank, edge = True, False
    for line in lines:
        if not line.strip():
            blank = True
            continue
        if furniture(line, name):
            edge = True
            continue
        s = line.strip()
        broken = paragraphs and regex.search(r"[-¬‐\u00ad]$", paragraphs[-1])
        flows = paragraphs and (broken or (edge and not regex.search(r"[.!?:]['\"”’)]*$", paragraphs[-1]) and s[:1].islower()))
        item = regex.match(r"(?:\d{1,3}[.)]|[-*•]) ", s)
        fresh = not paragraphs or item or (line[:2].isspace() and not broken) or (blank and not flows)
        if fresh:
            paragraphs.append(s)
        elif broken:
            m, after = _HYPHEN.search(paragraphs[-1]), _WORD.match(s)
            keep = m and after and m.group(2) == "-" and (m.group(1) + "-" + after.group()).lower() in compounds
            paragraphs[-1] = (paragraphs[-1] if keep or not m else paragraphs[-1][:-1]) + s
        else:
            paragraphs[-1] += " " + s
        blank = edge = False

    def right(m: regex.Match[str]) -> str:
        word = m.group()
        fixed = fixes.get(word.lower())
        if fixed is None:
            return word
        return fixed.upper() if word.isupper() and len(word) > 1 else fixed[0].upper() + fixed[1:] if word[0].isupper() or (word[0].isdigit() and len(word) > 8) else fixed

    return "\n\n".join(_WORD.sub(right, p) for p in paragraphs)


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The scanned texts as continuous paragraphs.

    What a text needs (its corrections, its hyphenated compounds) is gathered by text, so that
    nothing but a text's own words meets it in a task.
    """
    lines, breaks, fixes, counts = evidence(spark, folder)
    used = lines.filter("kind = 'text'").select("episode_id", F.explode("words").alias("word")).distinct()
    own = (
        looked_up(used, fixes, counts).join(fixes.groupBy("word").agg(F.max("correction").alias("correction")), "word")
        .groupBy("episode_id")
        .agg(F.collect_list(F.concat_ws("\t", "word", "correction")).alias("fixes"))
    )
    kept = (
        lines.filter("whole is not null").select("episode_id", "whole", "apart").join(breaks.filter("hyphenated"), ["whole", "apart"])
        .groupBy("episode_id").agg(F.collect_set("apart").alias("compounds"))
    )
    scanned = lines.select("episode_id").distinct()
    pages = table(spark, folder, "episodes").filter("source_type = 'pdf'").select(F.col("id").alias("episode_id"), "title", "raw_text")
    joined = pages.join(scanned, "episode_id").join(own, "episode_id", "left").join(kept, "episode_id", "left")

    def run(batch: dict[str, list]) -> dict[str, list]:
        texts = [
            rebuilt(text, title, dict(f.split("\t", 1) for f in fixes_ or []), set(compounds or []))
            for text, title, fixes_, compounds in zip(batch["raw_text"], batch["title"], batch["fixes"], batch["compounds"])
        ]
        return {"episode_id": batch["episode_id"], "repaired_text": texts}

    return map_batches(joined.select("episode_id", "title", "raw_text", "fixes", "compounds"), run, "episode_id string, repaired_text string").dropDuplicates(["episode_id"])


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
ORACLES: dict[str, str] = {}
