"""Problem 1: texts that were cut off before their end.

Each value is read once. A stack automaton walks its paragraphs and keeps the open quotes
and brackets; the end of the text is then taken apart from the back: marks of an interrupted
transfer (half an entity, half an escape, a replacement character, a link that never closes),
marks a limit leaves behind ("..." in brackets, an ellipsis), closing quotes, and the
terminator of the text's script. What the end alone can't tell is left to the baseline of its
source (feed and source type), or of the whole collection where the source has too few cases of
it (``SOURCE_LEAST``), counted in the same pass, each different text once however many copies
and deliveries it has:

* a last paragraph without terminator is a closing line (a sign-off) when paragraphs that
  open like it are usually unterminated last ones, in several episodes, and cut when they
  usually go on;
* an ellipsis is meant when sentences that open like this one often end with it inside texts;
* in scripts written without terminators the last letters must be ones that segments of
  the collection end with.

Cases: null is no value; an empty or blank text, one without letters, and one that ends with a
heading or list item is not cut; repeated rows give one result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import long_texts, map_batches
from wordloom.session import written
from wordloom.sources.tables import table

# Terminators of the scripts, and what may close a sentence behind one.
TERMINATORS = ".!?。！？．।॥؟۔…‥;;։።።፧។៕၊။᠃᠉｡"
CLOSERS = "\"'”’»›)]}）」』】〉》“‘*_"
OPENING = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "〈": "〉", "《": "》", "“": "”", "„": "“", "«": "»", "‹": "›"}
# Abbreviations that need a word behind them.
NEVER_LAST = {
    "dr", "prof", "mr", "mrs", "ms", "sr", "sra", "dra", "st", "e.g", "i.e", "z. b", "z.b", "d. h", "vs", "no", "nr", "fig", "cf",
    "approx", "aprox", "env", "ca", "sept", "т. е", "проф", "рис", "стр", "см", "г", "al", "pp", "vol", "κ", "π.χ", "д-р",
}
#: A closing line must have been seen in so many episodes, and so much more often last than inside.
LEAST_SEEN = 3
#: Different texts and places that a source's own baseline of a key needs; below, the collection's holds.
SOURCE_LEAST = 30
#: Keys up to which their table is broadcast (some 20 MB).
FEW_KEYS = 500_000
#: Parts into which values are dealt when they meet their baseline.
SALT = 16
#: Letters of an ending compared in scripts without terminators.
ENDING = 6

_BROKEN = regex.compile(
    r"(?:�+|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?|U[0-9A-Fa-f]{0,7})?|&(?:#?[A-Za-z0-9]{0,8})|\[[^\]\n]*\]\([^)\n]*|\[[^\]\n]*\]\(|<[/A-Za-z][^>\n]*|%[0-9A-Fa-f]?)$"
)
_LIMIT = regex.compile(r"[\[(<]\s*(?:\.{2,}|…|[\p{L} ]{0,20}(?:truncated|cut|continued|more)[\p{L} ]{0,20})\s*[\])>]$", regex.I)
_ELLIPSIS = regex.compile(r"(?:…|\.{3,})$")
_MARKS = regex.compile("[" + regex.escape("".join(OPENING) + "".join(OPENING.values())) + '"\n]')
_UNSPACED = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_SEGMENT_END = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{%d}(?=\n| (?=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])|$)" % ENDING)
_INNER_ELLIPSIS = regex.compile(r"…(?=[\s\p{Pf}\p{Pe}\"'])")
_ABBREVIATION = regex.compile(r"(?:^|[\s(“\"„«])((?:\p{L}\. ?)?[\p{L}.-]{1,7})\.$")
_INITIAL = regex.compile(r"(?:^|[\s(“\"])\p{Lu}\.$")


def open_marks(text: str) -> list[str]:
    """The stack of the automaton at the end of the text: quotes and brackets still open.

    A line break ends a paragraph, and with it what is open (marks don't span paragraphs).
    """
    stack: list[str] = []
    for m in _MARKS.finditer(text):
        c = m.group()
        if c == "\n":
            if m.end() < len(text):
                stack.clear()
        elif c == '"':
            if '"' in stack:
                del stack[stack.index('"') :]
            else:
                stack.append(c)
        elif stack and OPENING.get(stack[-1]) == c:
            stack.pop()
        elif c in OPENING:
            stack.append(c)
        elif c in ")]}」』】）" and any(OPENING.get(s) == c for s in stack):
            while OPENING.get(stack.pop()) != c:
                pass
    return stack


def opening(words: str) -> str:
    """How a paragraph opens: its first word, or its first mark with the word behind it left out."""
    first = words.split(None, 1)[0] if words.strip() else ""
    return first[0] if first and not first[0].isalnum() else first


def opening_of_sentence(sentence: str) -> str:
    """The first word of a sentence that isn't a name or number."""
    return next((w for w in regex.findall(r"[\p{L}\p{M}’'-]+", sentence) if w[0].islower()), "")


def last_sentence(paragraph: str) -> str:
    return regex.split(r"(?<=[.!?。！？।؟])\s+", paragraph)[-1]


def end_of(text: str) -> tuple[str, str]:
    """(verdict, key): 'whole', 'cut', or what the baseline must tell: 'closing', 'ellipsis', 'ending'."""
    body = text.rstrip()
    if not body or not any(map(str.isalpha, body)):
        return "whole", ""
    if _BROKEN.search(body):
        return "cut", ""
    limit = _LIMIT.search(body)
    if limit:
        body = body[: limit.start()].rstrip()
    last = body.rsplit("\n", 1)[-1].strip()
    if not any(map(str.isalpha, last)):
        return ("cut" if limit and last else "whole"), ""
    if regex.match(r"#{1,6} |[-•*–·] |\d+[.)] ", last):
        return ("cut" if limit else "whole"), ""
    unclosed = open_marks(body)
    core = last.rstrip(CLOSERS + " ")
    ellipsis = _ELLIPSIS.search(core)
    if ellipsis:
        return "ellipsis", opening_of_sentence(last_sentence(last))
    ended = core[-1:] in TERMINATORS and core != ""
    if ended and core.endswith("."):
        found = _ABBREVIATION.search(core)
        if (found and found.group(1).lower() in NEVER_LAST) or _INITIAL.search(core):
            ended = False
    if ended and not (unclosed and open_marks(last_sentence(last))):
        return "whole", ""
    if unclosed or limit:
        return "cut", ""
    if len(last) > 2 and OPENING.get(last[0]) == last[-1]:
        return "whole", ""
    if _UNSPACED.match(last[-1]):
        return "ending", last[-ENDING:]
    return "closing", opening(last)


def _read(batch: dict[str, list]) -> dict[str, list]:
    rows: list[tuple] = []
    known: set[tuple] = set()
    for eid, feed, kind, field, text in zip(batch["episode_id"], batch["feed_id"], batch["source_type"], batch["field"], batch["text"]):
        verdict, key = end_of(text)
        digest = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        rows.append((eid, feed, kind, field, verdict, key, digest, 1, 0))
        if (digest, feed, kind) in known:
            continue
        known.add((digest, feed, kind))
        paragraphs = [p for p in text.split("\n") if p and not p.isspace()]
        seen: Counter = Counter(("closing", k) for k in {opening(p) for p in paragraphs[:-1]})
        if "…" in text:
            for m in _INNER_ELLIPSIS.finditer(text):
                start = text.rfind("\n", 0, m.start()) + 1
                seen["ellipsis", opening_of_sentence(last_sentence(text[start : m.start()]))] += 1
        if _UNSPACED.search(text):
            ends = [m.group() for line in paragraphs if not line.startswith("#") for m in _SEGMENT_END.finditer(line)]
            seen.update(("ending", x) for x in ends[:-1])
        rows += [(None, feed, kind, None, verdict, key, digest, 0, n) for (verdict, key), n in seen.items()]
    names = ("episode_id", "feed_id", "source_type", "field", "verdict", "key", "digest", "last", "inside")
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def judged(episodes: DataFrame) -> DataFrame:
    """(episode_id, feed_id, source_type, field, cut): one row for each value."""
    read = written(
        map_batches(
            long_texts(episodes, keep=("feed_id", "source_type")),
            _read,
            "episode_id string, feed_id string, source_type string, field string, verdict string, key string, digest binary, last bigint, inside bigint",
        ),
        "p1-ends",
    )
    values = read.filter(F.col("episode_id").isNotNull()).drop("digest", "last", "inside").distinct()
    asked = F.col("verdict").isin("closing", "ellipsis", "ending")
    decided = values.filter(~asked).withColumn("cut", (F.col("verdict") == "cut").cast("int"))
    counted = asked_for(read.filter(asked), values.filter(asked))
    own, every = baseline(counted, "feed_id", "source_type"), baseline(counted)
    told = with_baseline(with_baseline(values.filter(asked), own, "own", "feed_id", "source_type"), every, "every")
    enough = F.col("own.n_last") + F.col("own.n_inside") >= SOURCE_LEAST
    base = F.when(enough, F.col("own")).otherwise(F.col("every"))
    usual = (
        F.when(F.col("verdict") == "closing", (base.n_episodes >= LEAST_SEEN) & (base.n_last > 2 * base.n_inside))
        .when(F.col("verdict") == "ellipsis", (base.n_inside > base.n_last) & (F.col("key") != ""))
        .otherwise(base.n_inside >= LEAST_SEEN)
    )
    told = told.withColumn("cut", (~usual).cast("int"))
    columns = ("episode_id", "feed_id", "source_type", "field", "cut")
    return decided.select(*columns).unionByName(told.select(*columns))


def asked_for(read: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of ``read`` whose key some value asks for, where these keys are few enough to be
    broadcast; else all rows, which gives the same result."""
    keys = written(values.select("verdict", "key").distinct(), "p1-keys")
    return read.join(F.broadcast(keys), ["verdict", "key"], "left_semi") if keys.count() <= FEW_KEYS else read


def baseline(read: DataFrame, *source: str) -> DataFrame:
    """By verdict and key, and by source where one is named: the different texts that end so, the
    places inside texts, and the episodes. Copies and deliveries of a text count once."""
    of_text = read.groupBy("verdict", "key", *source, "digest").agg(F.max("last").alias("last"), F.max("inside").alias("inside"))
    counts = of_text.groupBy("verdict", "key", *source).agg(F.sum("last").alias("n_last"), F.sum("inside").alias("n_inside"))
    episodes = read.filter(F.col("episode_id").isNotNull()).groupBy("verdict", "key", *source).agg(F.countDistinct("episode_id").alias("n_episodes"))
    both = counts.withColumn("n_episodes", F.lit(0).cast("bigint")).unionByName(episodes.select("verdict", "key", *source, F.lit(0).cast("bigint").alias("n_last"), F.lit(0).cast("bigint").alias("n_inside"), "n_episodes"))
    return both.groupBy("verdict", "key", *source).agg(*[F.sum(c).alias(c) for c in ("n_last", "n_inside", "n_episodes")])


def with_baseline(values: DataFrame, base: DataFrame, name: str, *source: str) -> DataFrame:
    """``values`` with the struct ``name`` of their baseline.

    Values that open with one word may be a third of all; so they join by salted keys: values
    are dealt into SALT parts, and each baseline row, one a key, goes to all of them.
    """
    keys = ("verdict", "key", *source)
    salted = values.withColumn("_salt", F.pmod(F.xxhash64("episode_id", "field"), F.lit(SALT)).cast("int"))
    right = base.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("n_last", "n_inside", "n_episodes").alias(name))
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    on = F.col("_salt") == F.col("_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return salted.join(right, on, "left").drop("_salt", "_part", *[f"_{k}" for k in keys])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value that was cut."""
    return judged(table(spark, folder, "episodes")).filter("cut = 1").select("episode_id", "field").distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """The share of cut values for each field, by feed and by source type."""
    rows = judged(table(spark, folder, "episodes"))
    by = F.explode(
        F.array(
            F.struct(F.lit("feed").alias("by"), F.col("feed_id").alias("source")),
            F.struct(F.lit("source_type").alias("by"), F.col("source_type").alias("source")),
        )
    )
    return (
        rows.select("field", "cut", by.alias("g"))
        .groupBy("field", "g.by", "g.source")
        .agg(F.count("*").alias("n_values"), F.sum("cut").alias("n_cut"))
        .withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 6))
    )


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
ORACLES: dict[str, str] = {}
