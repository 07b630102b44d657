"""Problem 3: page furniture mixed with the main text of web pages.

A page is a list of flat text blocks, its lines. Each block is described by its word count and
link density (how much of it is separators and capitals, as links leave in plain text), those
of its neighbours, its place among the long blocks, how many pages carry the same block, and
what its words say about furniture. Decision trees, each fitted on a
resample of one small labelled table, decide by their mean.

The labelled table is a bounded sample of pages of the input (``SAMPLE_PAGES``, chosen by the
hash of their id) whose service-made ``cleaned_text`` still matches every long block: a
block found in it is article text. Sentences between article blocks that the cleaning left
out count as article, since furniture there isn't a whole sentence. Only the fit sees
``cleaned_text``; the classification reads ``raw_text`` and ``title`` alone, over all pages.
How many pages carry a block is counted over all pages in a table of fixed size.

Cases: null and blank texts have no lines; blank lines are of no class; without any labelled
page (an empty table) nothing is furniture; repeated rows give one result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import cart
from wordloom.llm.common import map_batches
from wordloom.sources.tables import table

#: Bounds of the labelled table and of the table of block counts.
SAMPLE_PAGES = 1500
SKETCH_BITS = 20
#: A block of so many words (or half as many wide characters) is long.
LONG = 22

_DIGITS = regex.compile(r"\d+")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Hangul}]")
_END = regex.compile(r"[.!?。！？।؟…;:,]['\"”’»)\]]*$")
_BULLET = regex.compile(r"[-•*‣–·] ?|\d+[.)] ")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_PLAIN = regex.compile(r"\W+")
N_FEATURES = 38


def cell(line: str) -> int:
    return xxhash.xxh64_intdigest(_DIGITS.sub("9", line.strip().lower())) >> (64 - SKETCH_BITS)


def block_counts(pages: DataFrame) -> np.ndarray:
    """How many blocks of all pages fall in each cell; the table's size is fixed."""
    cells, size = 1 << SKETCH_BITS, 1 << 15

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = [cell(line) for line in set(text.split("\n")) if line and not line.isspace()]
                np.add.at(total, own, 1)
        rows = [(i, total[i * size : (i + 1) * size]) for i in range(cells // size)]
        rows = [(i, p.tobytes()) for i, p in rows if p.any()]
        yield pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows], pa.int32()), "counts": pa.array([r[1] for r in rows], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = np.frombuffer(part, dtype=np.uint32).astype(np.uint64)
                sums[i] = now if i not in sums else sums[i] + now
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({"block": pa.array(keys, pa.int32()), "counts": pa.array([sums[k].tobytes() for k in keys], pa.binary())})

    schema = "block int, counts binary"
    out = np.zeros(cells, dtype=np.uint64)
    for row in pages.select("raw_text").mapInArrow(count, schema).repartition(cells // size, "block").mapInArrow(merge, schema).collect():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["counts"], dtype=np.uint64)
    return out


def plain(line: str) -> str:
    return _PLAIN.sub(" ", line).strip().lower()


class Words:
    """What the words of a block say: log odds of furniture, from the labelled table."""

    def __init__(self, lines: list[str], furniture: list[int]) -> None:
        often = Counter(w for line in lines for w in set(_TOKEN.findall(line.lower())))
        self.common = {w for w, n in often.items() if n >= 20}
        self.odds = self._odds([set(_TOKEN.findall(line.lower())) for line in lines], furniture, 4)
        self.forms = self._odds([{self.form(line)} for line in lines], furniture, 3)

    @staticmethod
    def _odds(keys: list[set[str]], furniture: list[int], least: int) -> dict[str, float]:
        seen, total = (Counter(), Counter()), [1, 1]
        for own, y in zip(keys, furniture):
            seen[y].update(own)
            total[y] += 1
        return {
            k: math.log((seen[1][k] + 1) / total[1]) - math.log((seen[0][k] + 1) / total[0])
            for k in set(seen[0]) | set(seen[1])
            if seen[0][k] + seen[1][k] >= least
        }

    def form(self, line: str) -> str:
        """The block's opening with names, numbers and rare words made equal, and its length."""
        out = []
        for t in line.split()[:4]:
            w = t.strip(".,:;!?()\"'“”").lower()
            out.append(w if w in self.common else "9" if t[:1].isdigit() else "N" if t[:1].isupper() else "x" if t[:1].isalpha() else t[:2])
        return " ".join(out) + f" {min(len(line.split()), 12)}"

    def of(self, line: str) -> tuple[float, float, float, float, float]:
        """(first, mean, least, most) of the block's known words, and that of its form."""
        odds = [self.odds.get(w, 0.0) for w in _TOKEN.findall(line.lower())]
        form = self.forms.get(self.form(line), 0.0)
        return (odds[0], sum(odds) / len(odds), min(odds), max(odds), form) if odds else (3.0, 0.0, 0.0, 0.0, form)


def features(text: str, title: str | None, counts: np.ndarray, words: Words) -> tuple[list[int], np.ndarray]:
    """(numbers of the non-blank lines, their features)."""
    lines = text.split("\n")
    numbers = [i for i, line in enumerate(lines) if line and not line.isspace()]
    own = [lines[i].strip() for i in numbers]
    n = len(own)
    x = np.zeros((n, N_FEATURES))
    name = plain(title or "")
    for k, line in enumerate(own):
        tokens = line.split()
        wide = len(_WIDE.findall(line)) if not line.isascii() else 0
        size = len(tokens) + wide / 2
        marks = sum(not any(c.isalnum() for c in t) for t in tokens)
        capital = sum(t[0].isupper() for t in tokens)
        bare = plain(line)
        x[k, :13] = (
            size,
            marks / len(tokens) + line.count("  ") / len(tokens),
            capital / len(tokens),
            bool(_END.search(line)),
            line[0].islower(),
            bool(_BULLET.match(line)),
            ":" in line[:40],
            sum(c.isdigit() for c in line) / len(line),
            math.log1p(counts[cell(line)]),
            bare == name and name != "",
            name != "" and name in bare,
            "@" in line or "©" in line or "://" in line,
            ">" in line or "|" in line or "›" in line or "·" in line,
        )
        *x[k, 13:17], x[k, 37] = words.of(line)
        x[k, 34] = " > " in line
        x[k, 35] = x[k, 14] * min(len(tokens), 12)
        x[k, 36] = x[k, 9] if not name.isascii() or len(name.split()) > 2 else 0
        i = numbers[k]
        x[k, 17] = i > 0 and not lines[i - 1].strip()
        x[k, 18] = i + 1 < len(lines) and not lines[i + 1].strip()
    if not n:
        return numbers, x
    long = (x[:, 0] >= LONG) & (x[:, 3] > 0) & (x[:, 1] < 0.1)
    at = np.flatnonzero(long)
    place = np.arange(n)
    if len(at):
        before = np.searchsorted(at, place, side="left")
        after = np.searchsorted(at, place, side="right")
        x[:, 19] = np.where(before > 0, place - at[np.maximum(before - 1, 0)], 99)
        x[:, 20] = np.where(after < len(at), at[np.minimum(after, len(at) - 1)] - place, 99)
    else:
        x[:, 19:21] = 99
    x[:, 21] = place
    x[:, 22] = n - place
    titled = np.flatnonzero(x[:, 9] > 0)
    x[:, 23] = place - titled[0] if len(titled) else 99
    for column, source in ((24, 0), (25, 1), (26, 3), (27, 14), (28, 8)):
        x[1:, column] = x[:-1, source]
    for column, source in ((29, 0), (30, 1), (31, 3), (32, 14), (33, 8)):
        x[:-1, column] = x[1:, source]
    return numbers, x


def labels(text: str, title: str | None, cleaned: str) -> list[int] | None:
    """1 for furniture, by non-blank line; None where the cleaned text doesn't match the page."""
    known = {plain(line) for line in cleaned.split("\n")} - {""}
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    article = [plain(line) in known or plain(line) == plain(title or "") for line in lines]
    long = [k for k, line in enumerate(lines) if len(line.split()) + len(_WIDE.findall(line)) / 2 >= LONG and _END.search(line)]
    if not long or not all(article[k] or len(lines[k].split()) < 30 for k in long) or not any(article[k] for k in long):
        return None
    body = [k for k in long if article[k]]
    out = []
    for k, line in enumerate(lines):
        whole = _END.search(line) and line[-1:] != ":" and len(line.split()) >= 8
        out.append(int(not (article[k] or (whole and body[0] < k < body[-1]))))
    return out


def model(pages: DataFrame, counts: np.ndarray) -> tuple[list[dict[str, np.ndarray]], Words]:
    """(trees, words), fitted on at most SAMPLE_PAGES pages."""
    # the ids come first, thinned by hash, so that tasks send few short rows to the driver
    whole = pages.filter(F.col("cleaned_text").isNotNull()).select("id", "raw_text", "title", "cleaned_text")
    thin = max(1, whole.count() // (8 * SAMPLE_PAGES))
    order = F.xxhash64("id")
    ids = whole.filter(F.pmod(order, F.lit(thin)) == 0).select("id").distinct().orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE_PAGES)
    chosen = [r["id"] for r in ids.collect()]
    sample = sorted(whole.filter(F.col("id").isin(chosen)).collect(), key=lambda r: (r["id"] or "", r["raw_text"])) if chosen else []
    known = [(r, y) for r in {r["id"]: r for r in sample}.values() if (y := labels(r["raw_text"], r["title"], r["cleaned_text"])) is not None]
    lines = [line.strip() for r, _ in known for line in r["raw_text"].split("\n") if line.strip()]
    truth = [v for _, y in known for v in y]
    words = Words(lines, truth)
    x = [features(r["raw_text"], r["title"], counts, words)[1] for r, _ in known]
    return cart.fit_bagged(np.concatenate(x) if x else np.zeros((0, N_FEATURES)), np.array(truth, dtype=float)), words


def classified(pages: DataFrame) -> DataFrame:
    """(episode_id, line_no, furniture, line) of every non-blank line of the pages."""
    pages = pages.filter(F.col("raw_text").isNotNull())
    counts = block_counts(pages)
    tree, words = model(pages, counts)
    shared = pages.sparkSession.sparkContext.broadcast((counts, tree, words))

    def run(batch: dict[str, list]) -> dict[str, list]:
        counts_, tree_, words_ = shared.value
        ids, numbers, lines, rows = [], [], [], []
        for eid, text, title in zip(batch["id"], batch["raw_text"], batch["title"]):
            own, x = features(text, title, counts_, words_)
            split = text.split("\n")
            ids += [eid] * len(own)
            numbers += [i + 1 for i in own]
            lines += [split[i] for i in own]
            rows.append(x)
        share = cart.predict_bagged(tree_, np.concatenate(rows)) if rows else np.zeros(0)
        return {"episode_id": ids, "line_no": numbers, "furniture": (share >= 0.5).astype(int).tolist(), "line": lines}

    return map_batches(pages.select("id", "raw_text", "title"), run, "episode_id string, line_no int, furniture int, line string")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "episodes").filter("source_type = 'article'")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of a web article's page that is not part of the article."""
    return classified(articles(spark, folder)).filter("furniture = 1").select("episode_id", "line_no").distinct()


def p3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of each page: its lines, in order."""
    lines = classified(articles(spark, folder)).filter("furniture = 0").select("episode_id", "line_no", "line").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("episode_id").agg(ordered.alias("l")).select("episode_id", F.array_join(F.col("l.line"), "\n").alias("main_text"))


QUERIES = {"p3_found": p3_found, "p3_main_text": p3_main_text}
ORACLES: dict[str, str] = {}
