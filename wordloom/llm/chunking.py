"""Problem 6: cutting oversized texts at natural boundaries, with overlap.

Content-defined: a rolling hash over the bytes marks landmarks, about one in ``SPACING``
bytes. A piece ends at the natural boundary nearest to the first landmark between its least
and its largest size, so that after an edit the cuts of the unchanged text fall where they
fell before. Boundaries are ranked: behind a paragraph, behind a sentence, behind a word;
within the reach of a landmark the best rank wins, then the nearest. Without any boundary in
the allowed range the cut falls at the limit, at the start of a character. From the second
piece on, a piece opens with the last ``overlap`` bytes (or tokens) of the one before it, to
whole characters, within the size.

Cases: null and texts within the limit have no pieces; the pieces without their overlaps put
together give the text; repeated rows give one result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import TEXT_FIELDS, long_texts, map_batches
from wordloom.sources.tables import table

#: Bytes the rolling hash sees, and the mean distance of landmarks.
WINDOW = 32
SPACING = 512
#: A piece's least size, and the reach of a landmark, as a part of the largest size.
LEAST = 4
REACH = 12

_GEAR = np.random.default_rng(6).integers(0, 2**63, 256, dtype=np.uint64)
_SENTENCE_END = regex.compile(r"(?:[.!?।؟]['\"”’»)\]]*(?=\s)|[。！？]['\"”’」』）]*)\s*")
_SPACE = regex.compile(r"\s+")
_PARAGRAPH = regex.compile(r"\n\s*\n\s*")
# The characters that end a stretch without boundary.
_STOPS = regex.compile(r"[ \t\r\n.!?。！？।؟]+")


def landmarks(data: bytes) -> np.ndarray:
    """Byte positions behind which the rolling hash of the last WINDOW bytes hits."""
    b = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    h = np.zeros(len(b), dtype=np.uint64)
    for i in range(min(WINDOW, len(b))):
        h[i:] += b[: len(b) - i] << np.uint64(i)
    return np.flatnonzero((h >> np.uint64(20)) % np.uint64(SPACING) == 0) + 1


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(byte positions of natural cuts, their rank: 2 word, 1 sentence, 0 paragraph)."""
    rank: dict[int, int] = {m.end(): 2 for m in _SPACE.finditer(text)}
    rank.update((m.end(), 1) for m in _SENTENCE_END.finditer(text))
    rank.update((m.end(), 0) for m in _PARAGRAPH.finditer(text))
    rank.pop(0, None)
    at = np.array(sorted(rank), dtype=np.int64)
    ranks = np.array([rank[i] for i in at.tolist()], dtype=np.int64)
    return char_offsets(text)[at] if len(at) else at, ranks


def char_offsets(text: str) -> np.ndarray:
    """The byte position of each character, and of the end."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])


def cuts(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start of the piece with its overlap, its end), in bytes."""
    data = text.encode()
    total = len(data)
    if total <= most:
        return [(0, total)] if total else []
    starts = char_offsets(text)
    marks, (at, rank) = landmarks(data), boundaries(text)
    out, begin, opened = [], 0, 0
    while True:
        if total - opened <= most:
            out.append((opened, total))
            return out
        low, high = begin + most // LEAST, opened + most
        i, j = np.searchsorted(at, [low, high], side="left")
        j = np.searchsorted(at, high, side="right")
        if i == j:  # no boundary from the least size on: the last one before it, else a bare character
            k = np.searchsorted(at, begin, side="right")
            cut = int(at[i - 1]) if i > k and at[i - 1] > max(begin, opened) else int(starts[np.searchsorted(starts, high, side="right") - 1])
        else:
            here, ranks = at[i:j], rank[i:j]
            m = marks[np.searchsorted(marks, low) : np.searchsorted(marks, high, side="right")]
            if len(m):
                off = np.abs(here - m[0])
                near = off <= most // REACH
                pick = np.lexsort((off, np.where(near, ranks, 3)))[0]
                cut = int(here[pick])
            else:
                best = np.flatnonzero(ranks == ranks.min())
                cut = int(here[best[-1]])
        out.append((opened, cut))
        begin = cut
        opened = int(starts[np.searchsorted(starts, cut - overlap, side="left")]) if overlap else cut
        if opened <= out[-1][0]:
            opened = cut


def longest_stretch(text: str) -> int:
    """Bytes of the longest stretch without a place to cut at."""
    longest, last = 0, 0
    for m in _STOPS.finditer(text):
        if m.start() - last > longest // 4:
            longest = max(longest, len(text[last : m.start()].encode()))
        last = m.end()
    if len(text) - last > longest // 4:
        longest = max(longest, len(text[last:].encode()))
    return longest


def oversized(episodes: DataFrame, limits: DataFrame) -> DataFrame:
    """(episode_id, field, text, max_size, overlap) of the values above their field's limit in bytes."""
    bound = F.broadcast(
        limits.filter((F.col("purpose") == "speech_piece") & F.col("unit").contains("byte")).select("field", "max_size", F.col("overlap"))
    )
    long = long_texts(episodes).join(bound, "field").filter(F.octet_length("text") > F.col("max_size"))
    return long.select("episode_id", "field", "text", "max_size", "overlap")


_COLUMNS = "episode_id string, field string, piece_no int, start_byte bigint, overlap_bytes int, n_bytes int, longest_stretch int, max_size int, piece string"


def _cut(batch: dict[str, list]) -> dict[str, list]:
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    out: dict[str, list] = {n: [] for n in names}
    done = {}
    for eid, field, text, most, overlap in zip(*(batch[c] for c in ("episode_id", "field", "text", "max_size", "overlap"))):
        if done.get((eid, field)) == text:
            continue
        done = {(eid, field): text}
        data, stretch, end = text.encode(), longest_stretch(text), 0
        for n, (a, b) in enumerate(cuts(text, most, overlap)):
            row = (eid, field, n, a, max(0, end - a), b - a, stretch, most, data[a:b].decode())
            end = b
            for name, value in zip(names, row):
                out[name].append(value)
    return out


def pieces(episodes: DataFrame, limits: DataFrame) -> DataFrame:
    """Every piece, in order of ``piece_no`` by (episode_id, field)."""
    return map_batches(oversized(episodes, limits), _cut, _COLUMNS)


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized value, each once."""
    return (
        pieces(table(spark, folder, "episodes"), table(spark, folder, "text_limits"))
        .dropDuplicates(["episode_id", "field", "piece_no"])
        .drop("longest_stretch", "max_size")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value that had to be cut, and whether it has a stretch that can't be cut naturally."""
    return (
        pieces(table(spark, folder, "episodes"), table(spark, folder, "text_limits"))
        .select("episode_id", "field", (F.col("longest_stretch") > F.col("max_size")).cast("int").alias("no_boundary"))
        .distinct()
    )


QUERIES = {"p6_pieces": p6_pieces, "p6_found": p6_found}
ORACLES = {
    "p6_found": """WITH v AS (
  SELECT id, 'cleaned_text' AS field, cleaned_text AS text FROM episodes UNION ALL SELECT id, 'transcript', transcript FROM episodes
) SELECT DISTINCT id AS episode_id, field,
  CAST(list_max(list_transform(regexp_split_to_array(text, '[ \\t\\r\\n.!?。！？।؟]'), lambda x: strlen(x))) > 3600 AS INTEGER) AS no_boundary
FROM v WHERE text IS NOT NULL AND strlen(text) > 3600""",
}
assert TEXT_FIELDS == ("cleaned_text", "transcript")
