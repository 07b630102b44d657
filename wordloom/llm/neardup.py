"""Problem 7: near-duplicate texts, by a distributed prefix-tree join.

Texts become sets of word shingles. Equal sets are one class, numbered by the set's hash, so
that copies need no exchange to be told. Then, for a similarity (Jaccard) of at least ``t``:

1. A global order of shingles, rare first. Frequencies come from one sketch whose size follows
   the collection up to a bound (``SKETCH_BITS``); any order is correct, a better one is faster.
   A shingle alone in its cell is in no other set: it is left out, and what is left bounds the
   size of any partner.
2. Of each set only its prefix matters: two sets that reach ``t`` share at least ``l`` of the
   first ``n - ceil(t n) + l`` shingles. The prefix is dealt into lanes by hash; with
   ``l = (DEPTH - 1) lanes + 1`` some lane holds ``DEPTH`` shared shingles. Sets of LONG
   shingles and more have lanes by size class, so that a lane's path stays short however long
   a text is; a set enters the classes of all smaller sets it could match, and a pair meets in
   the class of its smaller set.
3. Each lane's ordered list is stored as paths of a trie. The rows below one first shingle
   form one subtree; subtrees are dealt over the partitions, one below a very frequent shingle
   in blocks of its rows, each pair of blocks to a partition. A task walks its subtrees from
   the root: rows alone at a node stop there, rows that share it go on to its children. Rows of
   a node are ordered by size, and only the range of sizes that a row's remaining length lets
   it match is listed at all; what is listed is held to the bound of both remaining lengths.
4. Pairs that share ``DEPTH`` nodes of a path are candidates. A bit for each shingle bounds what
   two sets can share and rules most of the others out; the whole sets of the rest are compared.

Sets too small for that bound (``n`` below ``small(t)``) share one shingle at least; they enter
the same trie with paths of one node. No candidate is capped, sampled or dropped.

Cases: texts of fewer words than a shingle (also null, empty, blank) have no set and are in no
pair and no class but their own; repeated rows of an id count once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import CHUNK, map_batches
from wordloom.session import dropped, written
from wordloom.sources.tables import table

#: Least and most bits of a cell's number in the frequency sketch (a byte a cell).
SKETCH_BITS = (20, 26)
#: Lanes of sets below LONG; from there on classes of sizes, each four times the one before.
LANES, LONG, RATIO = 24, 2048, 4
DEPTH = 3
SHARED = (DEPTH - 1) * LANES + 1
#: Prefix entries a task should hold, and entries a task sends on at once.
ENTRIES = 1_000_000
#: Rows of one first shingle in a block.
BLOCK = 20_000
NODE_BITS, TAIL_BITS = 24, 12
SUBTREE_COLUMNS = ("cids", "ns", "alone", "sizes", "nodes", "places", "mores", "longer", "tails")
MANY = 255
#: Least and most bits of a cell's number in the filter of classes that are in a pair (a bit a cell).
FILTER_BITS = (20, 28)
#: Ids of a class that one task pairs with the rest of it.
PART = 2000
#: Pairs of rows held at once while a node's rows are paired.
PAIRS = 400_000
#: A class is hot from this share of all rows on; so there are at most that many.
HOT = 1000

_WORD = re.compile(r"[^ \t\r\n\v\f\u0085  ]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """Hashes of words, kept from text to text up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_HASHES = _Hashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` lower-case words."""
    words = _WORD.findall(text.lower()) if text else []
    if len(words) < width:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = mixed(out + h[i : len(words) - width + 1 + i] + np.uint64(i + 1))
    return np.unique(out)


def small(t: float) -> int:
    """Below this size a set and its partners can't be held to SHARED common shingles."""
    return math.ceil(SHARED / t)


def size_class(n: int) -> int:
    """0 below LONG, then one more each time the size is RATIO times as large."""
    return 0 if n < LONG else 1 + int(math.log(n / LONG, RATIO) + 1e-9)


def lanes_of(size: int, t: float) -> int:
    """Lanes of a size class: fixed for the first, then in proportion to its least size, so
    that its sets hold DEPTH shingles in some lane for certain."""
    return LANES if size == 0 else int(LONG * RATIO ** (size - 1) * t * 3 / 16)


def least_overlap(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


# --- classes of equal sets ---------------------------------------------------


def class_number(s: np.ndarray) -> int | None:
    """64 bits of the set's 128-bit hash; None for a set without shingles."""
    return int.from_bytes(xxhash.xxh128_digest(s.tobytes())[:8], "little", signed=True) if len(s) else None


def signature(s: np.ndarray) -> bytes:
    """A bit for each shingle at its hash, in a power of two of at least two bits a shingle."""
    size = 1 << max(6, math.ceil(math.log2(2 * len(s))))
    bits = np.zeros(size, dtype=bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(n: int, x: bytes, m: int, y: bytes) -> int:
    """What two sets can share at most: each bit that only one has is a shingle of its own."""
    one, other, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 4 * max(len(x), len(y))
    while len(x) != len(y):  # the longer folds to half its size
        if len(x) > len(y):
            one, x = (one & ((1 << size) - 1)) | (one >> size), x[: len(x) // 2]
        else:
            other, y = (other & ((1 << size) - 1)) | (other >> size), y[: len(y) // 2]
        size //= 2
    return min(n - (one & ~other).bit_count(), m - (other & ~one).bit_count())


def class_rows(texts: DataFrame, width: int) -> DataFrame:
    """(id, cid, n, bits), written: the class of each row's text, the size and the signature of its set.

    The number of a class comes from its set, so that members need no exchange by class: a
    group of copies of any size is rows, never gathered. Of n classes two share a number with
    a chance of about n squared / 2^65.
    """

    def with_class(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "cid": [], "n": [], "bits": []}
        for id_, text in zip(batch["id"], batch["text"]):
            s = shingles(text, width)
            if len(s):
                for name, value in zip(out, (id_, class_number(s), len(s), signature(s))):
                    out[name].append(value)
        return out

    rows = map_batches(texts.select("id", "text").filter("id is not null"), with_class, "id string, cid bigint, n bigint, bits binary")
    return written(rows, "p7-rows")


def hot_classes(members: DataFrame) -> dict[int, str]:
    """The id that stands for each class of more than 1 / HOT of all ids: at most HOT classes."""
    total = members.count()
    sizes = members.groupBy("cid").agg(F.count("*").alias("size"), F.min("id").alias("id"))
    return {r["cid"]: r["id"] for r in sizes.filter(F.col("size") > max(total / HOT, HOT)).collect()}


class Sets:
    """The sets of a table (id, text), computed where a task reads the texts.

    No text is shuffled to fold copies: of hot classes only the chosen id's rows go on, other
    copies fold within a batch, and what is left of them meets again at a node and is one there.
    """

    def __init__(self, texts: DataFrame, width: int, hot: dict[int, str]) -> None:
        self.texts, self.width = texts.select("id", "text").filter("id is not null"), width
        self.hot = texts.sparkSession.sparkContext.broadcast(hot)

    def reader(self):
        """A function from a batch to (cid, set, text) of its different sets."""
        width, hot = self.width, self.hot

        def read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, str]]:
            seen = set()
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                for id_, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    s = shingles(text, width)
                    cid = class_number(s)
                    if cid is None or cid in seen or hot.value.get(cid, id_) != id_:
                        continue
                    seen.add(cid)
                    yield cid, s, text

        return read


# --- order, prefixes, subtrees -----------------------------------------------


def bits_for(total: int, bounds: tuple[int, int]) -> int:
    return min(max(math.ceil(math.log2(max(total, 2))), bounds[0]), bounds[1])


def cells_of(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def sketch(sets: Sets, bits: int) -> np.ndarray:
    """The frequency class of each hash cell: 0 for none, 1 for once, then by its logarithm.

    Counts are summed by block of cells; the result has one byte a cell.
    """
    cells, block = 1 << bits, 1 << 18
    read = sets.reader()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.uint8)
        for batch in batches:
            for _, s, _ in read(batch):
                own = cells_of(s, bits)
                total[own] += total[own] < 255
        for i in range(cells // block):
            part = total[i * block : (i + 1) * block]
            if part.any():
                packed = zlib.compress(part.tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": pa.array([packed], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = np.frombuffer(zlib.decompress(part), dtype=np.uint8)
                sums[i] = sums[i] + now if i in sums else now.astype(np.uint32)
        for i, total in sums.items():
            kind = np.where(total > 1, np.minimum(8 * np.log2(np.maximum(total, 1)) + 1, 255), total).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": pa.array([kind.tobytes()], pa.binary())})

    schema = "block int, counts binary"
    parts = sets.texts.mapInArrow(count, schema).repartition(max(1, cells // block), "block").mapInArrow(merge, schema)
    out = np.zeros(cells, dtype=np.uint8)
    for row in parts.toLocalIterator():  # one byte a cell in all
        out[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["counts"], dtype=np.uint8)
    return out


def prefix(s: np.ndarray, kinds: np.ndarray, t: float, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, their places in the global order of the set, their frequency classes) of the
    prefix that can be shared; ``kinds`` has the class of each shingle."""
    n = len(s)
    length = min(n, n - math.ceil(t * n - 1e-9) + shared)
    order = np.lexsort((s, kinds))[:length]
    keep = kinds[order] > 1  # a cell counted once holds a shingle no other set has
    return s[order][keep], np.arange(length)[keep], kinds[order][keep]


def planes(x: list[int]) -> bytes:
    """32-bit numbers byte plane by byte plane: planes of zeros take no room when compressed."""
    return np.array(x, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def packed_tails(x: np.ndarray) -> bytes:
    """Two 12-bit numbers in three bytes."""
    even = np.r_[x, np.zeros(len(x) % 2, dtype=x.dtype)].astype(np.uint32)
    both = even[0::2] | (even[1::2] << np.uint32(TAIL_BITS))
    return both.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked_tails(x: bytes, n: int) -> np.ndarray:
    three = np.frombuffer(x, dtype=np.uint8).reshape(-1, 3).astype(np.int64)
    both = three[:, 0] | (three[:, 1] << 8) | (three[:, 2] << 16)
    return np.stack([both & (2**TAIL_BITS - 1), both >> TAIL_BITS], axis=1).ravel()[:n]


Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def dealt(tokens: np.ndarray, kinds: np.ndarray, cid: int, size: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which entry, part, node) of entries by their first shingles.

    Below a shingle seen more than BLOCK times rows are dealt into blocks by their class, and
    an entry goes to each pair of blocks that its own is in.
    """
    seen = np.where(kinds > 8, 2.0 ** ((kinds.astype(np.float64) - 1) / 8), 1)
    blocks = np.ceil(seen / BLOCK).astype(np.int64)
    which = np.repeat(np.arange(len(tokens)), blocks)
    other = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = int(mixed(np.array([cid & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0] >> np.uint64(1)) % blocks[which]
    pair = np.minimum(own, other) * blocks[which] + np.maximum(own, other)
    h = mixed(mixed(tokens[which] + np.uint64(size)) + pair.astype(np.uint64))
    return which, ((h >> np.uint64(NODE_BITS)) % np.uint64(parts)).astype(np.int64), (h & np.uint64(2**NODE_BITS - 1)).astype(np.uint32)


def lane_entries(s: np.ndarray, kinds: np.ndarray, cid: int, size: int, t: float, parts: int) -> Entries:
    """(part, node, place, following, tails) of a set's paths in the lanes of one size class."""
    lanes = lanes_of(size, t)
    tokens, places, seen = prefix(s, kinds, t, (DEPTH - 1) * lanes + 1)
    lane = ((tokens >> np.uint64(8)) % np.uint64(lanes)).astype(np.int64)
    by_lane = np.argsort(lane, kind="stable")
    tokens, places, seen, lane = tokens[by_lane], places[by_lane], seen[by_lane], lane[by_lane]
    after = np.cumsum(np.bincount(lane, minlength=lanes))[lane] - np.arange(len(lane)) - 1
    mine = np.flatnonzero(after >= DEPTH - 1)
    which, part, node = dealt(tokens[mine], seen[mine], cid, size, parts)
    mine = mine[which]
    more = after[mine]
    follow = np.repeat(mine + 1 - (np.cumsum(more) - more), more) + np.arange(more.sum())
    return part, node, places[mine], more, ((tokens[follow] >> np.uint64(32)) & np.uint64(2**TAIL_BITS - 1)).astype(np.uint16)


def entries_of(s: np.ndarray, kinds: np.ndarray, cid: int, t: float, parts: int) -> Entries:
    """All entries of a set: its lanes in each size class it can meet, and paths of one node
    where a small set may be met; those have no following nodes."""
    n, least = len(s), small(t)
    found: list[Entries] = []
    if n >= least:
        for size in range(size_class(max(least, math.ceil(t * n - 1e-9))), size_class(n) + 1):
            found.append(lane_entries(s, kinds, cid, size, t, parts))
    if n < least / t:  # may meet a small set: one shared shingle is enough
        tokens, places, seen = prefix(s, kinds, t, 1)
        which, part, node = dealt(tokens, seen, cid, -1 & 0xFFFF, parts)
        found.append((part, node, places[which], np.zeros(len(which), dtype=np.int64), np.empty(0, dtype=np.uint16)))
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found))


def subtree_rows(sets: Sets, counts, bits: int, t: float, parts: int) -> DataFrame:
    """(part, cids, ns, alone, sizes, nodes, places, mores, longer, tails): paths in one
    partition's subtrees.

    A row holds those of many sets (their numbers, sizes, shingles alone in their cell, and
    numbers of entries), so that a set costs few bytes beside its entries. An entry is 24 bits
    of its first node (a partition holds about ENTRIES entries, however many there are in all),
    its place in the set in 256ths, and the number of nodes that follow; MANY stands for a
    number that ``longer`` has. ``tails`` has the following nodes, 12 bits each: chance matches
    only add candidates.
    """
    read = sets.reader()

    def rows(held: list[tuple[int, int, int, Entries]]) -> Iterator[dict[str, list]]:
        count = np.array([len(e[0]) for *_, e in held])
        part, node, place, more, tails = (np.concatenate(x) for x in zip(*[e for *_, e in held]))
        who = np.repeat(np.arange(len(held)), count)
        n = np.repeat(np.array([x[1] for x in held]), count)
        order = np.argsort(part, kind="stable")
        at = (np.cumsum(more) - more)[order]
        part, node, who, more = part[order], node[order], who[order], more[order]
        place = (place[order] * 256 // n[order]).astype(np.uint8)
        tails = tails[np.repeat(at - (np.cumsum(more) - more), more) + np.arange(more.sum())]
        short = np.minimum(more, MANY).astype(np.uint8)
        tail_at = np.r_[0, np.cumsum(more)]
        cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            first = a + np.flatnonzero(np.r_[True, who[a + 1 : b] != who[a : b - 1]])
            own = [held[i] for i in who[first].tolist()]
            values = (
                int(part[a]),
                np.array([x[0] for x in own], dtype=np.int64).tobytes(),
                planes([x[1] for x in own]),
                planes([x[2] for x in own]),
                planes(np.diff(np.r_[first, b]).tolist()),
                node[a:b].view(np.uint8).reshape(-1, 4)[:, :3].tobytes(),
                place[a:b].tobytes(),
                short[a:b].tobytes(),
                more[a:b][short[a:b] == MANY].astype(np.uint32).tobytes(),
                packed_tails(tails[tail_at[a] : tail_at[b]]),
            )
            yield {c: [v] for c, v in zip(("part", *SUBTREE_COLUMNS), values)}

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, Entries]] = []
        waiting = 0
        for batch in batches:
            for cid, s, _ in read(batch):
                kinds = counts.value[cells_of(s, bits)]
                alone = int((kinds <= 1).sum())
                if len(s) - alone < math.ceil(t * len(s) - 1e-9):
                    continue  # what other sets may have of it can't reach t
                own = entries_of(s, kinds, cid, t, parts)
                if len(own[0]):
                    held.append((cid, len(s), alone, own))
                    waiting += len(own[0])
                if waiting >= ENTRIES:
                    for row in rows(held):
                        yield pa.RecordBatch.from_pydict(row, schema=target)
                    held, waiting = [], 0
        if held:
            for row in rows(held):
                yield pa.RecordBatch.from_pydict(row, schema=target)

    target = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in SUBTREE_COLUMNS]])
    return sets.texts.mapInArrow(paths, "part int, " + ", ".join(f"{c} binary" for c in SUBTREE_COLUMNS))


# --- the walk ----------------------------------------------------------------


class Subtrees:
    """The decoded rows of one partition: sets, and entries that point at them."""

    def __init__(self, rows: list[tuple[bytes, ...]], t: float) -> None:
        cid, n, alone, sizes = [], [], [], []
        node, place, more, tails = [], [], [], []
        for cids, ns, us, counts, nodes, places, mores, longer, flat in rows:
            cid.append(np.frombuffer(cids, dtype=np.int64))
            n.append(unplanes(ns))
            alone.append(unplanes(us))
            sizes.append(unplanes(counts))
            three = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
            node.append(three[:, 0] | (three[:, 1] << 8) | (three[:, 2] << 16))
            place.append(np.frombuffer(places, dtype=np.uint8))
            following = np.frombuffer(mores, dtype=np.uint8).astype(np.int32)
            following[following == MANY] = np.frombuffer(longer, dtype=np.uint32)
            more.append(following)
            tails.append(unpacked_tails(flat, int(following.sum())).astype(np.uint16))
        self.cid, first, local = np.unique(np.concatenate(cid), return_index=True, return_inverse=True)
        self.n, self.alone = np.concatenate(n)[first], np.concatenate(alone)[first]
        self.own = np.repeat(local, np.concatenate(sizes)).astype(np.int32)
        self.node, self.place, self.more, self.tails = (np.concatenate(x) for x in (node, place, more, tails))
        self.at = np.cumsum(self.more, dtype=np.int64) - self.more
        self.t = t
        #: The largest partner that a set's shingles beside those it has alone allow.
        self.reach = np.floor(np.minimum(self.n / t, (1 + t) / t * (self.n - self.alone) - self.n) + 1e-9).astype(np.int64)

    def listed(self, rows: np.ndarray, key: np.ndarray, subtree: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, subtree) of sets that share a key, in blocks; all of one set in one subtree
        are in one block. ``rows`` are entries; bounds of sizes and remaining lengths hold."""
        own, t = self.own[rows], self.t
        order = np.lexsort((own, self.n[own], key))
        order = order[np.r_[True, (key[order][1:] != key[order][:-1]) | (own[order][1:] != own[order][:-1])]] if len(order) else order
        rows, key, subtree, own = rows[order], key[order], subtree[order], own[order]
        n = self.n[own]
        _, dense = np.unique(key, return_inverse=True)
        ranked = (dense.astype(np.int64) << 32) + n
        end = np.searchsorted(ranked, (dense.astype(np.int64) << 32) + np.maximum(self.reach[own], 0), side="right")
        fan = np.maximum(end - np.arange(len(own)) - 1, 0)
        low = self.place[rows].astype(np.int64) * n
        place = (low + 255) >> 8
        before = ((low + n + 255) >> 8) - 1 - self.alone[own]
        left = np.flatnonzero(fan)
        left = left[np.lexsort((own[left], subtree[left]))]
        edges = np.r_[np.flatnonzero(np.r_[True, (own[left][1:] != own[left][:-1]) | (subtree[left][1:] != subtree[left][:-1])]), len(left)] if len(left) else np.zeros(1, dtype=np.int64)
        total = np.r_[0, np.cumsum(fan[left])]
        e = 0
        while e < len(edges) - 1:
            f = max(e + 1, int(np.searchsorted(total[edges], total[edges[e]] + PAIRS, side="right")) - 1)
            block = left[edges[e] : edges[f]]
            e = f
            a = np.repeat(block, fan[block])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(fan[block]) - fan[block], fan[block])
            # before the node no more than the lesser place is shared, from it on no more than the shorter rest
            most = np.minimum(before[a], before[b]) + np.minimum(n[a] - place[a], n[b] - place[b])
            ok = (most >= least_overlap(n[a], n[b], t)) & (n[a] <= self.reach[own[b]])
            a, b = a[ok], b[ok]
            yield own[a].astype(np.int64), own[b].astype(np.int64), subtree[a]


def shared_nodes(keys: np.ndarray) -> np.ndarray:
    """The places of the keys that occur more than once, by key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    return order[same[:-1] | same[1:]]


def walk(rows: list[tuple[bytes, ...]], t: float) -> np.ndarray:
    """Candidate pairs (cid, cid) of one partition's subtrees, each once."""
    trie = Subtrees(rows, t)
    count = np.int64(len(trie.cid))
    found = [np.empty(0, dtype=np.int64)]

    def keep(code: np.ndarray) -> None:
        found.append(np.unique(code))
        if sum(map(len, found)) > 4 * len(found[0]) + 1_000_000:
            found[:] = [np.unique(np.concatenate(found))]

    # paths of one node: a pair with a small set needs no more
    one = np.flatnonzero(trie.more == 0)
    one = one[shared_nodes(trie.node[one])]
    for x, y, _ in trie.listed(one, trie.node[one], trie.node[one]):
        pair = trie.n[x] < small(t)  # x is the smaller
        keep(x[pair] * count + y[pair])
    # longer paths, some first nodes at a time: a pair goes on that shares DEPTH - 1 children of its node
    deep = np.flatnonzero(trie.more > 0)
    deep = deep[shared_nodes(trie.node[deep])]
    below = np.cumsum(trie.more[deep], dtype=np.int64)
    last = np.flatnonzero(np.r_[trie.node[deep][1:] != trie.node[deep][:-1], True]) + 1 if len(deep) else np.zeros(0, dtype=np.int64)
    start = 0
    while start < len(deep):
        done = below[start - 1] if start else 0
        k = max(np.searchsorted(below[last - 1], done + ENTRIES, side="right") - 1, np.searchsorted(last, start, side="right"))
        stop = int(last[k])
        above = deep[start:stop]
        start = stop
        who = np.repeat(np.arange(len(above)), trie.more[above])
        step = np.arange(len(who)) - np.repeat(np.cumsum(trie.more[above]) - trie.more[above], trie.more[above])
        child = (trie.node[above][who].astype(np.int64) << TAIL_BITS) | trie.tails[trie.at[above][who] + step]
        some = shared_nodes(child)
        for x, y, where in trie.listed(above[who[some]], child[some], child[some] >> TAIL_BITS):
            code = x * count + y
            met = mixed(where.astype(np.uint64) * _M3 + code.astype(np.uint64))
            _, first, times = np.unique(met, return_index=True, return_counts=True)
            keep(code[first[times >= DEPTH - 1]])
    code = np.unique(np.concatenate(found))
    return np.stack([trie.cid[code // max(1, count)], trie.cid[code % max(1, count)]], axis=1)


def candidates(rows: DataFrame, t: float, parts: int) -> DataFrame:
    """(a, b), a < b: pairs of classes that share enough nodes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, ...]] = []
        for batch in batches:
            held += zip(*[batch.column(i + 1).to_pylist() for i in range(len(SUBTREE_COLUMNS))])
        if held:
            out = np.sort(walk(held, t), axis=1)
            yield pa.RecordBatch.from_pydict({"a": pa.array(out[:, 0], pa.int64()), "b": pa.array(out[:, 1], pa.int64())})

    return rows.repartitionById(parts, "part").mapInArrow(run, "a bigint, b bigint").distinct()


# --- whole sets compared -----------------------------------------------------


def members_filter(pairs: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of a class in a pair; ``bits`` of a cell's number bound its size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            for column in (0, 1):
                held[filter_cell(batch.column(column).to_numpy(), bits)] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in pairs.select("a", "b").coalesce(16).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def filter_cell(cid: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(cid.astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)


def likely(pairs: DataFrame, rows: DataFrame, t: float) -> DataFrame:
    """The candidates whose signatures leave it open that they reach ``t``; none else is dropped."""
    one = rows.select("cid", "n", "bits").groupBy("cid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    left = one.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = one.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))

    def compare(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, n, x, m, y in zip(*(batch[c] for c in ("a", "b", "n_a", "bits_a", "n_b", "bits_b"))):
            if most_shared(n, x, m, y) * (1 + t) >= t * (n + m) - 1e-9:
                out["a"].append(a)
                out["b"].append(b)
        return out

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b"), compare, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: Sets, t: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose whole sets reach ``t``.

    Only the texts of classes in some pair are shuffled: a filter of bounded size drops most of
    the others first, the joins are exact.
    """
    bits = bits_for(16 * pairs.count(), FILTER_BITS)
    held = sets.texts.sparkSession.sparkContext.broadcast(members_filter(pairs, bits))
    read, width = sets.reader(), sets.width

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, texts = [], []
            for cid, _, text in read(batch):
                cids.append(cid)
                texts.append(text)
            at = filter_cell(np.array(cids, dtype=np.int64), bits)
            out = pa.RecordBatch.from_pydict({"cid": pa.array(cids, pa.int64()), "text": pa.array(texts, pa.string())})
            yield out.filter(pa.array((held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).cast(pa.bool_()))

    some = sets.texts.mapInArrow(needed, "cid bigint, text string").groupBy("cid").agg(F.first("text").alias("text"))
    left = some.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = some.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))

    def compare(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": [], "similarity": []}
        known: dict[int, np.ndarray] = {}  # of one batch
        for a, b, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
            for c, text in ((a, x), (b, y)):
                if c not in known:
                    known[c] = shingles(text, width)
            one, other = known[a], known[b]
            both = len(np.intersect1d(one, other, assume_unique=True))
            similarity = both / (len(one) + len(other) - both)
            if similarity >= t - 1e-12:
                out["a"].append(a)
                out["b"].append(b)
                out["similarity"].append(similarity)
        return out

    return map_batches(pairs.join(left, "a").join(right, "b"), compare, "a bigint, b bigint, similarity double")


def similar_classes(texts: DataFrame, width: int = 5, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members: id, cid, n; pairs: a, b, similarity between classes) of a table (id, text)."""
    spark = texts.sparkSession
    by_row = class_rows(texts, width)
    members = written(by_row.select("id", "cid", "n").distinct(), "p7-members")
    total = members.agg(F.sum("n")).first()[0] or 0
    sets = Sets(texts, width, hot_classes(members))
    bits = bits_for(total // 2, SKETCH_BITS)
    counts = spark.sparkContext.broadcast(sketch(sets, bits))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (1 - t + 0.1) / ENTRIES), 1)
    rows = subtree_rows(sets, counts, bits, t, parts)
    found = written(candidates(rows, t, parts), "p7-candidates")
    open_ = written(likely(found, by_row, t), "p7-likely")
    dropped(found)
    dropped(by_row)
    pairs = written(verified(open_, sets, t), "p7-pairs")
    dropped(open_)
    return members, pairs


# --- groups and pairs of ids ---------------------------------------------------


def attached(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right``, one row a key there; nulls where it has none.

    Keys of more than 1 / HOT of the left rows, at most HOT, take their row from a broadcast;
    so no task gets all rows of a hot key. A null key meets nothing.
    """
    often = left.groupBy(key).agg(F.count("*").alias("_rows"))
    total = often.agg(F.sum("_rows")).first()[0] or 0
    hot = [r[0] for r in often.filter((F.col("_rows") > max(total / HOT, HOT)) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    of_hot = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, "left")
    return of_hot.unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key, "left"))


def class_labels(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels: cid, label; links: cid, n_links) of the classes in a pair; the label is the
    least class number in reach.

    Labels spread along edges and jump along labels until a round moves none; each round is
    written and compared, and only one count reaches the driver.
    """
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "p7-edges")
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "cid")
    before = labels = written(labels, "p7-labels")
    moved = 1
    while moved:
        near = attached(edges.withColumnRenamed("b", "cid"), labels, "cid").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.cid == near.a).select("cid", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        hop = labels.select(F.col("cid").alias("label"), F.col("label").alias("root"))
        now = written(
            attached(spread, hop, "label").select("cid", F.least("label", "root").alias("label"), (F.least("label", "root") != F.col("was")).alias("moved")), "p7-labels"
        )
        moved = now.filter("moved").limit(1).count()
        dropped(before)
        before, labels = now, now.select("cid", "label")
    return labels, edges.groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "cid")


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id, group_no, group_size, n_links): connected classes, the least class number
    in reach and the least id in the group.

    A class of copies is one node, so that a group of copies takes no rounds; ids take what
    their class has, hot classes from a broadcast.
    """
    labels, links = class_labels(pairs)
    sized = members.groupBy("cid").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    by_class = sized.join(labels, "cid", "left").join(links, "cid", "left")
    by_class = written(by_class.select("cid", "size", "least", F.coalesce("label", "cid").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "p7-classes")
    named = by_class.groupBy("group_id").agg(F.min("least").alias("group_no"), F.sum("size").alias("group_size"))
    placed = written(attached(by_class.select("cid", "group_id", "n_links"), named, "group_id"), "p7-groups")
    return attached(members.select("id", "cid"), placed, "cid").select("id", "group_id", "group_no", "group_size", "n_links")


def large_classes(members: DataFrame) -> DataFrame:
    """(cid, parts) of the classes that are dealt into more than one part of PART ids."""
    sizes = members.groupBy("cid").agg(F.count("*").alias("size")).filter(F.col("size") > PART)
    return sizes.select("cid", F.ceil(F.col("size") / PART).cast("int").alias("parts"))


def _part(column: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(column), F.col(parts)).cast("int")


def pairs_within(members: DataFrame) -> DataFrame:
    """(x, y), x < y: all pairs of ids in one class.

    A large class is dealt into parts of about PART ids: one side keeps to its part, the other
    goes to all parts, so that no task pairs a whole large class.
    """
    sizes = members.groupBy("cid").agg(F.count("*").alias("size")).filter("size > 1")
    parts = sizes.select("cid", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    large = members.join(parts, "cid")
    left = large.select("cid", F.col("id").alias("x"), _part("id", "parts").alias("part"))
    right = large.select("cid", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["cid", "part"]).filter("x < y").select("x", "y")


def pairs_across(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y): all pairs of ids of two classes that are a pair (a, b).

    Ids of a large class a are dealt into parts, each of which meets the ids of b anew.
    """
    a = members.select(F.col("id").alias("x"), F.col("cid").alias("a"))
    b = members.select(F.col("id").alias("y"), F.col("cid").alias("b"))
    large = large_classes(members)
    if not large.limit(1).count():
        return pairs.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    one = F.coalesce("parts", F.lit(1))
    sized = pairs.select("a", "b").join(large.withColumnRenamed("cid", "a"), "a", "left").withColumn("parts", one)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    a = a.join(large.withColumnRenamed("cid", "a"), "a", "left").withColumn("parts", one).select("a", "x", _part("x", "parts").alias("part"))
    most = sized.groupBy("b").agg(F.max("parts").alias("parts"))
    b = b.join(most, "b").select("b", "y", every)
    return sized.select("a", "b", every).join(a, ["a", "part"]).join(b, ["b", "part"]).select("x", "y")


# --- queries -------------------------------------------------------------------


def raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "episodes").select("id", F.col("raw_text").alias("text")).filter("text is not null")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of episodes whose three-word shingles reach a similarity of 0.5.

    All pairs are the definition's form; ``p7_groups`` is the form for large groups of copies.
    """
    members, pairs = similar_classes(raw_texts(spark, folder), 3, 0.5)
    return (
        pairs_across(members, pairs)
        .unionByName(pairs_within(members))
        .select(F.least("x", "y").alias("episode_id_a"), F.greatest("x", "y").alias("episode_id_b"))
        .filter("episode_id_a <> episode_id_b")
        .distinct()
    )


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """A group for each episode: five words, similarity 0.8 or more, closed over links.

    The group's number is the least episode id in it; an episode without text is its own group.
    """
    members, pairs = similar_classes(raw_texts(spark, folder))
    every = table(spark, folder, "episodes").select("id").distinct().filter("id is not null")
    return every.join(groups(members, pairs), "id", "left").select(
        F.col("id").alias("episode_id"),
        F.coalesce("group_no", "id").alias("group_no"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}
ORACLES: dict[str, str] = {}
