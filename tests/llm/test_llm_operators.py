"""The operators on small tables: brute force, dirty rows, empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wordloom.llm import neardup, queries
from wordloom.sources import tables


@pytest.fixture(scope="module")
def small(spark, data, tmp_path_factory):
    """Tables with nulls, empty and very long texts, repeated rows, and clashing extra columns."""
    folder = tmp_path_factory.mktemp("dirty")
    extra = [F.lit("x").alias(c) for c in ("text", "field", "word", "n", "cid", "line")]
    episodes = spark.read.parquet(f"{data}/episodes.parquet").select("*", *extra)
    base = episodes.limit(40)
    bad = base.limit(6).withColumns({"id": F.concat(F.lit("bad"), F.monotonically_increasing_id().cast("string")), **{c: F.lit(None).cast("string") for c in ("raw_text", "cleaned_text", "transcript", "title", "feed_id")}})
    blank = base.limit(3).withColumns({"id": F.concat(F.lit("blank"), F.monotonically_increasing_id().cast("string")), **{c: F.lit(v) for c, v in (("raw_text", ""), ("cleaned_text", " \n"), ("transcript", ""))}})
    long = base.limit(2).withColumns({"id": F.concat(F.lit("long"), F.monotonically_increasing_id().cast("string")), **{c: F.expr(f"repeat(coalesce({c}, 'wörter and '), 60)") for c in ("raw_text", "cleaned_text", "transcript")}})
    base.unionByName(base.limit(15)).unionByName(bad).unionByName(blank).unionByName(long).write.parquet(f"{folder}/episodes.parquet")
    documents = spark.read.parquet(f"{data}/documents.parquet").limit(60).withColumn("n_tokens", F.lit("x"))
    more = documents.limit(4).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.expr("repeat(coalesce(text, 'a '), 200)"), "source": F.lit("harbour-digest")})
    none = documents.limit(4).withColumns({"doc_id": F.col("doc_id") + 10**7, "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    documents.unionByName(more).unionByName(none).write.parquet(f"{folder}/documents.parquet")
    for t in ("text_limits", "mix_targets", "feeds", "jobs", "ai_usage"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def nothing(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("episodes", "documents", "text_limits", "mix_targets", "feeds", "jobs", "ai_usage"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_dirty_and_empty_tables(spark, small, nothing, name):
    got = queries.QUERIES[name](spark, small)
    rows = [tuple(str(v) for v in r) for r in got.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    assert queries.QUERIES[name](spark, nothing).count() == 0


def brute_pairs(texts, width, t):
    sets = {}
    for i, x in texts.items():
        w = [z for z in re.split("[ \t\r\n]+", x.lower()) if z]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def made_texts(seed):
    """Edited copies, exact copies, short and very short texts from a small vocabulary."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = {}
    for n in range(120):
        if texts and rng.random() < 0.6:
            w = texts[rng.choice(list(texts))].split()
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                k = rng.randrange(len(w) or 1)
                w[k : k + 1] = rng.choice([[], [rng.choice(words)], [rng.choice(words)] * 2]) if w else []
            if rng.random() < 0.2:
                w = w[: len(w) * 2 // 3]
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 3, 8, 40, 90, 200, 420]))]
        texts[f"t{n:03}"] = " ".join(w)
    return texts


@pytest.mark.parametrize(("width", "t", "seed"), [(3, 0.5, 1), (3, 0.5, 2), (5, 0.8, 3), (2, 0.3, 4)])
def test_near_duplicates_equal_brute_force(spark, width, t, seed):
    texts = made_texts(seed)
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    members, pairs = neardup.similar_classes(df, width, t)
    ids = {}
    for r in members.collect():
        ids.setdefault(r["cid"], []).append(r["id"])
    got = {tuple(sorted((x, y))) for r in pairs.collect() for x in ids[r["a"]] for y in ids[r["b"]]}
    got |= {(x, y) for own in ids.values() for x in own for y in own if x < y}
    want = brute_pairs(texts, width, t)
    assert got == want
    grouped = {r["id"]: r["group_id"] for r in neardup.groups(members, pairs).collect()}
    assert all(grouped[a] == grouped[b] for a, b in want)
    root = {i: i for i in grouped}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in want:
        root[find(a)] = find(b)
    assert len(set(grouped.values())) == len({find(i) for i in root})


def test_long_chains_become_one_group(spark):
    members = spark.createDataFrame([(f"i{k:03}", k) for k in range(70)], "id string, cid bigint")
    pairs = spark.createDataFrame([(k, k + 1, 0.9) for k in range(0, 60)], "a bigint, b bigint, similarity double")
    got = neardup.groups(members, pairs)
    assert got.select("group_id").distinct().count() == 10
    assert got.filter("group_id = 0").count() == 61


def test_mixing_counts(spark, data):
    drawn = queries.QUERIES["p9_mix"](spark, data).collect()
    limits = {r["source"]: r["max_repeats"] for r in tables.table(spark, data, "mix_targets").collect()}
    assert drawn and all(1 <= r["copies"] <= limits[r["source"]] for r in drawn)
    assert len({r["doc_id"] for r in drawn}) == len(drawn)
    report = {r["source"]: r for r in queries.QUERIES["p9_shares"](spark, data).collect()}
    assert set(report) == set(limits)
    for s, r in report.items():
        assert r["tokens"] == sum(d["n_tokens"] * d["copies"] for d in drawn if d["source"] == s)


def test_packing_places_each_token_once(spark, data):
    rows = queries.QUERIES["p8_rows"](spark, data).collect()
    assert rows and all(r["n_tokens"] <= r["capacity"] for r in rows)
    spans = {}
    for r in rows:
        for d in r["documents"]:
            spans.setdefault((r["purpose"], d["doc_id"]), []).append((d["token_start"], d["n_tokens"]))
    for own in spans.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n


def test_truncation_by_the_baseline(spark):
    from wordloom.llm import truncation

    def row(i, text):
        return (str(i), "f", "article", text, None)

    body = "Listeners came. Then they left.\n\nListeners stayed for long.\n\nThe end of it."
    rows = [row(i, body + "\n\nMusic by Someone") for i in range(5)] + [row(10, body + "\n\nListeners"), row(11, body), row(12, None)]
    df = spark.createDataFrame(rows, "id string, feed_id string, source_type string, cleaned_text string, transcript string")
    got = {r["episode_id"]: r["cut"] for r in truncation.judged(df).collect()}
    assert got == {**{str(i): 0 for i in range(5)}, "10": 1, "11": 0}


def test_copies_do_not_move_the_baseline(spark):
    from wordloom.llm import truncation

    def row(i, text):
        return (str(i), "f", "article", text, None)

    inner = [row(f"in{i}", f"Rain fell on day {i}.\n\nThe end of it.") for i in range(2)]
    copies = [row(f"copy{i}", "The town woke.\n\nRain came over the") for i in range(40)]
    rows = [*inner, *copies, row("other", "A day passed.\n\nRain was in the")]
    rows += [row("again", "A week passed.\n\nSeldom did they")] * 3
    rows += [row(f"sign{i}", f"Talk {i} was long.\n\nMusic by Someone") for i in range(4)] + [row("opens", "Music was played.\n\nIt ended.")] * 9
    df = spark.createDataFrame(rows, "id string, feed_id string, source_type string, cleaned_text string, transcript string").repartition(4)
    got = {r["episode_id"]: r["cut"] for r in truncation.judged(df).collect()}
    assert {i: got[i] for i in ("copy0", "copy39", "other", "again")} == dict.fromkeys(("copy0", "copy39", "other", "again"), 1)
    assert all(got[f"sign{i}"] == 0 for i in range(4)) and got["in0"] == 0


def test_misread_words_are_joined_with_their_variants(spark):
    from wordloom.llm import scans

    counts = spark.createDataFrame([("register", 50), ("modern", 40), ("the", 900), ("report", 60), ("regisfer", 1), ("modem", 1), ("thereport", 1), ("zzyzx", 1)], "word string, n bigint")
    suspects = counts.select("word")
    fixed = scans.corrections(counts, suspects)
    assert {r["word"]: r["correction"] for r in fixed.collect()} == {"regisfer": "register", "modem": "modern"}
    assert {r["word"]: r["correction"] for r in scans.run_together(counts, suspects, fixed).collect()} == {"thereport": "the report"}


@pytest.mark.parametrize("times", [1, 4, 30])
def test_misread_words_are_told_by_relative_counts(spark, times):
    from wordloom.llm import scans

    seen = [("register", 24), ("regisfer", 2), ("the", 900), ("report", 60), ("thereport", 3), ("within", 50), ("with", 700), ("in", 700), ("modern", 15), ("modem", 2)]
    counts = spark.createDataFrame([(w, n * times) for w, n in seen], "word string, n bigint")
    fixed = scans.corrections(counts, counts.select("word"))
    assert {r["word"]: r["correction"] for r in fixed.collect()} == {"regisfer": "register"}
    assert {r["word"]: r["correction"] for r in scans.run_together(counts, counts.select("word"), fixed).collect()} == {"thereport": "the report"}


def test_copies_of_a_scan_count_once(spark):
    from wordloom.llm import scans

    texts = [f"the register of year {i}" for i in range(12)] + ["a regisfer here"] * 40 + [None]
    counts = scans.word_counts(spark.createDataFrame([(t,) for t in texts], "raw_text string").repartition(5))
    assert {r["word"]: r["n"] for r in counts.filter("word like 'regis%'").collect()} == {"register": 12, "regisfer": 1}
    fixed = scans.corrections(counts, counts.select("word"))
    assert {r["word"]: r["correction"] for r in fixed.collect()} == {"regisfer": "register"}


def test_parts_of_a_torn_word_are_no_words(spark):
    from wordloom.llm import scans

    text = "\n".join(["a line of the scan, wide enough to be wrapped", "ils prot├⌐gent les enfants du prot. encore une fois", "they modem prot├⌐gent the end of this long line"])
    page = spark.createDataFrame([("a", "pdf", text, "t")], "id string, source_type string, raw_text string, title string")
    words = {r["line_no"]: set(r["words"]) for r in scans.read_lines(page).collect()}
    assert "prot" not in words[3] and "gent" not in words[3] and "modem" in words[3] and "enfants" in words[2]


def test_large_classes_of_copies_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 3)
    members = spark.createDataFrame([(f"i{k:02}", 1) for k in range(20)] + [("a", 2), ("b", 2), ("c", 3)], "id string, cid bigint")
    got = [tuple(r) for r in neardup.pairs_within(members).collect()]
    assert len(got) == len(set(got)) == 20 * 19 // 2 + 1
    assert all(x < y for x, y in got)


def made_classes(spark, texts, width, t):
    df = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(3)
    members, pairs = neardup.similar_classes(df, width, t)
    ids = {}
    for r in members.collect():
        ids.setdefault(r["cid"], []).append(r["id"])
    return {tuple(sorted((x, y))) for r in pairs.collect() for x in ids[r["a"]] for y in ids[r["b"]]}


def test_very_long_texts_keep_short_paths(spark):
    """Sets of several size classes: the pair meets in the smaller one's, and paths stay short."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(4000)}" for _ in range(50_000)]
    near = [w if rng.random() > 0.02 else "x" for w in words]
    texts = {"a": " ".join(words), "b": " ".join(near), "c": " ".join(words[:30_000]), "d": " ".join(words[20_000:20_900]), "e": " ".join(words[:24_000])}
    assert made_classes(spark, texts, 3, 0.5) == brute_pairs(texts, 3, 0.5)
    s = neardup.shingles(texts["a"], 3)
    part, node, place, more, tails = neardup.entries_of(s, neardup.np.full(len(s), 2), 1, 0.5, 4)
    assert len(tails) < 40 * len(s) and len(node) < 2 * len(s)


def test_many_short_texts_with_one_shared_shingle_list_no_pairs(spark):
    texts = {f"i{k:05}": f"all of these u{k} v{k}" for k in range(20_000)}
    texts |= {"y": "all of these", "z": "all of these it"}
    assert made_classes(spark, texts, 3, 0.5) == {("y", "z")}


def test_rows_below_a_frequent_shingle_are_dealt_into_blocks(spark, monkeypatch):
    texts = made_texts(7)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    tokens, kinds = neardup.np.arange(5, dtype="u8"), neardup.np.full(5, 60)
    which, part, node = neardup.dealt(tokens, kinds, 77, 0, 8)
    assert len(which) > 5 and len(set(node.tolist())) == len(node)
    sets = {i: neardup.shingles(x, 3) for i, x in texts.items()}
    counts = neardup.np.zeros(1 << 20, dtype="u1")
    for s in {x.tobytes(): x for x in sets.values()}.values():
        counts[neardup.cells_of(s, 20)] += 1
    kinds = neardup.np.where(counts > 1, 8 * neardup.np.log2(neardup.np.maximum(counts, 1)) + 1, counts).astype("u1")
    blocked, plain = [], []
    for most, out in ((4, blocked), (10**9, plain)):
        monkeypatch.setattr(neardup, "BLOCK", most)
        for k, s in enumerate(sets.values()):
            if len(s):
                part, node, place, more, tails = neardup.entries_of(s, kinds[neardup.cells_of(s, 20)], k, 0.5, 1)
                out.append((neardup.np.array([k], dtype="i8").tobytes(), *map(neardup.planes, ([len(s)], [int((kinds[neardup.cells_of(s, 20)] <= 1).sum())], [len(node)])), node.view("u1").reshape(-1, 4)[:, :3].tobytes(), (place * 256 // len(s)).astype("u1").tobytes(), more.astype("u1").tobytes(), b"", neardup.packed_tails(tails)))
    pairs = [{tuple(sorted(p)) for p in neardup.walk(x, 0.5).tolist()} for x in (blocked, plain)]
    assert pairs[0] == pairs[1] and pairs[0]


def test_signatures_never_rule_out_too_much():
    rng = random.Random(3)
    for _ in range(300):
        a = neardup.np.array(sorted({rng.getrandbits(64) for _ in range(rng.randrange(1, 400))}), dtype="u8")
        b = neardup.np.unique(neardup.np.concatenate([rng.sample(list(a), len(a) // 2), neardup.np.array([rng.getrandbits(64) for _ in range(rng.randrange(1, 900))], dtype="u8")]).astype("u8"))
        both = len(neardup.np.intersect1d(a, b))
        assert both <= neardup.most_shared(len(a), neardup.signature(a), len(b), neardup.signature(b)) <= min(len(a), len(b))


def test_hot_classes_keep_their_pairs_and_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 5)
    monkeypatch.setattr(neardup, "PART", 4)
    texts = made_texts(11)
    texts |= {f"copy{k:02}": texts["t003"] for k in range(60)} | {f"other{k:02}": texts["t010"] for k in range(30)}
    df = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(5)
    members, pairs = neardup.similar_classes(df, 3, 0.5)
    got = {tuple(sorted(r)) for r in neardup.pairs_across(members, pairs).unionByName(neardup.pairs_within(members)).collect()}
    want = brute_pairs(texts, 3, 0.5)
    assert got == want
    grouped = {r["id"]: r for r in neardup.groups(members, pairs).collect()}
    assert len(grouped) == len({i for i, x in texts.items() if len(x.split()) >= 3})
    assert all(grouped[a]["group_no"] == grouped[b]["group_no"] for a, b in want)
    sizes = {}
    for r in grouped.values():
        sizes[r["group_no"]] = sizes.get(r["group_no"], 0) + 1
    assert all(r["group_size"] == sizes[r["group_no"]] for r in grouped.values())


def test_abbreviations_hold_in_their_own_language():
    from wordloom.llm.sentences import sentence_ends

    for text, want in (
        ("He studied modern art. The museum opened late.", 2),
        ("It was his ex. They met again.", 2),
        ("Das kostet 386 Euro bzw. 76.9 Prozent, d. h. zu viel.", 1),
        ("Voir p. 12 et M. Durand est là. Il dort.", 2),
        ("Dr. Smith met Prof. Jones. They left.", 2),
        ("См. рис. Два. Это всё.", 2),
        ("„" + "wort " * 120 + "ende.“ Dann ging er.", 2),
    ):
        assert len(sentence_ends(text)) == want, text


def test_a_source_with_enough_cases_has_its_own_baseline(spark):
    from wordloom.llm import truncation

    def row(i, feed, text):
        return (str(i), feed, "article", text, None)

    signed = [row(f"a{k}", "a", f"Talk {k} was long.\n\nMusic by Someone") for k in range(40)]
    inner = [row(f"b{k}", "b", f"Day {k} began.\n\nMusic was played in town {k}.\n\nIt ended.") for k in range(60)] + [row("cut", "b", "Day x began.\n\nMusic was played in the")]
    df = spark.createDataFrame(signed + inner, "id string, feed_id string, source_type string, cleaned_text string, transcript string").repartition(3)
    got = {r["episode_id"]: r["cut"] for r in truncation.judged(df).collect()}
    assert got["cut"] == 1 and all(got[f"a{k}"] == 0 for k in range(40)) and got["b3"] == 0


def test_attention_binds_and_long_texts_have_their_row():
    import numpy as np

    from wordloom.llm import packing

    sizes = np.array([100, 100, 72, 60, 60, 60, 20, 10, 8, 5, 3, 1, 1])
    row, n = packing.best_fit(sizes, 100)
    for r in range(n):
        own = np.sort(sizes[row == r])[::-1]
        assert own.sum() <= 100 and (own[1:] ** 2).sum() <= packing.attention_left(100, own[0]) + 1e-9
    assert {tuple(sizes[row == r]) for r in range(n)} >= {(100,)}
    _, n = packing.best_fit(np.array([90.0, 10.0] * 4), 100)
    assert n > 4  # tokens alone would allow four rows


def test_one_pasted_row_does_not_hide_a_scan():
    from wordloom.llm import scans

    wrapped = "\n".join(["the lines of this page were wrapped at the width of it and"] * 12)
    assert scans.is_scan(wrapped) and scans.is_scan(wrapped + "\n" + "a row of a table " * 20)
    assert not scans.is_scan("\n\n".join(["a paragraph of one line, which ends where the line does."] * 12 + ["x " * 200]))
    assert not scans.is_scan("\n".join(["wide lines of a text " * 10] * 5 + ["short lines of it are some as well"] * 2))


def test_words_with_two_misreadings_and_very_long_words(spark):
    from wordloom.llm import scans

    long = "donaudampfschifffahrtsgesellschaft" * 4
    seen = [("rocument", 1), ("government", 900), ("govemrnent", 1), ("govemmcnt", 1), (long, 50), (long.replace("gese", "gcse", 1), 1), ("hause", 700), ("heusc", 1)]
    counts = spark.createDataFrame(seen, "word string, n bigint")
    fixed = {r["word"]: r["correction"] for r in scans.corrections(counts, counts.select("word")).collect()}
    assert fixed[long.replace("gese", "gcse", 1)] == long
    assert fixed["govemmcnt"] == "government" and "heusc" not in fixed and "rocument" not in fixed
    assert scans.anagram_hash("ab") == scans.anagram_hash("ba")
