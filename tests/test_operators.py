"""Windows, changes, rolling totals, streams: invariants, and brute force on small tables."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wordloom.operators import marts, mutations, rolling, sections
from wordloom.plans import pipeline
from wordloom.sources import documents, tables
from wordloom.streaming import usage_stream

USAGE = "id bigint, provider string, input_tokens bigint, output_tokens bigint, created_at timestamp_ntz, provider_extra string"


def usage_rows(n=300, seed=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        day = dt.datetime(2025, 1, 1) + dt.timedelta(days=rng.choice([rng.randint(0, 20), rng.randint(60, 90)]), seconds=rng.choice([0, 86399, rng.randint(0, 86399)]))
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), rng.choice([0, None, 5, 70]), rng.choice([0, 0, 9]), day, "x"))
    rows += rng.sample(rows, 30)
    rows += [(None, "a", 3, 3, dt.datetime(2025, 1, 5), "x")] * 2 + [(1000, "c", 1, 1, None, "x")]
    return rows


def brute(rows):
    seen, day = set(), defaultdict(lambda: [0, 0])
    for i, p, a, b, at, _ in rows:
        if at is None or (i is not None and i in seen):
            continue
        seen.add(i)
        d = day[p, at.date()]
        d[0] += a or 0
        d[1] += b or 0
    out = {}
    for p in {p for p, _ in day}:
        days = [d for q, d in day if q == p]
        d = min(days)
        while d <= max(days):
            for w in (7, 30):
                near = [day[p, d - dt.timedelta(days=k)] for k in range(w) if (p, d - dt.timedelta(days=k)) in day]
                out[p, d, w] = (sum(x[0] for x in near), sum(x[1] for x in near))
            d += dt.timedelta(days=1)
    return out


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_rolling_equals_brute_force_however_rows_arrive(spark, batches):
    rows = usage_rows()
    state = rolling.rolling_state(spark.createDataFrame(rows, USAGE), batches=batches)
    got = {(r["entity"], r["day"], r["window_days"]): (r["sum_input_tokens"], r["sum_output_tokens"]) for r in rolling.report(state).collect()}
    assert got == brute(rows)
    assert state.version == batches


def test_rolling_corrections_change_affected_dates_only(spark):
    rows = [(i, "a", 1, 0, dt.datetime(2025, 1, 1) + dt.timedelta(days=i), "x") for i in range(60)]
    first = rolling.advance(rolling.RollingState(0, None, None), spark.createDataFrame(rows, USAGE))
    late = rolling.advance(first, spark.createDataFrame([(100, "a", 5, 0, dt.datetime(2025, 1, 20), "x"), rows[3]], USAGE))
    before = {r["day"]: r["input_tokens_7"] for r in first.rolling.collect()}
    after = {r["day"]: r["input_tokens_7"] for r in late.rolling.collect()}
    changed = sorted(d for d in before if before[d] != after[d])
    assert changed == [dt.date(2025, 1, 20) + dt.timedelta(days=k) for k in range(7)]


def stepwise(spark, runs):
    """The state after the runs, and what brute force gives when a later run replaces an id."""
    state, kept = rolling.RollingState(0, None, None), {}
    for run in runs:
        state = rolling.advance(state, spark.createDataFrame(run, USAGE))
        kept |= {r[0]: r for r in run if r[4] is not None}
    got = {(r["entity"], r["day"], r["window_days"]): (r["sum_input_tokens"], r["sum_output_tokens"]) for r in rolling.report(state).collect()}
    return state, got, brute(list(kept.values()))


def test_an_id_that_returns_with_other_amounts_is_corrected(spark):
    day = lambda k: dt.datetime(2025, 3, 1) + dt.timedelta(days=k)
    first = [(1, "a", 10, 1, day(5), "x"), (2, "a", 3, 0, day(6), "x"), (3, "a", 4, 0, day(20), "x"), (4, "b", 9, 9, day(0), "x")]
    second = [(1, "a", 99, 1, day(5), "x"), (2, "a", 3, 0, day(6), "x"), (3, "b", 4, 0, day(2), "x"), (5, "a", 7, 0, day(1), "x")]
    third = [(5, None, 7, 2, day(40), "x"), (6, "b", 1, 1, day(50), "x"), (4, "a", 9, 9, day(30), "x")]
    state, got, want = stepwise(spark, [first, second, third, third])
    assert got == want
    again = rolling.load(spark, state.folder, 2)
    assert {(r["entity"], r["day"]) for r in again.rolling.collect()} != {(r["entity"], r["day"]) for r in state.rolling.collect()}


def test_random_runs_with_corrections_equal_brute_force(spark):
    rng = random.Random(8)
    runs = []
    for k in range(3):
        runs.append([(i, rng.choice(["a", "b", None]), rng.randint(0, 9), rng.randint(0, 3), dt.datetime(2025, 1, 1) + dt.timedelta(days=rng.randint(k * 10, k * 25 + 30)), "x") for i in range(k * 15, k * 15 + 40)])
    _, got, want = stepwise(spark, runs)
    assert got == want


def test_rolling_of_no_rows(spark):
    assert rolling.report(rolling.rolling_state(spark.createDataFrame([], USAGE), batches=3)).count() == 0


def test_timeline_and_chapters(spark):
    texts = spark.createDataFrame([("e", "## A\n" + "word " * 24 + "\n## B\n" + "word " * 11), ("n", None), ("p", "plain words here")], "id string, text string")
    got = {(r["id"], r["section_no"]): (r["title"], r["start_secs"]) for r in sections.timeline(sections.speech_plan(texts)).collect()}
    assert got == {("e", 0): ("A", 0.0), ("e", 1): ("B", 11.5), ("p", 0): ("Introduction", 0.0)}
    episodes = spark.createDataFrame(
        [("e", 60, '[{"title":"a","start_secs":0},{"title":"b","start_secs":12.5},{"title":"c","start_secs":42}]'), ("x", 5, None)], "id string, duration_secs int, sections_json string"
    )
    assert [(r["start_ms"], r["end_ms"]) for r in sections.chapters(episodes).orderBy("chapter_no").collect()] == [(0, 12500), (12500, 42000), (42000, 60000)]


def test_blank_sections_fall_back_to_one_chunk(spark):
    texts = spark.createDataFrame([("e", " \n\t"), ("f", "## A\nx\n## B\n"), ("g", "")], "id string, text string")
    got = {(r["id"], r["section_no"]): (r["chunk"], r["pause"]) for r in sections.speech_plan(texts).collect()}
    assert got == {("e", 0): (" \n\t", False), ("f", 0): ("A\n\nx", True), ("f", 1): ("B", False), ("g", 0): ("", False)}


def test_cleaning_plan_and_reassembly(spark):
    text = "Lead.\n\n## One\n" + "First body. " * 4 + "\n\n## Two\nSecond body."
    plan = sections.cleaning_plan(spark.createDataFrame([("d", text)], "id string, text string"))
    rows = plan.orderBy("piece_no").collect()
    assert [r["role"] for r in rows] == ["open", "continue", "close"]
    assert all(r["context"] is None for r in rows if r["starts_section"])
    assert "## One" in sections.reassembled(plan).first()["text"]


def test_cache_split_and_page_ranges(spark):
    plan = spark.createDataFrame([("e", 0, "a"), ("e", 1, "b")], "id string, chunk_no int, chunk string")
    cache = plan.filter("chunk_no = 0").select("id", "chunk_no", F.xxhash64("chunk").alias("content_key"))
    hits, misses = sections.split_by_cache(plan, cache, "chunk")
    assert [r["chunk"] for r in hits.collect()] == ["a"] and [r["chunk"] for r in misses.collect()] == ["b"]
    papers = spark.createDataFrame([("a", 9), ("b", 0), ("c", None)], "id string, n_pages int")
    assert sorted((r["first_page"], r["last_page"]) for r in sections.page_ranges(papers).collect()) == [(1, 4), (5, 8), (9, 9)]


def test_changes(spark):
    t = spark.createDataFrame([("1", "a", "http://OLD.x/1"), ("2", "b", "http://old.x/2"), ("2", "b", "http://old.x/2")], "id string, title string, url string")
    changes = spark.createDataFrame([("2", "new", None)], "id string, title string, url string")
    assert sorted(tuple(r) for r in mutations.patch(t, changes, "id", ["title", "url"]).collect()) == [("1", "a", "http://OLD.x/1"), ("2", "new", "http://old.x/2"), ("2", "new", "http://old.x/2")]
    assert mutations.delete(t, changes, "id").count() == 1
    assert mutations.replace_host(t, "url", "old.x", "new.y").filter("url like '%new.y%'").count() == 2
    assert mutations.append(t, spark.createDataFrame([("3",)], "id string")).filter("id = '3' and title is null").count() == 1
    assert mutations.copy_columns(t, ["id", "more"]).columns == ["id", "more"]


def test_marts_run_over_empty_tables(spark):
    feeds, episodes, jobs, usage = (tables.empty(spark, t) for t in ("feeds", "episodes", "jobs", "ai_usage"))
    now = marts.at("2025-01-01 00:00:00")
    assert marts.feed_list(feeds, episodes).count() == 0
    assert marts.newest_of_feeds(episodes, jobs, now).count() == 0
    assert marts.claim_ranks(jobs, now).count() == 0
    assert marts.rss_documents(feeds, episodes).count() == 0
    assert marts.status_counts(feeds, episodes, jobs).first()["feeds"] == 0
    assert marts.usage_by(usage, "provider").count() == 0
    assert {r["n"] for r in marts.orphans(feeds, episodes, jobs, usage).collect()} == {0}


def test_stream_equals_batch(spark, data):
    got = {tuple(r) for r in usage_stream.daily_totals(spark, data).collect()}
    rows = tables.table(spark, data, "ai_usage")
    want = marts.usage_by(rows.withColumn("usage_day", F.date_format("created_at", "yyyy-MM-dd")), "provider", "usage_day")
    assert got == {tuple(r) for r in want.select("provider", "usage_day", "calls", "input_tokens", "output_tokens").collect()}


def test_uploads_and_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hi")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r["title"]: r["accepted"] for r in documents.text_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a": True, "b": False}
    files = documents.binary_uploads(spark, str(tmp_path), most=3)
    assert {r["title"]: r["accepted"] for r in files.filter("path like '%.pdf'").collect()} == {"c": False}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text('{"title": "t", "raw_text": "r"}\n')
    docs = documents.json_documents(spark, str(tmp_path / "d"))
    assert docs.first()["source_type"] == "pdf"
    assert "word_count" not in documents.to_json_documents(docs).first()["value"]


def test_pipeline_stops_where_told(spark):
    docs = spark.createDataFrame([("1", "t", "arxiv", "As shown [3] it works. (Smith et al., 2019) More. Even more. And more.", None, True)] * 2, "id string, title string, source_type string, raw_text string, focus string, wants_summary boolean")
    row = pipeline.run(docs, pipeline.LocalProvider()).collect()
    assert len(row) == 1 and "[3]" not in row[0]["cleaned_text"] and "Smith" not in row[0]["cleaned_text"]
    assert row[0]["transcript"] == "As shown it works." and row[0]["duration_secs"] == 1
    assert "transcript" not in pipeline.run(docs, pipeline.LocalProvider(), "clean").columns
    with pytest.raises(ValueError):
        pipeline.run(docs, pipeline.LocalProvider(), "fly")


def test_lists_come_in_the_order_asked_for(spark):
    at = [dt.datetime(2025, 1, d) for d in (2, 9, 5)]
    feeds = spark.createDataFrame([(str(i), "s", "t", x) for i, x in enumerate(at)], "id string, slug string, title string, created_at timestamp_ntz")
    episodes = spark.createDataFrame([("e", "1"), ("e", "1"), ("f", "1")], "id string, feed_id string")
    assert [(r["feed_id"], r["episode_count"]) for r in marts.feed_list(feeds, episodes).collect()] == [("1", 2), ("2", 0), ("0", 0)]


def test_claims_and_affected_rows(spark):
    jobs = spark.createDataFrame([("a", "queued"), ("b", "queued"), ("c", "done")], "id string, status string")
    ranks = spark.createDataFrame([("b", 1), ("a", 2)], "job_id string, claim_rank int")
    got = {r["id"]: (r["status"], r["claimed"]) for r in mutations.claim(jobs, ranks, 1).collect()}
    assert got == {"a": ("queued", False), "b": ("running", True), "c": ("done", False)}
    assert mutations.affected(jobs, ranks, "id") == 2 and mutations.affected(jobs, ranks.filter("job_id = 'x'"), "id") == 0
