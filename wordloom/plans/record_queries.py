"""Queries of titles, names, service records and statement-shaped changes, with their SQL.

Replies and outlines of services are not in the tables: their JSON is made from the tables' columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import names as N
from wordloom.functions import scalars as S
from wordloom.functions import text as X
from wordloom.operators import marts, mutations, sections
from wordloom.sources import documents as D
from wordloom.sources.tables import table

BASE = "https://pod.example"
NOW = "2025-09-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_E, _J, _U = "e AS (SELECT DISTINCT * FROM episodes)", "j AS (SELECT DISTINCT * FROM jobs)", "u AS (SELECT DISTINCT * FROM ai_usage)"
_URL = "replace(source_url, 'arxiv.example', 'arxiv.org')"


@query(
    f"""WITH {_E} SELECT id, coalesce(tts_voice, 'standard') AS voice, CASE WHEN source_type = 'pdf' AND title <> 'PDF Upload' THEN title ELSE 'Read: ' || title END AS final_title,
    coalesce(CASE WHEN source_type = 'arxiv' THEN 'arXiv:' || nullif(regexp_extract({_URL}, '(arxiv|ar5iv)\\.org/abs/([^/?]+)', 2), '') END, {_URL}) AS submission_title,
    md5(coalesce(cleaned_text, transcript)) AS image_text_md5, coalesce(len(CAST(json(sections_json) AS STRUCT(title VARCHAR, start_secs DOUBLE)[])) > 0, FALSE) AS has_chapters FROM e"""
)
def episode_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, voice, the text a cover is made from, and whether there are chapters."""
    c = F.col
    url = F.replace("source_url", F.lit("arxiv.example"), F.lit("arxiv.org"))
    return table(spark, folder, "episodes").select(
        "id",
        F.coalesce("tts_voice", F.lit("standard")).alias("voice"),
        N.final_title(c("source_type"), c("title"), F.concat(F.lit("Read: "), "title")).alias("final_title"),
        N.submission_title(c("source_type"), url).alias("submission_title"),
        F.md5(N.image_text(c("cleaned_text"), c("transcript"))).alias("image_text_md5"),
        N.has_sections(c("sections_json")).alias("has_chapters"),
    ).distinct()


@query(
    f"""WITH {_E} SELECT e.id AS episode_id, '{BASE}/feed/' || feed_token || '/rss.xml' AS rss_url, '{BASE}/feeds/' || feed_token AS feed_url,
    '{BASE}/feed/' || feed_token || '/episodes/' || e.id || '/chapters.json' AS chapters_url,
    CASE WHEN trim(f.description) = '' THEN f.title ELSE f.title || '. ' || f.description END AS brief,
    'cover-' || substr(sha256(f.title), 1, 16) || '.png' AS cover FROM e JOIN feeds f ON f.id = e.feed_id WHERE e.status = 'done'"""
)
def feed_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of feeds and chapters, the brief of the cover and its key, of published episodes."""
    f = table(spark, folder, "feeds").select(F.col("id").alias("feed_id"), "feed_token", F.col("title").alias("feed_title"), F.col("description").alias("about"))
    e = marts.once(table(spark, folder, "episodes").filter("status = 'done'"), "id", "feed_id")
    token = F.col("feed_token")
    return e.join(f, "feed_id").select(
        F.col("id").alias("episode_id"),
        N.rss_address(BASE, token).alias("rss_url"),
        N.feed_address(BASE + "/", token).alias("feed_url"),
        N.chapters_address(BASE, token, F.col("id")).alias("chapters_url"),
        N.cover_brief(F.col("feed_title"), F.col("about")).alias("brief"),
        N.cover_name(F.col("feed_title"), F.lit("image/png")).alias("cover"),
    )


@query(
    f"""WITH {_J} SELECT id, 'chunk-' || CASE WHEN length(CAST(n AS VARCHAR)) > 4 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 4, '0') END || '-' || substr(sha256(id), 1, 16) || '.mp3' AS chunk_name,
    CASE n % 4 WHEN 0 THEN 'page-' || lpad(CAST(p AS VARCHAR), 3, '0') WHEN 1 THEN 'page-' || lpad(CAST(p AS VARCHAR), 4, '0') ELSE 'page-' || lpad(CAST(p AS VARCHAR), 2, '0') END || '.jpg' AS page,
    base64(encode(id)) AS coded, id AS decoded, row_number() OVER (PARTITION BY episode_id ORDER BY job_type || '/' || id) AS name_order
    FROM (SELECT *, length(id) * 97 + attempts AS n, 7 + attempts AS p FROM j)"""
)
def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """Padded names, the probe for a page's file, base64 there and back, files in order of name."""
    from pyspark.sql import Window as W

    j = marts.once(table(spark, folder, "jobs"), "id", "episode_id", "job_type", "attempts", "status", "run_after", "created_at")
    n, p = F.length("id") * 97 + F.col("attempts"), F.lit(7) + F.col("attempts")
    there = F.when(n % 4 == 0, F.array(N.page_name(p, 3), N.page_name(p, 4))).when(n % 4 == 1, F.array(N.page_name(p, 4))).otherwise(F.array(N.page_name(p, 2), N.page_name(p, 3)))
    coded = F.base64(F.encode("id", "utf-8"))
    return j.select(
        "id",
        N.chunk_name(n, S.content_key(F.col("id"))).alias("chunk_name"),
        N.page_path(p, there).alias("page"),
        coded.alias("coded"),
        F.decode(F.unbase64(coded), "utf-8").alias("decoded"),
        F.row_number().over(W.partitionBy("episode_id").orderBy(F.concat("job_type", F.lit("/"), "id"))).alias("name_order").cast("bigint"),
    )


@query(
    f"""WITH {_U} SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE model || ' ' || stage END AS text, CASE WHEN id % 5 = 0 THEN 'empty: STOP' END AS fault,
    CASE WHEN id % 3 = 0 THEN 0 ELSE input_tokens END AS input_tokens, CASE WHEN id % 3 = 0 THEN 0 ELSE output_tokens END AS output_tokens FROM u"""
)
def service_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Replies read by path; missing counters are 0."""
    u = marts.once(table(spark, folder, "ai_usage"), "id", "model", "stage", "input_tokens", "output_tokens")
    words = F.when(F.col("id") % 5 == 0, F.array(F.lit(""))).otherwise(F.array("model", F.lit(" "), "stage"))
    parts = F.concat(F.lit('{"candidates":[{"finishReason":"STOP","content":{"parts":['), F.array_join(F.transform(words, lambda w: F.concat(F.lit('{"text":"'), w, F.lit('"}'))), ","), F.lit("]}}]"))
    usage = F.concat(F.lit(',"usageMetadata":{"promptTokenCount":'), F.col("input_tokens").cast("string"), F.lit(',"candidatesTokenCount":'), F.col("output_tokens").cast("string"), F.lit("}"))
    made = F.concat(parts, F.when(F.col("id") % 3 == 0, "").otherwise(usage), F.lit("}"))
    return u.select("id", N.reply(made).alias("r")).select("id", "r.*")


@query(
    f"""WITH {_E} SELECT id, CASE WHEN k = 0 THEN NULL ELSE id END AS title, CASE WHEN k IN (0, 1) THEN NULL ELSE status END AS intro, k <> 0 AS readable
    FROM (SELECT *, length(title) % 3 AS k FROM (SELECT DISTINCT id, title, status FROM e))"""
)
def outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Outlines in a code fence: defaults, missing fields, text that is no JSON."""
    e = marts.once(table(spark, folder, "episodes"), "id", "title", "status")
    k = F.length("title") % 3
    section = F.concat(F.lit('"sections":[{"title":"'), "id", F.lit('","start_anchor":"x"}]'))
    made = F.concat(
        F.lit("```json\n{"),
        F.when(k == 0, '"sections":[{"title":"only"}]').when(k == 1, section).otherwise(F.concat(F.lit('"intro_line":"'), "status", F.lit('",'), section)),
        F.lit("}\n```"),
    )
    read = N.outline(made)
    return e.select("id", F.get(read.sections, F.lit(0)).title.alias("title"), read.intro_line.alias("intro"), read.isNotNull().alias("readable"))


@query(
    f"""WITH {_E} SELECT id, CASE WHEN json_valid(sections_json) THEN sections_json END AS sections_json, TRY_CAST(tts_voice AS BIGINT) AS days,
    TRY_CAST(CAST(word_count AS VARCHAR) AS BIGINT) AS words FROM (SELECT DISTINCT id, sections_json, tts_voice, word_count FROM e)"""
)
def passed_through(spark: SparkSession, folder: str) -> DataFrame:
    """JSON as it is, and numbers of days that may be none."""
    e = marts.once(table(spark, folder, "episodes"), "id", "sections_json", "tts_voice", "word_count")
    words = F.col("word_count").cast("string")
    return e.select("id", N.json_or_null(F.col("sections_json")).alias("sections_json"), N.window_days(F.col("tts_voice")).alias("days"), N.window_days(words).alias("words"))


@query(
    f"""WITH {_U}, g AS (SELECT provider, model, stage, count(*) AS calls, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS i, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS o FROM u GROUP BY ALL)
    SELECT format('{{:<12}} {{:<28}} {{:<14}} {{:>6}} {{:>12}} {{:>12}}', provider, model, stage, calls, i, o) AS line FROM g"""
)
def usage_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The usage table in columns of fixed width."""
    g = marts.usage_by(table(spark, folder, "ai_usage"), "provider", "model", "stage")
    c = F.col
    return g.select(N.fixed_width((c("provider"), 12), (c("model"), 28), (c("stage"), 14), (c("calls"), -6), (c("input_tokens"), -12), (c("output_tokens"), -12)).alias("line"))


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "offset" FROM l"""
)
def line_starts(spark: SparkSession, folder: str) -> DataFrame:
    return N.line_offsets(table(spark, folder, "documents"), "doc_id", "text")


@query(
    f"""WITH {_E} SELECT id, CASE WHEN octet_length(encode(trim(coalesce(cleaned_text, ''), ' ' || chr(9) || chr(10) || chr(13)))) < 500 THEN 'suspiciously short content' END AS fault,
    coalesce(nullif(title, ''), 'arXiv:' || id) AS title, CASE WHEN lower(regexp_extract(source_url, '^[^?#]*')) LIKE '%.pdf' THEN 'a PDF, not an article' END AS article_fault
    FROM (SELECT DISTINCT id, cleaned_text, title, source_url FROM e)"""
)
def source_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Why a paper's or an article's page is refused, and the title it gets."""
    c = F.col
    return table(spark, folder, "episodes").select(
        "id",
        N.paper_fault(c("cleaned_text")).alias("fault"),
        N.paper_title(F.lit(None).cast("string"), c("title"), c("id")).alias("title"),
        N.article_fault(c("source_url"), F.lit(None).cast("string")).alias("article_fault"),
    ).distinct()


@query(
    f"""WITH {_J}, t AS (SELECT id FROM j WHERE status = 'queued' AND run_after <= TIMESTAMP '{NOW}' ORDER BY CASE job_type WHEN 'describe' THEN 0 WHEN 'image' THEN 0 WHEN 'tts' THEN 1
      WHEN 'summarize' THEN 2 WHEN 'clean' THEN 3 WHEN 'scrape' THEN 4 WHEN 'pdf' THEN 4 ELSE 5 END, run_after, created_at, id LIMIT 1)
    SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'running' ELSE status END AS status, id IN (SELECT id FROM t) AS claimed FROM (SELECT DISTINCT id, status FROM j)"""
)
def claimed_job(spark: SparkSession, folder: str) -> DataFrame:
    """The table of jobs after the next one is claimed."""
    jobs = table(spark, folder, "jobs")
    return mutations.claim(marts.once(jobs, "id", "status"), marts.claim_ranks(jobs, marts.at(NOW)), 1).select("id", "status", "claimed")


@query(
    f"""WITH {_E}, {_J}, {_U}, g AS (SELECT id FROM e WHERE status = 'error') SELECT 'episodes' AS name, count(*) AS n, (SELECT count(*) FROM g) AS affected FROM e WHERE id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'jobs', count(*), (SELECT count(*) FROM j WHERE episode_id IN (SELECT id FROM g)) FROM j WHERE episode_id IS NULL OR episode_id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'ai_usage', count(*), (SELECT count(*) FROM u WHERE episode_id IN (SELECT id FROM g)) FROM u WHERE episode_id IS NULL OR episode_id NOT IN (SELECT id FROM g)"""
)
def episode_delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Failed episodes deleted with their jobs and usage, and how many rows each table loses."""
    tables = {t: marts.once(table(spark, folder, t), *c) for t, c in (("episodes", ("id", "status")), ("jobs", ("id", "episode_id")), ("ai_usage", ("id", "episode_id")))}
    gone = tables["episodes"].filter("status = 'error'").select("id")
    out = None
    for name, key in (("episodes", "id"), ("jobs", "episode_id"), ("ai_usage", "episode_id")):
        left = mutations.delete(tables[name], gone, key).agg(F.count("*").alias("n"))
        hit = mutations.affected(tables[name], gone, key)
        row = left.select(F.lit(name).alias("name"), "n", F.lit(hit).cast("bigint").alias("affected"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    f"""WITH {_E} SELECT id, nullif(trim(source_url), '') AS source_url, coalesce(CASE WHEN lower(regexp_extract(source_url, '^[^?#]*')) LIKE '%.pdf' THEN 'pdf' END, source_type) AS source_type,
    CASE source_type WHEN 'pdf' THEN 'pdf' WHEN 'markdown' THEN 'clean' ELSE 'scrape' END AS first_job, EXISTS (SELECT 1 FROM jobs WHERE jobs.episode_id = e.id AND jobs.status = 'error') AS has_failed
    FROM (SELECT DISTINCT id, source_url, source_type FROM e) e"""
)
def submitted_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses blank to null, the new type before the old, the first job of each, and whether one failed."""
    e = marts.once(table(spark, folder, "episodes"), "id", "source_url", "source_type")
    failed = marts.once(table(spark, folder, "jobs").filter("status = 'error'"), "episode_id").select(F.col("episode_id").alias("id"), F.lit(True).alias("_f"))
    kind = F.when(S.looks_like_pdf(F.col("source_url")), "pdf")
    first = F.when(F.col("source_type") == "pdf", "pdf").when(F.col("source_type") == "markdown", "clean").otherwise("scrape")
    return e.join(failed, "id", "left").select(
        "id", S.not_blank(F.col("source_url")).alias("source_url"), F.coalesce(kind, "source_type").alias("source_type"), first.alias("first_job"), F.coalesce("_f", F.lit(False)).alias("has_failed")
    )


@query(
    f"""WITH {_E} SELECT md5('{{"id":"' || id || '","feed_id":"' || feed_id || '","status":"' || status || '","tts_chunks_done":' || tts_chunks_done || ',"error_msg":' || coalesce('"' || replace(error_msg, '"', '\\"') || '"', 'null') || '}}') AS row_md5
    FROM (SELECT DISTINCT id, feed_id, status, tts_chunks_done, error_msg FROM e)"""
)
def episode_rows_json(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes as JSON rows, nulls written out."""
    e = marts.once(table(spark, folder, "episodes"), "id", "feed_id", "status", "tts_chunks_done", "error_msg")
    return e.select(F.md5(F.to_json(F.struct("id", "feed_id", "status", "tts_chunks_done", "error_msg"), {"ignoreNullFields": "false"})).alias("row_md5"))


@query(
    f"""WITH {_E}, l AS (SELECT id, source_type, cleaned_text, source_type IN ('arxiv', 'pdf') AND regexp_matches(cleaned_text, '(?m)^[ \\t]*## [^#]') AS chunked FROM e WHERE cleaned_text IS NOT NULL)
    SELECT id, CASE WHEN chunked THEN 'chunked' ELSE 'single' END AS route FROM (SELECT DISTINCT id, chunked FROM l)"""
)
def clean_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Papers go the way by sections; where that finds none, and for all else, one call is made."""
    e = table(spark, folder, "episodes").filter("cleaned_text is not null")
    found = X.parse_sections(F.col("cleaned_text"))
    return e.select("id", F.when(F.col("source_type").isin("arxiv", "pdf") & (F.size(found) > 0), "chunked").otherwise("single").alias("route")).distinct()


@query()
def spoken_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain of a text to speech: pronunciation, sections, chunks, markup and timeline.

    Texts and markup come out as hashes; each chunk has its start.
    """
    from pyspark.sql import Window as W

    from wordloom.sources.lexicon import SPOKEN

    e = table(spark, folder, "episodes").select("id", F.coalesce("transcript", "cleaned_text").alias("text")).filter("text is not null")
    spoken = e.select("id", X.apply_lexicon(F.col("text"), SPOKEN).alias("text"))
    chunks = sections.spoken_chunks(spoken)
    small = chunks.select("id", "section_no", "title", "piece_no", "last_section", "seconds", F.md5(X.build_ssml(F.col("chunk"))).alias("ssml_md5"), F.md5("chunk").alias("chunk_md5")).distinct()
    plan = sections.in_order(small)
    length = F.col("seconds") + F.when(F.col("pause"), sections.SECTION_PAUSE).otherwise(0.0)
    before = W.partitionBy("id").orderBy("chunk_no").rowsBetween(W.unboundedPreceding, -1)
    return plan.withColumn("start_secs", F.round(F.coalesce(F.sum(length).over(before), F.lit(0.0)), 6)).withColumn("seconds", F.round("seconds", 6))


@query(
    f"""WITH {_E}, s AS (SELECT DISTINCT id, title, source_type, status FROM e), k AS (SELECT *, length(title) % 4 AS k FROM s)
    SELECT id, '<h' || (k % 3 + 1) || '>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h' || (k % 3 + 1) || '>' || chr(10) || 'x' AS rendered,
    '{{"a": "' || id || '"}}' AS unfenced, CASE WHEN k = 0 THEN 'Untitled PDF' ELSE id END AS parsed_title, CASE WHEN k = 0 THEN 'body ' || id ELSE 'body' END AS parsed_text,
    id AS stem, CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' ELSE 'bin' END AS extension, k IN (0, 1) AS yes, k <> 3 AS images,
    'episodes/' || id || '.mp3' AS object_key, CASE WHEN k = 3 THEN NULL ELSE id || ' ' || status END AS entry_title, 'episodes/' || id || '/' || substr(sha256(title), 1, 16) || '.mp3' AS audio_key,
    'episodes/' || id || '/cover.png' AS cover_key, CAST(CASE WHEN k = 0 THEN NULL ELSE k * 11 END AS INTEGER) AS n_pages, CASE WHEN k = 0 THEN 'b' WHEN k = 1 THEN 'b' ELSE 'a' END AS page FROM k"""
)
def small_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Headers, fences, titles, stems, types, switches, keys and feed entries of made records."""
    e = marts.once(table(spark, folder, "episodes"), "id", "title", "source_type", "status")
    k, i = F.length("title") % 4, F.col("id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    named = S.title_and_text(F.when(k == 0, text("body ", i)).otherwise(text("TITLE: ", i, "\n \nbody \n")))
    mime = F.when(k == 0, "image/png").when(k == 1, "image/jpg").when(k == 2, "image/webp").otherwise("text/x")
    switch = F.when(k == 0, "true").when(k == 1, "1").when(k == 2, "yes").otherwise("false")
    broken = text("x ", D.FATAL_CONVERSION)
    return e.select(
        "id",
        S.render_markdown_headers(text(F.substring(F.lit("###"), F.lit(1), k % 3 + 1), " ", F.col("title"), "\nx")).alias("rendered"),
        S.strip_code_fence(text("```json\n", '{"a": "', i, '"}', "\n```")).alias("unfenced"),
        named.title.alias("parsed_title"),
        named.text.alias("parsed_text"),
        S.file_stem(text("/up/", i, F.when(k == 0, ".md.md").when(k == 1, ".markdown").otherwise(".txt"))).alias("stem"),
        S.image_extension(mime).alias("extension"),
        S.is_true(switch).alias("yes"),
        S.images_wanted(switch).alias("images"),
        D.key_of_url(text(F.when(k == 0, "https://a.example/").otherwise("http://b.example/"), "episodes/", i, ".mp3"), ["a.example", "b.example"]).alias("object_key"),
        S.atom_title(text("<feed><title>f</title><entry>", F.when(k == 3, "").otherwise(text("<title> ", i, "\n", F.col("status"), "</title>")), "</entry></feed>")).alias("entry_title"),
        D.audio_key(i, F.col("title")).alias("audio_key"),
        D.cover_key(i, F.lit("image/png")).alias("cover_key"),
        D.page_count(F.when(k == 0, "no count").otherwise(text("Title: x\nPages:   ", (k * 11).cast("string"), "\n"))).alias("n_pages"),
        D.first_valid_page(F.when(k == 0, F.lit(None).cast("string")).when(k == 1, broken).otherwise("a"), F.lit("b")).alias("page"),
    )


@query(
    f"""WITH {_E}, t AS (SELECT DISTINCT id, title, cleaned_text FROM e) SELECT id, trim(title) AS title, octet_length(encode(cleaned_text)) AS n_bytes FROM t
    WHERE trim(title) <> '' AND cleaned_text IS NOT NULL AND trim(cleaned_text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND octet_length(encode(cleaned_text)) <= 4000"""
)
def accepted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Pasted texts within a size, with a title."""
    rows = table(spark, folder, "episodes").select("id", "title", F.col("cleaned_text").alias("text"), F.octet_length("cleaned_text").cast("bigint").alias("n_bytes"))
    return D.submitted_texts(rows.filter("n_bytes <= 4000")).select("id", "title", "n_bytes").distinct()


@query(
    f"""WITH {_E}, t AS (SELECT DISTINCT id, source_url FROM e WHERE source_url IS NOT NULL), f AS (SELECT id, lower(regexp_extract(source_url, '^[^?#]*')) LIKE '%.pdf' OR length(id) % 2 = 1 AS pdf FROM t)
    SELECT id, CASE WHEN pdf THEN 'pdf' ELSE 'html' END AS kind FROM f"""
)
def page_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched pages by what they turned out to be."""
    e = marts.once(table(spark, folder, "episodes"), "id", "source_url").filter("source_url is not null")
    kind = F.when(F.length("id") % 2 == 1, "application/PDF; x").otherwise("text/html")
    return D.fetched_pages(e.select("id", F.col("source_url").alias("final_url"), kind.alias("content_type"))).select("id", "kind")


@query(
    f"""WITH {_J}, c AS (SELECT DISTINCT id, attempts, job_type FROM j) SELECT id, CASE WHEN attempts = 0 THEN 'hit' ELSE 'miss' END AS found FROM c"""
)
def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces whose content key is in the cache, and those to be made anew."""
    rows = marts.once(table(spark, folder, "jobs"), "id", "attempts", "job_type").withColumns({"chunk_no": F.lit(0), "voice": F.lit("v")})
    cache = rows.select("id", "chunk_no", S.cache_key(F.when(F.col("attempts") == 0, F.col("job_type")).otherwise("edited"), F.col("voice")).alias("content_key"))
    hits, misses = sections.split_by_cache(rows, cache, "job_type", "voice")
    return hits.select("id", F.lit("hit").alias("found")).unionByName(misses.select("id", F.lit("miss").alias("found")))


@query(
    """WITH t AS (SELECT doc_id, text, substr(text, 31, 40) AS a, ltrim(substr(text, 31, 25)) AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(nullif(strpos(text, a), 0) AS INTEGER) AS first_at,
    CAST(coalesce(CASE WHEN length(l) >= 25 AND strlen(l) >= 10 THEN nullif(strpos(text, l), 0) END,
      CASE WHEN length(l) >= 15 AND strlen(substr(l, 1, 15)) >= 10 THEN nullif(strpos(text, substr(l, 1, 15)), 0) END) AS INTEGER) AS prefix_at FROM t"""
)
def anchor_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where anchors stand: their first place, and that of a prefix where the end was reworded."""
    d = table(spark, folder, "documents").filter("text is not null")
    anchor = F.substring("text", 31, 40)
    reworded = F.concat(F.substring(anchor, 1, 25), F.lit("\u0001 another end"))
    return d.select("doc_id", X.find_anchor(F.col("text"), anchor).alias("first_at"), X.find_anchor(F.col("text"), reworded).alias("prefix_at"))


@query()
def located_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut by an outline of two anchors out of them; no row's parts where the outline does not fit."""
    d = table(spark, folder, "documents").filter("text is not null")
    half = F.floor(F.length("text") / 2).cast("int")
    section = lambda title, at: F.struct(F.lit(title).alias("title"), F.substring("text", at, F.lit(30)).alias("start_anchor"))
    found = X.locate_sections(F.col("text"), F.array(section("one", F.lit(1)), section("two", half + 1)), F.substring("text", F.length("text") - 20, F.lit(21)))
    parts = F.transform(found, lambda p: F.struct(p.title.alias("title"), F.octet_length(p.body).alias("n_bytes")))
    return d.select("doc_id", found.isNotNull().alias("fits"), F.to_json(parts).alias("parts"))


@query(
    f"""WITH {_E}, t AS (SELECT DISTINCT id, title, status FROM e) SELECT id, status || ' page' AS title, status || ' page' || chr(10) || chr(10) || 'Let x=1 be ' || status || '.' || chr(10) || chr(10) || 'Then more.' AS text FROM t"""
)
def paper_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A converted paper's page read: formulas by their text, citations, tables and authors left out."""
    e = marts.once(table(spark, folder, "episodes"), "id", "title", "status")
    page = F.concat(
        F.lit('<html><body><nav>Menu</nav><article class="ltx_document"><h1 class="ltx_title ltx_title_document">'), "status", F.lit(' page</h1><div class="ltx_authors">Someone</div><p>Let <math alttext="x=1"><mi>x</mi></math> be '),
        "status", F.lit('<cite>[1]</cite>.</p><table><tr><td>1</td></tr></table><section class="ltx_section"><p>Then more.</p></section><section class="ltx_bibliography"><p>Ref</p></section></article></body></html>'),
    )
    return e.select("id", X.paper_text(page).alias("p")).select("id", "p.title", "p.text")


@query()
def reassembled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned pieces put together again; by hash. Texts of one id are one text here."""
    raw = table(spark, folder, "episodes").select("id", F.col("cleaned_text").alias("text")).filter("text is not null")
    # the pieces of repeated rows fold as pieces
    plan = sections.with_roles(sections.cleaned_pieces(raw).distinct())
    return sections.reassembled(plan, "From the start.").select("id", F.md5("text").alias("text_md5"))
