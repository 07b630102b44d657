"""All queries outside the ``llm`` subpackage, and the SQL that must agree with them.

Every query runs over its whole tables. Times are compared with the fixed moment NOW, limits
are top-k reports. Texts that come out long are compared by their hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.functions import text as X
from wordloom.operators import marts, mutations, sections
from wordloom.plans import pipeline, record_queries, rolling_queries
from wordloom.sources.lexicon import SPOKEN
from wordloom.sources.tables import table
from wordloom.streaming import usage_stream

NOW = "2025-09-01 00:00:00"
DAYS = 30
GONE = ("harbour-digest", "tidal-briefing")
OLD_HOST, NEW_HOST = "podstore.example", "media.example"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_USAGE = "u AS (SELECT DISTINCT * FROM ai_usage)"
_EPISODES = "e AS (SELECT DISTINCT * FROM episodes)"
_JOBS = "j AS (SELECT DISTINCT * FROM jobs)"
_SUMS = "count(*) AS calls, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens"


def _texts(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """(id, text, ...): what is spoken - the transcript, else the cleaned text."""
    e = table(spark, folder, "episodes")
    return e.select("id", F.coalesce("transcript", "cleaned_text").alias("text"), *more).filter("text is not null")


# --- aggregates, joins, top-k ------------------------------------------------


@query(f"WITH {_USAGE} SELECT provider, model, stage, {_SUMS} FROM u GROUP BY provider, model, stage")
def usage_summary(spark: SparkSession, folder: str) -> DataFrame:
    return marts.usage_by(table(spark, folder, "ai_usage"), "provider", "model", "stage", ordered=True)


@query(f"WITH {_USAGE} SELECT provider, model, stage, {_SUMS} FROM u WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL {DAYS} DAY GROUP BY provider, model, stage")
def usage_window_days(spark: SparkSession, folder: str) -> DataFrame:
    since = marts.at(NOW) - F.make_dt_interval(F.lit(DAYS))
    return marts.usage_by(table(spark, folder, "ai_usage"), "provider", "model", "stage", since=since, ordered=True)


@query(f"WITH {_USAGE} SELECT episode_id, {_SUMS} FROM u WHERE episode_id IS NOT NULL GROUP BY episode_id")
def usage_by_episode(spark: SparkSession, folder: str) -> DataFrame:
    return marts.usage_by(table(spark, folder, "ai_usage").filter("episode_id is not null"), "episode_id")


@query(
    f"""WITH {_USAGE} SELECT episode_id, id, stage, provider, model, row_number() OVER w AS call_no,
    CAST(sum(input_tokens + output_tokens) OVER (PARTITION BY episode_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_so_far
    FROM u WHERE episode_id IS NOT NULL WINDOW w AS (PARTITION BY episode_id ORDER BY created_at, id)"""
)
def usage_episode_rows(spark: SparkSession, folder: str) -> DataFrame:
    return marts.usage_of_episodes(table(spark, folder, "ai_usage"))


@query(
    f"""WITH {_EPISODES} SELECT f.id AS feed_id, f.slug, f.title, f.created_at, CAST(count(e.id) AS INTEGER) AS episode_count
    FROM feeds f LEFT JOIN e ON e.feed_id = f.id GROUP BY f.id, f.slug, f.title, f.created_at"""
)
def feed_list_counts(spark: SparkSession, folder: str) -> DataFrame:
    return marts.feed_list(table(spark, folder, "feeds"), table(spark, folder, "episodes"))


@query(
    f"""WITH {_EPISODES}, {_JOBS}, t AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY created_at DESC, id) AS place FROM e)
    SELECT feed_id, CAST(place AS INTEGER) AS place, id AS episode_id, title, status, created_at, (SELECT min(run_after) FROM j
      WHERE j.episode_id = t.id AND j.status = 'queued' AND run_after > TIMESTAMP '{NOW}' AND job_type NOT IN ('image', 'describe')) AS retry_at
    FROM t WHERE place <= 100"""
)
def feed_episodes_retry_at(spark: SparkSession, folder: str) -> DataFrame:
    return marts.newest_of_feeds(table(spark, folder, "episodes"), table(spark, folder, "jobs"), marts.at(NOW))


@query(
    f"""WITH {_EPISODES}, {_JOBS} SELECT (SELECT count(*) FROM feeds) AS feeds, (SELECT count(*) FROM e) AS episodes,
    (SELECT count(*) FROM e WHERE status = 'done') AS done, (SELECT count(*) FROM e WHERE status = 'error') AS failed,
    (SELECT count(*) FROM j WHERE status = 'queued') AS queued, (SELECT count(*) FROM j WHERE status = 'running') AS running"""
)
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return marts.status_counts(*(table(spark, folder, t) for t in ("feeds", "episodes", "jobs")))


@query(
    f"""WITH {_EPISODES}, {_JOBS} SELECT j.id AS job_id, job_type, j.status, attempts, run_after, episode_id, e.title AS episode_title, f.slug AS feed_slug
    FROM j JOIN e ON e.id = j.episode_id JOIN feeds f ON f.id = e.feed_id WHERE j.status IN ('queued', 'running')"""
)
def active_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return marts.active_jobs(*(table(spark, folder, t) for t in ("jobs", "episodes", "feeds")))


@query(
    f"""WITH {_JOBS}, d AS (SELECT *, CASE job_type WHEN 'describe' THEN 0 WHEN 'image' THEN 0 WHEN 'tts' THEN 1 WHEN 'summarize' THEN 2
      WHEN 'clean' THEN 3 WHEN 'scrape' THEN 4 WHEN 'pdf' THEN 4 ELSE 5 END AS priority FROM j WHERE status = 'queued' AND run_after <= TIMESTAMP '{NOW}')
    SELECT id AS job_id, episode_id, job_type, priority, row_number() OVER (ORDER BY priority, run_after, created_at, id) AS claim_rank FROM d"""
)
def claim_next_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return marts.claim_ranks(table(spark, folder, "jobs"), marts.at(NOW))


@query(
    f"""WITH {_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY status = 'error' DESC, created_at DESC, id DESC) AS n FROM j)
    SELECT episode_id, CASE WHEN status = 'error' THEN job_type ELSE 'scrape' END AS job_type FROM r WHERE n = 1"""
)
def latest_failed_job(spark: SparkSession, folder: str) -> DataFrame:
    return marts.latest_failed_job(table(spark, folder, "jobs"))


_ITEMS = f"""{_EPISODES}, i AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY pub_date DESC NULLS LAST, id) AS place
  FROM e WHERE status = 'done' AND audio_url IS NOT NULL)"""
_XML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(f"WITH {_ITEMS} SELECT feed_id, CAST(place AS INTEGER) AS place, id AS episode_id, title, pub_date FROM i WHERE place <= 50")
def rss_items_top50(spark: SparkSession, folder: str) -> DataFrame:
    return marts.feed_items(table(spark, folder, "episodes")).select("feed_id", "place", F.col("id").alias("episode_id"), "title", "pub_date")


_CLOCK = """CASE WHEN hours THEN (s // 3600) || ':' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
  ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END"""
_SECTIONS = """c AS (SELECT id, generate_subscripts(l, 1) AS n, unnest(l) AS x, len(l) AS k FROM
  (SELECT id, CAST(json(sections_json) AS STRUCT(title VARCHAR, start_secs DOUBLE)[]) AS l FROM e WHERE sections_json IS NOT NULL))"""
_CHAPTERS = f"""{_SECTIONS}, h AS (SELECT id, n, x.title AS title, CAST(floor(greatest(x.start_secs, 0)) AS BIGINT) AS s,
    bool_or(n = k AND x.start_secs >= 3600) OVER (PARTITION BY id) AS hours FROM c),
  lists AS (SELECT id, string_agg({_CLOCK} || ' ' || title || chr(10), '' ORDER BY n) AS chapters FROM h GROUP BY id)"""


@query(
    f"""WITH {_ITEMS}, {_CHAPTERS}, d AS (SELECT i.*, coalesce(description, source_url, 'PDF upload') AS base, lists.chapters FROM i LEFT JOIN lists USING (id) WHERE place <= 50)
    SELECT feed_id, CAST(place AS INTEGER) AS place, id AS episode_id,
    {_XML.format("CASE WHEN d.\"summarize\" <> 0 THEN title || ' (Summary)' ELSE title END")} AS item_title,
    md5({_XML.format("base || CASE WHEN source_url IS NOT NULL AND NOT contains(base, source_url) THEN chr(10) || chr(10) || 'Source: ' || source_url ELSE '' END || coalesce(chr(10) || chr(10) || 'Chapters:' || chr(10) || chapters, '')")}) AS description_md5,
    coalesce(strftime(pub_date, '%a, %d %b %Y %H:%M:%S +0000'), '') AS item_date, {_XML.format("audio_url")} AS item_url FROM d"""
)
def rss_item_render(spark: SparkSession, folder: str) -> DataFrame:
    items = marts.rendered_items(table(spark, folder, "episodes"))
    return items.select("feed_id", "place", "episode_id", "item_title", F.md5("item_description").alias("description_md5"), "item_date", "item_url")


@query()
def rss_documents(spark: SparkSession, folder: str) -> DataFrame:
    return marts.rss_documents(table(spark, folder, "feeds"), table(spark, folder, "episodes"))


@query(
    f"""WITH {_EPISODES} SELECT status, count(*) AS episodes, CAST(sum(tts_chunks_done) AS BIGINT) AS chunks_done, CAST(sum(tts_chunks_total) AS BIGINT) AS chunks_total,
    count(*) FILTER (WHERE cleaned_text IS NOT NULL OR transcript IS NOT NULL) AS with_text FROM e GROUP BY status"""
)
def episode_progress(spark: SparkSession, folder: str) -> DataFrame:
    return marts.progress(table(spark, folder, "episodes"))


@query(
    f"""WITH {_EPISODES}, {_JOBS}, {_USAGE}
    SELECT 'episodes' AS child, 'feeds' AS parent, count(*) AS n FROM e WHERE feed_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM feeds f WHERE f.id = e.feed_id)
    UNION ALL SELECT 'jobs', 'episodes', count(*) FROM j WHERE episode_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = j.episode_id)
    UNION ALL SELECT 'ai_usage', 'episodes', count(*) FROM u WHERE episode_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = u.episode_id)
    UNION ALL SELECT 'ai_usage', 'feeds', count(*) FROM u WHERE feed_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM feeds f WHERE f.id = u.feed_id)"""
)
def foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    return marts.orphans(*(table(spark, folder, t) for t in ("feeds", "episodes", "jobs", "ai_usage")))


# --- changes -----------------------------------------------------------------

_GONE = "(" + ", ".join(f"'{s}'" for s in GONE) + ")"


@query(
    f"""WITH {_EPISODES}, {_JOBS}, {_USAGE}, g AS (SELECT id FROM feeds WHERE slug IN {_GONE}), l AS (SELECT id FROM e WHERE feed_id IN (SELECT id FROM g))
    SELECT 'feeds' AS name, count(*) AS n, CAST(0 AS BIGINT) AS n_without_feed FROM feeds WHERE id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'episodes', count(*), 0 FROM e WHERE id NOT IN (SELECT id FROM l)
    UNION ALL SELECT 'jobs', count(*), 0 FROM j WHERE episode_id IS NULL OR episode_id NOT IN (SELECT id FROM l)
    UNION ALL SELECT 'ai_usage', count(*), count(*) FILTER (WHERE feed_id IS NULL OR feed_id IN (SELECT id FROM g)) FROM u WHERE episode_id IS NULL OR episode_id NOT IN (SELECT id FROM l)"""
)
def feed_delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    kept = {"feeds": ["id", "slug"], "episodes": ["id", "feed_id"], "jobs": ["id", "episode_id"], "ai_usage": ["id", "episode_id", "feed_id"]}
    tables = {t: marts.once(table(spark, folder, t), *c) for t, c in kept.items()}
    left = mutations.delete_feeds(tables, tables["feeds"].filter(F.col("slug").isin(*GONE)).select("id"))

    def count(name: str) -> DataFrame:
        free = F.count_if(F.col("feed_id").isNull()) if name == "ai_usage" else F.lit(0).cast("bigint")
        return left[name].agg(F.count("*").alias("n"), free.alias("n_without_feed")).select(F.lit(name).alias("name"), "n", "n_without_feed")

    return count("feeds").unionByName(count("episodes")).unionByName(count("jobs")).unionByName(count("ai_usage"))


@query(
    f"""WITH {_EPISODES} SELECT id, CASE WHEN id < 'V' THEN 'Again: ' || trim(title) ELSE title END AS title,
    CASE WHEN id < 'V' THEN coalesce(replace(source_url, 'http:', 'https:'), source_url) ELSE source_url END AS source_url FROM e"""
)
def episode_patch(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and addresses changed by a table of changes; absent values change nothing."""
    e = marts.once(table(spark, folder, "episodes"), "id", "title", "source_url")
    changes = e.filter("id < 'V'").select("id", F.concat(F.lit("Again: "), F.trim("title")).alias("title"), F.replace("source_url", F.lit("http:"), F.lit("https:")).alias("source_url"))
    return mutations.patch(e, changes, "id", ["title", "source_url"])


@query(
    f"""WITH {_EPISODES} SELECT id, CASE WHEN audio_url ILIKE '%{OLD_HOST}%' THEN replace(audio_url, '{OLD_HOST}', '{NEW_HOST}') ELSE audio_url END AS audio_url,
    CASE WHEN image_url ILIKE '%{OLD_HOST}%' THEN replace(image_url, '{OLD_HOST}', '{NEW_HOST}') ELSE image_url END AS image_url FROM e"""
)
def hostname_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    e = marts.once(table(spark, folder, "episodes"), "id", "audio_url", "image_url")
    return mutations.replace_host(mutations.replace_host(e, "audio_url", OLD_HOST, NEW_HOST), "image_url", OLD_HOST, NEW_HOST)


@query(
    f"""WITH {_EPISODES} SELECT id AS episode_id, 'describe' AS job_type, 'queued' AS status, CAST(0 AS INTEGER) AS attempts, TIMESTAMP '{NOW}' AS run_after
    FROM e WHERE status = 'done' AND description IS NULL"""
)
def describe_backfill(spark: SparkSession, folder: str) -> DataFrame:
    e = marts.once(table(spark, folder, "episodes"), "id", "status", "description")
    new = {"episode_id": F.col("id"), "job_type": F.lit("describe"), "status": F.lit("queued"), "attempts": F.lit(0), "run_after": marts.at(NOW)}
    return mutations.backfill(e, (F.col("status") == "done") & F.col("description").isNull(), new)


@query(f"WITH {_JOBS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status FROM j) GROUP BY status")
def orphan_recovery(spark: SparkSession, folder: str) -> DataFrame:
    j = marts.once(table(spark, folder, "jobs"), "id", "status")
    return mutations.update_where(j, F.col("status") == "running", {"status": F.lit("queued")}).groupBy("status").agg(F.count("*").alias("n"))


# --- scalars -----------------------------------------------------------------

_URL = "replace(source_url, 'arxiv.example', 'arxiv.org')"


@query(
    f"""WITH {_EPISODES}, l AS (SELECT id, {_URL} AS url FROM e WHERE source_url IS NOT NULL) SELECT id, CASE WHEN regexp_matches(url, 'arxiv\\.org/(abs|html|pdf)/') OR contains(url, 'ar5iv.org') THEN 'arxiv'
      WHEN lower(regexp_extract(url, '^[^?#]*')) LIKE '%.pdf' THEN 'pdf' ELSE 'article' END AS server_type,
    CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(url, 'arxiv\\.org|ar5iv\\.org') THEN 'arxiv' ELSE 'article' END AS batch_type,
    nullif(regexp_extract(url, 'arxiv\\.org/abs/([^/?]+)', 1), '') AS abstract_id,
    regexp_replace(coalesce(nullif(regexp_extract(url, 'arxiv\\.org/abs/([^/?#]+)', 1), ''), nullif(regexp_extract(url, 'arxiv\\.org/html/([^/?#]+)', 1), ''), nullif(regexp_extract(url, 'arxiv\\.org/pdf/([^/?#]+)', 1), '')), '\\.pdf$', '') AS paper_id FROM l"""
)
def source_type_detect(spark: SparkSession, folder: str) -> DataFrame:
    e = marts.once(table(spark, folder, "episodes"), "id", "source_url").filter("source_url is not null")
    url = F.col("url")
    return e.select("id", F.replace("source_url", F.lit("arxiv.example"), F.lit("arxiv.org")).alias("url")).select(
        "id", S.detect_source_type(url).alias("server_type"), S.detect_input_type(url).alias("batch_type"), S.arxiv_id_of_abstract(url).alias("abstract_id"), S.arxiv_id(url).alias("paper_id")
    )


@query(
    f"""WITH {_EPISODES}, l AS (SELECT id, CAST(coalesce(duration_secs, 0) AS BIGINT) AS s, duration_secs >= 3600 AS hours FROM e)
    SELECT id, CASE WHEN s = 0 THEN '--:--' ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS label, {_CLOCK} AS clock FROM l"""
)
def timestamp_format(spark: SparkSession, folder: str) -> DataFrame:
    e = marts.once(table(spark, folder, "episodes"), "id", "duration_secs")
    secs = F.coalesce("duration_secs", F.lit(0))
    return e.select("id", S.duration_label(F.col("duration_secs")).alias("label"), S.clock(secs, F.coalesce(F.col("duration_secs") >= 3600, F.lit(False))).alias("clock"))


@query(
    f"""WITH {_EPISODES} SELECT error_msg, regexp_matches(lower(error_msg), '{"|".join(S.OUTAGE_SIGNS)}') AS outage, count(*) AS n FROM e WHERE error_msg IS NOT NULL GROUP BY ALL"""
)
def outage_classify(spark: SparkSession, folder: str) -> DataFrame:
    e = marts.once(table(spark, folder, "episodes"), "id", "error_msg").filter("error_msg is not null")
    return e.groupBy("error_msg", S.is_outage(F.col("error_msg")).alias("outage")).agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\s\\p{Z}\\x{85}\\x{0b}]+')) AS INTEGER) AS n_words, least(greatest(length(text) // 3 + 2048, 4096), 32768) AS most_tokens,
    substr(sha256(text), 1, 16) AS content_key FROM documents WHERE text IS NOT NULL"""
)
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter("text is not null")
    text = F.col("text")
    return d.select("doc_id", S.word_count(text).alias("n_words"), S.max_output_tokens(F.length(text)).alias("most_tokens"), S.content_key(text).alias("content_key"))


@query(
    f"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[{S.MATH_SIGNS}\\x{{0391}}-\\x{{03C9}}\\\\]')) * 1000.0 / greatest(len(regexp_extract_all(text, '[^\\s\\p{{Z}}\\x{{85}}\\x{{0b}}]+')), 1) AS d FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, round(CAST(d AS DOUBLE), 6) AS density, d > 15 AS math_heavy FROM w"""
)
def math_heavy(spark: SparkSession, folder: str) -> DataFrame:
    density = S.math_density(F.col("text"))
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.round(density, 6).alias("density"), (density > S.MATH_PER_THOUSAND).alias("math_heavy"))


@query(
    """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?m)[ \\t\\r]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g')) AS collapsed_md5
    FROM documents WHERE text IS NOT NULL"""
)
def collapse_blank_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.md5(S.collapse_blank_lines(F.col("text"))).alias("collapsed_md5"))


@query(
    f"""WITH {_EPISODES}, {_SECTIONS}, m AS (SELECT id, n - 1 AS chapter_no, x.title AS title, CAST(floor(greatest(x.start_secs * 1000, 0)) AS BIGINT) AS start_ms, k FROM c)
    SELECT m.id, CAST(chapter_no AS INTEGER) AS chapter_no, m.title, start_ms,
    greatest(coalesce(lead(start_ms) OVER (PARTITION BY m.id ORDER BY chapter_no), CAST(duration_secs AS BIGINT) * 1000, 0), start_ms) AS end_ms FROM m JOIN e ON e.id = m.id"""
)
def chapter_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return sections.chapters(marts.once(table(spark, folder, "episodes"), "id", "duration_secs", "sections_json"))


@query(
    f"""WITH {_EPISODES}, {_CHAPTERS} SELECT id, md5(chapters) AS chapters_md5 FROM lists"""
)
def chapter_lists(spark: SparkSession, folder: str) -> DataFrame:
    e = marts.once(table(spark, folder, "episodes"), "id", "sections_json")
    return e.select("id", F.md5(S.chapter_list(S.parse_sections_json(F.col("sections_json")))).alias("chapters_md5")).filter("chapters_md5 is not null")


@query()
def chapters_json(spark: SparkSession, folder: str) -> DataFrame:
    e = marts.once(table(spark, folder, "episodes"), "id", "sections_json")
    return e.select("id", S.chapters_json(S.parse_sections_json(F.col("sections_json"))).alias("document"))


@query(
    f"""WITH {_EPISODES}, p AS (SELECT id, 1 + length(title) % 37 AS n FROM e), r AS (SELECT id, n, unnest(generate_series(1, n, 4)) AS first_page FROM p)
    SELECT id, CAST(first_page AS INTEGER) AS first_page, CAST(least(first_page + 3, n) AS INTEGER) AS last_page FROM r"""
)
def page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Page counts are not in the tables; the length of a title stands in for one."""
    e = marts.once(table(spark, folder, "episodes"), "id", "title")
    return sections.page_ranges(e.select("id", (1 + F.length("title") % 37).alias("n_pages")))


# --- texts -------------------------------------------------------------------

_LEXICON = [("files", "fyles"), ("storage", "store age"), ("The", "Thee"), *SPOKEN]


@query(
    """WITH x(t, s) AS (VALUES """
    + ", ".join(f"('{t}', '{s}')" for t, s in dict(reversed(_LEXICON)).items())
    + """), w AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS t FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS l FROM documents WHERE text IS NOT NULL AND text <> ''))
    SELECT doc_id, md5(string_agg(coalesce(x.s, w.t), '' ORDER BY n)) AS spoken_md5, count(x.s) AS n_spoken FROM w LEFT JOIN x ON x.t = w.t GROUP BY doc_id"""
)
def lexicon_apply(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter("text is not null and text <> ''")
    terms = F.array(*[F.lit(t) for t in dict(_LEXICON)])
    tokens = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(terms, t))).cast("bigint")
    return d.select("doc_id", F.md5(X.apply_lexicon(F.col("text"), _LEXICON)).alias("spoken_md5"), hits.alias("n_spoken"))


_MASK = "regexp_replace(regexp_replace({}, '([0-9])[.]([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9])[.]([0-9])', '\\1' || chr(1) || '\\2', 'g')"
# letters, and the marks of Arabic, Devanagari and Thai that count as alphabetic
_ALPHA = "\\p{L}\\p{Nl}\\x{64B}-\\x{657}\\x{659}-\\x{65F}\\x{670}\\x{900}-\\x{903}\\x{93A}\\x{93B}\\x{93E}-\\x{94C}\\x{94E}\\x{94F}\\x{E31}\\x{E34}-\\x{E3A}\\x{E4D}"
_ABBR = f"(^|[^{_ALPHA}])([{_ALPHA}]|(?i:" + "|".join(X.SPOKEN_ABBREVIATIONS) + "))[.]"
_MASKED = "regexp_replace(regexp_replace(" + _MASK.format("text") + f", '{_ABBR}', '\\1\\2' || chr(1), 'g'), '{_ABBR}', '\\1\\2' || chr(1), 'g')"


@query(
    f"""WITH m AS (SELECT doc_id, regexp_extract_all({_MASKED}, '(?s).[^.!?]*[.!?]|(?s).+') AS l FROM documents WHERE text IS NOT NULL AND text <> '')
    SELECT doc_id, len(l) AS n_sentences, md5(replace(array_to_string(l, chr(2)), chr(1), '.')) AS sentences_md5 FROM m"""
)
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    """Spoken sentences of every document."""
    return _sentences(table(spark, folder, "documents"))


@query(ORACLES["sentence_split"])
def sentence_split_all(spark: SparkSession, folder: str) -> DataFrame:
    """The former name of ``sentence_split``."""
    return _sentences(table(spark, folder, "documents"))


def _sentences(documents: DataFrame) -> DataFrame:
    pieces = X.split_sentences(F.col("text"))
    d = documents.filter("text is not null and text <> ''")
    return d.select("doc_id", F.size(pieces).cast("bigint").alias("n_sentences"), F.md5(F.array_join(pieces, "\x02")).alias("sentences_md5"))


@query(
    f"""WITH {_EPISODES}, t AS (SELECT id, cleaned_text AS text FROM e WHERE cleaned_text IS NOT NULL AND regexp_matches(cleaned_text, '(?m)^[ \\t]*## [^#]')),
    l AS (SELECT id, generate_subscripts(a, 1) AS n, unnest(a) AS line FROM (SELECT id, string_split(text, chr(10)) AS a FROM t)),
    h AS (SELECT *, regexp_matches(line, '^\\s*## ($|[^#])') AS head FROM l), s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY id ORDER BY n) AS k FROM h),
    g AS (SELECT id, k, max(CASE WHEN head THEN trim(regexp_replace(line, '^\\s*## ', '')) END) AS title,
      regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY n), ''), '^\\s+|\\s+$', '', 'g') AS rest FROM s GROUP BY id, k)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS section_no, title,
    md5(CASE WHEN title IS NULL THEN rest WHEN rest = '' THEN title ELSE title || chr(10) || chr(10) || rest END) AS body_md5 FROM g WHERE title IS NOT NULL OR rest <> ''"""
)
def section_parse(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "episodes").select("id", "cleaned_text").filter("cleaned_text is not null")
    found = X.parse_sections(F.col("cleaned_text"))
    return e.select("id", F.posexplode(found).alias("section_no", "s")).select("id", "section_no", "s.title", F.md5("s.body").alias("body_md5")).distinct()


@query()
def greedy_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = X.speech_chunks(F.col("text"))
    each = _texts(spark, folder).select("id", F.posexplode(chunks).alias("chunk_no", "chunk"))
    return each.select("id", "chunk_no", F.octet_length("chunk").alias("n_bytes"), F.md5("chunk").alias("chunk_md5")).distinct()


@query()
def section_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return sections.timeline(sections.in_order(sections.spoken_chunks(_texts(spark, folder)).drop("chunk").distinct()))


@query()
def chunk_roles_tail(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "episodes").select("id", F.col("cleaned_text").alias("text")).filter("text is not null")
    pieces = sections.cleaned_pieces(raw).withColumn("piece_md5", F.md5("piece")).drop("piece").distinct()
    return sections.with_roles(pieces).select("id", "piece_no", "section_no", "starts_section", "role", F.length("context").alias("context_chars"), "piece_md5")


@query()
def ssml_build(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("id", F.md5(X.build_ssml(F.col("text"))).alias("ssml_md5")).distinct()


@query()
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Pages are not in the tables; the cleaned texts are put into pages and read back."""
    e = table(spark, folder, "episodes").select("id", "title", "cleaned_text").filter("cleaned_text is not null")
    paragraphs = F.array_join(F.transform(F.split("cleaned_text", "\n\n"), lambda p: F.concat(F.lit("<p>"), S.xml_escape(p), F.lit("</p>"))), "")
    page = F.concat(F.lit("<html><head><title>"), S.xml_escape(F.col("title")), F.lit("</title></head><body><nav>Menu</nav><article>"), paragraphs, F.lit("</article><footer>End</footer></body></html>"))
    return e.select("id", X.article_text(page).alias("t")).select("id", "t.title", F.md5("t.text").alias("text_md5")).distinct()


@query()
def document_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Every document through clean, summarise, describe and speech with the local provider;
    long texts by their hash, so that repeated rows fold as small rows."""
    out = pipeline.staged(pipeline.documents_of(table(spark, folder, "episodes")), pipeline.LocalProvider())
    small = out.withColumns({c: F.md5(c) for c in ("cleaned_text", "transcript", "description")})
    return small.distinct()


@query(
    f"""WITH {_USAGE} SELECT provider, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS usage_day, {_SUMS} FROM u WHERE created_at IS NOT NULL GROUP BY provider, CAST(created_at AS DATE)"""
)
def usage_daily_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The usage table read as a stream of arrivals; late and repeated rows counted rightly."""
    return usage_stream.daily_totals(spark, folder)


for _module in (rolling_queries, record_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
