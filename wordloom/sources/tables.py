"""Table schemas and the parquet table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(spec: str) -> T.StructType:
    """A schema from "name type, ..." (needs no session, unlike Spark's own DDL parser)."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in spec.split(","))])


FEEDS = _struct(
    "id string, slug string, title string, description string, feed_token string, "
    "tts_default string, created_at timestamp_ntz, image_url string"
)
EPISODES = _struct(
    "id string, feed_id string, title string, source_url string, source_type string, "
    "raw_text string, cleaned_text string, transcript string, audio_url string, image_url string, "
    "duration_secs int, tts_provider string, status string, error_msg string, pub_date timestamp_ntz, "
    "created_at timestamp_ntz, word_count int, tts_chunks_done int, tts_chunks_total int, summarize int, "
    "audio_bytes bigint, description string, sections_json string, summarize_focus string, tts_voice string"
)
JOBS = _struct(
    "id string, episode_id string, job_type string, status string, attempts int, "
    "run_after timestamp_ntz, created_at timestamp_ntz"
)
AI_USAGE = _struct(
    "id bigint, episode_id string, feed_id string, stage string, provider string, model string, "
    "input_tokens bigint, output_tokens bigint, created_at timestamp_ntz"
)
SECTION = _struct("title string, start_secs double")
DOCUMENT = _struct(
    "title string, source_type string, raw_text string, cleaned_text string, transcript string, word_count bigint"
)
SCHEMAS = {"feeds": FEEDS, "episodes": EPISODES, "jobs": JOBS, "ai_usage": AI_USAGE}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """Schema bootstrap: the named table without rows."""
    return spark.createDataFrame([], SCHEMAS[name])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet`` with the columns it has; the scan is pruned by the query."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
