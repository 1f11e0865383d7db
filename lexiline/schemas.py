"""Table schemas. Times are whole milliseconds: exact arithmetic and integer bucket keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

TRACKS = (
    "track_id BIGINT, file_name STRING, artist STRING, title STRING, album STRING, duration_ms BIGINT, "
    "language STRING, status STRING, default_censor_type STRING"
)
WORDS = (
    "track_id BIGINT, pass STRING, word_id BIGINT, pos BIGINT, word STRING, start_ms BIGINT, end_ms BIGINT, "
    "confidence DOUBLE, is_profanity BOOLEAN, detection_source STRING, match_type STRING, matched STRING, "
    "censor_type STRING, original_word STRING, correction_confidence DOUBLE"
)
TIMED_LINES = "track_id BIGINT, line_no BIGINT, time_ms BIGINT, text STRING"
REF_TOKENS = "track_id BIGINT, line_no BIGINT, pos BIGINT, token STRING"
LEXICON = "term STRING, lang STRING, tier STRING"
REGIONS = "track_id BIGINT, region_no BIGINT, start_ms BIGINT, end_ms BIGINT, censor_type STRING, n_words BIGINT"
FRAMES = "track_id BIGINT, frame BIGINT, rms DOUBLE"
SPEC = "track_id BIGINT, frame BIGINT, bins ARRAY<FLOAT>"
CATALOG = "entry_id BIGINT, artist STRING, title STRING, duration_ms BIGINT, plain STRING, synced STRING, rank BIGINT"
TAGS = "track_id BIGINT, container STRING, key STRING, value BINARY"
USERS = (
    "uid BIGINT, email STRING, songs_processed BIGINT, songs_imported BIGINT, songs_ready BIGINT, "
    "songs_exported BIGINT, created_at TIMESTAMP, last_active_at TIMESTAMP, subscription STRUCT<status: STRING, "
    "lifetime: BOOLEAN, customer_id: BIGINT, sub_id: BIGINT, current_period_end: TIMESTAMP, "
    "cancel_at_period_end: BOOLEAN, billable_count: BIGINT>"
)
SUBSCRIPTIONS = (
    "customer_id BIGINT, sub_id BIGINT, status STRING, period_end TIMESTAMP, cancel_at_period_end BOOLEAN"
)
EDITS = (
    "track_id BIGINT, seq BIGINT, action STRING, word_id BIGINT, censor_type STRING, word STRING, "
    "start_ms BIGINT, end_ms BIGINT"
)


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project onto a schema: cast what is there, add what is missing as nulls."""
    cols = []
    for field in struct_type(ddl).fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def conform_words(df: DataFrame) -> DataFrame:
    """Word rows with every optional column present; a missing flag means false."""
    return conform(df, WORDS).withColumn("is_profanity", F.coalesce("is_profanity", F.lit(False)))
