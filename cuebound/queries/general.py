"""Queries of the general problems: compaction (p2), intervals (p4) and heavy keys (p5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.functions.keys import video_key
from cuebound.operators.intervals import periods_and_gaps
from cuebound.operators.tree import heavy_keys, topic_profile
from cuebound.session import table
from cuebound.streaming.compactor import compact_tables, read_index

HEAVY_SHARE = 0.04


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id and smallest file_id of each record of segment_files."""
    return read_index(spark, compact_tables(spark, sf_dir)).select("segment_id", "file_id")


def p2_compacted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, files with a copy and bytes of content per first character of the id, over the compacted records."""
    records = spark.read.parquet(f"{compact_tables(spark, sf_dir)}/whole")
    return records.groupBy(F.substring("segment_id", 1, 1).alias("initial")).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.octet_length("content").cast("bigint")).alias("content_bytes")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of each video."""
    rows = periods_and_gaps(table(spark, sf_dir, "segments"), video_key(F.col("video_id")), F.col("start"), F.col("end"))
    return rows.withColumnRenamed("key", "video_id")


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and uncovered milliseconds of each video."""
    length = F.col("end_ms") - F.col("start_ms")
    return p4_found(spark, sf_dir).groupBy("video_id").agg(
        F.count_if(F.col("kind") == "period").alias("n_periods"),
        F.count_if(F.col("kind") == "gap").alias("n_gaps"),
        F.sum(F.when(F.col("kind") == "period", length).otherwise(0)).alias("covered_ms"),
        F.sum(F.when(F.col("kind") == "gap", length).otherwise(0)).alias("gap_ms"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of topic and video_id that hold at least 4 % of all rows."""
    return heavy_keys(table(spark, sf_dir, "segments"), ["topic", "video_id"], HEAVY_SHARE)


def p5_topic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete results per topic, by the tree."""
    return topic_profile(table(spark, sf_dir, "segments"), "topic", "video_id")


def p5_video_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete results per video_id, by the tree."""
    return topic_profile(table(spark, sf_dir, "segments"), "video_id", "topic")


#: Blanks for a regular expression of the SQL engine, which lacks a Unicode white-space class.
SQL_BLANK = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

SQL_VIDEO = rf"""
bare AS (SELECT *, regexp_replace(video_id, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g') AS bare_id FROM segments),
keyed AS (SELECT *, CASE
    WHEN regexp_full_match(bare_id, '[A-Za-z0-9_-]{{11}}') THEN bare_id
    WHEN NOT regexp_matches(bare_id, '(?i)^(?:[a-z][a-z0-9+.-]*:)?//|^[a-z0-9-]+(?:\.[a-z0-9-]+)+/') THEN NULL
    WHEN regexp_matches(bare_id, '[?&]v=') THEN nullif(regexp_extract(bare_id, '[?&]v=([A-Za-z0-9_-]{{11}})(?:[&#]|$)', 1), '')
    ELSE nullif(regexp_extract(bare_id, '^[^?#]*/([A-Za-z0-9_-]{{11}})/?(?:[?#].*)?$', 1), '') END AS vid FROM bare)"""

SQL_PERIODS = f"""
WITH {SQL_VIDEO},
i AS (SELECT DISTINCT vid, CAST(round("start" * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e FROM keyed
      WHERE vid IS NOT NULL AND abs("start") < 9e12 AND abs("end") < 9e12),
o AS (SELECT *, max(e) OVER (PARTITION BY vid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE e > s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM o),
p AS (SELECT vid, min(s) AS s, max(e) AS e FROM g GROUP BY vid, grp),
n AS (SELECT *, lead(s) OVER (PARTITION BY vid ORDER BY s) AS next_s FROM p),
found AS (SELECT vid AS video_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM n
          UNION ALL SELECT vid, 'gap', e, next_s FROM n WHERE next_s IS NOT NULL)
"""

SQL_RECORDS = rf"""
WITH f AS (SELECT file_id, regexp_extract(path, '([^/]*)$', 1) AS name,
    regexp_replace(content, '^(?:\x{{FEFF}}|{SQL_BLANK})+|(?:\x{{FEFF}}|{SQL_BLANK})+$', '', 'g') AS body FROM segment_files),
v AS (SELECT file_id, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS segment_id,
    CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' AND list_contains(json_keys(body), 'text') THEN json_extract(body, '$.text') END AS value FROM f
    WHERE starts_with(body, '{{') AND json_valid(body)),
d AS (SELECT file_id, segment_id, CASE WHEN json_type(value) = 'NULL' THEN NULL ELSE json_extract_string(value, '$') END AS text_value
      FROM v WHERE value IS NOT NULL),
found AS (SELECT segment_id, text_value, min(file_id) AS file_id FROM d GROUP BY segment_id, text_value)
"""


def _profile_sql(key: str, other: str) -> str:
    ms = lambda c: f'CASE WHEN isnan("{c}") OR abs("{c}") >= 9e12 THEN NULL ELSE CAST(round("{c}" * 1000) AS BIGINT) END'
    return f"""
SELECT {key} AS key_value, count(*) AS n_rows, count({ms("duration")}) AS n_durations, CAST(sum({ms("duration")}) AS BIGINT) AS total_ms,
  CAST(sum(CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '{SQL_BLANK}+'), lambda w: w <> '')) END) AS BIGINT) AS n_words,
  min({ms("start")}) AS first_ms, max({ms("end")}) AS last_ms, count(DISTINCT {other}) AS n_other
FROM segments GROUP BY {key}"""


QUERIES = {
    "p2_found": (p2_found, f"{SQL_RECORDS} SELECT segment_id, file_id FROM found"),
    "p2_compacted_sizes": (
        p2_compacted_sizes,
        f"""{SQL_RECORDS} SELECT substr(found.segment_id, 1, 1) AS initial, count(*) AS n_records, CAST(sum(strlen(content)) AS BIGINT) AS content_bytes
        FROM found JOIN segment_files USING (file_id) GROUP BY 1""",
    ),
    "p4_found": (p4_found, f"{SQL_PERIODS} SELECT * FROM found"),
    "p4_coverage": (
        p4_coverage,
        f"""{SQL_PERIODS} SELECT video_id, count(*) FILTER (kind = 'period') AS n_periods, count(*) FILTER (kind = 'gap') AS n_gaps,
        CAST(sum(CASE kind WHEN 'period' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS covered_ms,
        CAST(sum(CASE kind WHEN 'gap' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS gap_ms FROM found GROUP BY video_id""",
    ),
    "p5_found": (
        p5_found,
        """WITH n AS (SELECT 'topic' AS field, topic AS key_value, count(*) AS n FROM segments GROUP BY topic
        UNION ALL SELECT 'video_id', video_id, count(*) FROM segments GROUP BY video_id)
        SELECT field, key_value FROM n WHERE key_value IS NOT NULL AND n * 25 >= (SELECT count(*) FROM segments)""",
    ),
    "p5_topic_profile": (p5_topic_profile, _profile_sql("topic", "video_id")),
    "p5_video_profile": (p5_video_profile, _profile_sql("video_id", "topic")),
}
