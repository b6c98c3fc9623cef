"""What the query modules share: the tidy segments on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuebound.functions.sqltext import number
from cuebound.session import table
from cuebound.sources.segments import tidy


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments table, tidy."""
    return tidy(table(spark, sf_dir, "segments"))


#: The same rows for SQL: s(row_id, segment_id, topic, video_id, text, file_path, st, en, du, filled).
S = f"""WITH s0 AS (SELECT row_id, segment_id, topic, video_id, text, file_path, created_at, ingested_at, {number('"start"')} AS st,
    {number('"end"')} AS en, {number('"duration"')} AS du FROM segments), s AS (SELECT *, coalesce(du, en - st) AS filled FROM s0)"""


def stats(value: str, name: str, kinds: str = "count sum mean median min max std") -> str:
    """SQL of operators.summary.statistics."""
    make = {
        "count": f"count({value})",
        "sum": f"round(sum({value}), 4)",
        "mean": f"round(avg({value}), 6)",
        "median": f"round(median(CAST({value} AS DOUBLE)), 6)",
        "min": f"min({value})",
        "max": f"max({value})",
        "std": f"round(stddev_samp({value}), 6)",
        "q25": f"round(quantile_cont(CAST({value} AS DOUBLE), 0.25), 6)",
        "q75": f"round(quantile_cont(CAST({value} AS DOUBLE), 0.75), 6)",
    }
    return ", ".join(f"{make[k]} AS {name}_{k}" for k in kinds.split())


def category(d: str) -> str:
    """SQL of operators.summary.duration_category."""
    return f"CASE WHEN {d} <= 0 THEN NULL WHEN {d} <= 10 THEN '0-10s' WHEN {d} <= 20 THEN '10-20s' WHEN {d} <= 30 THEN '20-30s' WHEN {d} <= 60 THEN '30-60s' WHEN {d} > 60 THEN '60s+' END"


def hist_sql(rows: str, value: str, bins: int) -> str:
    """SQL of operators.summary.histogram; rows begins with WITH."""
    return f"""{rows}, hv AS (SELECT CAST({value} AS DOUBLE) AS v FROM s WHERE {value} IS NOT NULL),
    he0 AS (SELECT min(v) AS a, max(v) AS b FROM hv), he AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS a, CASE WHEN a = b THEN b + 0.5 ELSE b END AS b FROM he0),
    hb AS (SELECT CAST(least(floor((v - a) / (b - a) * {bins}), {bins - 1}) AS INTEGER) AS bin, a, b FROM hv, he)
    SELECT bin, round(min(a) + bin * (min(b) - min(a)) / {bins}, 6) AS low, round(min(a) + (bin + 1) * (min(b) - min(a)) / {bins}, 6) AS high, count(*) AS n FROM hb GROUP BY bin"""


def box_sql(rows: str, key: str, value: str) -> str:
    """SQL of operators.summary.box_plot."""
    return f"""{rows}, bq AS (SELECT {key} AS k, quantile_cont(CAST({value} AS DOUBLE), 0.25) AS q1, median(CAST({value} AS DOUBLE)) AS q2, quantile_cont(CAST({value} AS DOUBLE), 0.75) AS q3 FROM s WHERE {value} IS NOT NULL GROUP BY 1),
    bi AS (SELECT bq.*, {value} AS v, {value} >= q1 - 1.5 * (q3 - q1) AND {value} <= q3 + 1.5 * (q3 - q1) AS inside FROM s JOIN bq ON s.{key} IS NOT DISTINCT FROM bq.k WHERE {value} IS NOT NULL)
    SELECT k AS {key}, round(any_value(q1), 6) AS q25, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q75, min(v) FILTER (inside) AS low_whisker,
    max(v) FILTER (inside) AS high_whisker, count(*) FILTER (NOT inside) AS n_outliers FROM bi GROUP BY k"""
