"""Sinks: reports, label sets, features, shards, address lists and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(table: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header. Values are quoted and keep their blanks; NULL is an unquoted nothing. A report is one
    file, so one task writes it: it is for tables that people read."""
    options = {"header": True, "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table.coalesce(1).write.mode("overwrite").options(**options).csv(path)


def write_labels(labels: DataFrame, path: str, topic: str = "topic") -> None:
    """Labels as JSON lines in a folder per topic: one data set instead of a file per row. Rows of one topic are spread over as many
    files as their number asks for (not one task per topic)."""
    labels.write.mode("overwrite").partitionBy(topic).option("maxRecordsPerFile", 1_000_000).json(path)


def write_summary(labels: DataFrame, path: str) -> None:
    """Labels nested per video, one JSON line per video of the summary's map."""
    nested = labels.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("segment_num", "text"))).alias("labels"))
    nested.write.mode("overwrite").json(path)


def write_features(features: DataFrame, path: str, rows_per_file: int = 1000) -> None:
    """Features or logits as compressed Parquet, a bounded number of rows per file."""
    features.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def write_urls(videos: DataFrame, path: str) -> None:
    """Addresses as text lines, in the order of the listing, beside the records as JSON lines."""
    listed = videos.where("url IS NOT NULL").orderBy("index", "video_id")
    listed.select("url").write.mode("overwrite").text(f"{path}/urls")
    videos.write.mode("overwrite").json(f"{path}/records")


def write_manifest(samples: DataFrame, path: str) -> None:
    """Samples as JSON lines per split, beside their totals as one JSON file."""
    samples.write.mode("overwrite").partitionBy("split").json(f"{path}/samples")
    totals = samples.groupBy("split").agg(F.count(F.lit(1)).alias("total_samples"), F.sum("duration").alias("total_duration_seconds"))
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/totals")


def drop_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """(df without the names, those of them that it had)."""
    had = [n for n in names if n in df.columns]
    return df.drop(*had), had


def render_report(title: str, table: DataFrame, rows: int = 200) -> str:
    """A small result as text: the first rows rows, and how many more there are."""
    found, more = table.limit(rows).collect(), max(0, table.count() - rows)
    width = max([len(c) for c in table.columns], default=0)
    lines = [title, "=" * len(title)]
    for row in found:
        lines += [f"{name:<{width}}  {row[name]}" for name in table.columns] + [""]
    return "\n".join([*lines, f"({more} more rows)"] if more else lines)
