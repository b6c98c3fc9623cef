"""Data quality: missing values, inconsistent times, doubtful texts, unusable ids, balance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebound.functions import text as X
from cuebound.operators.summary import rounded


def counted(df: DataFrame, checks: dict[str, Column | str]) -> DataFrame:
    """(issue, n): the rows for which each check is true (NULL is not), in one pass; 0 for an empty df."""
    row = df.agg(*[F.count_if(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in checks.items()])
    return row.unpivot([], list(checks), "issue", "n")


#: Checks of times on tidy segments, and of video ids.
CONSISTENCY = {"start_after_end": "start > end", "mismatch": "abs(duration - (end - start)) > 0.1", "negative": "filled < 0", "zero": "filled = 0"}
VIDEO_ID = {
    "n_empty": "coalesce(video_id, '') = ''",
    "n_length": "coalesce(length(video_id) <> 11, true)",
    "n_characters": "NOT coalesce(video_id RLIKE '^[A-Za-z0-9_-]+$', false)",
}


def text_checks(text: Column) -> dict[str, Column]:
    """Checks of a text: empty, under five characters, nothing but specials, over 1000 characters, a character six times in a
    row, over 20 digits, over 50 specials. NULL is empty and nothing but specials, no other."""
    return {
        "n_empty": X.or_empty(text) == "",
        "n_short": F.length(text) < 5,
        "n_only_specials": X.clean_keep_case(text) == "",
        "n_long": F.length(text) > 1000,
        "n_repeated": X.repeats_a_character(text, 6),
        "n_digits": X.count_of(text, "[0-9]") > 20,
        "n_specials": X.count_of(text, X.SPECIAL) > 50,
    }


def missing_data(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_missing, share in percent) of each field; a field that df lacks is missing in every row."""
    total = F.count(F.lit(1))
    rows = df.agg(total.alias("total"), *[(F.count_if(F.col(f).isNull()) if f in df.columns else total).alias(f) for f in fields])
    long = rows.unpivot(["total"], fields, "field", "n_missing")
    return long.select("field", "n_missing", rounded(F.coalesce(F.try_divide(F.col("n_missing") * 100, F.col("total")), F.lit(0.0))).alias("share"))


def number_gaps(segments: DataFrame) -> DataFrame:
    """(topic, video, n_numbers, n_expected) of the videos whose segment numbers (the digits after the last underscore of
    segment_id) are not contiguous from their smallest to their largest; repeated numbers count once."""
    number = F.regexp_extract("segment_id", r"_(\d+)$", 1)
    rows = segments.where(number != "").select("topic", F.regexp_extract("segment_id", r"^(.*)_\d+$", 1).alias("video"), F.expr("try_cast(regexp_extract(segment_id, '_(\\\\d+)$', 1) AS BIGINT)").alias("num"))
    found = rows.groupBy("topic", "video").agg(F.count_distinct("num").alias("n_numbers"), (F.max("num") - F.min("num") + 1).alias("n_expected"))
    return found.where("n_numbers <> n_expected")


def per_video(segments: DataFrame) -> DataFrame:
    """Videos (as stored, NULL aside), mean segments of a video, and videos with fewer than three."""
    counts = segments.where("video_id IS NOT NULL").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("n_videos"), rounded(F.avg("n")).alias("mean_segments"), F.count_if(F.col("n") < 3).alias("n_small"))


def balance(df: DataFrame, key: str, limit: float) -> DataFrame:
    """Rows of the largest and smallest key (NULL aside), their ratio, and whether it is beyond limit; NULLs for no key."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = counts.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"))
    return both.select("largest", "smallest", rounded(F.col("largest") / F.col("smallest")).alias("ratio"), (F.col("largest") > limit * F.col("smallest")).alias("is_imbalanced"))


def quality_summary(segments: DataFrame) -> DataFrame:
    """(category, n_issues, status): missing cells, and the kinds of issues that occur in times, texts and video ids; one pass."""
    fields = ["start", "end", "duration", "video_id", "text", "topic"]
    kinds = {"Consistency": CONSISTENCY, "Text Quality": text_checks(F.col("text")), "Video IDs": VIDEO_ID}
    checks = {f"{kind} {name}": F.expr(c) if isinstance(c, str) else c for kind, named in kinds.items() for name, c in named.items()}
    counts = [F.count_if(F.col(f).isNull()).alias(f) for f in fields] + [F.count_if(c).alias(name) for name, c in checks.items()]
    row = segments.agg(*counts)
    found = {"Missing Data": reduce(Column.__add__, map(F.col, fields))}
    for kind, named in kinds.items():
        found[kind] = reduce(Column.__add__, [(F.col(f"`{kind} {name}`") > 0).cast("bigint") for name in named])
    rows = row.select(F.inline(F.array(*[F.struct(F.lit(kind).alias("category"), n.alias("n_issues")) for kind, n in found.items()])))
    return rows.withColumn("status", F.when(F.col("n_issues") == 0, "OK").otherwise("ISSUES"))
