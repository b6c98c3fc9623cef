"""Text statistics and data quality: PRJ2-PRJ5, PRJ9, PRJ10, AG5-AG9, AG15-AG22, TK1, TK2, CH5, CH7, FS1-FS10, WN1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.functions import sqltext as Q
from cuebound.functions import text as X
from cuebound.operators import quality as D
from cuebound.operators import summary as M
from cuebound.operators import vocabulary as V
from cuebound.queries.common import S, segments, stats
from cuebound.session import spread, table


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(segments(spark, sf).select("row_id", "topic", "text", "filled")).withColumn("clean", X.clean(F.col("text")))
    rows = rows.withColumns({"n_words": F.size(X.words(F.col("clean"))).cast("bigint"), "n_chars": F.length("clean").cast("bigint"), "n_sentences": X.sentence_count(F.col("text"))})
    return rows.withColumn("rate", X.rate(F.col("n_words"), F.col("filled")))


C = f"""{S}, c0 AS (SELECT *, {Q.clean("text")} AS clean FROM s), c1 AS (SELECT *, len({Q.words("clean")}) AS n_words, length(clean) AS n_chars, {Q.sentence_count("text")} AS n_sentences FROM c0),
c AS (SELECT *, {Q.rate("n_words", "filled")} AS rate FROM c1)"""


def prj02_text_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Words, characters, sentences and speaking rate of each segment, on cleaned text."""
    return _measured(spark, sf).select("row_id", "n_words", "n_chars", "n_sentences", F.round("rate", 6).alias("rate"))


def prj09_cleaners(spark: SparkSession, sf: str) -> DataFrame:
    """The three cleaned forms of each document, by their lengths and hashes."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(X.clean(t)).alias("cleaned"), F.md5(X.clean_keep_case(t)).alias("kept_case"), F.md5(X.clean_spaced(t)).alias("spaced"))


def prj10_mean_word_length(spark: SparkSession, sf: str) -> DataFrame:
    """Mean word length of each segment, 0 without words."""
    w = X.words(F.col("text"))
    total = F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return table(spark, sf, "segments").select("row_id", F.round(F.coalesce(F.try_divide(total, F.size(w)), F.lit(0.0)), 6).alias("mean_length"))


def ag05_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of words, characters and speaking rate."""
    k = "mean median min max sum"
    return _measured(spark, sf).agg(*M.statistics(F.col("n_words").cast("double"), "words", k), *M.statistics(F.col("n_chars").cast("double"), "chars", k), *M.statistics(F.col("rate"), "rate", "mean median min max"))


def ag06_word_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Word frequencies on cleaned text."""
    return V.word_counts(_measured(spark, sf), X.words(F.col("clean")))


def ag07_vocabulary_richness(spark: SparkSession, sf: str) -> DataFrame:
    """Words, different words, words that occur once, and ratios."""
    return V.richness(ag06_word_frequency(spark, sf))


def ag09_topic_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Text statistics per topic, most words first."""
    k = "mean median sum"
    grouped = _measured(spark, sf).groupBy("topic").agg(*M.statistics(F.col("n_words").cast("double"), "words", k), *M.statistics(F.col("n_chars").cast("double"), "chars", k), *M.statistics(F.col("rate"), "rate", "mean median"), F.round(F.sum("filled"), 4).alias("total_duration"))
    return grouped.orderBy(F.desc("words_sum"), "topic")


def tk01_top_words(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 most frequent words."""
    return V.top_words(ag06_word_frequency(spark, sf), 30)


def tk02_top_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The ten topics with most words."""
    return _measured(spark, sf).groupBy("topic").agg(F.sum("n_words").alias("n_words")).orderBy(F.desc("n_words"), F.asc_nulls_first("topic")).limit(10)


def wn01_repeated_words(spark: SparkSession, sf: str) -> DataFrame:
    """Segments in which a word of more than two letters follows itself."""
    return table(spark, sf, "segments").where(X.repeats_a_word(F.col("text"))).select("row_id")


def ag15_missing_data(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values per required field; a field without a column is missing everywhere."""
    return D.missing_data(segments(spark, sf), ["start", "end", "duration", "video_id", "text", "topic", "speaker"])


def ag16_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of inconsistent times."""
    return D.counted(segments(spark, sf), D.CONSISTENCY)


def ag16_segment_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Videos (per topic) whose segment numbers are not contiguous from their smallest."""
    return D.number_gaps(table(spark, sf, "segments"))


def ag17_text_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of doubtful texts."""
    return D.counted(table(spark, sf, "segments"), D.text_checks(F.col("text")))


def ag18_text_quality_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means of words, characters and word lengths of raw text."""
    w = X.words(F.col("text"))
    mean_length = F.coalesce(F.try_divide(F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)), F.size(w)), F.lit(0.0))
    return table(spark, sf, "segments").agg(F.round(F.avg(F.size(w)), 6).alias("words"), F.round(F.avg(F.length(X.or_empty(F.col("text")))), 6).alias("chars"), F.round(F.avg(mean_length), 6).alias("word_length"))


def ag19_video_id_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of unusable video ids; NULL counts as each kind."""
    return D.counted(table(spark, sf, "segments"), D.VIDEO_ID)


def ag20_segments_per_video(spark: SparkSession, sf: str) -> DataFrame:
    """Videos, their mean number of segments, and videos with fewer than three."""
    return D.per_video(table(spark, sf, "segments"))


def ag21_topic_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the largest and the smallest topic, their ratio, and whether it is beyond 5."""
    return D.balance(table(spark, sf, "segments"), "topic", 5.0)


def ag22_quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Issues per category with a status."""
    return D.quality_summary(segments(spark, sf))


def ch05_missing_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the fields is missing in each segment."""
    return segments(spark, sf).select("row_id", *[F.col(c).isNull().alias(f"no_{c}") for c in ("start", "end", "duration", "video_id", "text", "topic")])


def ch07_word_cloud(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 most frequent words with their weight relative to the first."""
    top = V.top_words(ag06_word_frequency(spark, sf), 100)
    return top.withColumn("weight", F.round(F.col("n") / F.max("n").over(M.Window.partitionBy()), 6))


W = f"{C}, v AS (SELECT word, count(*) AS n FROM (SELECT unnest({Q.words('clean')}) AS word FROM c) GROUP BY word)"
K = "mean median min max sum"
REPEATED = """g AS (SELECT row_id, ch, pos, pos - row_number() OVER (PARTITION BY row_id, ch ORDER BY pos) AS isle FROM
  (SELECT row_id, unnest(string_split(text, '')) AS ch, unnest(range(1, length(text) + 1)) AS pos FROM segments WHERE text <> '') WHERE ch <> chr(10)),
 rep AS (SELECT DISTINCT row_id FROM (SELECT row_id FROM g GROUP BY row_id, ch, isle HAVING count(*) >= 6))"""
QUALITY_SQL = f"""WITH {REPEATED}, x AS (SELECT text, row_id IN (FROM rep) AS rep FROM segments)
 SELECT count(*) FILTER (coalesce(text, '') = '') AS n_empty, count(*) FILTER (length(text) < 5) AS n_short,
  count(*) FILTER (text IS NULL OR {Q.clean_keep_case('text')} = '' OR NOT regexp_matches({Q.clean_keep_case('text')}, '.|\\n')) AS n_only_specials,
  count(*) FILTER (length(text) > 1000) AS n_long, count(*) FILTER (rep) AS n_repeated, count(*) FILTER ({Q.count_of('text', '[0-9]')} > 20) AS n_digits,
  count(*) FILTER ({Q.count_of('text', '[^' + X.WORD + X.BL + X.LATIN + ']')} > 50) AS n_specials FROM x"""


def _long(sql: str, names: list[str]) -> str:
    return f"SELECT issue, n FROM ({sql}) UNPIVOT (n FOR issue IN ({', '.join(names)}))"


CONSISTENCY_SQL = f"""{S} SELECT count(*) FILTER (st > en) AS start_after_end, count(*) FILTER (abs(du - (en - st)) > 0.1) AS mismatch, count(*) FILTER (filled < 0) AS negative, count(*) FILTER (filled = 0) AS zero FROM s"""
VIDEO_SQL = r"""SELECT count(*) FILTER (coalesce(video_id, '') = '') AS n_empty, count(*) FILTER (coalesce(length(video_id) <> 11, true)) AS n_length, count(*) FILTER (NOT coalesce(regexp_full_match(video_id, '[A-Za-z0-9_-]+\n?'), false)) AS n_characters FROM segments"""
MISSING_SQL = f"{S}, m AS (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS m_{n}" for n, c in (("start", "st"), ("end", "en"), ("duration", "du"), ("video_id", "video_id"), ("text", "text"), ("topic", "topic"))) + " FROM s) " + " UNION ALL ".join(f"SELECT '{n}' AS field, {'m_' + n if n != 'speaker' else 'total'} AS n_missing, round({'m_' + n if n != 'speaker' else 'total'} * 100 / total, 6) AS share FROM m" for n in ("start", "end", "duration", "video_id", "text", "topic", "speaker"))
NUMBERS_SQL = r"""WITH n AS (SELECT topic, regexp_extract(segment_id, '^(.*)_\d+$', 1) AS video, TRY_CAST(nullif(regexp_extract(segment_id, '_(\d+)$', 1), '') AS BIGINT) AS num FROM segments)
 SELECT topic, video, count(DISTINCT num) AS n_numbers, max(num) - min(num) + 1 AS n_expected FROM n WHERE num IS NOT NULL GROUP BY topic, video HAVING count(DISTINCT num) <> max(num) - min(num) + 1"""

QUERIES = {
    "prj02_text_measures": (prj02_text_measures, f"{C} SELECT row_id, n_words, n_chars, n_sentences, {Q.zero('round(rate, 6)')} AS rate FROM c"),
    "prj09_cleaners": (prj09_cleaners, f"SELECT doc_id, md5({Q.clean('text')}) AS cleaned, md5({Q.clean_keep_case('text')}) AS kept_case, md5({Q.clean_spaced('text')}) AS spaced FROM documents"),
    "prj10_mean_word_length": (prj10_mean_word_length, f"WITH w AS (SELECT row_id, {Q.words('text')} AS w FROM segments) SELECT row_id, round(CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform(w, lambda x: length(x))) / len(w) END, 6) AS mean_length FROM w"),
    "ag05_text_stats": (ag05_text_stats, f"{C} SELECT {stats('CAST(n_words AS DOUBLE)', 'words', K)}, {stats('CAST(n_chars AS DOUBLE)', 'chars', K)}, {stats('rate', 'rate', 'mean median min max')} FROM c"),
    "ag06_word_frequency": (ag06_word_frequency, f"{W} SELECT word, n FROM v"),
    "ag07_vocabulary_richness": (ag07_vocabulary_richness, f"{W} SELECT CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_unique, count(*) FILTER (n = 1) AS n_hapax, round(count(*) / sum(n), 6) AS richness, round(count(*) FILTER (n = 1) * 100 / count(*), 6) AS hapax_share FROM v"),
    "ag09_topic_text_stats": (ag09_topic_text_stats, f"{C} SELECT topic, {stats('CAST(n_words AS DOUBLE)', 'words', 'mean median sum')}, {stats('CAST(n_chars AS DOUBLE)', 'chars', 'mean median sum')}, {stats('rate', 'rate', 'mean median')}, round(sum(filled), 4) AS total_duration FROM c GROUP BY topic"),
    "tk01_top_words": (tk01_top_words, f"{W} SELECT word, n FROM v ORDER BY n DESC, word LIMIT 30"),
    "tk02_top_topics": (tk02_top_topics, f"{C} SELECT topic, CAST(sum(n_words) AS BIGINT) AS n_words FROM c GROUP BY topic ORDER BY n_words DESC, topic NULLS FIRST LIMIT 10"),
    "wn01_repeated_words": (wn01_repeated_words, f"WITH w AS (SELECT row_id, {Q.words('lower(text)')} AS w FROM segments) SELECT row_id FROM w WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) > 2)) > 0"),
    "ag15_missing_data": (ag15_missing_data, MISSING_SQL),
    "ag16_consistency": (ag16_consistency, _long(CONSISTENCY_SQL, ["start_after_end", "mismatch", "negative", "zero"])),
    "ag16_segment_numbers": (ag16_segment_numbers, NUMBERS_SQL),
    "ag17_text_quality": (ag17_text_quality, _long(QUALITY_SQL, ["n_empty", "n_short", "n_only_specials", "n_long", "n_repeated", "n_digits", "n_specials"])),
    "ag18_text_quality_means": (ag18_text_quality_means, f"WITH w AS (SELECT text, {Q.words('text')} AS w FROM segments) SELECT round(avg(len(w)), 6) AS words, round(avg(length(coalesce(text, ''))), 6) AS chars, round(avg(CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform(w, lambda x: length(x))) / len(w) END), 6) AS word_length FROM w"),
    "ag19_video_id_checks": (ag19_video_id_checks, _long(VIDEO_SQL, ["n_empty", "n_length", "n_characters"])),
    "ag20_segments_per_video": (ag20_segments_per_video, "WITH v AS (SELECT video_id, count(*) AS n FROM segments WHERE video_id IS NOT NULL GROUP BY 1) SELECT count(*) AS n_videos, round(avg(n), 6) AS mean_segments, count(*) FILTER (n < 3) AS n_small FROM v"),
    "ag21_topic_balance": (ag21_topic_balance, "WITH v AS (SELECT topic, count(*) AS n FROM segments WHERE topic IS NOT NULL GROUP BY 1) SELECT max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 6) AS ratio, max(n) > 5.0 * min(n) AS is_imbalanced FROM v"),
    "ag22_quality_summary": (ag22_quality_summary, None),
    "ch05_missing_matrix": (ch05_missing_matrix, f"{S} SELECT row_id, st IS NULL AS no_start, en IS NULL AS no_end, du IS NULL AS no_duration, video_id IS NULL AS no_video_id, text IS NULL AS no_text, topic IS NULL AS no_topic FROM s"),
    "ch07_word_cloud": (ch07_word_cloud, f"{W}, k AS (SELECT word, n FROM v ORDER BY n DESC, word LIMIT 100) SELECT word, n, round(n / max(n) OVER (), 6) AS weight FROM k"),
}
QUERIES["ag22_quality_summary"] = (
    ag22_quality_summary,
    f"""WITH a AS (SELECT 'Missing Data' AS category, CAST(sum(n_missing) AS BIGINT) AS n_issues FROM ({MISSING_SQL}) WHERE field <> 'speaker'),
    b AS (SELECT 'Consistency' AS category, count(*) AS n_issues FROM ({_long(CONSISTENCY_SQL, ["start_after_end", "mismatch", "negative", "zero"])}) WHERE n > 0),
    c AS (SELECT 'Text Quality' AS category, count(*) AS n_issues FROM ({_long(QUALITY_SQL, ["n_empty", "n_short", "n_only_specials", "n_long", "n_repeated", "n_digits", "n_specials"])}) WHERE n > 0),
    d AS (SELECT 'Video IDs' AS category, count(*) AS n_issues FROM ({_long(VIDEO_SQL, ["n_empty", "n_length", "n_characters"])}) WHERE n > 0)
    SELECT category, n_issues, CASE WHEN n_issues = 0 THEN 'OK' ELSE 'ISSUES' END AS status FROM (FROM a UNION ALL FROM b UNION ALL FROM c UNION ALL FROM d)""",
)
