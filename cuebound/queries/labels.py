"""Subtitles, labels and crawl listings: SRC5, SRC6, SNK2, SNK3, SNK7, SNK8, PRJ11-PRJ15, JN1, JN12-JN14, FD1, FS8-FS14, AG48, ST1, ST5, TK5, WN12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.functions import text as X
from cuebound.operators import overlap as O
from cuebound.operators.intervals import to_ms
from cuebound.session import table
from cuebound.sources import crawl as R
from cuebound.sources import subtitles as B

WIDTH = 30


def _clock(seconds: str) -> str:
    ms = f"CAST(round({seconds} * 1000) AS BIGINT)"
    return f"concat(lpad(CAST({ms} DIV 3600000 AS STRING), 2, '0'), ':', lpad(CAST({ms} DIV 60000 % 60 AS STRING), 2, '0'), ':', lpad(CAST({ms} DIV 1000 % 60 AS STRING), 2, '0'), ',', lpad(CAST({ms} % 1000 AS STRING), 3, '0'))"


def _srt(spark: SparkSession, sf: str) -> DataFrame:
    """A file of three blocks per cue: the cue, one without text, one without a time line."""
    cues = table(spark, sf, "cues").where("start >= 0 AND end >= 0")
    block = F.concat_ws("\n", F.coalesce("cue_index", F.lit("0")), F.concat(F.expr(_clock("start")), F.lit(" --> "), F.expr(_clock("end"))), "text")
    return cues.select("cue_id", F.concat(block, F.lit("\n\n7\n00:00:05 --> 00:00:06,000\n \n\n8\nno time\nhere\n")).alias("content"))


def src05_srt_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Cues parsed from SRT text that is written from the cues table."""
    return B.parse_srt(_srt(spark, sf), "cue_id", "content").select("cue_id", "pos", "cue_index", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def snk07_srt_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """Plain text of SRT text."""
    return _srt(spark, sf).select("cue_id", B.srt_to_text(F.col("content")).alias("text"))


_CLOCK_SQL = lambda s: f"printf('%02d:%02d:%02d,%03d', CAST(round({s} * 1000) AS BIGINT) // 3600000, CAST(round({s} * 1000) AS BIGINT) // 60000 % 60, CAST(round({s} * 1000) AS BIGINT) // 1000 % 60, CAST(round({s} * 1000) AS BIGINT) % 1000)"
SRT_SQL = f"""WITH srt AS (SELECT cue_id, concat_ws(chr(10), coalesce(cue_index, '0'), {_CLOCK_SQL('"start"')} || ' --> ' || {_CLOCK_SQL('"end"')}, text) || chr(10) || chr(10) || '7' || chr(10) || '00:00:05 --> 00:00:06,000' || chr(10) || ' ' || chr(10) || chr(10) || '8' || chr(10) || 'no time' || chr(10) || 'here' || chr(10) AS content
 FROM cues WHERE "start" >= 0 AND "end" >= 0)"""
_SECONDS_SQL = lambda t: f"CASE WHEN regexp_full_match({t}, '[0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}}[.,][0-9]{{1,6}}') AND CAST(split_part({t}, ':', 1) AS INTEGER) <= 23 THEN round(CAST(split_part({t}, ':', 1) AS INTEGER) * 3600 + CAST(split_part({t}, ':', 2) AS INTEGER) * 60 + CAST(replace(split_part({t}, ':', 3), ',', '.') AS DOUBLE), 3) ELSE 0.0::DOUBLE END"


def jn01_overlap_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of cues in each 30-second segment of a video: the flagship."""
    return O.label_segments(table(spark, sf, "cues"), float(WIDTH), "cue_id")


def jn01_segment_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Cues that overlap each segment of any length: how many, and the smallest and largest id."""
    segs = table(spark, sf, "segments").select("row_id", "video_id", to_ms(F.col("start")).alias("left_start"), to_ms(F.col("end")).alias("left_end"))
    cues = table(spark, sf, "cues").select("cue_id", "video_id", to_ms(F.col("start")).alias("right_start"), to_ms(F.col("end")).alias("right_end"))
    return O.overlap_join(segs, cues, "video_id").groupBy("row_id").agg(F.count(F.lit(1)).alias("n_cues"), F.min("cue_id").alias("first_cue"), F.max("cue_id").alias("last_cue"))


def snk02_label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Label rows as they are written: names of the pair of files beside the label."""
    name = F.format_string("%s_%03d", "video_id", "segment_num")
    return jn01_overlap_labels(spark, sf).select(F.concat(name, F.lit(".json")).alias("json_file"), F.concat(name, F.lit(".wav")).alias("audio_file"), "video_id", "segment_num", "start", "end", F.lit(float(WIDTH)).alias("duration"), "text")


def snk03_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Labels nested per video, one row per video of the summary map."""
    rows = snk02_label_pairs(spark, sf)
    nested = rows.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("segment_num", "json_file"))).alias("labels"))
    return nested.select("video_id", F.size("labels").cast("bigint").alias("n_labels"), F.array_join("labels.json_file", " ").alias("files"))


def prj12_fixed_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-width segments of each video with their true ends."""
    videos = table(spark, sf, "videos").where("duration > 0").groupBy("video_id").agg(F.max("duration").alias("duration"))
    return O.fixed_segments(videos, WIDTH).withColumn("name", F.format_string("%s_segment_%03d", "video_id", "segment_id"))


def prj14_duration_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Videos from 5 to 60 minutes."""
    return table(spark, sf, "videos").where("duration BETWEEN 300 AND 3600").select("video_id", "index")


def prj15_available_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Listings that are usable: with an id that is no channel's, whose availability is not restricted."""
    status = F.element_at(F.array(*map(F.lit, R.STATES)), (F.pmod(F.col("index"), F.lit(len(R.STATES))) + 1))
    return R.available(table(spark, sf, "videos").withColumn("availability", status)).select("video_id", "index", "availability")


def jn12_subtitle_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first subtitle file of each video, by name."""
    files = table(spark, sf, "cues").select(F.concat(F.lit("subs/"), "video_id", F.lit("."), F.coalesce("lang", F.lit("xx")), F.lit(".srt")).alias("path")).distinct()
    return B.subtitle_of_video(table(spark, sf, "videos"), files)


def jn13_preferred_language(spark: SparkSession, sf: str) -> DataFrame:
    """The subtitle language to take for each video: vi, then en, then the first there is."""
    return B.preferred_language(table(spark, sf, "cues"), ["vi", "en"])


def jn14_merged_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Automatic and manual tracks of each video merged; the manual one wins where both have a language."""
    cues = table(spark, sf, "cues").where("lang IS NOT NULL")
    return R.merge_tracks(cues.where("cue_id % 2 = 0"), cues.where("cue_id % 2 = 1"))


def src06_url_list(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of videos, trimmed, without blanks and repeats: the first 50 in order."""
    return R.url_list(table(spark, sf, "videos"), "url", 50)


def fs11_url_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids in addresses by the watch and short forms, of one form of each address."""
    url = F.when(F.col("index") % 3 == 0, F.concat(F.lit("https://youtu.be/"), "video_id", F.lit("?si=1"))).when(F.col("index") % 3 == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id", F.lit("&t=1"))).otherwise(F.col("url"))
    rows = table(spark, sf, "videos").withColumn("made", url).select("video_id", "index", "made").distinct()
    return rows.select("video_id", "index", "made", X.video_id_of_address(F.col("made")).alias("found"))


def fs12_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Normalized addresses and names of channels."""
    urls = table(spark, sf, "videos").select("channel_url").where("channel_url IS NOT NULL").distinct()
    return urls.select("channel_url", R.channel_videos_url(F.col("channel_url")).alias("videos_url"), R.channel_name(F.col("channel_url")).alias("name"))


def fs13_safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """Titles as file names."""
    return table(spark, sf, "videos").where("title IS NOT NULL").select("title", X.file_name_safe(F.concat("title", F.lit(' <a>:"b"/|c?*'))).alias("safe")).distinct()


def fs14_path_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Stem, suffix and number of each small file's path."""
    return table(spark, sf, "segment_files").select("file_id", X.stem(F.col("path")).alias("stem"), X.suffix(F.col("path")).alias("suffix"), F.regexp_extract("path", r"_(\d{3})\.[^./]*$", 1).alias("number"))


def ag48_crawl_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Hours, mean minutes and channels of the listing, and videos per channel."""
    return R.crawl_stats(table(spark, sf, "videos"))


def tk05_selected_videos(spark: SparkSession, sf: str) -> DataFrame:
    """The longest, shortest and first videos of the listing, ten each."""
    return R.select_videos(table(spark, sf, "videos").where("duration > 0"), 10)


def wn12_first_valid(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 videos of the listing that pass the filters."""
    rows = table(spark, sf, "videos").where("duration BETWEEN 300 AND 3600 AND url IS NOT NULL AND title IS NOT NULL")
    return rows.orderBy("index", "video_id", "crawled_at").limit(25).select("index", "video_id", F.unix_micros("crawled_at").alias("us"))


LABEL_SQL = """WITH l AS (SELECT video_id, CAST(n AS BIGINT) AS n, string_agg(text, ' ' ORDER BY cue_id, text) AS text FROM (SELECT *, unnest(range(CAST(floor("start" / 30) AS BIGINT), CAST(ceil("end" / 30) AS BIGINT))) AS n
 FROM cues WHERE "start" >= 0 AND "end" > "start" AND text <> '' AND video_id IS NOT NULL) GROUP BY video_id, n)"""
ROWS_L = 'video_id, n + 1 AS segment_num, CAST(n * 30 AS DOUBLE) AS "start", CAST((n + 1) * 30 AS DOUBLE) AS "end", text'
STATES_SQL = "[" + ", ".join(f"'{s}'" for s in R.STATES) + "]"
QUERIES = {
    "src05_srt_cues": (src05_srt_cues, rf"""{SRT_SQL}, b AS (SELECT cue_id, unnest(bl) AS block, unnest(range(len(bl))) AS pos FROM (SELECT cue_id, regexp_split_to_array(trim(content), '\n[ \t\r\f\x0B]*\n(?:[ \t\r\f\x0B]*\n)*') AS bl FROM (SELECT cue_id, replace(content, chr(13), '') AS content FROM srt))),
     l AS (SELECT cue_id, pos, string_split(regexp_replace(block, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM b), g AS (SELECT cue_id, pos, trim(l[1]) AS cue_index, trim(split_part(l[2], ' --> ', 1)) AS a, trim(split_part(l[2], ' --> ', 2)) AS z, trim(array_to_string(l[3:], ' ')) AS text FROM l WHERE len(l) >= 3 AND contains(l[2], '-->') AND len(string_split(l[2], ' --> ')) = 2)
     SELECT cue_id, CAST(pos AS INTEGER) AS pos, cue_index, {_SECONDS_SQL('a')} AS "start", {_SECONDS_SQL('z')} AS "end", text FROM g WHERE text <> ''"""),
    "snk07_srt_to_text": (snk07_srt_to_text, rf"{SRT_SQL} SELECT cue_id, array_to_string(list_filter(regexp_split_to_array(content, '\r?\n'), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\s*\d+\s*$') AND NOT contains(x, '-->')), chr(10)) AS text FROM srt"),
    "jn01_overlap_labels": (jn01_overlap_labels, f"{LABEL_SQL} SELECT {ROWS_L} FROM l"),
    "jn01_segment_cues": (jn01_segment_cues, """WITH s AS (SELECT row_id, video_id, CAST(round("start" * 1000) AS BIGINT) AS a, CAST(round("end" * 1000) AS BIGINT) AS b FROM segments WHERE NOT isnan("start") AND NOT isnan("end")),
     c AS (SELECT cue_id, video_id, CAST(round("start" * 1000) AS BIGINT) AS x, CAST(round("end" * 1000) AS BIGINT) AS y FROM cues WHERE NOT isnan("start") AND NOT isnan("end"))
     SELECT row_id, count(*) AS n_cues, min(cue_id) AS first_cue, max(cue_id) AS last_cue FROM s JOIN c USING (video_id) WHERE b > a AND y > x AND greatest(a, x) < least(b, y) GROUP BY row_id"""),
    "snk02_label_pairs": (snk02_label_pairs, f"{LABEL_SQL} SELECT printf('%s_%03d', video_id, n + 1) || '.json' AS json_file, printf('%s_%03d', video_id, n + 1) || '.wav' AS audio_file, {ROWS_L}, 30.0::DOUBLE AS duration FROM l"),
    "snk03_dataset_summary": (snk03_dataset_summary, f"{LABEL_SQL} SELECT video_id, count(*) AS n_labels, string_agg(printf('%s_%03d', video_id, n + 1) || '.json', ' ' ORDER BY n) AS files FROM l GROUP BY video_id"),
    "prj12_fixed_segments": (prj12_fixed_segments, "WITH v AS (SELECT video_id, max(duration) AS d FROM videos WHERE duration > 0 GROUP BY 1), u AS (SELECT video_id, d, unnest(range(1, CAST(ceil(d / 30) AS BIGINT) + 1)) AS segment_id FROM v) SELECT video_id, segment_id, (segment_id - 1) * 30 AS start_time, least(segment_id * 30, d) AS end_time, printf('%s_segment_%03d', video_id, segment_id) AS name FROM u"),
    "prj14_duration_filter": (prj14_duration_filter, 'SELECT video_id, "index" FROM videos WHERE duration BETWEEN 300 AND 3600'),
    "prj15_available_videos": (prj15_available_videos, f"""SELECT * FROM (SELECT video_id, "index", {STATES_SQL}[CAST("index" % {len(R.STATES)} + 1 AS INTEGER)] AS availability FROM videos) WHERE coalesce(availability, '') NOT IN ('private', 'premium_only', 'subscriber_only') AND video_id IS NOT NULL AND NOT starts_with(video_id, 'UC')"""),
    "jn12_subtitle_files": (jn12_subtitle_files, "WITH f AS (SELECT DISTINCT video_id, 'subs/' || video_id || '.' || coalesce(lang, 'xx') || '.srt' AS path FROM cues), b AS (SELECT video_id, min(path) AS path FROM f GROUP BY 1) SELECT video_id, path FROM (SELECT DISTINCT video_id FROM videos) LEFT JOIN b USING (video_id)"),
    "jn13_preferred_language": (jn13_preferred_language, "SELECT video_id, arg_min(lang, (CASE lang WHEN 'vi' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, lang)) AS lang FROM cues WHERE lang IS NOT NULL AND video_id IS NOT NULL GROUP BY 1"),
    "jn14_merged_tracks": (jn14_merged_tracks, "WITH a AS (SELECT video_id, lang, max(cue_id % 2) AS m FROM cues WHERE lang IS NOT NULL GROUP BY 1, 2) SELECT video_id, lang, CASE m WHEN 1 THEN 'manual' ELSE 'automatic' END AS kind FROM a"),
    "src06_url_list": (src06_url_list, "SELECT DISTINCT trim(url) AS url FROM videos WHERE trim(url) <> '' ORDER BY url LIMIT 50"),
    "fs11_url_ids": (fs11_url_ids, """WITH m AS (SELECT DISTINCT video_id, "index", CASE "index" % 3 WHEN 0 THEN 'https://youtu.be/' || video_id || '?si=1' WHEN 1 THEN 'https://www.youtube.com/watch?v=' || video_id || '&t=1' ELSE url END AS made FROM videos)
     SELECT *, CASE WHEN contains(made, 'watch?v=') THEN split_part(split_part(made, 'watch?v=', 2), '&', 1) WHEN contains(made, 'youtu.be/') THEN split_part(split_part(made, 'youtu.be/', 2), '?', 1) END AS found FROM m"""),
    "fs12_channels": (fs12_channels, r"SELECT DISTINCT channel_url, CASE WHEN regexp_matches(channel_url, '/videos/?$') THEN channel_url ELSE regexp_replace(channel_url, '/+$', '') || '/videos' END AS videos_url, CASE WHEN contains(channel_url, '@') THEN regexp_extract(channel_url, '@([^/?]+)', 1) ELSE regexp_extract(channel_url, '([^/]+)/*$', 1) END AS name FROM videos WHERE channel_url IS NOT NULL"),
    "fs13_safe_names": (fs13_safe_names, """SELECT DISTINCT title, regexp_replace(title || ' <a>:"b"/|c?*', '[<>:"/\\\\|?*]', '_', 'g') AS safe FROM videos WHERE title IS NOT NULL"""),
    "fs14_path_parts": (fs14_path_parts, r"SELECT file_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, lower(regexp_extract(path, '[^/.][^/]*(\.[^./]*)$', 1)) AS suffix, regexp_extract(path, '_(\d{3})\.[^./]*$', 1) AS number FROM segment_files"),
    "ag48_crawl_stats": (ag48_crawl_stats, "WITH v AS (SELECT * FROM videos), n AS (SELECT count(*) AS n, sum(duration) AS d, count(duration) AS k, count(DISTINCT channel) AS c FROM v) SELECT n AS n_videos, round(d / 3600, 6) AS hours, round(d / k / 60, 6) AS mean_minutes, c AS n_channels, round(n / c, 6) AS videos_per_channel FROM n"),
    "tk05_selected_videos": (tk05_selected_videos, """WITH v AS (SELECT * FROM videos WHERE duration > 0) (SELECT 'longest' AS strategy, video_id, duration FROM v ORDER BY duration DESC, video_id, crawled_at LIMIT 10) UNION ALL (SELECT 'shortest', video_id, duration FROM v ORDER BY duration, video_id, crawled_at LIMIT 10) UNION ALL (SELECT 'first', video_id, duration FROM v ORDER BY "index", video_id, crawled_at LIMIT 10)"""),
    "wn12_first_valid": (wn12_first_valid, 'SELECT "index", video_id, epoch_us(crawled_at) AS us FROM videos WHERE duration BETWEEN 300 AND 3600 AND url IS NOT NULL AND title IS NOT NULL ORDER BY "index" NULLS FIRST, video_id, crawled_at LIMIT 25'),
}
