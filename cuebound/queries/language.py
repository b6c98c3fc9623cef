"""Vietnamese-language, topic and readiness analyses: AG23-AG36, AG39-AG46, TK3, TK4, JN8, JN11, CH6, CH9, FS17-FS19."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuebound.functions import sqltext as Q
from cuebound.functions import text as X
from cuebound.operators import summary as M
from cuebound.operators import vocabulary as V
from cuebound.queries.common import S, hist_sql, segments
from cuebound.session import spread, table



def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "segments").select("row_id", "topic", "text")).select("row_id", "topic", "text", F.lower(X.or_empty(F.col("text"))).alias("low"))


L = "WITH l AS (SELECT row_id, topic, text, lower(coalesce(text, '')) AS low FROM segments)"


def ag23_character_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of lower-cased texts, and the spaces that would join them left out."""
    return V.word_counts(_texts(spark, sf), F.filter(F.split("low", ""), lambda c: c != "")).withColumnRenamed("word", "character")


def ag24_vowel_families(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of each vowel family (and of d) in lower-cased texts."""
    row = _texts(spark, sf).agg(*[F.coalesce(F.sum(X.count_of(F.col("low"), f"[{c}]")), F.lit(0)).alias(f) for f, c in X.FAMILIES.items()])
    return row.unpivot([], list(X.FAMILIES), "family", "n")


def ag25_tone_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of each tone, and their share of all characters of the texts joined by one space."""
    joined = (F.sum(F.length(X.or_empty(F.col("text")))) + F.count(F.lit(1)) - 1).alias("total")
    row = _texts(spark, sf).agg(joined, *[F.coalesce(F.sum(X.count_of(F.col("low"), f"[{c}]")), F.lit(0)).alias(t) for t, c in X.TONE_CLASSES.items()])
    return row.unpivot(["total"], list(X.TONE_CLASSES), "tone", "n").select("tone", "n", M.rounded(F.try_divide(F.col("n") * 100, F.col("total"))).alias("share"))


def ag26_consonant_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Words that begin with each consonant cluster; each cluster counts on its own."""
    row = _texts(spark, sf).agg(*[F.coalesce(F.sum(X.count_of(F.col("low"), f"(?:^|[^{X.WORD}]){c}")), F.lit(0)).alias(c) for c in X.CLUSTERS])
    return row.unpivot([], X.CLUSTERS, "cluster", "n")


def _syllables(spark: SparkSession, sf: str) -> DataFrame:
    """(syllables, n) of each different word; the patterns run once a word, not once an occurrence."""
    counts = V.word_counts(_texts(spark, sf), X.words(F.col("low")))
    bare = counts.select(F.regexp_replace("word", f"[^{X.WORD}{X.LATIN}]", "").alias("word"), "n").where("word <> ''")
    return bare.select(X.count_of(F.col("word"), f"[{X.VOWELS}]+").cast("bigint").alias("syllables"), "n")


SYL = f"{L}, sy AS (SELECT {Q.count_of('w', '[' + X.VOWELS + ']+')} AS n FROM (SELECT regexp_replace(unnest({Q.words('low')}), '[^{X.WORD}{X.LATIN}]', '', 'g') AS w FROM l) WHERE w <> '')"


def ag27_syllables(spark: SparkSession, sf: str) -> DataFrame:
    """Syllables (vowel groups) of words: total, mean, words of one and their share. Words without a vowel count as 0."""
    n, k = F.col("n"), F.col("syllables")
    one = F.coalesce(F.sum(F.when(k == 1, n)), F.lit(0))
    return _syllables(spark, sf).agg(F.coalesce(F.sum(n * k), F.lit(0)).alias("n_syllables"), M.rounded(F.try_divide(F.sum(n * k), F.sum(n))).alias("mean"), one.alias("n_mono"), M.rounded(F.try_divide(one * 100, F.sum(n))).alias("mono_share"))


def _token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.word_counts(_texts(spark, sf), X.tokens(F.col("low")))


TOK = f"{L}, k AS (SELECT word, count(*) AS n FROM (SELECT unnest({Q.tokens('low')}) AS word FROM l) GROUP BY word)"
WORD_LIST = ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS)


def ag28_token_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens, different tokens, function words and their share."""
    function = F.sum(F.when(F.col("word").isin(X.FUNCTION_WORDS), F.col("n")).otherwise(0))
    return _token_counts(spark, sf).agg(F.sum("n").alias("n_words"), F.count("word").alias("n_unique"), function.alias("n_function"), M.rounded(function * 100 / F.sum("n")).alias("function_share"))


def ag29_word_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, median and most frequent length of tokens (the smallest of those on a tie), from the counts of each length."""
    lengths = _token_counts(spark, sf).groupBy(F.length("word").alias("len")).agg(F.sum("n").alias("n"))
    return lengths.agg(
        M.rounded(F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("mean"),
        F.expr("percentile(len, 0.5, n)").alias("median"),
        F.max_by("len", F.struct("n", -F.col("len"))).cast("bigint").alias("mode"),
    )


def ag30_transcription_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with mixed case, with a word that may lack its tone, with a repeated word; letters of other scripts."""
    t = X.or_empty(F.col("text"))
    mixed = t.rlike(f"[A-Za-z{X.LATIN}]") & (t != F.lower(t)) & (t != F.upper(t))
    # A word of three or more characters without a toned vowel but with a plain one, as one pattern over the text.
    plain = F.col("low").rlike(f"(?<![^{X.BL}])(?=[^{X.BL}]*[{X.BASES}])[^{X.BL}{X.ALL_TONED}]{{3,}}(?![^{X.BL}])")
    rows = _texts(spark, sf)
    row = rows.agg(F.count_if(mixed).alias("mixed_case"), F.count_if(plain).alias("missing_tone"), F.count_if(X.repeats_a_word(F.col("text"))).alias("repeated_word"))
    other = V.word_counts(rows, F.array_distinct(F.regexp_extract_all(t, F.lit(f"\\p{{L}}"), F.lit(0)))).where(~F.col("word").rlike(f"^[A-Za-z{X.LATIN}]$"))
    letters = other.agg(F.lit("other_letters").alias("issue"), F.count(F.lit(1)).alias("n"))
    return row.unpivot([], ["mixed_case", "missing_tone", "repeated_word"], "issue", "n").unionByName(letters)


def ag31_language_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Characters, tokens, different tokens, mean length of different tokens, syllables and shares in one row."""
    chars = _texts(spark, sf).agg(F.sum(F.length(X.or_empty(F.col("text")))).alias("n_chars"))
    words = _token_counts(spark, sf).agg(F.sum("n").alias("n_words"), F.count("word").alias("n_unique"), M.rounded(F.avg(F.length("word"))).alias("mean_type_length"))
    return words.select(chars.select("n_chars").scalar().alias("n_chars"), "*", ag27_syllables(spark, sf).select("n_syllables").scalar().alias("n_syllables"), ag28_token_vocabulary(spark, sf).select("function_share").scalar().alias("function_share"))


def jn11_function_words(spark: SparkSession, sf: str) -> DataFrame:
    """How often each function word of the list occurs, 0 for those that do not."""
    listed = spark.createDataFrame([(w,) for w in X.FUNCTION_WORDS], "word string")
    return F.broadcast(listed).join(_token_counts(spark, sf), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def ag32_topic_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Segments, durations and words per topic."""
    rows = segments(spark, sf).withColumn("n_words", F.size(X.words(F.col("text"))).cast("bigint"))
    total = F.sum("filled")
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n_segments"), F.round(total, 4).alias("total"), M.rounded(F.avg("filled")).alias("mean"), M.rounded(F.stddev_samp("filled")).alias("std"), F.sum("n_words").alias("n_words"), F.round(total / 3600, 4).alias("hours"), M.rounded(F.avg("n_words")).alias("words_per_segment"))


def _topic_words(spark: SparkSession, sf: str) -> DataFrame:
    return V.word_counts(_texts(spark, sf), X.words(X.clean_spaced(F.col("text"))), "topic")


TW = f"WITH tw AS (SELECT topic, word, count(*) AS n FROM (SELECT topic, unnest({Q.words(Q.clean_spaced('text'))}) AS word FROM segments) GROUP BY ALL)"


def ag33_topic_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Words, different words and richness per topic; topics without words have 0."""
    names = table(spark, sf, "segments").select("topic").distinct()
    rich = V.richness(_topic_words(spark, sf), "topic")
    joined = names.alias("a").join(rich.alias("b"), F.col("a.topic").eqNullSafe(F.col("b.topic")), "left")
    return joined.select("a.topic", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_words", "n_unique")], F.coalesce("richness", F.lit(0.0)).alias("richness"))


def wn07_topic_top_words(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent words of each topic."""
    return V.top_words(_topic_words(spark, sf), 10, "topic")


def ag34_topic_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """TF-IDF similarity of each two topics of segments."""
    return V.tfidf_similarity(spread(table(spark, sf, "segments").select("topic", "row_id", "text")), "topic", "row_id", "text")


SIM = f"""WITH d AS (SELECT topic AS key, row_id, regexp_extract_all({Q.clean_spaced('text')}, '[{X.WORD}]{{2,}}') AS t FROM segments WHERE topic IS NOT NULL),
 u AS (SELECT key, row_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM d), p AS (SELECT key, token, lead(token) OVER (PARTITION BY key ORDER BY row_id, pos) AS next FROM u),
 tf AS (SELECT key, term, count(*) AS n FROM (SELECT key, token AS term FROM p UNION ALL SELECT key, token || ' ' || next FROM p WHERE next IS NOT NULL) GROUP BY ALL),
 kept AS (SELECT term, sum(n) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 1000), nk AS (SELECT count(DISTINCT topic) AS c FROM segments),
 w AS (SELECT key, term, n * (ln((1 + c) / (1 + df)) + 1) AS w FROM tf JOIN kept USING (term), nk), nn AS (SELECT key, sqrt(sum(w * w)) AS norm FROM w GROUP BY key),
 x AS (SELECT key, term, w / norm AS w FROM w JOIN nn USING (key)), k AS (SELECT DISTINCT topic AS key FROM segments WHERE topic IS NOT NULL),
 dots AS (SELECT a.key AS a, b.key AS b, sum(a.w * b.w) AS dot FROM x a JOIN x b ON a.term = b.term AND a.key < b.key GROUP BY ALL),
 sim AS (SELECT i.key AS a, j.key AS b, round(coalesce(dot, 0.0::DOUBLE), 6) AS similarity FROM k i JOIN k j ON i.key < j.key LEFT JOIN dots ON dots.a = i.key AND dots.b = j.key)"""


def tk03_least_similar(spark: SparkSession, sf: str) -> DataFrame:
    """The five least similar pairs of topics."""
    return ag34_topic_similarity(spark, sf).orderBy("similarity", "a", "b").limit(5)


def ch06_similarity_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The similarity matrix of the first twenty topics, as (row, column, value) with ones on the diagonal."""
    first = table(spark, sf, "segments").select(F.col("topic").alias("a")).where("a IS NOT NULL").distinct().orderBy("a").limit(20)
    both = ag34_topic_similarity(spark, sf)
    mirrored = both.union(both.select("b", "a", "similarity")).union(first.select("a", F.col("a").alias("b"), F.lit(1.0).alias("similarity")))
    return mirrored.join(first, "a", "left_semi").join(first.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", "similarity")


def ag35_topic_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword scores and the primary domain of each topic."""
    return V.domain_scores(table(spark, sf, "segments"), "topic", "text")


_DOM = ", ".join(f"CAST(sum({' + '.join(Q.occurrences('low', w) for w in ws)}) AS BIGINT) AS {d}" for d, ws in X.DOMAIN_KEYWORDS.items())
_BEST = f"greatest({', '.join(X.DOMAIN_KEYWORDS)})"
DOMAINS = f"{L}, dm AS (SELECT topic, {_DOM} FROM l GROUP BY topic), dp AS (SELECT *, CASE WHEN {_BEST} = 0 THEN 'general' {' '.join(f'WHEN {d} = {_BEST} THEN {chr(39)}{d}{chr(39)}' for d in X.DOMAIN_KEYWORDS)} END AS primary_domain FROM dm)"


def ag35_domain_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Topics per primary domain."""
    return ag35_topic_domains(spark, sf).groupBy("primary_domain").agg(F.count(F.lit(1)).alias("n_topics"))


def ag36_content_complexity(spark: SparkSession, sf: str) -> DataFrame:
    """Words per sentence, mean word length, diversity and speaking rate of each topic."""
    rows = spread(segments(spark, sf).select("topic", "text", "filled")).withColumns({"w": X.words(F.col("text")), "n_sentences": F.size(X.sentences(F.col("text"))).cast("bigint")})
    letters = F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    main = rows.groupBy("topic").agg(F.sum("n_sentences").alias("ns"), F.sum(F.size("w")).alias("nw"), F.sum(letters).alias("nl"), F.sum("filled").alias("seconds"))
    unique = V.word_counts(rows, F.col("w"), "topic").groupBy("topic").agg(F.count(F.lit(1)).alias("nu"))
    joined = main.alias("a").join(unique.alias("b"), F.col("a.topic").eqNullSafe(F.col("b.topic")), "left")
    nu = F.coalesce("nu", F.lit(0))
    part = lambda x, y: M.rounded(F.when(y > 0, x / y).otherwise(0.0))
    nw, ns, seconds = F.col("nw"), F.col("ns"), F.col("seconds")
    return joined.select("a.topic", part(nw, ns).alias("sentence_length"), part(F.col("nl"), nw).alias("word_length"), part(nu, nw).alias("diversity"), part(nw, seconds).alias("speaking_rate"), nw.alias("n_words"), nu.alias("n_unique"))


CX = f"""{S}, cx AS (SELECT topic, filled, {Q.words('text')} AS w, len({Q.sentences('text')}) AS n_sentences FROM s), cm AS (SELECT topic, sum(n_sentences) AS ns, CAST(sum(len(w)) AS BIGINT) AS nw,
 sum(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)) AS nl, sum(filled) AS seconds FROM cx GROUP BY topic), cu AS (SELECT topic, count(DISTINCT word) AS nu FROM (SELECT topic, unnest(w) AS word FROM cx) GROUP BY topic),
 cc AS (SELECT cm.topic, round(CASE WHEN ns > 0 THEN nw / ns ELSE 0.0::DOUBLE END, 6) AS sentence_length, round(CASE WHEN nw > 0 THEN nl / nw ELSE 0.0::DOUBLE END, 6) AS word_length, round(CASE WHEN nw > 0 THEN coalesce(nu, 0) / nw ELSE 0.0::DOUBLE END, 6) AS diversity,
 round(CASE WHEN seconds > 0 THEN nw / seconds ELSE 0.0::DOUBLE END, 6) AS speaking_rate, nw AS n_words, coalesce(nu, 0) AS n_unique FROM cm LEFT JOIN cu ON cm.topic IS NOT DISTINCT FROM cu.topic)"""


def tk04_fastest_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The five topics with the highest speaking rate."""
    return ag36_content_complexity(spark, sf).orderBy(F.desc("speaking_rate"), F.asc_nulls_first("topic")).limit(5).select("topic", "speaking_rate")


@F.pandas_udf(T.BooleanType())
def not_nfc_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a text differs from its composed form; the engine has no built-in for it."""
    for batch in texts:
        yield batch.map(lambda t: t is not None and not unicodedata.is_normalized("NFC", t)).astype(bool)


def ag40_required_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Missing required fields."""
    from cuebound.operators.quality import missing_data

    return missing_data(segments(spark, sf), ["start", "end", "text"]).select("field", "n_missing")


def ag41_timestamp_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Unusable times, negative and zero lengths; times in text form are cast, and what cannot be cast is unusable."""
    from cuebound.operators.quality import counted

    length = "try_cast(end AS DOUBLE) - try_cast(start AS DOUBLE)"
    return counted(segments(spark, sf), {"invalid": f"({length}) IS NULL", "negative": f"{length} < 0", "zero": f"{length} = 0"})


SIGNS = r".,!?;:\-'\"()"
NEEDS = ["empty_text", "only_punctuation", "mixed_languages", "special_characters", "numbers_only", "very_long_text", "unicode_issues"]


def ag42_preprocessing_needs(spark: SparkSession, sf: str) -> DataFrame:
    """Texts by what they need before training; an empty text counts only as that."""
    t = F.col("t")
    rows = table(spark, sf, "segments").select(X.strip(X.or_empty(F.col("text"))).alias("t"))
    odd = f"[^{X.WORD}{X.BL}{X.LATIN}{SIGNS}]"
    checks = {
        "only_punctuation": t.rlike(f"^[^{X.WORD}{X.LATIN}]+$"), "mixed_languages": t.rlike(odd), "special_characters": X.count_of(t, odd) > 5,
        "numbers_only": t.rlike(f"^\\p{{Nd}}+[{X.BL}\\p{{Nd}}]*$"), "very_long_text": F.length("t") > 500, "unicode_issues": not_nfc_udf(t),
    }
    row = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(t == "").alias("empty_text"), *[F.count_if((t != "") & c).alias(n) for n, c in checks.items()])
    return row.unpivot(["total"], NEEDS, "need", "n").select("need", "n", M.rounded(F.try_divide(F.col("n") * 100, F.col("total"))).alias("share"))


def ag43_topic_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Share of segments and hours per topic; a missing duration counts as 0."""
    grouped = segments(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("filled", F.lit(0.0))) / 3600, 6).alias("hours"))
    return M.shares(grouped)


def ag44_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a split by 80, 15 and 5 %, each rounded down."""
    n = F.count(F.lit(1))
    row = table(spark, sf, "segments").agg(*[F.floor(n * p / 100).alias(s) for s, p in (("train", 80), ("validation", 15), ("test", 5))])
    return row.unpivot([], ["train", "validation", "test"], "split", "n")


def ag45_compute_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated memory, hours, storage and batch size for training."""
    row = segments(spark, sf).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.coalesce("filled", F.lit(0.0))) / 3600).alias("hours"))
    batch = F.when(F.col("n") < 1000, "4-8").when(F.col("n") < 5000, "8-16").otherwise("16-32")
    return row.select("n", M.rounded(F.col("hours")).alias("hours"), F.round(F.greatest(F.lit(8.0), F.col("n") * 0.001), 6).alias("memory_gb"), M.rounded(F.col("hours") * 0.5).alias("least_hours"), M.rounded(F.col("hours") * 2).alias("most_hours"), F.round(F.col("hours") * 100, 4).alias("storage_mb"), batch.alias("batch_size"))


LETTERS = X.ALL_TONED + "ăâêôơưđ"
LETTERS = LETTERS + LETTERS.upper()


def ag46_character_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of the texts: all, of the language, different ones, and kinds that may be problematic."""
    chars = V.word_counts(table(spark, sf, "segments"), F.filter(F.split(X.or_empty(F.col("text")), ""), lambda c: c != ""))
    c, n = F.col("word"), F.col("n")
    fine = c.rlike(f"^[\\p{{L}}\\p{{N}}{X.BL}.,!?;:\\-'\"()\\[\\]{{}}]$")
    own = F.sum(F.when(c.rlike(f"^[{LETTERS}]$"), n).otherwise(0))
    return chars.agg(F.sum(n).alias("n_chars"), own.alias("n_language"), M.rounded(own * 100 / F.sum(n)).alias("language_share"), F.count(c).alias("n_unique"), F.count_if(~fine).alias("n_problematic"))


def fs18_problem_characters(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent problematic characters with their code points."""
    chars = V.word_counts(table(spark, sf, "documents"), F.filter(F.split(X.or_empty(F.col("text")), ""), lambda c: c != ""))
    odd = chars.where(~F.col("word").rlike(f"^[\\p{{L}}\\p{{N}}{X.BL}.,!?;:\\-'\"()\\[\\]{{}}]$"))
    return odd.withColumn("code", X.code_point(F.col("word"))).orderBy(F.desc("n"), "word").limit(10).select("code", "n")


def ag39_token_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated tokens (a quarter of the characters) of texts that are not empty: mean, largest, how many beyond 400."""
    rows = table(spark, sf, "documents").where("text <> ''").select(F.floor(F.length("text") / 4).alias("n"))
    return rows.agg(M.rounded(F.avg("n")).alias("mean_tokens"), F.max("n").alias("max_tokens"), F.count_if(F.col("n") > 400).alias("n_long"))


def fs16_previews(spark: SparkSession, sf: str) -> DataFrame:
    """Previews of documents whose estimate is beyond 400 tokens."""
    return table(spark, sf, "documents").where(F.length("text") >= 1604).select("doc_id", X.preview(F.col("text")).alias("preview"))


def ch09_duration_planning(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of durations in 30 bins for planning."""
    return M.histogram(segments(spark, sf), F.col("filled"), 30)


def _unpivot(rows: str, columns: dict[str, str], key: str, extra: str = "") -> str:
    return f"{rows} " + " UNION ALL ".join(f"SELECT '{k}' AS {key}, {v} AS n FROM l" for k, v in columns.items())


_CHAR_OK = "^[\\p{L}\\p{N}" + X.BL + ".,!?;:\\-''\"()\\[\\]{}]$"
_ODD = f"[^{X.WORD}{X.BL}{X.LATIN}{SIGNS}]".replace("'", "''")
QUERIES = {
    "ag23_character_frequency": (ag23_character_frequency, f"{L} SELECT character, count(*) AS n FROM (SELECT unnest(string_split(low, '')) AS character FROM l WHERE low <> '') GROUP BY 1"),
    "ag24_vowel_families": (ag24_vowel_families, _unpivot(L, {f: f"CAST(sum({Q.count_of('low', f'[{c}]')}) AS BIGINT)" for f, c in X.FAMILIES.items()}, "family")),
    "ag25_tone_marks": (ag25_tone_marks, f"{L}, a AS (SELECT sum(length(coalesce(text, ''))) + count(*) - 1 AS total FROM l) " + " UNION ALL ".join(f"SELECT '{t}' AS tone, CAST(sum({Q.count_of('low', f'[{c}]')}) AS BIGINT) AS n, round(sum({Q.count_of('low', f'[{c}]')}) * 100 / (SELECT total FROM a), 6) AS share FROM l" for t, c in X.TONE_CLASSES.items())),
    "ag26_consonant_clusters": (ag26_consonant_clusters, _unpivot(L, {c: f"CAST(sum({Q.count_of('low', f'(?:^|[^{X.WORD}]){c}')}) AS BIGINT)" for c in X.CLUSTERS}, "cluster")),
    "ag27_syllables": (ag27_syllables, f"{SYL} SELECT CAST(sum(n) AS BIGINT) AS n_syllables, round(avg(n), 6) AS mean, count(*) FILTER (n = 1) AS n_mono, round(count(*) FILTER (n = 1) * 100 / count(*), 6) AS mono_share FROM sy"),
    "ag28_token_vocabulary": (ag28_token_vocabulary, f"{TOK} SELECT CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_unique, CAST(sum(n) FILTER (word IN ({WORD_LIST})) AS BIGINT) AS n_function, round(sum(n) FILTER (word IN ({WORD_LIST})) * 100 / sum(n), 6) AS function_share FROM k"),
    "ag29_word_lengths": (ag29_word_lengths, f"{TOK}, ln AS (SELECT length(word) AS len, unnest(range(n)) FROM k), lc AS (SELECT len, count(*) AS c FROM ln GROUP BY 1) SELECT round(avg(len), 6) AS mean, median(CAST(len AS DOUBLE)) AS median, (SELECT len FROM lc ORDER BY c DESC, len LIMIT 1) AS mode FROM ln"),
    "ag30_transcription_quality": (ag30_transcription_quality, f"""{L}, r AS (SELECT row_id, {Q.words('low')} AS w FROM l), q AS (SELECT
       count(*) FILTER (regexp_matches(text, '[A-Za-z{X.LATIN}]') AND text <> lower(text) AND text <> upper(text)) AS mixed_case,
       count(*) FILTER (len(list_filter({Q.words('low')}, lambda w: regexp_matches(w, '[{X.BASES}]') AND NOT regexp_matches(w, '[{X.ALL_TONED}]') AND length(w) > 2)) > 0) AS missing_tone,
       (SELECT count(*) FROM r WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) > 2)) > 0) AS repeated_word,
       (SELECT count(DISTINCT c) FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\\p{{L}}')) AS c FROM l) WHERE NOT regexp_matches(c, '^[A-Za-z{X.LATIN}]$')) AS other_letters FROM l)
       SELECT issue, n FROM q UNPIVOT (n FOR issue IN (mixed_case, missing_tone, repeated_word, other_letters))"""),
    "ag31_language_summary": (ag31_language_summary, f"{TOK}, sy AS (SELECT sum({Q.count_of('w', '[' + X.VOWELS + ']+')}) AS n FROM (SELECT regexp_replace(unnest({Q.words('low')}), '[^{X.WORD}{X.LATIN}]', '', 'g') AS w FROM l) WHERE w <> '') SELECT (SELECT CAST(sum(length(coalesce(text, ''))) AS BIGINT) FROM l) AS n_chars, CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_unique, round(avg(length(word)), 6) AS mean_type_length, (SELECT CAST(n AS BIGINT) FROM sy) AS n_syllables, round(sum(n) FILTER (word IN ({WORD_LIST})) * 100 / sum(n), 6) AS function_share FROM k"),
    "jn11_function_words": (jn11_function_words, f"{TOK}, f AS (SELECT unnest([{WORD_LIST}]) AS word) SELECT word, coalesce(n, 0) AS n FROM f LEFT JOIN k USING (word)"),
    "ag32_topic_stats": (ag32_topic_stats, f"{S} SELECT topic, count(*) AS n_segments, round(sum(filled), 4) AS total, round(avg(filled), 6) AS mean, round(stddev_samp(filled), 6) AS std, CAST(sum(len({Q.words('text')})) AS BIGINT) AS n_words, round(sum(filled) / 3600, 4) AS hours, round(avg(len({Q.words('text')})), 6) AS words_per_segment FROM s GROUP BY topic"),
    "ag33_topic_vocabulary": (ag33_topic_vocabulary, f"{TW}, g AS (SELECT topic, CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_unique FROM tw GROUP BY topic), t AS (SELECT DISTINCT topic FROM segments) SELECT t.topic, coalesce(n_words, 0) AS n_words, coalesce(n_unique, 0) AS n_unique, round(coalesce(n_unique / n_words, 0.0::DOUBLE), 6) AS richness FROM t LEFT JOIN g ON t.topic IS NOT DISTINCT FROM g.topic"),
    "wn07_topic_top_words": (wn07_topic_top_words, f"{TW} SELECT topic, word, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS rank FROM tw) WHERE rank <= 10"),
    "ag34_topic_similarity": (ag34_topic_similarity, f"{SIM} SELECT * FROM sim"),
    "tk03_least_similar": (tk03_least_similar, f"{SIM} SELECT * FROM sim ORDER BY similarity, a, b LIMIT 5"),
    "ch06_similarity_matrix": (ch06_similarity_matrix, f"{SIM}, f AS (SELECT key FROM k ORDER BY key LIMIT 20), m AS (SELECT a, b, similarity FROM sim UNION ALL SELECT b, a, similarity FROM sim UNION ALL SELECT key, key, 1.0::DOUBLE FROM f) SELECT * FROM m WHERE a IN (FROM f) AND b IN (FROM f)"),
    "ag35_topic_domains": (ag35_topic_domains, f"{DOMAINS} SELECT * FROM dp"),
    "ag35_domain_counts": (ag35_domain_counts, f"{DOMAINS} SELECT primary_domain, count(*) AS n_topics FROM dp GROUP BY 1"),
    "ag36_content_complexity": (ag36_content_complexity, f"{CX} SELECT * FROM cc"),
    "tk04_fastest_topics": (tk04_fastest_topics, f"{CX} SELECT topic, speaking_rate FROM cc ORDER BY speaking_rate DESC, topic NULLS FIRST LIMIT 5"),
    "ag40_required_fields": (ag40_required_fields, f"{S} SELECT 'start' AS field, count(*) FILTER (st IS NULL) AS n_missing FROM s UNION ALL SELECT 'end', count(*) FILTER (en IS NULL) FROM s UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM s"),
    "ag41_timestamp_checks": (ag41_timestamp_checks, f"{S} SELECT 'invalid' AS issue, count(*) FILTER (en - st IS NULL) AS n FROM s UNION ALL SELECT 'negative', count(*) FILTER (en - st < 0) FROM s UNION ALL SELECT 'zero', count(*) FILTER (en - st = 0) FROM s"),
    "ag42_preprocessing_needs": (ag42_preprocessing_needs, f"WITH t AS (SELECT {Q.strip('coalesce(text, ' + chr(39) * 2 + ')')} AS t FROM segments), z AS (SELECT count(*) AS total FROM t), c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS need, count(*) FILTER ({e}) AS n FROM t" for n, e in {"empty_text": "t = ''", "only_punctuation": f"regexp_matches(t, '^[^{X.WORD}{X.LATIN}]+$')", "mixed_languages": f"regexp_matches(t, '{_ODD}')", "special_characters": f"len(regexp_extract_all(t, '{_ODD}')) > 5", "numbers_only": f"regexp_matches(t, '^\\p{{Nd}}+[{X.BL}\\p{{Nd}}]*$')", "very_long_text": "length(t) > 500", "unicode_issues": "nfc_normalize(t) <> t"}.items()) + ") SELECT need, n, round(n * 100 / total, 6) AS share FROM c, z"),
    "ag43_topic_hours": (ag43_topic_hours, f"{S} SELECT topic, count(*) AS n, round(sum(coalesce(filled, 0)) / 3600, 6) AS hours, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY topic"),
    "ag44_split_sizes": (ag44_split_sizes, "WITH c AS (SELECT count(*) AS n FROM segments) SELECT 'train' AS split, CAST(floor(n * 80 / 100) AS BIGINT) AS n FROM c UNION ALL SELECT 'validation', CAST(floor(n * 15 / 100) AS BIGINT) FROM c UNION ALL SELECT 'test', CAST(floor(n * 5 / 100) AS BIGINT) FROM c"),
    "ag45_compute_estimate": (ag45_compute_estimate, f"{S}, c AS (SELECT count(*) AS n, sum(coalesce(filled, 0)) / 3600 AS h FROM s) SELECT n, round(h, 6) AS hours, round(greatest(8.0::DOUBLE, n * 0.001::DOUBLE), 6) AS memory_gb, round(h * 0.5::DOUBLE, 6) AS least_hours, round(h * 2, 6) AS most_hours, round(h * 100, 4) AS storage_mb, CASE WHEN n < 1000 THEN '4-8' WHEN n < 5000 THEN '8-16' ELSE '16-32' END AS batch_size FROM c"),
    "ag46_character_profile": (ag46_character_profile, f"WITH c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM segments WHERE text <> '') GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_chars, CAST(sum(n) FILTER (regexp_matches(ch, '^[{LETTERS}]$')) AS BIGINT) AS n_language, round(sum(n) FILTER (regexp_matches(ch, '^[{LETTERS}]$')) * 100 / sum(n), 6) AS language_share, count(*) AS n_unique, count(*) FILTER (NOT regexp_matches(ch, '{_CHAR_OK}')) AS n_problematic FROM c"),
    "fs18_problem_characters": (fs18_problem_characters, f"WITH c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY 1) SELECT 'U+' || printf('%04X', unicode(ch)) AS code, n FROM c WHERE NOT regexp_matches(ch, '{_CHAR_OK}') ORDER BY n DESC, ch LIMIT 10"),
    "ag39_token_lengths": (ag39_token_lengths, "WITH t AS (SELECT length(text) // 4 AS n FROM documents WHERE text <> '') SELECT round(avg(n), 6) AS mean_tokens, max(n) AS max_tokens, count(*) FILTER (n > 400) AS n_long FROM t"),
    "fs16_previews": (fs16_previews, "SELECT doc_id, left(text, 100) || '...' AS preview FROM documents WHERE length(text) >= 1604"),
    "ch09_duration_planning": (ch09_duration_planning, hist_sql(S, "filled", 30)),
}
