"""Arrays, tensors, tokenizer and audio: SRC8-SRC10, AG37, AG38, FA1-FA10, FD3, FD5, FM1-FM9, FS19, FS20, JN6, JN15, ST4, ST6, ST7, TK6, TK8, TN1-TN17, TZ1-TZ8."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.functions import arrays as A
from cuebound.functions import decoding as D
from cuebound.functions import signal as W
from cuebound.functions import text as X
from cuebound.functions import tokenizer as Z
from cuebound.operators.summary import rounded
from cuebound.queries.language import not_nfc_udf
from cuebound.session import spread, table

EMB = "embedding"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _sixes(values: Column) -> Column:
    return F.transform(values, lambda x: F.round(x, 6))


def fa01_pad_or_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors cut to 48 and filled up to 80."""
    v = A.doubles(F.col(EMB))
    return _vectors(spark, sf).select("vec_id", _sixes(A.pad_or_trim(v, 48)).alias("cut"), F.size(A.pad_or_trim(v, 80)).alias("long_size"), F.round(A.total(A.pad_or_trim(v, 80)), 5).alias("long_sum"))


def _ids() -> Column:
    return F.transform(F.sequence(F.lit(1), F.col("label") + 2), lambda i: i * 7 + F.col("vec_id").cast("int") % 5)


def fa02_end_padding(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of length 6 with a forced and an unforced end."""
    return _vectors(spark, sf).select("vec_id", A.end_padded(_ids(), 6, 99).alias("forced"), A.end_padded(_ids(), 6, 99, False).alias("plain"))


def fa03_shifted(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs and targets of sequences."""
    inputs, targets = A.shifted(_ids())
    return _vectors(spark, sf).select("vec_id", inputs.alias("inputs"), targets.alias("targets"))


def fa04_batch_padding(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of batches of 16 filled up with 0 to the longest of their batch."""
    rows = _vectors(spark, sf).select("vec_id", F.floor(F.col("vec_id") / 16).alias("batch"), _ids().alias("ids"))
    longest = rows.groupBy("batch").agg(F.max(F.size("ids")).alias("longest"))
    joined = rows.join(longest, "batch")
    return joined.select("vec_id", "batch", F.concat("ids", F.array_repeat(F.lit(0), F.col("longest") - F.size("ids"))).alias("ids"))


def fa06_before_end(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences up to their first 21, without the small ids, and flattened twice."""
    before = A.before_end(_ids(), 21)
    return _vectors(spark, sf).select("vec_id", before.alias("before"), F.filter(_ids(), lambda i: i > 10).alias("masked"), F.flatten(F.array(_ids(), _ids())).alias("flat"))


def fa10_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest and largest value and where the largest is."""
    return _vectors(spark, sf).select("vec_id", rounded(F.array_min(A.doubles(F.col(EMB)))).alias("least"), rounded(F.array_max(A.doubles(F.col(EMB)))).alias("most"), A.argmax(A.doubles(F.col(EMB))).alias("argmax"))


def fm04_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Root mean square and signal-to-noise ratio of vectors."""
    return _vectors(spark, sf).select("vec_id", rounded(A.root_mean_square(F.col(EMB))).alias("rms"), rounded(A.signal_to_noise(F.col(EMB))).alias("snr"))


def fm06_learning_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of the three schedules at steps 0 to 1100."""
    step = F.col("step")
    rate = lambda k: rounded(A.learning_rate(step, k, 0.001, 100, 1000, 0.00001), 9).alias(k)
    return spark.range(1101).select(F.col("id").alias("step")).select("step", rate("constant"), rate("linear"), rate("cosine"))


def fm07_penalties(spark: SparkSession, sf: str) -> DataFrame:
    """Length penalties and normalized scores of sequences."""
    size = F.size(_ids())
    score = (0 - F.col("vec_id").cast("double")) / 10
    return _vectors(spark, sf).select("vec_id", rounded(score / A.length_penalty(size, 0.6)).alias("normalized"), rounded(score / A.length_penalty(size, None)).alias("per_token"), rounded(score / (size + 1)).alias("mean_logprob"))


def fm08_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Storage of logits, batch sizes by memory and model, and back-off delays."""
    n = F.col("id")
    storage = n * 448 * 51864 * 4
    batch = F.greatest(F.lit(1), F.least(F.lit(16), F.floor((n - 6.0) / 0.5).cast("int")))
    return spark.range(1, 25).select(n.alias("n"), storage.alias("bytes"), F.round(storage / 1048576, 4).alias("megabytes"), batch.alias("batch_size"), F.pow(F.lit(2.0), n).alias("delay"))


def fd03_times(spark: SparkSession, sf: str) -> DataFrame:
    """Durations for people, and the tokens of times."""
    return table(spark, sf, "videos").where("duration IS NOT NULL").select("video_id", "duration", A.human_time(F.col("duration")).alias("shown"), F.format_string("<|%.2f|>", F.least(F.col("duration"), F.lit(1500)) * 0.02).alias("token")).distinct()


def tn05_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """Tempered probabilities and log probabilities of vectors."""
    return _vectors(spark, sf).select("vec_id", _sixes(A.softmax(F.col(EMB), 2.0)).alias("p"), _sixes(A.log_softmax(F.col(EMB))).alias("logp"), rounded(A.total(A.softmax(F.col(EMB), 2.0))).alias("total"))


def _teacher(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("student"))
    return rows.join(other, "vec_id")


def tn06_distillation_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Divergence of neighbours, cross entropy of labels, and their blend; the mean over rows with a label below 8."""
    kl, ce = A.kl_divergence(F.col(EMB), F.col("student"), 2.0), A.cross_entropy(F.col("student"), F.col("label"))
    rows = _teacher(spark, sf).select("label", kl.alias("kl"), ce.alias("ce")).where("label < 8")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("kl"), 5).alias("kl"), rounded(F.avg("ce"), 5).alias("ce"), rounded(F.avg(F.col("kl") * 0.7 + F.col("ce") * 0.3), 5).alias("loss"))


def tn07_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors fitted to vocabularies of 60 and 70."""
    return _vectors(spark, sf).select("vec_id", F.size(A.fitted(F.col(EMB), 60)).alias("small"), rounded(A.total(A.fitted(F.col(EMB), 60)), 5).alias("small_sum"), F.size(A.fitted(F.col(EMB), 70)).alias("large"), F.element_at(A.fitted(F.col(EMB), 70), -1).alias("last"))


def tn08_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each vector and the next."""
    return _teacher(spark, sf).select("vec_id", rounded(A.cosine(F.col(EMB), F.col("student"))).alias("similarity"))


def tn09_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    """The largest position when the first four are suppressed, and the eight largest."""
    return _vectors(spark, sf).select("vec_id", A.argmax(A.suppressed(F.col(EMB), [0, 1, 2, 3])).alias("choice"), A.top_positions(F.col(EMB), 8).alias("best"))


def tn12_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The best of each group of sequences by normalized score, ties to the smaller id."""
    rows = _vectors(spark, sf).select("vec_id", "label", rounded(-F.col("vec_id").cast("double") / A.length_penalty(F.size(_ids()), 1.0)).alias("score"))
    return rows.groupBy("label").agg(F.max_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("vec_id"), F.max("score").alias("score"))


def tn10_greedy_step(spark: SparkSession, sf: str) -> DataFrame:
    """One greedy step on each vector: the token, its log probability added to a sum, both as they were after an end token."""
    token, ended = A.argmax(A.doubles(F.col(EMB))), F.col("label") == 9
    logp = F.array_max(A.log_softmax(F.col(EMB)))
    return _vectors(spark, sf).select("vec_id", F.when(ended, F.lit(Z.EOT)).otherwise(token).alias("token"), rounded(F.when(ended, F.lit(0.0)).otherwise(logp)).alias("sum_logprob"))


def _counting_model(sequences: list[list[int]]) -> np.ndarray:
    """A model of 32 tokens for which the next token is likely to be about twice the last one."""
    last = np.array([s[-1] for s in sequences])[:, None]
    return -np.abs(np.arange(32)[None, :] - (last * 2 + 1) % 32) * 0.7


def tn11_beam_search(spark: SparkSession, sf: str) -> DataFrame:
    """Beam searches of width 4 over a small model from each vector's label, ranked by length."""
    rows = _vectors(spark, sf).select("vec_id", F.array(F.col("label") + 1).alias("start"))
    return D.decode_rows(rows, "vec_id", "start", _counting_model, D.Rules(begin=1, end=0, suppress=[13]), 12, 4, 0.6)


def tn14_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Sinusoidal codes of 64 positions and 16 channels."""
    grid = spark.range(64 * 16).select(F.floor(F.col("id") / 16).alias("position"), (F.col("id") % 16).alias("channel"))
    return grid.withColumn("code", rounded(A.position_code(F.col("position"), F.col("channel"), 16)))


def tn15_causal_mask(spark: SparkSession, sf: str) -> DataFrame:
    """The mask of 16 positions."""
    grid = spark.range(256).select(F.floor(F.col("id") / 16).alias("q"), (F.col("id") % 16).alias("k"))
    return grid.withColumn("is_masked", F.col("q") < F.col("k"))


def tn17_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Norms of vectors, clipped ones, and of all of them together per label."""
    return _vectors(spark, sf).groupBy("label").agg(rounded(F.sqrt(F.sum(A.dot(F.col(EMB), F.col(EMB)))), 5).alias("norm"), rounded(F.max(F.sqrt(A.dot(A.norm_clipped(F.col(EMB), 0.5), A.norm_clipped(F.col(EMB), 0.5))))).alias("largest_clipped"))


def st07_id_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted unions and differences of id sets."""
    other = F.array(F.lit(3), F.lit(7), F.lit(14))
    return _vectors(spark, sf).select("vec_id", F.array_sort(F.array_union(_ids(), other)).alias("both"), F.array_except(other, _ids()).alias("rest"))


def tz01_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each document by the byte-level tokenizer with suffixes."""
    return table(spark, sf, "documents").select("doc_id", Z.token_count(F.col("text")).cast("bigint").alias("n_tokens"))


def tz01_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of each document, checked against their count and decoded again where all characters are ASCII."""
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).withColumn("ids", Z.encode_udf("text"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), (F.size("ids") == Z.token_count(F.col("text"))).alias("agrees"), F.md5(Z.decode_udf("ids")).alias("decoded"))


def tz08_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Decoder inputs and targets of 64 ids: start, language, task, text, end."""
    rows = table(spark, sf, "segments").where("text <> ''")
    whole = F.concat(F.array(*map(F.lit, Z.start_sequence("vi"))), Z.encode_udf("text"), F.array(F.lit(Z.EOT)))
    inputs, targets = A.shifted(F.col("whole"))
    done = rows.withColumn("whole", whole).select("row_id", A.end_padded(inputs, 64, Z.EOT).alias("inputs"), A.end_padded(targets, 64, Z.EOT).alias("targets"))
    return done.select("row_id", F.element_at("inputs", 1).alias("first"), F.element_at("targets", 64).alias("last"), F.size("inputs").alias("size"), F.size("targets").alias("target_size"))


def jn15_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of documents' tags with their names and tokens, 'unknown' for tags outside the table."""
    listed = spark.createDataFrame([(c, n, Z.SPECIALS.get(f"<|{c}|>")) for c, n in Z.LANGUAGES.items()], "code string, name string, token int")
    tags = table(spark, sf, "documents").select(F.lower("lang").alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return tags.join(F.broadcast(listed), "code", "left").select("code", "n", F.coalesce("name", F.lit("unknown")).alias("name"), "token")


def fs19_not_composed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text is not in composed form."""
    return table(spark, sf, "documents").where(not_nfc_udf("text")).select("doc_id")


def fs20_compression(spark: SparkSession, sf: str) -> DataFrame:
    """Compression ratio of each document."""
    return table(spark, sf, "documents").select("doc_id", F.round(W.compression_ratio_udf("text"), 6).alias("ratio"))


def jn06_matched_features(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of features and logits whose names agree but for their endings, where there are tokens."""
    mel = table(spark, sf, "manifest_samples").where("transcription <> ''").select(F.concat(X.stem(F.col("audio_path")), F.lit("_mel")).alias("name"), F.col("id").alias("mel_id"))
    logits = table(spark, sf, "segment_files").select(F.concat(X.stem(F.col("path")), F.lit("_logits")).alias("name"), F.col("file_id").alias("logits_id"))
    mel, logits = mel.withColumn("stem", F.regexp_replace("name", "_mel$", "")), logits.withColumn("stem", F.regexp_replace("name", "_logits$", ""))
    return mel.join(logits, "stem").select("stem", "mel_id", "logits_id")


def _waves(spark: SparkSession, sf: str) -> DataFrame:
    """Tones made from vectors: half a second of each vector's values, repeated."""
    return spread(_vectors(spark, sf)).select("vec_id", "label", F.flatten(F.array_repeat(F.transform(F.col(EMB), lambda x: x * 0.1), 125)).alias("wave"))


def ag37_audio_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Means of rate, duration, megabytes, noise ratio and level of the manifest's audio and of waves."""
    meta = table(spark, sf, "manifest_samples").agg(rounded(F.avg("sampling_rate")).alias("rate"), rounded(F.avg("duration")).alias("duration"), rounded(F.avg(F.col("duration") * F.col("sampling_rate") * 2 / 1048576)).alias("megabytes"))
    waves = _vectors(spark, sf).agg(rounded(F.avg(A.signal_to_noise(F.col(EMB))), 5).alias("snr"), rounded(F.avg(A.root_mean_square(F.col(EMB)))).alias("rms"))
    return meta.select("*", waves.select("snr").scalar().alias("snr"), waves.select("rms").scalar().alias("rms"))


def ag38_audio_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    """Samples by what is unusual about their audio."""
    from cuebound.operators.quality import counted

    return counted(table(spark, sf, "manifest_samples"), {"other_rate": "sampling_rate <> 16000", "too_long": "duration > 30", "too_short": "duration < 1"})


def tn03_log_mel(spark: SparkSession, sf: str) -> DataFrame:
    """Log-mel features of the waves: shape and extremes (80 bands, 3000 frames)."""
    mel = W.log_mel_features(_waves(spark, sf), "vec_id", "wave")
    flat = F.flatten("mel")
    return mel.select("vec_id", F.size("mel").alias("bands"), F.size(F.col("mel")[0]).alias("frames"), F.round(F.array_max(flat).cast("double"), 4).alias("most"), F.round(F.array_min(flat).cast("double"), 4).alias("least"))


_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_SUM = lambda e: f"list_sum({e})"
_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_IDS = "list_transform(range(1, label + 3), lambda i: CAST(i * 7 + vec_id % 5 AS INTEGER))"
E = f"WITH e AS (SELECT vec_id, label, embedding, {_D} AS d, {_IDS} AS ids FROM embeddings)"
_LSM = lambda d, t: f"list_transform({d}, lambda x: x / {t} - list_max({d}) / {t} - ln(list_sum(list_transform({d}, lambda y: exp(y / {t} - list_max({d}) / {t})))))"
_R6 = lambda l: f"list_transform({l}, lambda r: round(r, 6))"
PAIR = f"{E}, p AS (SELECT a.vec_id, a.label, a.d AS t, b.d AS s FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"
#: Z.SPLIT without its look-ahead, which this engine lacks and counts do not need: a run of blanks has as many bytes in one piece or two.
_Z_SPLIT = (
    r"''s|''t|''re|''ve|''m|''ll|''d| ?[a-zA-Z\x{C0}-\x{FF}\x{100}-\x{17F}\x{180}-\x{24F}\x{1E00}-\x{1EFF}]+| ?[0-9]+"
    r"| ?[^\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{L}\p{N}_]+"
    r"|[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
#: Tokens decode on their own, so each byte of a character that is not ASCII shows as a replacement character.
_IDS_SQL = f"""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_Z_SPLIT}') AS l FROM documents),
  n AS (SELECT doc_id, CAST(coalesce(list_sum(list_transform(l, lambda p: CASE WHEN p IN ({", ".join(f"'{s}'" for s in Z.SUFFIXES)}) THEN 1 ELSE strlen(p) END)), 0) AS BIGINT) AS n_tokens, coalesce(array_to_string(l, ''), '') AS s FROM p)
  SELECT doc_id, n_tokens, TRUE AS agrees, md5(replace(regexp_replace(regexp_replace(regexp_replace(s, '[\\x{{10000}}-\\x{{10FFFF}}]', repeat(chr(1), 4), 'g'), '[\\x{{800}}-\\x{{FFFF}}]', repeat(chr(1), 3), 'g'), '[\\x{{80}}-\\x{{7FF}}]', repeat(chr(1), 2), 'g'), chr(1), '�')) AS decoded FROM n"""
_SUF = ", ".join(f"'{s}'" for s in Z.SUFFIXES)
QUERIES = {
    "fa01_pad_or_trim": (fa01_pad_or_trim, f"{E} SELECT vec_id, {_R6('d[1:48]')} AS cut, CAST(80 AS INTEGER) AS long_size, round(list_sum(d), 5) AS long_sum FROM e"),
    "fa02_end_padding": (fa02_end_padding, f"{E} SELECT vec_id, CASE WHEN len(ids) > 6 THEN ids[1:5] || [99] ELSE ids || list_transform(range(6 - len(ids)), lambda i: 99) END AS forced, CASE WHEN len(ids) > 6 THEN ids[1:6] ELSE ids || list_transform(range(6 - len(ids)), lambda i: 99) END AS plain FROM e"),
    "fa03_shifted": (fa03_shifted, f"{E} SELECT vec_id, ids[1:len(ids) - 1] AS inputs, ids[2:] AS targets FROM e"),
    "fa04_batch_padding": (fa04_batch_padding, f"{E}, m AS (SELECT vec_id // 16 AS batch, max(len(ids)) AS l FROM e GROUP BY 1) SELECT vec_id, batch, ids || list_transform(range(l - len(ids)), lambda i: 0) AS ids FROM e JOIN m ON vec_id // 16 = batch"),
    "fa06_before_end": (fa06_before_end, f"{E} SELECT vec_id, CASE WHEN list_contains(ids, 21) THEN ids[1:list_position(ids, 21) - 1] ELSE ids END AS before, list_filter(ids, lambda i: i > 10) AS masked, ids || ids AS flat FROM e"),
    "fa10_extremes": (fa10_extremes, f"{E} SELECT vec_id, round(list_min(d), 6) AS least, round(list_max(d), 6) AS most, CAST(list_position(d, list_max(d)) - 1 AS INTEGER) AS argmax FROM e"),
    "fm04_levels": (fm04_levels, f"{E}, o AS (SELECT vec_id, d, list_sort(list_transform(d, lambda x: abs(x))) AS m, len(d) AS n FROM e) SELECT vec_id, round(sqrt({_DOT('d', 'd')} / n), 6) AS rms, round(20 * log10(list_avg(m[CAST(floor(n * 0.9) AS INTEGER) + 1:]) / (list_avg(m[1:CAST(floor(n * 0.1) AS INTEGER)]) + 1e-10)), 6) AS snr FROM o"),
    "fm06_learning_rates": (fm06_learning_rates, "WITH s AS (SELECT unnest(range(1101)) AS step), p AS (SELECT step, least((step - 100) / 900, 1.0::DOUBLE) AS q, 0.001::DOUBLE * step / 100 AS w FROM s) SELECT step, round(CASE WHEN step < 100 THEN w ELSE 0.001::DOUBLE END, 9) AS constant, round(CASE WHEN step < 100 THEN w ELSE 0.001::DOUBLE - 0.00099::DOUBLE * q END, 9) AS linear, round(CASE WHEN step < 100 THEN w ELSE 0.00001::DOUBLE + 0.00099::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * q)) END, 9) AS cosine FROM p"),
    "fm07_penalties": (fm07_penalties, f"{E} SELECT vec_id, round((0 - CAST(vec_id AS DOUBLE)) / 10 / pow((len(ids) + 5) / 6, 0.6::DOUBLE), 6) AS normalized, round((0 - CAST(vec_id AS DOUBLE)) / 10 / len(ids), 6) AS per_token, round((0 - CAST(vec_id AS DOUBLE)) / 10 / (len(ids) + 1), 6) AS mean_logprob FROM e"),
    "fm08_sizes": (fm08_sizes, "SELECT n, n * 448 * 51864 * 4 AS bytes, round(n * 448 * 51864 * 4 / 1048576, 4) AS megabytes, CAST(greatest(1, least(16, floor((n - 6) / 0.5::DOUBLE))) AS INTEGER) AS batch_size, pow(2.0::DOUBLE, n) AS delay FROM (SELECT unnest(range(1, 25)) AS n)"),
    "fd03_times": (fd03_times, "SELECT DISTINCT video_id, duration, CASE WHEN duration >= 3600 THEN printf('%dh %dm %ds', duration // 3600, duration % 3600 // 60, duration % 60) WHEN duration >= 60 THEN printf('%dm %ds', duration // 60, duration % 60) ELSE printf('%ds', duration) END AS shown, printf('<|%.2f|>', least(duration, 1500) * 0.02::DOUBLE) AS token FROM videos WHERE duration IS NOT NULL"),
    "tn05_softmax": (tn05_softmax, f"{E}, s AS (SELECT vec_id, list_transform({_LSM('d', '2.0::DOUBLE')}, lambda z: exp(z)) AS p, {_LSM('d', '1.0::DOUBLE')} AS l FROM e) SELECT vec_id, {_R6('p')} AS p, {_R6('l')} AS logp, round(list_sum(p), 6) AS total FROM s"),
    "tn06_distillation_loss": (tn06_distillation_loss, f"{PAIR}, q AS (SELECT label, {_LSM('t', '2.0::DOUBLE')} AS lt, {_LSM('s', '2.0::DOUBLE')} AS ls, {_LSM('s', '1.0::DOUBLE')} AS l1 FROM p WHERE label < 8), r AS (SELECT label, 4 * list_sum(list_transform(range(1, len(lt) + 1), lambda i: exp(lt[i]) * (lt[i] - ls[i]))) AS kl, -l1[label + 1] AS ce FROM q) SELECT label, count(*) AS n, round(avg(kl), 5) AS kl, round(avg(ce), 5) AS ce, round(avg(kl * 0.7::DOUBLE + ce * 0.3::DOUBLE), 5) AS loss FROM r GROUP BY label"),
    "tn07_fitted": (tn07_fitted, f"{E} SELECT vec_id, 60::INTEGER AS small, round(list_sum(d[1:60]), 5) AS small_sum, 70::INTEGER AS large, 0.0::DOUBLE AS last FROM e"),
    "tn08_cosine": (tn08_cosine, f"{PAIR} SELECT vec_id, round({_DOT('t', 's')} / sqrt({_DOT('t', 't')}) / sqrt({_DOT('s', 's')}), 6) AS similarity FROM p"),
    "tn09_suppressed": (tn09_suppressed, f"{E} SELECT vec_id, CAST(list_position(d[5:], list_max(d[5:])) + 3 AS INTEGER) AS choice, list_transform(list_sort(list_transform(range(1, len(d) + 1), lambda i: {{'v': -d[i], 'i': i}}))[1:8], lambda s: CAST(s.i - 1 AS INTEGER)) AS best FROM e"),
    "tn12_ranked": (tn12_ranked, f"{E}, r AS (SELECT vec_id, label, round(-CAST(vec_id AS DOUBLE) / ((len(ids) + 5) / 6), 6) AS score FROM e) SELECT label, arg_max(vec_id, (score, -vec_id)) AS vec_id, max(score) AS score FROM r GROUP BY label"),
    "tn10_greedy_step": (tn10_greedy_step, f"{E} SELECT vec_id, CAST(CASE label WHEN 9 THEN {Z.EOT} ELSE list_position(d, list_max(d)) - 1 END AS INTEGER) AS token, round(CASE label WHEN 9 THEN 0.0::DOUBLE ELSE list_max({_LSM('d', '1.0::DOUBLE')}) END, 6) AS sum_logprob FROM e"),
    "tn11_beam_search": (tn11_beam_search, None),
    "tn14_positions": (tn14_positions, "WITH g AS (SELECT i // 16 AS position, i % 16 AS channel FROM (SELECT unnest(range(1024)) AS i)) SELECT *, round(CASE WHEN channel < 8 THEN sin(position * exp(-ln(10000) / 7 * (channel % 8))) ELSE cos(position * exp(-ln(10000) / 7 * (channel % 8))) END, 6) AS code FROM g"),
    "tn15_causal_mask": (tn15_causal_mask, "SELECT i // 16 AS q, i % 16 AS k, i // 16 < i % 16 AS is_masked FROM (SELECT unnest(range(256)) AS i)"),
    "tn17_norms": (tn17_norms, f"{E} SELECT label, round(sqrt(sum({_DOT('d', 'd')})), 5) AS norm, round(max(least(sqrt({_DOT('d', 'd')}), 0.5::DOUBLE)), 6) AS largest_clipped FROM e GROUP BY label"),
    "st07_id_sets": (st07_id_sets, f"{E} SELECT vec_id, list_sort(list_distinct(ids || [3, 7, 14])) AS both, list_filter([3, 7, 14], lambda x: NOT list_contains(ids, x)) AS rest FROM e"),
    "tz01_token_counts": (tz01_token_counts, f"SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '{_Z_SPLIT}'), lambda p: CASE WHEN p IN ({_SUF}) THEN 1 ELSE strlen(p) END)), 0) AS BIGINT) AS n_tokens FROM documents"),
    "tz01_token_ids": (tz01_token_ids, _IDS_SQL),
    "tz08_sequences": (tz08_sequences, f"SELECT row_id, {Z.SOT} AS first, {Z.EOT} AS last, 64 AS size, 64 AS target_size FROM segments WHERE text <> ''"),
    "jn15_languages": (jn15_languages, "WITH l AS (SELECT lower(lang) AS code, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), k(code, name, token) AS (VALUES " + ", ".join(f"('{c}', '{n}', {Z.SPECIALS.get(f'<|{c}|>', 'NULL')})" for c, n in Z.LANGUAGES.items()) + ") SELECT code, n, coalesce(name, 'unknown') AS name, token FROM l LEFT JOIN k USING (code)"),
    "fs19_not_composed": (fs19_not_composed, "SELECT doc_id FROM documents WHERE nfc_normalize(text) <> text"),
    "fs20_compression": (fs20_compression, None),
    "jn06_matched_features": (jn06_matched_features, r"WITH m AS (SELECT id, regexp_replace(regexp_extract(audio_path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM manifest_samples WHERE transcription <> ''), f AS (SELECT file_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM segment_files) SELECT stem, id AS mel_id, file_id AS logits_id FROM m JOIN f USING (stem)"),
    "ag37_audio_summary": (ag37_audio_summary, f"{E}, o AS (SELECT d, list_sort(list_transform(d, lambda x: abs(x))) AS m, len(d) AS n FROM e), w AS (SELECT round(avg(20 * log10(list_avg(m[CAST(floor(n * 0.9) AS INTEGER) + 1:]) / (list_avg(m[1:CAST(floor(n * 0.1) AS INTEGER)]) + 1e-10))), 5) AS snr, round(avg(sqrt({_DOT('d', 'd')} / n)), 6) AS rms FROM o) SELECT round(avg(sampling_rate), 6) AS rate, round(avg(duration), 6) AS duration, round(avg(duration * sampling_rate * 2 / 1048576), 6) AS megabytes, (SELECT snr FROM w) AS snr, (SELECT rms FROM w) AS rms FROM manifest_samples"),
    "ag38_audio_compatibility": (ag38_audio_compatibility, "SELECT 'other_rate' AS issue, count(*) FILTER (sampling_rate <> 16000) AS n FROM manifest_samples UNION ALL SELECT 'too_long', count(*) FILTER (duration > 30) FROM manifest_samples UNION ALL SELECT 'too_short', count(*) FILTER (duration < 1) FROM manifest_samples"),
    "tn03_log_mel": (tn03_log_mel, None),
}
