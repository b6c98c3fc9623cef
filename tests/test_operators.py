"""Operators on small tables with known results, and files of every source and sink."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuebound.functions import arrays as A
from cuebound.functions import decoding as D
from cuebound.functions import signal as W
from cuebound.functions import tokenizer as Z
from cuebound.operators import metrics as G
from cuebound.operators import ordering as R
from cuebound.operators import overlap as O
from cuebound.operators import quality as Q
from cuebound.operators import summary as S
from cuebound.operators import validate as V
from cuebound.operators import vocabulary as C
from cuebound.plans import checkpoints as H
from cuebound.plans import pipeline as P
from cuebound.plans import settings as N
from cuebound.sources import audio, sinks, tables
from cuebound.sources import segments as G1
from cuebound.streaming.windows import windowed_metrics

CUES = "video_id string, cue_id bigint, start double, end double, text string"


def test_labels_of_crossing_touching_and_empty_cues(spark):
    cues = [("v", 1, 28.0, 32.0, "A"), ("v", 2, 30.0, 35.0, "B"), ("v", 3, 60.0, 60.0, "C"), ("v", 4, 0.0, 95.0, "D"), ("v", 5, 10.0, 5.0, "E"), ("v", 6, 1.0, 2.0, None), ("v", 7, 1.0, 2.0, ""), (None, 8, 1.0, 2.0, "F"), ("v", 9, None, 2.0, "G")]
    found = {r.segment_num: r.text for r in O.label_segments(spark.createDataFrame(cues, CUES), 30.0, "cue_id").collect()}
    assert found == {1: "A D", 2: "A B D", 3: "D", 4: "D"}
    assert O.label_segments(spark.createDataFrame([], CUES), 30.0, "cue_id").count() == 0


def test_overlap_join_equals_the_plain_predicate(spark):
    rng = random.Random(1)

    def spans(n):
        out = []
        for i in range(n):
            a = rng.randint(-2000, 100_000)
            out.append((i, rng.choice(["k", "k", "m", None]), a, a + rng.choice([-5, 0, 1, 7, 64, 512, 5_000, 10**6, 10**11])))
        return out

    left, right = spans(150), spans(150)
    a = spark.createDataFrame(left, "l bigint, key string, left_start bigint, left_end bigint")
    b = spark.createDataFrame(right, "r bigint, key string, right_start bigint, right_end bigint")
    found = [(r.l, r.r) for r in O.overlap_join(a, b, "key").collect()]
    want = {(x[0], y[0]) for x in left for y in right if x[1] and x[1] == y[1] and x[3] > x[2] and y[3] > y[2] and max(x[2], y[2]) < min(x[3], y[3])}
    assert len(found) == len(set(found))
    assert set(found) == want
    plan = O.overlap_join(a, b, "key")._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_overlap_join_puts_an_interval_into_two_bins_at_most(spark):
    spans = [(i, "k", a, a + n) for i, (a, n) in enumerate((a, n) for a in (-70_001, 0, 29_999, 2**52 + 1) for n in (1, 2, 63, 512, 30_000, 32_768, 262_143, 2**45, 2**60))]
    df = spark.createDataFrame(spans, "i bigint, key string, left_start bigint, left_end bigint")
    bins = O._binned(df, F.col("left_start"), F.col("left_end"), F.array().cast("array<int>")).groupBy("i").count().collect()
    assert len(bins) == len(spans) and max(r["count"] for r in bins) <= 2
    large = [(1, "k", 2**60 + 1, 2**60 + 2), (2, "k", -(2**61), 2**61)]
    a = spark.createDataFrame(large, "l bigint, key string, left_start bigint, left_end bigint")
    b = spark.createDataFrame([*large, (3, "k", 2**60, 2**60 + 1)], "r bigint, key string, right_start bigint, right_end bigint")
    assert sorted((r.l, r.r) for r in O.overlap_join(a, b, "key").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]


def test_overlap_join_does_not_broadcast_bins(spark):
    side = lambda name: spark.range(1000).select(F.lit("k").alias("key"), (F.col("id") * 10).alias(f"{name}_start"), (F.col("id") * 10 + 15).alias(f"{name}_end"))
    found = O.overlap_join(side("left"), side("right"), "key")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1000 + 2 * 999


def test_numbers_and_running_totals(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1.0, 2.5, -3.0]), rng.choice(["a", "a", "a", "b", None])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i bigint, v double, k string").repartition(7)
    found = R.numbered(df, [F.asc("i")], {"total": ("sum", F.col("v")), "low": ("min", F.col("v"))}).orderBy("i").collect()
    total, low = None, None
    for n, (row, (i, v, _)) in enumerate(zip(found, sorted(rows), strict=True), 1):
        total = v if total is None else total + (v or 0)
        low = v if low is None else min(low, v if v is not None else low)
        assert (row.i, row.number, row.total, row.low) == (i, n, total, low)
    within, seen = R.numbered_within(df, "k", [F.asc("i")]).orderBy("i").collect(), {}
    for row in within:
        seen[row.k] = seen.get(row.k, 0) + 1
        assert row.number == seen[row.k]
    assert R.numbered(df.limit(0), [F.asc("i")]).count() == 0
    assert [tuple(r) for r in R.index_batches(130, 64, spark).orderBy("batch").collect()] == [(0, 0, 64), (1, 64, 128), (2, 128, 130)]


def test_summaries(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 5.0), ("c", None)], "k string, v double")
    bins = {r.bin: r.n for r in S.histogram(df, F.col("v"), 10).collect()}
    assert bins == {0: 5, 9: 1}
    box = {r.k: r for r in S.box_plot(df, "k", "v").collect()}
    assert (box["a"].median, box["a"].high_whisker, box["a"].n_outliers) == (3.0, 4.0, 1)
    assert S.histogram(df.where("v = 5"), F.col("v"), 4).collect()[0].n == 1
    assert S.histogram(df.limit(0), F.col("v"), 4).collect() == []
    edges = spark.createDataFrame([(x,) for x in (None, 0.0, 10.0, 20.0, 30.0, 60.0, 60.01)], "d double").select(S.duration_category(F.col("d")).alias("c")).collect()
    assert [r.c for r in edges] == [None, None, "0-10s", "10-20s", "20-30s", "30-60s", "60s+"]


def test_vocabulary(spark):
    df = spark.createDataFrame([("x", 1, "mèo chạy mèo"), ("x", 2, "ăn cá"), ("y", 3, "mèo ăn cá"), ("z", 4, None), ("w", 5, "khác hẳn")], "topic string, i bigint, text string")
    found = {(r.a, r.b): r.similarity for r in C.tfidf_similarity(df, "topic", "i", "text").collect()}
    assert set(found) == {("w", "x"), ("w", "y"), ("w", "z"), ("x", "y"), ("x", "z"), ("y", "z")}
    assert found["w", "x"] == found["x", "z"] == 0.0
    assert 0.4 < found["x", "y"] < 1.0
    scores = {r.topic: r.primary_domain for r in C.domain_scores(spark.createDataFrame([("p", "tâm lý học"), ("q", "tiền"), ("r", None)], "topic string, text string"), "topic", "text").collect()}
    assert scores == {"p": "self_development", "q": "business_finance", "r": "general"}


def test_quality_and_validation(spark):
    rows = [(30.0, 10.0, "v", "ok text"), (0.0, 5.0, None, None), (-1.0, 5.0, "abc$efghijk", "  "), (1.0, 1.0, "dQw4w9WgXcQ", "x"), (None, 2.0, "short", "y")]
    df = spark.createDataFrame(rows, "start double, end double, video_id string, text string")
    errors = [r.e for r in df.select(V.label_error(F.col("start"), F.col("end"), F.col("text")).alias("e")).collect()]
    assert errors == ["end not after start", "no text", "blank text", "end not after start", "no start"]
    assert {r.issue: r.n for r in Q.counted(df, Q.VIDEO_ID).collect()} == {"n_empty": 1, "n_length": 3, "n_characters": 2}
    assert {r.field: r.n_missing for r in Q.missing_data(df, ["start", "speaker"]).collect()} == {"start": 1, "speaker": 5}
    files = spark.createDataFrame([("d/a.wav",), ("d/a.json",), ("e/b.wav",), ("e/c.JSON",), ("e/d.txt",)], "path string")
    pairs = {r.stem: (r.left_path, r.right_path) for r in V.pair_files(files, ".wav", ".json").collect()}
    assert pairs == {"a": ("d/a.wav", "d/a.json"), "b": ("e/b.wav", None), "c": (None, "e/c.JSON")}
    totals = spark.createDataFrame([(100, 100), (100, 95), (100, 94), (0, 0)], "n_total bigint, n_valid bigint")
    assert [r.status for r in V.verdict(totals).collect()] == ["PASSED", "WARNING", "FAILED", "FAILED"]
    bodies = spark.createDataFrame([("{}",), ("[1]",), ("3 ",), ('{"a": ',), ("",), (None,)], "c string")
    assert [r.e for r in bodies.select(V.json_error(F.octet_length("c"), F.col("c")).alias("e")).collect()] == [None, None, "neither object nor array", "unreadable", "too small", "missing"]


def test_metric_logs(spark):
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate([4.0, 2.0, None, 2.0, 3.0])], "phase string, step bigint, loss double")
    r = G.summary(df, "phase", "step", "loss").first()
    assert (r.first_value, r.last_value, r.least_step, r.most_step, r.change, r.trend) == (4.0, 3.0, 1, 0, -25.0, "decreasing")
    assert [x.step for x in G.best(df, "phase", "loss", "step", 2).orderBy("rank").collect()] == [1, 3]
    both = G.union_sorted(df.select("step"), df.select("loss", "phase"))
    assert both.columns == ["loss", "phase", "step"] and both.count() == 10


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [3.0, 2.0, 1.0], [5, 6, 9, 7])], "a array<double>, b array<double>, ids array<int>")
    row = df.select(
        A.softmax(F.col("a")).alias("p"), A.cosine(F.col("a"), F.col("b")).alias("c"), A.kl_divergence(F.col("a"), F.col("a"), 2.0).alias("k"), A.cross_entropy(F.col("a"), F.lit(2)).alias("ce"),
        A.end_padded(F.col("ids"), 3, 9).alias("cut"), A.end_padded(F.col("ids"), 6, 9).alias("long"), A.before_end(F.col("ids"), 9).alias("before"), A.argmax(F.col("a")).alias("top"),
        A.pad_or_trim(A.pad_or_trim(F.col("a"), 5), 5).alias("twice"), A.pad_or_trim(F.col("a"), 2).alias("short"), A.top_positions(F.col("b"), 2).alias("best"),
    ).first()
    p = np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum()
    assert np.allclose(row.p, p) and abs(row.c - 10 / 14) < 1e-12 and abs(row.k) < 1e-12 and abs(row.ce + np.log(p[2])) < 1e-12
    assert (row.cut, row.long, row.before, row.top, row.twice, row.short, row.best) == ([5, 6, 9], [5, 6, 9, 7, 9, 9], [5, 6], 2, [1.0, 2.0, 3.0, 0.0, 0.0], [1.0, 2.0], [0, 1])


def test_tokenizer(spark):
    assert (Z.EOT, Z.SOT, Z.SPECIALS["<|vi|>"], Z.SPECIALS["<|translate|>"], Z.SPECIALS["<|transcribe|>"]) == (50257, 50258, 50278, 50358, 50359)
    assert (Z.TIMES, len(Z.SPECIALS) + Z.BASE) == (50364, 51865)
    assert Z.start_sequence("Vietnamese") == [50258, 50278, 50359]
    assert Z.encode("ing") == [257] and Z.encode(" hi") == [32, 104, 105] and Z.decode(Z.encode("ness abc")) == "ness abc"
    assert "�" in Z.decode(Z.encode("ế"))
    assert Z.split_to_words(Z.encode("hi you, ok")) == [[104, 105], [32, 121, 111, 117], [44], [32, 111, 107]]
    assert Z.decode([104, Z.TIMES + 54], True) == "h<|1.08|>" and Z.decode([104, Z.TIMES + 54]) == "h"
    assert 35 in Z.non_speech_ids()
    with pytest.raises(ValueError, match="unsupported"):
        Z.language_code("klingon")
    texts = ["", "Xin chào các bạn", "running fastest", "日本 a", "  two\n\nlines ", "it's 12 tests!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", Z.token_count(F.col("t")).alias("n"), Z.encode_udf("t").alias("ids"))
    assert all(r.n == len(r.ids) == len(Z.encode(r.t)) for r in df.collect())


def test_audio_files(spark, tmp_path):
    t = np.arange(W.SAMPLES) / W.RATE
    wave = 0.1 * np.sin(2 * np.pi * 440 * t)
    (tmp_path / "long.wav").write_bytes(W.write_wav(np.concatenate([wave, wave[:16000]])))
    (tmp_path / "short.wav").write_bytes(W.write_wav(wave[:160_000]))
    (tmp_path / "silent.wav").write_bytes(W.write_wav(np.zeros(16000)))
    (tmp_path / "broken.wav").write_bytes(b"RIFFnothing")
    files = audio.read_audio(spark, str(tmp_path))
    heads = {r.stem: r for r in audio.headers(files).collect()}
    assert (heads["short"].rate, heads["short"].channels, heads["short"].seconds, heads["broken"].rate) == (16000, 1, 10.0, None)
    mels = {r.stem: r.mel for r in W.log_mel_features(audio.waves(files), "stem", "wave").collect()}
    assert mels["broken"] is None
    for name in ("long", "short", "silent"):
        assert len(mels[name]) == 80 and {len(band) for band in mels[name]} == {3000}
    own = np.argmax(np.array(mels["long"])[:, 100])
    edges = W.mel_frequencies(82)
    assert edges[own] < 440 < edges[own + 2]
    assert np.allclose(np.array(mels["silent"]), (-10 + 4) / 4)
    assert abs(float(W.hz_to_mel(float(W.mel_to_hz(np.array([20.0]))[0])) - 20)) < 1e-9


def test_segment_files(spark, tmp_path):
    folder = tmp_path / "topic a" / "dataset"
    folder.mkdir(parents=True)
    rows = {"v_001": {"start": 0, "end": 30, "duration": 30, "video_id": "v", "text": "x"}, "v_002": {"start": 10.0, "end": 25.0, "video_id": "v", "text": "y"}, "v_004": {"start": 1, "end": 2, "duration": None, "text": "z"}, "dataset_summary": {"total_videos": 1}}
    for name, row in rows.items():
        (folder / f"{name}.json").write_text(json.dumps(row))
    (folder / "v_003.json").write_text('{"text": ')
    good, bad = G1.split_errors(G1.read_segments(spark, str(tmp_path)))
    found = {r.segment_id: (r.topic, r.duration, r.text) for r in good.collect()}
    assert found == {"v_001": ("topic a", 30.0, "x"), "v_002": ("topic a", 15.0, "y"), "v_004": ("topic a", None, "z")}
    assert [r.file_path.split("/")[-1] for r in bad.collect()] == ["v_003.json"]
    assert G1.read_segments(spark, str(tmp_path), exclude_summary=False).count() == 5


def test_other_files(spark, tmp_path):
    manifest = {"split": "train", "samples": [{"id": 1, "duration": 2.5, "transcription": "x"}, {"id": 2}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert [(r.split, r.id, r.duration) for r in tables.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("train", 1, 2.5), ("train", 2, None)]
    for i in range(2):
        (tmp_path / f"{i}_metrics.json").write_text(json.dumps({"metrics": [{"step": i, "loss": 1.5}, {"batch": 1}] if i else []}))
    logs = tables.read_metric_logs(spark, str(tmp_path / "*_metrics.json"))
    assert [(r.file, r.entry["loss"]) for r in tables.first_entries(logs).collect()] == [("1_metrics.json", "1.5")]
    samples = spark.createDataFrame([(1, "train", 1.0, "a"), (2, "test", 2.0, "b")], "id bigint, split string, duration double, text string")
    sinks.write_manifest(samples, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/totals")).count() == 2
    sinks.write_features(spark.range(2500).toDF("id"), str(tmp_path / "f"), 1000)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2500
    sinks.write_report(samples, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    labels = samples.select(F.col("split").alias("topic"), F.lit("v").alias("video_id"), F.col("id").alias("segment_num"), "text")
    sinks.write_labels(labels, str(tmp_path / "labels"))
    sinks.write_summary(labels, str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "labels")).count() == 2 and spark.read.json(str(tmp_path / "summary")).count() == 1
    df, had = sinks.drop_columns(samples, ["duration", "nothing"])
    assert had == ["duration"] and "duration" not in df.columns
    assert "train" in sinks.render_report("Report", samples)
    shards = tmp_path / "s" / "deep"
    samples.coalesce(1).write.parquet(str(shards))
    assert tables.sample_text(tables.read_shards(spark, str(tmp_path / "s"), "*.parquet")).count() == 2
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert tables.read_config(str(tmp_path / "c.json"), {"a": ["b"]})["a"]["b"] == 1
    with pytest.raises(KeyError, match="a.c"):
        tables.read_config(str(tmp_path / "c.json"), {"a": ["c"]})
    assert "(2 more rows)" in sinks.render_report("Report", spark.range(3), rows=1)


def test_settings(tmp_path):
    sections = {place: {} for place in ("paths", "student", "teacher", "distillation", "data", "hardware")}
    for section, options in N.OPTIONS.items():
        for name, default in options.items():
            place, key = N._ELSEWHERE.get((section, name), (section, name))
            if default is N._REQUIRED:
                sections[place][key] = "5e-5" if name == "learning_rate" else 2 if name in N._NUMBERS else name
    text = "project:\n  name: 'a: b'  # comment\n---\n" + "".join(f"{place}:\n" + "".join(f"  {k}: {v}\n" for k, v in options.items()) for place, options in sections.items())
    (tmp_path / "c.yaml").write_text(text.replace("---\n", ""))
    found = N.Settings.read(str(tmp_path / "c.yaml"))
    assert found.project == "a: b" and found.training.learning_rate == 5e-5 and found.model.student_model_name == "student_model_name"
    assert found.data.hop_length == 160 and found.data.return_timestamps is False and found.distillation.ignore_index == -100
    with pytest.raises(KeyError, match="hardware.device"):
        N.Settings.of({"project": {"name": "x"}} | {k: {n: 1 for n in v if n != "device"} for k, v in sections.items()})
    assert N._mappings("a:\n  b: true\n  c: \"x # y\"\n  d: 1.5 # z\ne: ~\n# end\n") == {"a": {"b": True, "c": "x # y", "d": 1.5}, "e": None}
    with pytest.raises(ValueError, match="line 2"):
        N._mappings("a:\n  - b\n")


def test_checkpoints(spark, tmp_path):
    values = H.KeyValues(spark, str(tmp_path / "kv"))
    assert not values.has_any() and values.get() == {}
    values.update(channel="a", count=1)
    values.update(count=2, nested={"x": [1, None]})
    assert values.get() == {"channel": "a", "count": 2, "nested": {"x": [1, None]}} and values.has_any()
    values.clear()
    assert not values.has_any()
    steps, calls = H.Steps(spark, str(tmp_path / "steps")), []

    @steps.step("crawl")
    def crawl(n):
        calls.append(n)
        return {"found": n}

    assert not steps.is_complete("crawl") and steps.result("crawl") is None
    assert crawl(3) == {"found": 3} and crawl(9) == {"found": 3} and calls == [3]
    steps.processed("a", "b")
    steps.failed("c", 'bad "thing"')
    steps.failed("b", "failed at first")
    items = spark.createDataFrame([("a",), ("c",), ("d",)], "item string")
    assert sorted(r.item for r in steps.unprocessed(items, "item").collect()) == ["c", "d"]
    assert [tuple(r) for r in steps.failures().collect()] == [("c", 'bad "thing"')]
    size = H.size_of(spark, str(tmp_path / "steps"))
    assert size > 0 and H.free_bytes(spark, str(tmp_path)) > 0
    assert H.clean_up(spark, [str(tmp_path / "steps"), str(tmp_path / "none")]) == [(str(tmp_path / "steps"), size), (str(tmp_path / "none"), 0)]
    assert not steps.is_complete("crawl")


def test_options_and_exact_numbers(spark):
    D.check_options(temperature=0.0, width=5, patience=1.0, alpha=0.6)
    for bad in ({"width": 5, "best_of": 2}, {"best_of": 2}, {"patience": 1.0}, {"alpha": 1.5}):
        with pytest.raises(ValueError):
            D.check_options(**bad)
    df = spark.createDataFrame([(480, 160), (None, 160)], "a bigint, b bigint")
    assert [r[0] for r in df.select(A.exact_quotient(F.col("a"), F.col("b"))).collect()] == [3, None]
    with pytest.raises(Exception, match="481 is no multiple of 160"):
        spark.createDataFrame([(481, 160)], "a bigint, b bigint").select(A.exact_quotient(F.col("a"), F.col("b"))).collect()
    assert spark.range(1).select(A.half_even(F.lit(0.125), 2), A.half_even(F.lit(0.375), 2)).first()[:] == (0.12, 0.38)


def test_compression_ratio(spark):
    import zlib

    texts = ["", "a" * 1000, "ế b", None]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(W.compression_ratio_udf("t")).collect()]
    assert found == [None if t is None else len(t.encode()) / len(zlib.compress(t.encode())) for t in texts]


def test_hidden_names_and_empty_files(spark, tmp_path):
    folder = tmp_path / "My topic" / "dataset"
    folder.mkdir(parents=True)
    for name, text in {"_id_001.json": '{"text": "x", "start": 1.0, "end": 2.5}', "b_001.json": "", "c_001.json": "[1]", "d_001.json": "{'text': 'x'}", "e_001.json": '{"start": 1}'}.items():
        (folder / name).write_text(text)
    good, bad = G1.split_errors(G1.read_segments(spark, str(tmp_path)))
    assert sorted((r.topic, r.segment_id, r.text, r.duration) for r in good.collect()) == [("My topic", "_id_001", "x", 1.5), ("My topic", "e_001", None, None)]
    assert sorted(r.file_path[-10:] for r in bad.collect()) == ["b_001.json", "c_001.json", "d_001.json"]


def test_executors_list_the_tree(spark, tmp_path):
    names = ["a b.json", "Biển+Nắng%20é.json", "x#y?[1].json", "_h.json", ".h.json", "no.txt", "dataset_summary.json"]
    for topic in ("Bếp lửa 1", "[t]"):
        (tmp_path / topic / "dataset" / "d.json").mkdir(parents=True)
        for name in names:
            (tmp_path / topic / "dataset" / name).write_text('{"text": "x"}')
    (tmp_path / "empty").mkdir()
    (tmp_path / "file.json").write_text("{}")
    rows = G1.read_segments(spark, str(tmp_path))
    assert rows.inputFiles() == []  # the driver holds no list of files
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).where("path LIKE '%/dataset/%.json' AND path NOT LIKE '%summary%'")
    seen = {r[0] for r in rows.select("file_path").collect()}
    assert {r[0] for r in want.select("_metadata.file_path").collect()} == {p for p in seen if not p.rsplit("/", 1)[1].startswith(("_", "."))}
    assert len(seen) == 10 and {r.text for r in rows.collect()} == {"x"}
    with pytest.raises(FileNotFoundError):
        G1.read_segments(spark, str(tmp_path / "none"))


def test_read_errors_reads_the_tree_once(spark):
    from cuebound.queries.files import src03_read_errors

    plan = src03_read_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow read") == 1 and "Union" not in plan


def test_pipeline(spark, tmp_path):
    made = []

    def make(name):
        made.append(name)
        return spark.range(3)

    def fail():
        raise ValueError("no")

    for _ in range(2):
        p = P.Pipeline(spark, str(tmp_path / "p"))
        assert p.stage("one", lambda: make("one")).count() == 3
        assert p.stage("two", fail, optional=True) is None
    assert made == ["one"] and p.log == [("one", "skipped"), ("two", "failed")]
    with pytest.raises(ValueError, match="no"):
        p.stage("two", fail)
    p.clear()
    assert not p.done("one")
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert P.retry(flaky, 4, 1.0, 2.0, OSError, waits.append) == "done" and waits == [1.0, 2.0]
    assert P.safely(fail, 7) == 7
    kept = {}
    assert P.run_all({"a": lambda: spark.range(2), "b": fail}, lambda n, df: kept.update({n: df.count()})) == {"a": "success", "b": "failed: no"}
    b = P.Batches(spark, str(tmp_path / "b"), 25, 10)
    assert [next(b.run(lambda n, s, e: {"n": e - s}))] == [0]
    assert [x[0] for x in b.pending()] == [1, 2] and list(b.run(lambda n, s, e: {})) == [1, 2] and b.pending() == []


def test_stream_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2025-01-01 00:10:00' + make_interval(0,0,0,0,0,id,0) AS ts, 'a' AS event_type, CAST(id AS DOUBLE) AS value FROM range(300)")
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    query = windowed_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    query.processAllAvailable()
    query.stop()
    a = {(r.window.start, r.n, r.total) for r in spark.sql("SELECT * FROM w").collect()}
    assert a == {(r.window.start, r.n, r.total) for r in windowed_metrics(rows).collect()}


def test_decoding_rules():
    rules = D.Rules(begin=1, end=5, suppress=[2], not_first=[1, 5], times=8, no_times=7, latest_first=1)
    flat = np.zeros(12)
    flat[0] = 3.0
    allowed = lambda tokens, logits=flat: set(np.flatnonzero(np.isfinite(rules.apply(logits, tokens))))
    assert allowed([9]) == {8, 9}
    assert allowed([9, 8]) == {0, 1, 3, 4, 5, 6}
    assert allowed([9, 8, 0]) == {0, 1, 3, 4, 5, 6, 9, 10, 11}
    assert allowed([9, 8, 0, 10]) == {10, 11}  # an open pair; all times together are likelier than the end
    assert allowed([9, 8, 0, 11]) == {5, 6, 11}
    assert allowed([9, 8, 0], np.zeros(12)) == {9, 10, 11}


def test_search():
    table = np.log(np.array([[0.0, 0.55, 0.45, 0.0], [0.5, 0.0, 0.0, 0.5], [0.0, 0.05, 0.0, 0.95], [0.0, 0.0, 0.0, 1.0]]) + 1e-12)
    model = lambda sequences: table[[s[-1] for s in sequences]]
    rules = D.Rules(begin=1, end=3)
    assert D.greedy(model, [0], rules, 10).tokens[:2] == [0, 1]
    best = D.beam(model, [0], rules, 10, 3)[0]
    assert best.tokens == [0, 2, 3] and abs(best.score - np.log(0.45 * 0.95)) < 1e-6
    assert D.beam(model, [0], rules, 1, 2)[0].tokens[-1] == 3
    assert D.start_tokens([1, 2], prompt=list(range(500)))[0] == 50361 and len(D.start_tokens([1, 2], prompt=list(range(500)))) == 226
