"""Compaction, intervals and heavy keys against plain Python, with the awkward inputs."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuebound.functions.keys import fold_topic, video_key
from cuebound.operators import intervals as I
from cuebound.operators.tree import Measure, chunk_numbers, heavy_keys, topic_profile, tree_aggregate
from cuebound.streaming import compactor as C

SEGMENTS = "row_id bigint, topic string, video_id string, start double, end double, duration double, text string"


def sweep(rows):
    """Periods and gaps by sorting."""
    found, by_key = set(), {}
    for key, s, e in rows:
        if key is None or s is None or e is None or s != s or e != e or abs(s) > 1e12 or abs(e) > 1e12:
            continue
        a, b = round(s * 1000), round(e * 1000)
        if b > a:
            by_key.setdefault(key, []).append((a, b))
    for key, spans in by_key.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        found |= {(key, "period", a, b) for a, b in merged}
        found |= {(key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return found


def run_sweep(spark, rows):
    df = spark.createDataFrame(rows, "video string, a double, b double").withColumn("t", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("block", F.lit(None).cast("int"))
    out = I.periods_and_gaps(df, F.col("video"), F.col("a"), F.col("b"))
    return [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("seed", range(3))
def test_periods_and_gaps_agree_with_sorting(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        a = rng.choice([rng.randint(0, 60), rng.randint(0, 40_000), rng.randint(-90_000, 90_000_000)]) + rng.choice([0.0, 0.5, 0.001, 1e-9])
        rows.append((rng.choice(["x", "x", "x", "y", None]), float(a), a + rng.choice([0, -1, 0.001, 1, 10, 4200, 40_000.25])))
    rows += rows[:50]
    rows += [("z", None, 1.0), ("z", 1.0, None), ("z", float("nan"), 2.0), ("z", 1.0, float("inf")), ("z", 3.0, 3.0), ("z", 1e300, 2e300)]
    found = run_sweep(spark, rows)
    assert len(found) == len(set(found))
    assert set(found) == sweep(rows)


def test_touching_intervals_and_empty_input(spark):
    assert set(run_sweep(spark, [("v", 0.0, 1.0), ("v", 1.0, 2.0), ("v", 2.001, 3.0)])) == {("v", "period", 0, 2000), ("v", "gap", 2000, 2001), ("v", "period", 2001, 3000)}
    assert run_sweep(spark, []) == []


def test_video_key(spark):
    good = "dQw4w9WgX_-"
    cases = {
        good: good, f" {good}\n": good, f" {good}\t": good, f"https://h.example/watch?v={good}": good, f"https://h.example/watch?list=PLaaaaaaaaaaaaaaaa&v={good}&t=1s": good, f"http://h.example/{good}": good,
        f"https://h.example/{good}?si=abc": good, f"https://h.example/shorts/{good}/": good, f"h.example/{good}": good, good[:-1]: None, good + "x": None, "dQw4w9Wg$_-": None, "": None, "null": None, None: None,
        "https://h.example/watch?v=short": None, f"https://h.example/{good}?v=short": None, f"say {good}": None,
    }
    df = spark.createDataFrame(list(cases.items()), "a string, b string").withColumn("k", video_key(F.col("a")))
    assert {r.a: r.k for r in df.collect()} == cases


def test_fold_topic():
    assert fold_topic("Bếp Lửa-1") == fold_topic("BẾP_LỬA.1") == fold_topic(" bếp lửa 1 ") == fold_topic("bếplửa1")
    assert fold_topic("bep") != fold_topic("bếp")


def segment_rows(spark, rows):
    return spark.createDataFrame(rows, SEGMENTS).withColumn("__extra", F.lit(1)).withColumn("n", F.lit("x"))


def test_heavy_keys_counts_nulls_among_rows(spark):
    rows = [(i, "big" if i < 34 else None if i < 90 else f"t{i}", "vid" if i % 2 else None, None, None, None, None) for i in range(100)]
    df = segment_rows(spark, rows).repartition(7)
    assert {tuple(r) for r in heavy_keys(df, ["topic", "video_id"], 0.34, fan_in=2).collect()} == {("topic", "big"), ("video_id", "vid")}
    assert {tuple(r) for r in heavy_keys(df, ["topic", "video_id"], 0.341).collect()} == {("video_id", "vid")}
    assert heavy_keys(df.limit(0), ["topic"], 0.04).collect() == []


def test_tree_equals_group_by_and_has_no_rows_for_none(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(-5, 5)) for _ in range(2000)], "k string, v int").repartition(13)
    measures = [Measure("n", F.count(F.lit(1))), Measure("s", F.sum("v")), Measure("lo", F.min("v"), "min"), Measure("hi", F.max("v"), "max")]
    want = {tuple(r) for r in df.groupBy("k").agg(F.count(F.lit(1)), F.sum("v"), F.min("v"), F.max("v")).collect()}
    for bits, fan_in in ((4, 2), (4, 4), (16, 32), (0, 3), (5, None)):
        node, chunks = chunk_numbers(df, 2000, bits)
        assert {tuple(r) for r in tree_aggregate(df, ["k"], measures, node, chunks, fan_in).collect()} == want
    assert tree_aggregate(df.limit(0), ["k"], measures, F.lit(0), 0).collect() == []


def test_chunks_have_a_fixed_size(spark):
    for parts in (1, 7):
        df = spark.range(5000).repartition(parts)
        node, chunks = chunk_numbers(df, 5000, 6)
        sizes = [r["count"] for r in df.withColumn("c", node).groupBy("c").count().collect()]
        assert max(sizes) == 64 and len(sizes) <= -(-5000 // 64) + parts and abs(len(sizes) - chunks) <= parts


def test_merging_takes_three_rounds(spark):
    df = segment_rows(spark, [(i, f"t{i % 3}", "v", None, None, None, None) for i in range(2000)]).repartition(4)
    plan = heavy_keys(df, ["topic"], 0.04, chunk_bits=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(field") == 4 and plan.count("__node") >= 3  # one exchange for the chunks, three for the rounds


def test_profile_keeps_null_keys_and_long_texts(spark):
    rows = [(1, "a", "v", 0.0, 1.0, float("nan"), "x " * 50_000), (2, "a", "w", None, None, 2.0, None), (3, None, None, 5.0, 4.0, None, ""), (3, None, None, 5.0, 4.0, None, "")]
    found = {r.key_value: r for r in topic_profile(segment_rows(spark, rows), "topic", "video_id").collect()}
    assert (found["a"].n_rows, found["a"].n_words, found["a"].total_ms, found["a"].n_other) == (2, 50_000, 2000, 2)
    assert (found[None].n_rows, found[None].n_durations, found[None].first_ms, found[None].n_other) == (2, 0, 5000, 0)


RECORDS = [
    (1, "d/a_001.json", '{"text": "x", "n": 1}'), (2, "copy/a_001.JSON", '  ﻿{"n": 2, "text": "\\u0078"}\n'), (3, "d/a_001.json", '{"text": "y"}'), (4, "d/b.json", '{"text": null}'),
    (5, "e/b.json", '{"text":null}'), (6, "d/c.json", '{"other": "x"}'), (7, "d/d.json", '{"text": "x"'), (8, "d/e.json", '[{"text": "x"}]'), (9, "d/f.json", '{"text": "x"} {"text": "y"}'),
    (10, "d/g.json", ""), (11, "d/h.json", None), (12, None, '{"text": "z"}'), (13, "d/i.json", '{"a": {"text": "x"}}'), (14, "d/j.json", '{"text": "\\ud83d"}'), (15, "d/k", '{"text": ""}'),
    (16, "d/l.json", "{'text': 'x'}"), (17, "d/m.json", '{"text": NaN}'), (18, "d/n.json", '{"text": "' + "long " * 100_000 + '"}'), (19, "d/o.v2.json", '{"text": "q"}'), (None, "d/nameless.json", '{"text": "x"}'),
    (None, "d/k.json", '{"text": ""}'),
]
WANTED = {("nameless", None), ("a_001", 1), ("a_001", 3), ("b", 4), ("j", 14), ("k", 15), ("n", 18), ("o.v2", 19)}


def small_files(spark, rows, path):
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string").withColumn("text_key", F.lit("clash")).withColumn("kept", F.lit(0))
    df.coalesce(1).write.mode("append").parquet(path)


def index(spark, target):
    return {(r.segment_id, r.file_id) for r in C.read_index(spark, target).collect()}


def test_compactor_keeps_each_record_once_over_batches_and_calls(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(0, len(RECORDS), 4):
        small_files(spark, list(reversed(RECORDS))[i : i + 4], source)
    done = C.compact_files(spark, source, target, state, files_per_batch=2)
    assert done["batches"] >= 2
    assert index(spark, target) == WANTED
    assert C.compact_files(spark, source, target, state)["batches"] == 0  # nothing is discovered twice
    small_files(spark, [(0, "d/b.json", '{"text": null}'), (20, "d/new.json", '{"text": "n"}')], source)
    C.compact_files(spark, source, target, state)
    assert index(spark, target) == (WANTED - {("b", 4)}) | {("b", 0), ("new", 20)}
    rows = C.read_compacted(spark, target).collect()
    assert Counter((r.segment_id, r.file_id) for r in rows).most_common(1)[0][1] == 1
    assert {r.file_id: r.content for r in rows}[1] == RECORDS[0][2]
    for _ in range(2):
        C.consolidate(spark, target, str(tmp_path / "whole"))
    assert sorted((r.segment_id, r.file_id) for r in spark.read.parquet(str(tmp_path / "whole")).collect()) == sorted(index(spark, target))
    # A later batch holds only what it adds: no record of an earlier one comes again.
    batches = spark.read.parquet(f"{target}/records").groupBy("segment_id", "text_key").count()
    again = {r.segment_id for r in batches.where("count > 1").collect()}  # copies with a smaller id, or with one at last
    assert "b" in again <= {"b", "k"}
    small_files(spark, [(30, "d/new.json", '{"text": "n"}')], source)
    C.compact_files(spark, source, target, state)
    assert index(spark, target) == (WANTED - {("b", 4)}) | {("b", 0), ("new", 20)}


def test_compactor_replaces_a_batch_that_is_retried(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    small_files(spark, RECORDS + RECORDS[:3], source)
    C.compact_files(spark, source, target, str(tmp_path / "s1"))
    C.compact_files(spark, source, target, str(tmp_path / "s2"))  # a lost checkpoint: batch 0 comes again
    assert index(spark, target) == WANTED
    assert spark.read.parquet(f"{target}/records").count() == len(WANTED)


def test_compactor_of_an_empty_table(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    small_files(spark, [], source)
    C.compact_files(spark, source, target, str(tmp_path / "s"))
    assert C.read_index(spark, target).count() == 0
    assert C.read_compacted(spark, target).count() == 0


def test_record_text_is_exact():
    assert C.record_text('{"text": "a"}') == C.record_text('{ "x": {}, "text" : "\\u0061" }') == json.dumps("a")
    assert C.record_text('{"text": "é"}') != C.record_text('{"text": "e\\u0301"}')
    assert C.record_text('{"text": "null"}') != C.record_text('{"text": null}')
