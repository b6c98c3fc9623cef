"""Pivotal rounding and mixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuebound.llm import mixing as M

TARGETS = "mix_id string, source string, target_share double, max_repeats int, size_factor double"


def test_pivotal_keeps_the_weighted_sum_and_leaves_one():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(0, 60))
        p, w = rng.random(n), rng.integers(1, 900, n).astype(float)
        q = M.pivotal(p, w, rng)
        open_at = (q != 0) & (q != 1)
        assert open_at.sum() <= 1
        assert abs((p * w).sum() - (q * w).sum()) < 1e-3


def test_pivotal_keeps_expectations():
    rng = np.random.default_rng(2)
    p, w = np.array([0.2, 0.7, 0.45, 0.9, 0.35]), np.array([10.0, 3.0, 40.0, 7.0, 25.0])
    draws = np.mean([M.pivotal(p, w, rng) for _ in range(20_000)], axis=0)
    assert np.abs(draws - p).max() < 0.015


def test_settling_misses_by_little():
    rng = np.random.default_rng(5)
    for n in (1, 10, 50, 300):
        missed = []
        for _ in range(60):
            p, w = rng.random(n), rng.integers(1, 900, n).astype(float)
            q = M.settle(p, M.pivotal(p, w, rng), w)
            assert set(q) <= {0.0, 1.0}
            missed.append(abs((p * w).sum() - (q * w).sum()))
            assert missed[-1] <= w.max() / 2
        assert np.median(missed) <= 900 / n  # about the shortest of n documents


def corpus(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "big" if i < 3000 else "mid" if i < 3600 else "tiny" if i < 3605 else None, int(rng.integers(0, 400))) for i in range(3700)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("p", F.lit("clash")).withColumn("copies", F.lit(1)).withColumn("mix_id", F.lit("x")), rows


@pytest.mark.parametrize("chunk", [5000, 40])
def test_mix_reaches_its_shares(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(M, "FAN_IN", 4)
    sizes, rows = corpus(spark)
    total = sum(r[2] for r in rows)
    targets = spark.createDataFrame([("m", "big", 0.5, 3, 0.5), ("m", "mid", 0.4, 4, 0.5), ("m", "tiny", 0.06, 8, 0.5), ("m", "none", 0.04, 4, 0.5), ("n", "mid", 1.0, 1, 0.05)], TARGETS)
    drawn = M.draw_mix(sizes, targets, seed=5).cache()
    by = {}
    source_of, size_of = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    for r in drawn.collect():
        assert source_of[r.doc_id] == r.source and size_of[r.doc_id] == r.n_tokens and r.copies >= 1
        assert (r.mix_id, r.doc_id) not in by
        by[r.mix_id, r.doc_id] = r.copies
    report = {(r.mix_id, r.source): r for r in M.mix_report(sizes, targets, drawn).collect()}
    assert len(report) == 5
    for key in (("m", "big"), ("m", "mid"), ("n", "mid")):
        assert abs(report[key].drawn_tokens - report[key].planned_tokens) <= 3  # documents have up to 400
    assert abs(sum(r.planned_tokens for k, r in report.items() if k[0] == "m") - 0.5 * total) < 1e-6  # the mix has its size
    assert report["m", "big"].planned_tokens > report["m", "big"].target_tokens
    assert abs(report["m", "big"].planned_tokens / report["m", "mid"].planned_tokens - 5 / 4) < 1e-9
    tiny = sum(r[2] for r in rows if r[1] == "tiny")
    assert report["m", "tiny"].drawn_tokens == min(8 * tiny, report["m", "tiny"].drawn_tokens) and report["m", "tiny"].most_copies <= 8
    assert report["m", "none"].drawn_tokens == 0 and report["m", "none"].is_capped
    assert abs(sum(r.actual_share for k, r in report.items() if k[0] == "m") - 1) < 1e-9
    assert abs(report["m", "big"].target_tokens - 0.25 * total) < 1e-6
    again = {(r.mix_id, r.doc_id): r.copies for r in M.draw_mix(sizes.repartition(9), targets, seed=5).collect()}
    assert again == by


def test_filling_stops_at_caps_and_can_be_left_out(spark):
    sizes = spark.createDataFrame([(i, s, 10) for i, s in enumerate("a" * 100 + "b" * 10 + "c" * 10)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 0.2, 1, 1.0), ("m", "b", 0.4, 2, 1.0), ("m", "c", 0.3, 4, 1.0), ("m", "none", 0.1, 9, 1.0)], TARGETS)
    plan = {r.source: r.planned_tokens for r in M.mix_plan(sizes, targets).collect()}
    assert plan == {"a": pytest.approx(600), "b": 200, "c": 400, "none": 0}  # c is filled up to its cap, a takes the rest
    assert {r.source: r.planned_tokens for r in M.mix_plan(sizes, targets, fill=False).collect()} == {"a": pytest.approx(240), "b": 200, "c": pytest.approx(360), "none": 0}
    tight = targets.where("source <> 'a'")
    assert {r.source: r.planned_tokens for r in M.mix_plan(sizes, tight).collect()} == {"b": 200, "c": 400, "none": 0}
    assert {r.copies for r in M.draw_mix(sizes, tight).collect()} == {2, 4}


def test_mix_of_nothing(spark):
    sizes, _ = corpus(spark)
    none = spark.createDataFrame([], TARGETS)
    assert M.draw_mix(sizes, none).count() == 0
    targets = spark.createDataFrame([("m", "big", 1.0, 2, 0.5), ("m", None, None, None, None)], TARGETS)
    assert M.draw_mix(sizes.limit(0), targets).count() == 0
    assert [r.drawn_tokens for r in M.mix_report(sizes.limit(0), targets, M.draw_mix(sizes.limit(0), targets)).collect()] == [0, 0]
