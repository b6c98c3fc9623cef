"""Components and splits against plain Python."""

import random

from pyspark.sql import functions as F

from cuebound.functions.keys import fold_topic
from cuebound.llm import components as C
from cuebound.llm.components import connected_components
from cuebound.llm.splits import assign_splits, row_components, tied_topics

SCHEMA = "row_id bigint, topic string, video_id string"


def groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    found = {}
    for x in parent:
        found.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in found.values()}


def components(spark, edges):
    rows = connected_components(spark.createDataFrame(edges, "a string, b string")).collect()
    found = {}
    for r in rows:
        found.setdefault(r.component, set()).add(r.node)
    assert len({r.node for r in rows}) == len(rows)
    assert all(c in members for c, members in found.items())
    return {frozenset(g) for g in found.values()}


def test_components_of_paths_stars_cycles_and_loops(spark):
    path = [(f"p{i}", f"p{i + 1}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(40)]
    cycle = [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)]
    edges = path + star + cycle + [("l", "l"), ("u", "v"), ("v", "u"), ("u", "v")]
    assert components(spark, edges) == groups(edges)


def test_hubs_have_their_lists_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "LIST", 3)
    monkeypatch.setattr(C, "EDGES", 5)
    edges = [("hub", f"s{i}") for i in range(40)] + [(f"s{i}", f"t{i}") for i in range(0, 40, 3)] + [("other", f"u{i}") for i in range(9)]
    graph, n = C._lists(spark.createDataFrame(edges + [(b, a) for a, b in edges], "a string, b string"))
    assert n > 1 and graph.where("a = 'hub'").count() > 5
    assert components(spark, edges) == groups(edges)


def test_lists_are_not_shuffled_again(spark, monkeypatch):
    monkeypatch.setattr(C, "EDGES", 1)
    graph, n = C._lists(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")], "a string, b string"))
    assert n == 4
    sent = spark.createDataFrame([("a", 0)], "a string, part int").repartition(n, "a", "part")
    joined = graph.join(sent.hint("merge"), ["a", "part"])
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the frontier's


def test_components_of_random_graphs_and_none(spark):
    for seed in range(2):
        rng = random.Random(seed)
        edges = [(f"n{rng.randint(0, 120)}", f"n{rng.randint(0, 120)}") for _ in range(90)]
        assert components(spark, edges) == groups(edges)
    assert components(spark, []) == set()
    assert components(spark, [(None, "a"), ("a", None)]) == set()


def corpus():
    rng = random.Random(9)
    rows, n = [], 0
    topics = [f"topic {i}" for i in range(40)]
    for _ in range(1500):
        t = rng.choice(topics[:3] * 10 + topics)
        t = rng.choice([t, t, t.upper(), t.replace(" ", "_"), f" {t}"])
        v = f"vid{topics.index(t.strip().lower().replace('_', ' ')):03d}{rng.randint(0, 20):05d}"
        rows.append((n, rng.choice([t] * 9 + [None]), rng.choice([v, v, f"https://h.example/{v}", None, "none"])))
        n += 1
    rows += [(n, "topic 5", "shared00001"), (n + 1, "TOPIC-9", " shared00001 "), (n + 2, None, "shared00001"), (n + 3, " ", None), (n + 3, " ", None), (n + 4, "", "lonely00001"), (n + 5, None, "lonely00001")]
    return rows


def expected_pairs(rows):
    from re import fullmatch

    edges = []
    for _, t, v in rows:
        if t is None or not t.strip():
            continue
        edges.append(("s" + t, "k" + fold_topic(t)))
        bare = (v or "").strip().split("/")[-1]
        if fullmatch(r"[A-Za-z0-9_-]{11}", bare):
            edges.append(("s" + t, "v" + bare))
    pairs = set()
    for g in groups(edges):
        names = sorted(x[1:] for x in g if x[0] == "s")
        pairs |= {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    return pairs


def test_tied_topics(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("clash")).withColumn("node", F.lit(0))
    found = [tuple(r) for r in tied_topics(df).collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected_pairs(rows)
    assert tied_topics(df.limit(0)).count() == 0


def test_splits_keep_components_whole_and_near_the_shares(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("split", F.lit("clash"))
    members = row_components(df).cache()
    assert members.count() == len(rows)
    split = assign_splits(members, (0.7, 0.15, 0.15), 101).collect()
    assert len(split) == len(rows)
    of_row = {r.row_id: r.split for r in split}
    by_topic, by_video = {}, {}
    for i, t, v in rows:
        if t and t.strip():
            by_topic.setdefault(fold_topic(t), set()).add(of_row[i])
        bare = (v or "").strip().split("/")[-1]
        if len(bare) == 11:
            by_video.setdefault(bare, set()).add(of_row[i])
    assert all(len(s) == 1 for s in by_topic.values())
    assert all(len(s) == 1 for s in by_video.values())
    assert {r.split for r in split} == {"train", "validation", "test"}
    again = {r.row_id: r.split for r in assign_splits(members, (0.7, 0.15, 0.15), 101).collect()}
    assert again == of_row
    assert {r.split for r in assign_splits(members, (0.85, 0.15, 0.0), 7).collect()} <= {"train", "validation"}


def test_splits_in_hash_order_alone(spark):
    rows = [(i, f"big{i % 2}" if i < 3000 else f"small{i // 4}", None) for i in range(10_000)]
    members = row_components(spark.createDataFrame(rows, SCHEMA)).cache()
    shares = (0.6, 0.2, 0.2)
    splits = {first: {r.row_id: r.split for r in assign_splits(members, shares, 3, first).collect()} for first in (0.0, 0.005)}
    for of_row in splits.values():
        by_topic = {}
        for i, t, _ in rows:
            by_topic.setdefault(t, set()).add(of_row[i])
        assert all(len(s) == 1 for s in by_topic.values()) and len(of_row) == len(rows)
    missed = {first: max(abs(list(of_row.values()).count(name) / 10_000 - share) for name, share in zip(("train", "validation", "test"), shares, strict=True)) for first, of_row in splits.items()}
    assert missed[0.005] < 0.02 and missed[0.0] < 0.16  # at most what one large component holds


def test_splits_of_many_small_groups_are_close(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 4)).alias("topic"), F.lit(None).cast("string").alias("video_id"))
    counts = {r.split: r["count"] for r in assign_splits(row_components(df), (0.9, 0.05, 0.05), 7).groupBy("split").count().collect()}
    assert abs(counts["train"] / 20_000 - 0.9) < 0.02
    assert abs(counts["test"] / 20_000 - 0.05) < 0.02


def test_splits_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert assign_splits(row_components(df), (0.9, 0.05, 0.05), 7).count() == 0
