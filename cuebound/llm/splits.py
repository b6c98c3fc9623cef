"""Train, validation and test splits that keep tied records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuebound.functions.keys import is_blank, topic_key_udf, video_key
from cuebound.llm.components import connected_components
from cuebound.session import written

SPLITS = ("train", "validation", "test")
#: Hash ranges of components; each goes to one split.
BUCKETS = 4096
#: By default, components of at least this share of all rows are placed before the others (there are at most as many as its
#: inverse); 0 leaves all of them in hash order.
PLACE_FIRST = 0.005


def _keyed(segments: DataFrame) -> DataFrame:
    """segments' distinct (topic, video) with the topic's key; blank topics count as NULL."""
    topic = F.when(~is_blank(F.col("topic")), F.col("topic"))
    return segments.select(topic.alias("topic"), video_key(F.col("video_id")).alias("video")).distinct()


def topic_keys(segments: DataFrame) -> DataFrame:
    """(topic, topic_key) of each distinct stored topic that is not blank."""
    topics = segments.select("topic").where(~is_blank(F.col("topic"))).distinct()
    return topics.withColumn("topic_key", topic_key_udf("topic"))


def topic_components(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components of topic keys and the map (topic, topic_key, component).

    Topics are tied when their keys agree or when a video has rows of both. A video's topic keys are tied to its smallest
    one, so a video with many topics gives a star, never all pairs; videos of a single topic give no edge.
    Returns ((topic, topic_key, component), (video, topic_key) with the smallest key of each video).
    """
    names = written(topic_keys(segments), "topics")
    pairs = _keyed(segments).where("topic IS NOT NULL AND video IS NOT NULL").join(names, "topic").select("video", "topic_key").distinct()
    pairs = written(pairs, "pairs")
    hubs = pairs.groupBy("video").agg(F.min("topic_key").alias("hub"), F.max("topic_key").alias("last"))
    ties = pairs.join(hubs.where("hub <> last").select("video", "hub"), "video").where("hub <> topic_key")
    edges = ties.select(F.col("hub").alias("a"), F.col("topic_key").alias("b")).distinct()
    tied = connected_components(edges).select(F.col("node").alias("topic_key"), "component")
    mapped = names.join(tied, "topic_key", "left").select("topic", "topic_key", F.coalesce("component", "topic_key").alias("component"))
    return mapped, hubs.select("video", F.col("hub").alias("topic_key"))


def topic_classes(segments: DataFrame) -> DataFrame:
    """(topic, class): each distinct stored topic that is not blank, and the smallest topic that must share its split. One row a topic,
    however many are tied."""
    mapped = written(topic_components(segments)[0].select("topic", "component"), "mapped")
    return mapped.join(mapped.groupBy("component").agg(F.min("topic").alias("class")), "component").select("topic", "class")


def tied_topics(segments: DataFrame) -> DataFrame:
    """(topic_a, topic_b): each pair of different stored topics, topic_a < topic_b, that must share a split. It grows with the square of
    the topics that are tied, which is what is asked for; topic_classes says the same in one row a topic."""
    classes = topic_classes(segments)
    a, b = classes.select("class", F.col("topic").alias("topic_a")), classes.select("class", F.col("topic").alias("topic_b"))
    return a.join(b, "class").where("topic_a < topic_b").select("topic_a", "topic_b")


def row_components(segments: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, component) of every row: what must stay together. A row belongs to its topic's component, a row without a
    topic to that of its video, and a row with neither is a component of its own. Rows that repeat stay together."""
    mapped, videos = topic_components(segments)
    topics = mapped.select("topic", F.concat(F.lit("t:"), "component").alias("c1"))
    keys = mapped.select("topic_key", F.concat(F.lit("t:"), "component").alias("c2")).distinct()
    rows = segments.select(F.col(row_id).alias("row_id"), "topic", video_key(F.col("video_id")).alias("video"))
    lone = F.concat(F.lit("r:"), F.coalesce(F.col("row_id").cast("string"), F.lit("")))
    with_topic = rows.join(topics, "topic", "left")
    known = with_topic.where("c1 IS NOT NULL").select("row_id", F.col("c1").alias("component"))
    # Only rows without a topic need their video: the second join has no hot topic left in it.
    rest = with_topic.where("c1 IS NULL").select("row_id", "video").join(videos.join(keys, "topic_key").select("video", "c2"), "video", "left")
    rest = rest.select("row_id", F.coalesce("c2", F.concat(F.lit("v:"), "video"), lone).alias("component"))
    return known.union(rest)


def component_sizes(members: DataFrame) -> DataFrame:
    """(component, n) of the rows of row_components, written once."""
    return written(members.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")


def split_components(sizes: DataFrame, configs: list[tuple[str, tuple[float, float, float], int]], place_first: float = PLACE_FIRST) -> DataFrame:
    """(config, component, n, split) for each configuration (name, shares of train, validation and test, seed), all in one pass.

    Components are split by hash order: cumulative row counts over BUCKETS ranges of the hash, each range to the split that its
    middle falls into. With place_first above 0, the components that hold at least that share of all rows (so at most 1/place_first
    of them) go first, largest first, each to the split that lacks most, and the ranges fill what is left of each split: hash order
    alone misses the shares by as much as the largest components hold. With 0 all are in hash order.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("n")).first()[0] or 0
    heavy = sizes.where(F.col("n") >= max(1.0, place_first * total)).orderBy(F.desc("n"), "component").collect() if place_first > 0 else []
    placed, bounds = [], []
    for name, shares, seed in configs:
        lack = [s * total for s in shares]
        for component, n in heavy:
            best = max(range(3), key=lambda i: (lack[i], -i))
            lack[best] -= n
            placed.append((name, component, SPLITS[best]))
        left = [max(0.0, x) for x in lack]
        left = left if sum(left) else list(shares)
        bounds.append((name, seed, left[0] / sum(left), (left[0] + left[1]) / sum(left)))
    each = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(s).cast("bigint").alias("seed"), F.lit(x).alias("first"), F.lit(y).alias("second")) for c, s, x, y in bounds])
    light = sizes.where(F.col("n") < max(1.0, place_first * total)) if place_first > 0 else sizes
    light = light.select("component", "n", F.explode(each).alias("c")).select("component", "n", "c.*").withColumn("at", F.pmod(F.xxhash64("component", "seed"), F.lit(BUCKETS)))
    ranges = light.groupBy("config", "first", "second", "at").agg(F.sum("n").alias("rows"))
    upto = Window.partitionBy("config").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most BUCKETS rows
    middle = (F.sum("rows").over(upto) - F.col("rows") / 2) / F.sum("rows").over(Window.partitionBy("config"))
    split = F.when(middle < F.col("first"), SPLITS[0]).when(middle < F.col("second"), SPLITS[1]).otherwise(SPLITS[2])
    ranges = ranges.select("config", "at", split.alias("split"))  # at most BUCKETS rows a configuration
    chosen = light.join(F.broadcast(ranges), ["config", "at"]).select("config", "component", "n", "split")
    if not placed:
        return chosen
    first = spark.createDataFrame(placed, "config string, component string, split string")
    return chosen.union(sizes.join(F.broadcast(first), "component").select("config", "component", "n", "split"))


def assign_splits(members: DataFrame, shares: tuple[float, float, float], seed: int, place_first: float = PLACE_FIRST) -> DataFrame:
    """(row_id, component, split) of the rows of row_components: train, validation or test in about the proportions of
    shares, so that no component has rows in two splits (see split_components). Empty input gives no rows."""
    chosen = split_components(component_sizes(members), [("", shares, seed)], place_first).select("component", "split")
    return members.join(chosen, "component").select("row_id", "component", "split")
