"""Connected components by breadth-first search from many seeds at once, with colliding labels merged in a small graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.session import bucketed, cut

#: Neighbours in one row of the adjacency lists; a node with more has several rows, in different partitions.
LIST = 4096
#: Edges in one partition of the lists, as long as shuffles have as many partitions.
EDGES = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is one node of the component, the same for all its nodes.

    edges may repeat, run either way or loop (a loop makes its node a component of at least itself). Rows with a NULL end
    are ignored. An empty input gives no rows.

    One level: adjacency lists are written once in hash buckets by (node, part). Every node that hashes below all its neighbours is a
    seed, so each component has one. All seeds expand at once: a round sends the frontier to the lists' partitions, shuffles
    nothing that does not lie beside it, and gives each node that is reached for the first time the smallest label that
    reaches it. Edges between nodes with different labels are where searches collided: their distinct label pairs are the edges of a smaller graph (at most
    half as many nodes, since no two seeds are neighbours), and the next level works on that, until no pair is left. Labels
    compose by joins. Only the numbers of frontier nodes and edges come to the driver.
    """
    fine = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    graph, n = _lists(fine.where("a <> b").select("a", "b").union(fine.where("a <> b").select("b", "a")))
    labels, levels = None, 0
    while graph is not None:
        level = _expand(graph, n)
        labels = level.select("node", F.col("label").alias("component")) if labels is None else cut(
            labels.join(level.select(F.col("node").alias("component"), "label"), "component", "left").select("node", F.coalesce("label", "component").alias("component"))
        )
        la, lb = level.select(F.col("node").alias("a"), F.col("label").alias("la")), level.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        ends = graph.select("a", F.explode("neighbours").alias("b"))
        graph, n = _lists(ends.join(la, "a").join(lb, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
        levels += 1
        if levels >= max_rounds:
            raise RuntimeError("the search did not end")
    loops = fine.where("a = b").select(F.col("a").alias("node")).distinct()
    if labels is None:
        return loops.select("node", F.col("node").alias("component"))
    return labels.union(loops.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))


def _lists(edges: DataFrame) -> tuple[DataFrame | None, int]:
    """Adjacency lists (a, part, parts, neighbours) of the distinct edges (a, b), in hash buckets by (a, part), and the number
    of buckets, which follows that of edges; None without edges. b's hash chooses among a node's parts, so that each has
    about LIST neighbours and no task has all edges of a hub."""
    distinct = cut(edges.distinct())
    n_edges = distinct.count()
    if not n_edges:
        return None, 0
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(most, -(-n_edges // EDGES)))
    hubs = distinct.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST).select("a", F.ceil(F.col("n") / LIST).cast("int").alias("parts"))
    placed = distinct.join(hubs, "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    return bucketed(placed.groupBy("a", "part", "parts").agg(F.collect_list("b").alias("neighbours")), "lists", n, "a", "part"), n


def _expand(graph: DataFrame, n: int) -> DataFrame:
    """(node, label) of each node of a symmetric graph: the seed whose search reaches it first, the smallest on a tie."""
    order = lambda c: F.struct(F.xxhash64(c), c)
    least = F.array_min(F.transform("neighbours", order))
    nodes = cut(graph.select("a", "parts", least.alias("least")).repartition(n, "a").groupBy("a", "parts").agg(F.min("least").alias("least")))
    is_seed = order(F.col("a")) < F.col("least")
    reached = frontier = nodes.where(is_seed).select(F.col("a").alias("node"), F.col("a").alias("label"), "parts")
    hubs = cut(nodes.where("parts > 1").select(F.col("a").alias("node"), "parts"))
    before, left = frontier, nodes.where(~is_seed).count()  # every node is reached, since every component has a seed
    while left:
        sent = frontier.select("label", F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        met = graph.select("a", "part", "neighbours").join(sent.repartition(n, "a", "part"), ["a", "part"]).select("label", F.explode("neighbours").alias("node"))
        nearest = met.groupBy("node").agg(F.min(order(F.col("label"))).alias("x")).select("node", F.col("x.label").alias("label"))
        # A neighbour of the frontier that was reached already was so in this round or the one before: distances to the seeds differ by one.
        recent = frontier.select("node").union(before.select("node"))
        new = nearest.join(recent, "node", "left_anti").join(hubs, "node", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        before, frontier = frontier, cut(new)
        left -= frontier.count()
        reached = reached.union(frontier)
    return reached.select("node", "label")
