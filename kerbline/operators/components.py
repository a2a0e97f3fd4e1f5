"""Connected components of an edge table by alternating star contraction.

Each round points every node at the smallest node it can see, first over its
larger neighbours and then over its smaller ones (Kiveris et al. 2014). Rounds
grow with the logarithm of the graph. Smallest neighbours are found by a grouped
minimum, which combines before the shuffle; the minimum then goes back to the
edges of its node in as many copies as the node's edges have parts, so a node
with very many edges never gathers them in one task. A graph that has fewer
edges than one such part needs no copies, and as few tasks as its edges call for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed

#: Edges of a node that go to one part; a node has at most PARTS parts.
PART_EDGES, PARTS = 100_000, 1024
#: Edges of a task in a graph of fewer than PART_EDGES.
TASK_EDGES = 5_000


def _with_smallest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(u, v, m)``: each edge with the smallest node that ``u`` sees, itself included; and ``(u, m)`` alone."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    parts = F.least(F.lit(PARTS), F.floor(F.col("n") / PART_EDGES) + 1).cast("int")
    crowded = least.filter(F.col("n") >= PART_EDGES).select("u", parts.alias("parts"))
    salted = edges.join(crowded, "u", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"), F.lit(0))
    )
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(copies.select("u", "salt", "m"), ["u", "salt"]).select("u", "v", "m"), least.select("u", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen, _ = _with_smallest(both)
    return (
        seen.filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen, least = _with_smallest(down)
    return (
        seen.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_round(edges: DataFrame, tasks: int) -> DataFrame:
    """Both stars of a graph where no node can have PART_EDGES edges; every shuffle is written by ``tasks`` tasks."""
    least = F.least(F.min("v").over(W.partitionBy("u")), F.col("u"))
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.coalesce(tasks).withColumn("m", least).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    seen = large.coalesce(tasks).withColumn("m", least)
    pairs = seen.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return pairs.select("e.u", "e.v").filter(F.col("u") != F.col("v")).coalesce(tasks).distinct().coalesce(tasks)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of edges ``(u, v)``; the component is its smallest node.

    Nodes without an edge do not appear. Each round is cut by a checkpoint in
    reliable storage; the driver reads one count a round.
    """
    now = checkpointed(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = before = _state(now)
    while True:  # every round that changes the edges brings some node nearer its root
        if state[0] < PART_EDGES:  # edges never grow in number
            now = checkpointed(_small_round(now, state[0] // TASK_EDGES + 1))
        else:
            now = checkpointed(_small_star(_large_star(now)))
        state = _state(now)
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def with_component(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """Every node with its component; a node without edges is its own."""
    found = components(edges).withColumnRenamed("node", node)
    return nodes.join(found, node, "left").withColumn(
        "component", F.coalesce("component", F.col(node))
    )
