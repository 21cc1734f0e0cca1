"""Communities by modularity at several resolutions, as alternating moves and merges of the whole graph.

Every pass is a Spark job over edges: each node looks up the weight to the communities around it and the
gain of modularity of joining one; only a half of the nodes, by hash, moves at a time, so neighbours that
would swap forever don't; then communities become nodes and the passes go on over the smaller graph. At
last the single nodes move once more between the communities found, and communities that fall apart are split.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import both_ways

RESOLUTIONS = (0.3, 1.0, 3.0)
#: Parts the nodes move in, by hash.
PARTS = 2
#: While communities are merged nodes may move so many times as much as at last.
COARSE = 5


def _one_pass(links: DataFrame, state: DataFrame, two_m: float, resolution: float, turn: int) -> DataFrame:
    """state: (node, community, degree), links: (node, other, weight, degree). The nodes whose turn it is join the
    community with the best gain, the own one first, then the least."""
    total = state.groupBy("community").agg(F.sum("degree").alias("total"))
    near = links.join(state.select(F.col("node").alias("other"), "community"), "other").select("node", "community", "degree", "weight", F.lit(False).alias("own"))
    # the own community is an option, too, though no link may lead into it
    stay = state.select("node", "community", "degree", F.lit(0.0).alias("weight"), F.lit(True).alias("own"))
    options = near.unionByName(stay).groupBy("node", "community").agg(F.sum("weight").alias("w"), F.max("own").alias("own"), F.max("degree").alias("degree"))
    rest = F.col("total") - F.when(F.col("own"), F.col("degree")).otherwise(0.0)
    gain = F.round(F.col("w") - F.lit(resolution) * F.col("degree") * rest / F.lit(two_m), 9)
    order = F.struct(-gain, ~F.col("own"), F.col("community"))
    best = options.join(total, "community").groupBy("node").agg(F.min_by("community", order).alias("best"), F.max(F.when(F.col("own"), F.col("community"))).alias("own"), F.max("degree").alias("degree"))
    now = F.pmod(F.xxhash64("node", F.lit(turn // PARTS)), F.lit(PARTS)) == turn % PARTS
    return best.select("node", F.when(now, F.col("best")).otherwise(F.col("own")).alias("community"), "degree", (now & (F.col("best") != F.col("own"))).alias("moved"))


def _moves(links: DataFrame, state: DataFrame, two_m: float, resolution: float, passes: int, still: float, seed: int) -> tuple[DataFrame, bool]:
    """Passes until, of all parts in turn, at most the share `still` of the nodes moves; `passes` is a safety stop, which warns. Whether any node moved."""
    nodes, last, moved = state.count(), [], False
    for turn in range(passes):
        state = materialize(_one_pass(links, state, two_m, resolution, seed + turn), "state")
        last.append(state.filter("moved").count())
        moved = moved or last[-1] > 0
        if turn >= PARTS - 1 and sum(last[-PARTS:]) <= still * nodes:
            break
    else:
        warnings.warn(f"communities: {sum(last[-PARTS:])} of {nodes} nodes still move after {passes} passes", stacklevel=3)
    return state, moved


def _connected(links: DataFrame, member: DataFrame, rounds: int = 100) -> DataFrame:
    """member (node, community) with communities split where they fall apart: each part is named by its least node.

    Nodes take the least name around them inside their community, and the name of that name (pointer jumping), until none changes.
    """
    name = member.select(F.col("node").alias("other"), F.col("community").alias("theirs"))
    inside = materialize(links.select("node", "other").join(member, "node").join(name, "other").filter("community = theirs").select("node", "other"), "inside")
    part = materialize(member.select("node", F.col("node").alias("part")), "part")
    for _ in range(rounds):
        near = inside.join(part.select(F.col("node").alias("other"), "part"), "other").groupBy("node").agg(F.min("part").alias("least"))
        least = part.join(near, "node", "left").select("node", F.col("part").alias("old"), F.least("part", F.coalesce("least", "part")).alias("part"))
        further = part.select(F.col("node").alias("part"), F.col("part").alias("next"))
        part = materialize(least.join(further, "part").select("node", "old", F.least("part", "next").alias("part")), "part")
        if part.filter("part <> old").isEmpty():
            break
    else:
        warnings.warn(f"communities: parts aren't told apart after {rounds} rounds", stacklevel=3)
    return part.select("node", F.col("part").alias("community"))


def communities(edge: DataFrame, resolution: float = 1.0, *, still: float = 0.01, levels: int = 20, passes: int = 60) -> DataFrame:
    """(node, community_id) of every node with an edge; ids count from 0 by size, then by least member.

    Nodes move until at most the share `still` of them does, COARSE times as many at the levels where communities are merged, and levels follow until none joins another; `levels` and
    `passes` are safety stops. Communities are connected. Deterministic; an empty graph gives no rows. Edges are (src, dst, weight), once each.
    """
    links = materialize(both_ways(edge), "links")
    two_m = links.agg(F.sum("weight")).first()[0]
    if not two_m:
        return edge.sparkSession.createDataFrame([], "node string, community_id int")
    member = links.select("node").distinct().withColumn("community", F.col("node"))
    loops = None
    for level in range(levels):
        degree = links.groupBy("node").agg(F.sum("weight").alias("degree"))
        if loops is not None:
            degree = degree.unionByName(loops.select("node", F.col("weight").alias("degree"))).groupBy("node").agg(F.sum("degree").alias("degree"))
        start = materialize(degree.select("node", F.col("node").alias("community"), "degree"), "state")
        weighted = materialize(links.join(degree, "node"), "links")
        if not level:
            single, first = start, weighted
        state, moved = _moves(weighted, start, two_m, resolution, passes, COARSE * still, level * passes)
        if not moved:
            break
        step = state.select(F.col("node").alias("community"), F.col("community").alias("next"))
        member = materialize(member.join(step, "community").select("node", F.col("next").alias("community")), "member")
        name = state.select("node", "community")
        merged = links.join(name, "node").withColumnRenamed("community", "a").join(name.select(F.col("node").alias("other"), F.col("community").alias("b")), "other").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
        if loops is not None:
            held = loops.join(name, "node").select(F.col("community").alias("a"), F.col("community").alias("b"), "weight")
            merged = merged.unionByName(held).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
        merged = materialize(merged, "merged")
        loops = merged.filter("a = b").select(F.col("a").alias("node"), "weight")
        links = merged.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other"), "weight")
    placed = single.select("node", "degree").join(member, "node").select("node", "community", "degree")
    member = _moves(first, materialize(placed, "state"), two_m, resolution, passes, still, levels * passes)[0].select("node", "community")
    member = _connected(first, member)
    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    return member.join(numbered(sizes), "community").select("node", "community_id")


def numbered(sizes: DataFrame) -> DataFrame:
    """(community, community_id): ids by size, then least member, without a global window: range-sorted parts count on from each other."""
    from pyspark.sql import Window

    spark = sizes.sparkSession
    ordered = materialize(sizes.repartitionByRange(F.desc("size"), F.asc("least")).sortWithinPartitions(F.desc("size"), "least").withColumn("part", F.spark_partition_id()), "sizes")
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nr = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("size"), "least"))
    return ordered.withColumn("nr", nr).join(F.broadcast(counts.select("part", "before")), "part").select("community", (F.col("before") + F.col("nr") - 1).cast("int").alias("community_id"))


def modularity(edge: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity, the weight inside communities and the number of communities."""
    link = both_ways(edge)
    a = assignment.select("node", F.col("community_id").alias("ca"))
    inside = link.join(a, "node").join(a.select(F.col("node").alias("other"), F.col("ca").alias("cb")), "other").filter("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    total = link.join(a, "node").groupBy("ca").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("squares"), F.sum("d").alias("two_m"), F.count(F.lit(1)).alias("communities"))
    share = F.col("inside") / F.col("two_m") - F.lit(resolution) * F.col("squares") / (F.col("two_m") * F.col("two_m"))
    return inside.crossJoin(total).select(share.alias("modularity"), "inside", "communities")
