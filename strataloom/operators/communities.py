"""Communities by modularity: local moves, then communities as the nodes of the next level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.graph import both_ways
from strataloom.sources.shared import cut, drop


def modularity(links: DataFrame, labels: DataFrame, total: float, resolution: float = 1.0) -> float:
    """Share of weight inside communities less what strengths alone would put there. ``links`` (a, b, weight) run both ways."""
    mine, other = labels.toDF("a", "_x"), labels.toDF("b", "_y")
    rows = links.join(mine, "a").join(other, "b").groupBy(F.col("_x").alias("label")).agg(F.sum("weight").alias("strength"), F.sum(F.when(F.col("_x") == F.col("_y"), F.col("weight")).otherwise(0.0)).alias("inside"))
    return rows.agg(F.coalesce(F.sum(F.col("inside") / total - resolution * (F.col("strength") / total) ** 2), F.lit(0.0))).first()[0]


def connected(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): labels split into their connected parts, each named after its smallest node.

    Every round a node takes the smallest name among its own and those of its neighbours inside the community, and then
    that name's own name, so that names travel twice as far from round to round.
    """
    inside = cut(links.join(labels.toDF("a", "_x"), "a").join(labels.toDF("b", "_y"), "b").where("_x = _y and a <> b").select("a", "b"))
    names = cut(labels.select("node", F.col("node").alias("label")))
    while True:
        seen = inside.join(names.toDF("b", "label"), "b").select(F.col("a").alias("node"), "label")
        least = names.unionByName(seen).groupBy("node").agg(F.min("label").alias("label"))
        least = least.join(names.toDF("label", "further"), "label").select("node", F.least("label", "further").alias("label"))
        new = cut(least)
        done = new.join(names.toDF("node", "was"), "node").where("label <> was").isEmpty()
        drop(names)
        names = new
        if done:
            drop(inside)
            return names


def local_moves(links: DataFrame, total: float, resolution: float, rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """Labels after rounds in which half of the nodes (by hash) may join the neighbouring community that gains most.

    Halves alternate, as neighbours that move at once would pass each other by; a round that lowers the modularity is
    taken back, and two rounds without a gain end the search.
    """
    strength = cut(links.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")))
    apart = links.where("a <> b")
    labels = cut(strength.select("node", F.col("node").alias("label")))
    best, idle = modularity(links, labels, total, resolution), 0
    for turn in range(rounds):
        placed = labels.join(strength, "node")
        held = placed.groupBy("label").agg(F.sum("k").alias("held"))
        votes = apart.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("w"))
        votes = votes.unionByName(labels.select("node", "label", F.lit(0.0).alias("w"))).groupBy("node", "label").agg(F.sum("w").alias("w"))
        own = placed.select("node", F.col("label").alias("own"), "k")
        rows = votes.join(held, "label").join(own, "node")
        others = F.col("held") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * others / total, 9)
        rows = rows.withColumn("gain", gain).groupBy("node").agg(
            F.max(F.struct("gain", -F.col("label"))).alias("top"), F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("stay"), F.first("own").alias("own")
        )
        moves = (F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2) & (F.col("top.gain") > F.col("stay"))
        new = cut(rows.select("node", F.when(moves, -F.col("top.col2")).otherwise(F.col("own")).alias("label")))
        value = modularity(links, new, total, resolution)
        if value > best:
            idle = 0 if value > best + tolerance else idle + 1
            labels, new, best = new, labels, value
        else:
            idle += 1
        drop(new)
        if idle == 2:
            break
    drop(strength)
    return labels, best


def modularity_communities(edges: DataFrame, resolution: float = 1.0, levels: int = 10, rounds: int = 10, tolerance: float = 1e-4) -> DataFrame:
    """(level, node, label): communities of edges (a, b, weight) at each level, from 0; higher levels merge lower ones.

    Level 0 moves nodes; every further level moves the communities before it as single nodes, whose links and inner
    weight are the sums of theirs. Communities are connected at every level, and each has the name of its smallest node.
    A level that does not raise the modularity by ``tolerance`` ends the search and is left out, but for level 0.
    """
    links = cut(both_ways(edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))))
    total = links.agg(F.sum("weight")).first()[0]
    nodes = cut(links.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    found, before = [], None
    for level in range(levels if total else 0):
        labels, value = local_moves(links, total, resolution, rounds, tolerance)
        parts = connected(links, labels)
        drop(labels)
        if before is not None and value <= before + tolerance:
            drop(parts)
            break
        before = value
        nodes = cut(nodes.join(parts.toDF("label", "further"), "label").select("node", F.col("further").alias("label")))
        found.append(nodes.select(F.lit(level).alias("level"), "node", "label"))
        merged = links.join(parts.toDF("a", "x"), "a").join(parts.toDF("b", "y"), "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("weight").alias("weight"))
        merged, links = cut(merged), links
        drop(links, parts)
        links = merged
    out = found[0] if found else nodes.select(F.lit(0).alias("level"), "node", "label")
    for more in found[1:]:
        out = out.unionByName(more)
    return out
