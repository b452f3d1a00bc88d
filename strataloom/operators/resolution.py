"""Entity resolution: names propose, vectors dispose, and the best-connected entity stands for the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.functions import vector as V
from strataloom.operators.graph import related_names
from strataloom.sources.shared import cut, drop


def candidate_folds(entities: DataFrame, least: float) -> DataFrame:
    """(x, y, cos, order): entities of a type with related names and close vectors, y better connected than x.

    ``order`` is y's place in the sequence of a type, more mentions first and then by name, as a value that grows.
    """
    names = entities.select("type", "name").distinct()
    pairs = related_names(names)
    pairs = pairs.unionByName(pairs.select("type", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    side = lambda node, name: entities.select("type", F.col("name").alias(name), F.col("entity_id").alias(node), F.col("vec").alias(f"_{node}"), F.struct((-F.col("degree")).alias("less"), F.col("name").alias("name")).alias(f"o{node}"))
    both = pairs.join(side("x", "a"), ["type", "a"]).join(side("y", "b"), ["type", "b"]).where(F.col("oy") < F.col("ox"))
    both = both.withColumn("cos", F.round(V.cosine(F.col("_x"), F.col("_y")), 6)).where(F.col("cos") >= least)
    return both.select("type", "x", "y", "cos", F.col("oy").alias("order"), (X.normal_name(F.col("a")) == X.normal_name(F.col("b"))).alias("equal"))


def resolve_entities(entities: DataFrame, verdicts: DataFrame | None = None, least: float = 0.90, sure: float = 0.92, judged_types: tuple[str, ...] = ()) -> DataFrame:
    """(entity_id, canonical) of entities (entity_id, type, name, degree, vec), one row a type and name.

    The rule is sequential: from the most mentioned entity of a type on, each one folds into the canonical entity before
    it with a related name and the closest vector (of equals the later one), at a cosine of ``least`` or more; else it is
    canonical itself. Below ``sure``, types that are judged need a verdict (x, y, same) for the pair, unless the names are
    equal but for space and case; without one, or with false, the entity stays apart. Entities without a vector or a
    mention take no part and stand for themselves.

    It is taken in rounds, each for all entities at once: an entity is settled when none of its unsettled predecessors
    could still be closer than its closest canonical one. A round shuffles the open candidate pairs, which get fewer.
    """
    rows = entities.where("degree > 0 and vec is not null")
    folds = candidate_folds(rows, least)
    asked = (F.col("cos") < sure) & F.lower("type").isin(*[t.lower() for t in judged_types]) & ~F.col("equal")
    if verdicts is not None:
        folds = folds.join(verdicts.select("x", "y", F.col("same").alias("_same")), ["x", "y"], "left")
    else:
        folds = folds.withColumn("_same", F.lit(None).cast("boolean"))
    open_ = cut(folds.select("x", "y", F.struct("cos", "order").alias("close"), (~asked | F.coalesce("_same", F.lit(False))).alias("may")))
    waiting = open_.select(F.col("x").alias("entity_id")).distinct()
    settled = cut(entities.select("entity_id").join(waiting, "entity_id", "left_anti").withColumn("canonical", F.col("entity_id")))
    done = [settled]
    while not open_.isEmpty():
        state = settled.toDF("y", "of")
        for more in done[1:]:
            state = state.unionByName(more.toDF("y", "of"))
        seen = open_.join(state, "y", "left")
        head = seen.groupBy("x").agg(
            F.max(F.when(F.col("of") == F.col("y"), F.struct("close", "y", "may"))).alias("best"), F.max(F.when(F.col("of").isNull(), F.col("close"))).alias("wait")
        )
        ready = head.where(F.col("wait").isNull() | (F.col("best.close") > F.col("wait")))
        new = cut(ready.select(F.col("x").alias("entity_id"), F.when(F.col("best.may"), F.col("best.y")).otherwise(F.col("x")).alias("canonical")))
        done.append(new)
        rest = cut(open_.join(new.select(F.col("entity_id").alias("x")), "x", "left_anti"))
        drop(open_)
        open_ = rest
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
