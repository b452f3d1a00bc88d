"""A Merkle manifest of a dataset: every row's hash folds up, three at a time, to one root, with a proof per row.

Rows of a group follow each other by id. Each level is a pass of lag and lead columns at a fixed offset: at level k
a node stands on the row of its first leaf, so its neighbours stand 3^k rows before and after it. The slot in the run
of three and the run's length mask what lies outside; the row of a run's first child hashes the parent. Runs never
cross blocks of 3^LEVELS rows, so windows are over blocks, whatever share of all rows a group holds. The blocks'
hashes are the nodes of the next round, and the groups' roots make a tree of their own in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import Scratch, tidy

RUN = 3
LEVELS = 6
"""Levels that one round folds; a block has RUN ** LEVELS rows."""
BLOCK = RUN**LEVELS


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Rows with ``idx``, the place in ``grp`` by ``order`` from 0, and ``n``, the group's size.

    One range sort places all rows, so a large group lies in many tasks; what the tasks hold of each group is
    counted in a row per task and group.
    """
    placed = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.write(placed.withColumn("_task", F.shiftright("_at", 33)))
    held = placed.groupBy("grp", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held"))
    by_task = Window.partitionBy("grp").orderBy("_task")
    before = F.coalesce(F.sum("_held").over(by_task.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.write(held.select("grp", "_task", (before - F.col("_first")).alias("_shift"), F.sum("_held").over(Window.partitionBy("grp")).alias("n")))
    return placed.join(starts, ["grp", "_task"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def folded(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, idx, n, hash) folded LEVELS levels up inside their blocks.

    Adds ``block``, ``path`` (the texts of the siblings left and right of the node and of its ancestors, level by
    level) and ``top`` (on a block's first row: the block's hash). A level at which the group has one node is skipped.
    """
    idx, n = F.col("idx"), F.col("n")
    rows = nodes.withColumn("block", F.expr(f"idx div {BLOCK}")).withColumn("top", F.col("hash"))
    inside = Window.partitionBy("grp", "block").orderBy("idx")
    for level in range(LEVELS):
        step = RUN**level
        slot, count = F.expr(f"idx div {step} % {RUN}"), F.expr(f"(n + {step - 1}) div {step}")
        run = F.least(F.lit(RUN), count - F.expr(f"idx div {RUN * step} * {RUN}"))
        rows = rows.withColumns({f"_before{k}": F.lag("top", k * step).over(inside) for k in (1, 2)} | {f"_after{k}": F.lead("top", k * step).over(inside) for k in (1, 2)})
        left = F.concat(*[F.when(slot >= k, F.col(f"_before{k}")).otherwise("") for k in (2, 1)])
        right = F.concat(*[F.when(slot + k < run, F.col(f"_after{k}")).otherwise("") for k in (1, 2)])
        rows = rows.withColumns({"_right": right, f"_sides{level}": F.when((count > 1) & (idx % step == 0), F.struct(left.alias("left"), right.alias("right")))})
        parent = F.when(idx % (RUN * step) == 0, hashed(F.col("top"), F.col("_right")))
        rows = rows.withColumn("top", F.when(count > 1, parent).otherwise(F.col("top"))).drop("_right", "_before1", "_before2", "_after1", "_after2")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [F.last(f"_sides{level}", ignorenulls=True).over(so_far) for level in range(LEVELS)]  # an ancestor stands on the last row that has one
    rows = rows.withColumn("path", F.array_compact(F.array(*sides)))
    return rows.drop(*[f"_sides{level}" for level in range(LEVELS)])


def climbed(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The nodes that each round starts with; the last table has one row a group, with the group's root."""
    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        top = folded(rounds[-1]).where(F.col("idx") % BLOCK == 0)
        rounds.append(scratch.write(top.select("grp", F.col("block").alias("idx"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("hash"))))
        most = -(-most // BLOCK)
    return rounds


def descended(rounds: list[DataFrame], above: DataFrame, scratch: Scratch) -> DataFrame:
    """The first round's rows with the whole ``path`` up to the root; ``above``: (grp, path, and more) of each group."""
    more = [c for c in above.columns if c not in ("grp", "path")]
    upper = above.select("grp", F.lit(0).cast("long").alias("block"), F.col("path").alias("_upper"), *more)
    for place, nodes in list(enumerate(rounds[:-1]))[::-1]:
        rows = folded(nodes).join(upper, ["grp", "block"]).withColumn("path", F.concat("path", "_upper")).drop("_upper", "top")
        if place:
            upper = scratch.write(rows.select("grp", F.col("idx").alias("block"), F.col("path").alias("_upper"), *more))
    return rows if len(rounds) > 1 else rounds[0].join(upper.drop("block"), "grp").withColumnRenamed("_upper", "path")


@tidy()
def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row per row of ``docs``: id_col, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of ``columns``. Rows with the same group and id follow each other by leaf, and rows without an
    id come first; a null group is a group of its own, before all others. As a drill, half of the rows (by id; not
    those without one) are checked with the line ends of their text deleted: those whose text had any must not
    verify. Other columns are not read. Null and empty texts are values of their own. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.col(id_col).cast("string")
    cut = F.replace(F.col(text_col).cast("string"), F.lit("\n"), F.lit(""))
    changed = (F.crc32(key) % 2 == 0) & F.contains(F.col(text_col).cast("string"), F.lit("\n"))
    leaves = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp"),  # null before all others
        hashed(*[field(F.col(c)) for c in columns]).alias("leaf"),
        F.when(changed, hashed(*[field(cut if c == text_col else F.col(c)) for c in columns])).alias("tampered"),
    )
    leaves = scratch.write(leaves)  # as a range sort reads its input twice
    rounds = climbed(scratch.write(ranked(leaves, ["id", "leaf"], scratch).withColumn("hash", F.col("leaf"))), scratch)
    subroots = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("hash").alias("subroot"))
    groups = climbed(scratch.write(ranked(subroots, ["member"], scratch).withColumn("hash", F.col("subroot"))), scratch)
    root = groups[-1].select("hash").first()  # one row, none in an empty table
    empty = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    above = scratch.write(descended(groups, docs.sparkSession.range(1).select(F.lit("").alias("grp"), empty.alias("path")), scratch).select(F.col("member").alias("grp"), "path", "subroot"))
    found = descended(rounds, above, scratch)
    fold = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda h, s: hashed(s["left"], h, s["right"]))
    out = found.select(
        F.col("id").alias(id_col), "leaf", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"),
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"), fold.alias("folded_root"),
    )
    out = scratch.write(out.withColumn("verified", F.col("folded_root") == F.col("root")))
    scratch.drop(keep=1)
    return out
