"""Chat formatting with cumulative-snapshot collapse.

A logged conversation is often a prefix of a longer one. All turns are sorted once, by ranges of (conversation, turn, role,
text), so that a conversation of any length takes as many tasks as its rows fill; a turn's position follows from its place
in its range. Every turn gets the rolling hash of the turns up to it. Of all conversations that pass through the same
prefix the longest one stands for it; a conversation that ends there is compared with that one turn by turn, and goes if
nothing differs. What stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import Scratch, join_groups, tidy

PART_TURNS = 512
"""Turns that are rendered in one row unless asked otherwise; so no row grows with the length of a conversation."""


def place_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, scratch: Scratch) -> DataFrame:
    """Distinct turns with _key (never null), _conv, _role, _text, the range _pid that they fell in, and _pos from 1."""
    rows = turns.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"))
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("_conv").cast("string")), F.lit(""))).distinct()
    order = ["_key", "_turn", "_role", "_text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.write(rows.withColumn("_pid", F.shiftright("_at", 33)))
    ranges = rows.groupBy("_key", "_pid").agg(F.count(F.lit(1)).alias("_m"), F.min("_at").alias("_from"))
    above = Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = scratch.write(ranges.withColumn("_skip", F.coalesce(F.sum("_m").over(above), F.lit(0)) - F.col("_from") + 1))
    placed = join_groups(rows, ranges.select("_key", "_pid", "_m", "_skip"), ["_key", "_pid"], "_m", max(1, rows.count()))
    return scratch.write(placed.select("_key", "_conv", "_pid", "_role", "_text", (F.col("_at") + F.col("_skip")).alias("_pos")))


def prefix_hashes(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """_key, _conv, _pos, and _h1, _h2 over the turns up to _pos: sums inside a range, then over the ranges before it."""
    said = [F.col("_role").isNull(), F.col("_role"), F.col("_text").isNull(), F.col("_text")]
    first, second = F.xxhash64("_pos", *said), F.xxhash64(*said, "_pos")  # 40 bits of each, so that sums stay far from overflow
    terms = placed.select("_key", "_conv", "_pid", "_pos", F.shiftrightunsigned(first, 24).alias("_t1"), F.shiftrightunsigned(second, 24).alias("_t2"))
    upto = Window.partitionBy("_key", "_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    terms = scratch.write(terms.select("_key", "_conv", "_pid", "_pos", F.sum("_t1").over(upto).alias("_p1"), F.sum("_t2").over(upto).alias("_p2")))
    totals = terms.groupBy("_key", "_pid").agg(F.count(F.lit(1)).alias("_m"), F.max("_p1").alias("_a1"), F.max("_p2").alias("_a2"))  # terms are not negative
    above = Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_key", "_pid", "_m", *[F.coalesce(F.sum(f"_a{k}").over(above), F.lit(0)).alias(f"_o{k}") for k in (1, 2)])
    joined = join_groups(terms, scratch.write(starts), ["_key", "_pid"], "_m", max(1, terms.count()))
    return scratch.write(joined.select("_key", "_conv", "_pos", (F.col("_p1") + F.col("_o1")).alias("_h1"), (F.col("_p2") + F.col("_o2")).alias("_h2")))


def maximal(placed: DataFrame, hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """(_key, _n): the conversations that stay, with their number of turns."""
    total = max(1, hashed.count())
    full = hashed.groupBy("_key").agg(F.max("_pos").alias("_n"), F.first("_conv").alias("_conv"), F.max_by(F.struct("_h1", "_h2"), "_pos").alias("_h"))
    full = scratch.write(full.select("_key", "_conv", "_n", "_h._h1", "_h._h2"))
    long = join_groups(hashed, full.select("_key", "_n"), ["_key"], "_n", total)
    # of those that pass through a prefix the longest, then the one with the smallest id; combined before the shuffle
    rank = F.struct((-F.col("_n")).alias("m"), F.col("_conv").isNull().alias("none"), F.col("_conv").alias("id"), F.col("_key").alias("key"))
    best = long.groupBy("_pos", "_h1", "_h2").agg(F.min(rank).alias("_best"), F.count(F.lit(1)).alias("_size"))
    best = scratch.write(best.select(F.col("_pos").alias("_n"), "_h1", "_h2", F.col("_best.key").alias("_into"), "_size"))
    into = scratch.write(join_groups(full, best, ["_n", "_h1", "_h2"], "_size", total).select("_key", "_n", "_into"))
    # a turn of the one that stands for others, and theirs at the same position, must be alike
    gone = into.where(F.col("_key") != F.col("_into"))
    compared = gone.unionByName(into.where(F.col("_key") == F.col("_into")).join(gone.select("_into"), "_into", "left_semi").select(*into.columns))
    turns = join_groups(placed.select("_key", "_pos", "_role", "_text"), scratch.write(compared), ["_key"], "_n", total).where(F.col("_into").isNotNull())
    said = F.struct(F.col("_role").isNull().alias("a"), F.col("_role").alias("b"), F.col("_text").isNull().alias("c"), F.col("_text").alias("d"))
    own = F.max(F.when(F.col("_key") == F.col("_into"), said))
    unlike = turns.groupBy("_into", "_pos").agg(F.min(said).alias("_least"), F.max(said).alias("_most"), own.alias("_own"))
    unlike = scratch.write(unlike.where(~F.col("_least").eqNullSafe(F.col("_most"))).select("_into", "_pos", "_own"))
    other = turns.withColumn("_said", said).join(unlike, ["_into", "_pos"]).where(~F.col("_said").eqNullSafe(F.col("_own"))).select("_key").distinct()
    stays = into.where(F.col("_key") == F.col("_into")).select("_key", "_n").unionByName(into.join(other, "_key", "left_semi").select("_key", "_n"))
    return scratch.write(stays)


@tidy()
def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int | None = PART_TURNS) -> DataFrame:
    """One row per part of a maximal conversation: its id, part (from 0), n_turns and the rendered text.

    Turns are ordered by turn number, then role and text, null first. A part has ``part_turns`` turns, the last one fewer;
    with None each conversation is one row, however long. A null role is rendered as ``unknown`` and a null text as empty.
    Rows without a conversation id are one conversation of their own. Rows logged twice count once. Of equal
    conversations the one with the smallest id stays, one without an id being the last. Other columns are not read. An
    empty table gives no rows.
    """
    scratch = Scratch(turns.sparkSession)
    placed = place_turns(turns, conv_col, turn_col, role_col, text_col, scratch)
    kept = maximal(placed, prefix_hashes(placed, scratch), scratch)
    shown = join_groups(placed, kept, ["_key"], "_n", max(1, placed.count())).where(F.col("_n").isNotNull())
    part = F.floor((F.col("_pos") - 1) / part_turns) if part_turns else F.lit(0)
    line = F.concat(F.lit("<|"), F.coalesce("_role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("_text", F.lit("")), F.lit("<|end|>\n"))
    lines = F.array_sort(F.collect_list(F.struct("_pos", line.alias("line")))).getField("line")
    texts = shown.groupBy("_key", part.cast("int").alias("part")).agg(F.first("_conv").alias("_conv"), F.count(F.lit(1)).alias("n_turns"), F.array_join(lines, "").alias("text"))
    out = scratch.write(texts.select(F.col("_conv").alias(conv_col), "part", "n_turns", "text"))
    scratch.drop(keep=1)
    return out
