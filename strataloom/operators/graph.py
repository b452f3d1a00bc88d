"""Operators on the entity graph: joins, co-occurrence, similarity links, propagation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.functions import vector as V
from strataloom.sources.shared import cut, drop


def mentions_of(entities: DataFrame, contains: DataFrame) -> DataFrame:
    """Per chunk: how many of the entities (entity_id, name) it contains, and their sorted names."""
    hits = contains.join(entities.select("entity_id", "name"), "entity_id")
    return hits.groupBy("chunk_id").agg(F.countDistinct("entity_id").alias("matches"), F.array_sort(F.collect_set("name")).alias("matched"))


def degrees(entities: DataFrame, contains: DataFrame) -> DataFrame:
    """Chunks per entity; entities without a chunk have degree 0."""
    counted = contains.groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("degree"))
    return entities.join(counted, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def sized_contexts(contains: DataFrame, least: int, most: int) -> DataFrame:
    """Mentions in chunks with least to most entities; larger chunks relate everything to everything."""
    rows = contains.select("chunk_id", "entity_id").distinct()
    fit = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))
    return rows.join(fit.select("chunk_id"), "chunk_id", "left_semi")


SIEVE_BITS = 1 << 23
"""Bits of a sieve, whatever it holds; every task gets 131,072 words at most."""


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be among ``wanted`` (one column of numbers): each that is stays, of the others a few. What cannot
    match does not travel to the exact join that has to follow."""
    name = wanted.columns[0]
    bit = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(SIEVE_BITS)).alias("_at")
    words = wanted.where(F.col(name).isNotNull()).select(bit(name)).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(_at & 63 AS INT)))").alias("_bits"))
    held = rows.withColumn("_at", bit(key)).join(F.broadcast(words), F.shiftright("_at", 6) == F.col("_word"))
    return held.where(F.expr("getbit(_bits, CAST(_at & 63 AS INT)) = 1")).select(*rows.columns)


MENTIONS = 250_000
"""Mentions whose pairs one task makes, on average."""
LINKS = 1_000_000
"""Pairs or links that one task holds, on average."""


def co_occurrence(contains: DataFrame, least: int = 2, most: int = 25) -> DataFrame:
    """(a, b, shared): pairs a < b of entities and how many chunks they share.

    A chunk has at most ``most`` entities here, so it gives at most most * (most - 1) / 2 pairs. Chunks and pairs are dealt
    to tasks by their numbers, so that what a task holds does not grow with the input.
    """
    rows = cut(contains.select("chunk_id", "entity_id").distinct())
    tasks = lambda n, size: max(1, -(-int(n or 0) // size))
    rows = rows.repartition(tasks(rows.count(), MENTIONS), "chunk_id")
    n = F.col("n")
    total = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where(n.between(least, most)).agg(F.sum(n * (n - 1) / 2)).first()[0]
    sets = sized_contexts(rows, least, most).groupBy("chunk_id").agg(F.array_sort(F.collect_list("entity_id")).alias("_all"))  # ``most`` at most
    firsts = sets.select("_all", F.posexplode("_all").alias("_at", "a"))
    pairs = firsts.select("a", F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all"))).alias("b"))
    return pairs.repartition(tasks(total, LINKS), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def npmi_edges(contains: DataFrame, least: int = 2, most: int = 25, shared: int = 1, floor: float = 0.0) -> DataFrame:
    """(a, b, npmi) above the floor; pairs that occur in every context carry no information and go."""
    rows = sized_contexts(contains, least, most)
    total = rows.select(F.countDistinct("chunk_id").alias("n"))
    single = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("c"))
    pairs = co_occurrence(contains, least, most).where(F.col("shared") >= shared)
    joined = pairs.join(single.select(F.col("entity_id").alias("a"), F.col("c").alias("ca")), "a").join(single.select(F.col("entity_id").alias("b"), F.col("c").alias("cb")), "b")
    joined = joined.crossJoin(F.broadcast(total))  # one row
    p = joined.where(F.col("shared") < F.col("n"))
    scored = p.withColumn("npmi", V.npmi(F.col("shared") / F.col("n"), F.col("ca") / F.col("n"), F.col("cb") / F.col("n")))
    return scored.where(F.col("npmi") > floor).select("a", "b", "npmi")


CUT_EVERY = 5
"""Rounds of an iteration between two written tables."""
DEAL = 1000
"""Members of a group that one task pairs with as many others."""


def paired(rows: DataFrame, key: str, item: str, values: list[str] = ()) -> DataFrame:
    """(a, b) and the values of both (x_..., y_...) for items a < b with a key in common, once per key.

    A group is dealt into chunks of DEAL members on average, and each pair of chunks is a task's own, so a hot key spreads.
    Callers keep groups small where the result allows it: pairs are what a group costs.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("long").alias("_chunks")).where(F.col("_chunks").isNotNull())
    placed = rows.join(sizes, key).withColumn("_chunk", F.pmod(F.xxhash64(item), "_chunks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)
    cell = lambda mine, other: F.struct(F.least(mine, other).alias("lo"), F.greatest(mine, other).alias("hi"))
    dealt = placed.withColumn("_cell", F.explode(F.transform(others, lambda o: cell(F.col("_chunk"), o))))
    side = lambda p, name: dealt.select(key, "_cell", F.col("_chunk").alias(f"_{p}"), F.col(item).alias(name), *[F.col(v).alias(f"{p}_{v}") for v in values])
    both = side("x", "a").join(side("y", "b"), [key, "_cell"]).where("a < b")
    met = ((F.col("_x") == F.col("_cell.lo")) & (F.col("_y") == F.col("_cell.hi"))) | ((F.col("_y") == F.col("_cell.lo")) & (F.col("_x") == F.col("_cell.hi")))
    return both.where(met).drop("_cell", "_x", "_y")


def paired_with(rows: DataFrame, key: str, item: str, flag: str) -> DataFrame:
    """(a, b): items a < b with a key in common, at least one of them flagged, once per key. A key's items are dealt into chunks
    of DEAL on average, and its flagged items go to each."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("_chunks"), F.max(flag).alias("_any")).where("_any").drop("_any")
    placed = rows.join(sizes, key)
    own = placed.select(key, F.pmod(F.xxhash64(item), "_chunks").cast("int").alias("_chunk"), F.col(item).alias("_x"), F.col(flag).alias("_f"))
    sent = placed.where(flag).select(key, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), F.col(item).alias("_y"))
    both = own.join(sent, [key, "_chunk"]).where("_x < _y or (_y < _x and not _f)")  # two flagged items meet twice
    return both.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


PAIRS = 2_000_000
"""Pairs that one task counts, on average."""


def met_counts(rows: DataFrame, key: str, item: str, mark: str) -> DataFrame:
    """(a, x, b, y, met): items a < b with keys in common, their marks (one an item; y is null if no list with b has a mark
    below 0), and how many keys they share.

    Rows (key, item, mark) are distinct and not null. What travels is a list of partners for each item of a key, not a row a
    pair, and pairs are counted where the lists of their first item come together, in tasks of PAIRS pairs on average. A
    key's members are dealt into lists of DEAL on average, and each two lists meet in a task of their own.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum(F.col("_n") * F.col("_n")).alias("n")).first()["n"] or 0
    lists = rows.join(sizes.select(key, F.ceil(F.col("_n") / DEAL).cast("int").alias("_lists")), key).withColumn("_at", F.pmod(F.xxhash64(item), "_lists").cast("int"))
    lists = lists.groupBy(key, "_lists", "_at").agg(F.sort_array(F.collect_list(F.struct(F.col(item).alias("i"), F.col(mark).alias("m")))).alias("_list"))
    upto = F.explode(F.sequence(F.lit(0), F.col("_lists") - 1))
    mine = lists.select(key, F.col("_at").alias("_i"), upto.alias("_j"), F.col("_list").alias("_mine"))
    theirs = lists.select(key, upto.alias("_i"), F.col("_at").alias("_j"), F.col("_list").alias("_theirs"))
    sent = mine.join(theirs, [key, "_i", "_j"]).select(F.explode("_mine").alias("_a"), "_theirs")
    sent = sent.select(F.col("_a.i").alias("a"), F.col("_a.m").alias("x"), F.filter("_theirs", lambda t: t["i"] > F.col("_a.i")).alias("_later")).where(F.size("_later") > 0)
    marks = F.when(F.exists("_later", lambda t: t["m"] < 0), F.col("_later.m"))
    sent = sent.select("a", "x", F.col("_later.i").alias("b"), marks.alias("y")).repartition(max(1, -(-total // (2 * PAIRS))), "a")
    pairs = sent.select("a", "x", F.explode(F.arrays_zip("b", F.coalesce("y", F.array().cast("array<int>")).alias("y"))).alias("_b")).select("a", "x", "_b.b", "_b.y")
    return pairs.groupBy("a", "x", "b").agg(F.max("y").alias("y"), F.count(F.lit(1)).alias("met"))


def shared_documents(mentions: DataFrame, least_shared: int, least_jaccard: float) -> DataFrame:
    """(d1, d2, shared, jaccard), both directions, of documents (doc_id, entity_id) with entities in common.

    Two documents that reach the limits share one of the rarest entities of each: of n entities all but
    max(least_shared, least_jaccard * n) - 1 of the most frequent. Only those and all that at most DEAL documents mention
    propose pairs, so an entity that most documents mention does not pair them all. What two documents without other
    entities share is the number of proposals; for others it is counted on the full sets, if they can still reach the limits.
    """
    rows = mentions.select("doc_id", "entity_id").where("doc_id is not null and entity_id is not null").distinct()
    often = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_often"))
    sets = rows.join(often, "entity_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_often", "entity_id"))).alias("_all"))
    need = lambda n: F.greatest(F.lit(least_shared), F.ceil(n * least_jaccard - 1e-9)).cast("int")
    n, calm = F.size("_all"), F.size(F.filter("_all", lambda x: x["_often"] <= DEAL))
    sets = cut(sets.select("doc_id", F.col("_all.entity_id").alias("_set"), n.alias("_n"), F.least(n, F.greatest(n - need(n) + 1, calm)).alias("_h")))
    mark = F.when(F.col("_h") < F.col("_n"), -F.col("_n")).otherwise(F.col("_n")).alias("_mark")  # below 0: some entities propose nothing
    heads = sets.select("doc_id", mark, F.explode(F.slice("_set", 1, F.col("_h"))).alias("entity_id"))
    beyond = lambda m: F.when(F.col(m) < 0, need(-F.col(m)) - 1).otherwise(0)
    size = lambda y: F.abs("x") + F.abs(y)
    most = F.col("met") + beyond("x") + beyond("y")  # what their heads share, and at best all that is beyond a head
    pairs = met_counts(heads, "entity_id", "doc_id", "_mark")
    able = lambda y: (most >= least_shared) & (most + 1e-9 >= least_jaccard * (size(y) - most))
    pairs = pairs.where(able(F.coalesce("y", F.lit(1)))).join(sets.select(F.col("doc_id").alias("b"), "_n"), "b").where(able(F.col("_n")))
    pairs = cut(pairs.select("a", "b", size("_n").alias("_size"), ((F.col("x") > 0) & (F.coalesce("y", F.lit(1)) > 0)).alias("_all"), "met"))
    side = lambda name, held: sets.select(F.col("doc_id").alias(name), F.col("_set").alias(held))
    open_ = pairs.where("not _all").join(side("a", "_a"), "a").join(side("b", "_b"), "b")
    scored = pairs.where("_all").select("a", "b", "_size", F.col("met").alias("shared")).unionByName(open_.select("a", "b", "_size", F.size(F.array_intersect("_a", "_b")).cast("long").alias("shared")))
    scored = scored.withColumn("jaccard", F.col("shared") / (F.col("_size") - F.col("shared")))
    scored = scored.where((F.col("shared") >= least_shared) & (F.col("jaccard") >= least_jaccard))
    way = lambda x, y: F.struct(F.col(x).alias("d1"), F.col(y).alias("d2"))
    return scored.select(F.inline(F.array(way("a", "b"), way("b", "a"))), "shared", "jaccard")


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.unionByName(edges.withColumns({a: F.col(b), b: F.col(a)})).distinct()


def top_per(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


WIDE = 64
"""Entities of a chunk beyond which its partners are counted one by one, not by pairs of its entities."""


def neighbours(contains: DataFrame, k: int = 20) -> DataFrame:
    """(a, b, shared, rank): chunks that share entities, up to k per chunk; more shared first, then the smaller id.

    Pairs with a single entity in common are not all made: one that ranks among a chunk's first k is among the k smallest
    other chunks of that entity, as each smaller one would rank before it. Pairs with more in common meet on pairs of
    entities; those of a chunk with more than WIDE entities on each of its entities.
    """
    rows = cut(contains.select("entity_id", "chunk_id").where("entity_id is not null and chunk_id is not null").distinct())
    sizes = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"))
    wide = sizes.where(F.col("_n") > WIDE).select("chunk_id")
    sets = rows.join(sizes.where(F.col("_n").between(2, WIDE)), "chunk_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list("entity_id")).alias("_all"))  # WIDE at most
    firsts = sets.select("chunk_id", "_all", F.posexplode("_all").alias("_at", "x"))
    both = firsts.select("chunk_id", "x", F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all"))).alias("y")).select("chunk_id", "x", "y").repartition("x", "y")
    often = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    both = both.join(often, ["x", "y"]).select(F.struct("x", "y").alias("_key"), "chunk_id")  # most pairs of entities have one chunk
    # a pair that shares n entities meets n (n - 1) / 2 times
    met = paired(both, "_key", "chunk_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("m"))) / 2).cast("long").alias("shared"))
    each = rows.join(wide, "chunk_id", "left_semi").select("entity_id", F.col("chunk_id").alias("a")).join(rows.withColumnRenamed("chunk_id", "b"), "entity_id").where("a <> b")
    each = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where("shared > 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared").distinct()
    more = met.unionByName(each)
    more = more.unionByName(more.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    more = top_per(more, ["a"], [F.desc("shared"), F.asc("b")], k).groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("s"), "b"))).alias("_more"))
    few = top_per(rows, ["entity_id"], [F.asc("chunk_id")], k + 1).groupBy("entity_id").agg(F.collect_list("chunk_id").alias("_few"))
    alone = rows.join(few, "entity_id").groupBy("chunk_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_few")))).alias("_few"))
    alone = alone.select(F.col("chunk_id").alias("a"), F.slice(F.array_remove("_few", F.col("chunk_id")), 1, k).alias("_few")).join(more, "a", "left")
    none = F.array().cast(more.schema["_more"].dataType)
    taken = F.coalesce("_more", none)
    single = F.transform(F.array_except("_few", taken.getField("b")), lambda b: F.struct(F.lit(-1).cast("long").alias("s"), b.alias("b")))
    best = alone.select("a", F.posexplode(F.slice(F.concat(taken, single), 1, k)).alias("_at", "_b"))
    return best.select("a", "_b.b", (-F.col("_b.s")).alias("shared"), (F.col("_at") + 1).alias("rank"))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, iterations: int | None = None, most: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(node, score): personalised PageRank, until a round changes less than tolerance * nodes in sum, ``most`` rounds at most.

    ``edges`` (a, b, weight) are directed; ``seeds`` (node) share the restart mass. A node's outgoing mass splits by
    weight; nodes without outgoing edges give theirs to the seeds. The transition table is shuffled once and kept by its
    source, so that a round shuffles scores alone: one join and one aggregation. A graph without seeds has no ranks, and
    neither has one that does not settle. With ``iterations`` so many rounds are taken, settled or not.
    """
    spark = edges.sparkSession
    edges = cut(edges.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    out = edges.groupBy("a").agg(F.sum("weight").alias("total"))
    steps = edges.join(out, "a").select("a", "b", (damping * F.col("weight") / F.col("total")).alias("share")).repartition(max(1, -(-edges.count() // LINKS)), "a").persist()
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("leads")), F.struct(F.col("b").alias("node"), F.lit(False).alias("leads")))))
    nodes = cut(ends.groupBy("node").agg(F.bool_or("leads").alias("leads")))
    dangling = nodes.where("NOT leads").select("node")
    start = nodes.select("node").join(seeds.select("node").distinct(), "node", "left_semi")
    count, seeded = nodes.count(), start.count()
    base = cut(start.withColumn("p", F.lit(1.0 / max(1, seeded))))
    zero = F.lit(0.0)
    ranks = table = cut(nodes.join(base, "node", "left").select("node", F.coalesce("p", zero).alias("score")))
    leaks = not dangling.isEmpty()
    settled, held = iterations is not None, None
    for k in range((iterations or most) if seeded else 0):
        lost = ranks.join(dangling, "node", "left_semi").agg(F.coalesce(F.sum("score"), zero).alias("s")).first()["s"] if leaks else 0.0
        parts = ranks.join(steps, ranks["node"] == steps["a"]).select(F.col("b").alias("node"), (F.col("score") * F.col("share")).alias("x"), zero.alias("was"))
        parts = parts.unionByName(base.select("node", ((1 - damping + damping * lost) * F.col("p")).alias("x"), zero.alias("was")))
        parts = parts.unionByName(ranks.select("node", zero.alias("x"), F.col("score").alias("was")))
        new = parts.groupBy("node").agg(F.sum("x").alias("score"), F.sum("was").alias("was")).persist()
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0]
        ranks = new.select("node", "score")
        if k % CUT_EVERY == CUT_EVERY - 1:  # a lost executor costs the rounds since the last written one
            table, gone = cut(ranks), table
            ranks = table
            drop(gone)
        if held is not None:
            held.unpersist()
        held = new
        if iterations is None and moved < count * tolerance:
            settled = True
            break
    result = cut(ranks if settled else ranks.limit(0))
    for kept in (steps, held):
        if kept is not None:
            kept.unpersist()
    drop(edges, nodes, base, table)
    return result


PART_LINKS = 3_000_000
"""Links that one task holds, on average, for a block of seed sets."""
SETS = (64, 256)
"""Seed sets of a block, at least and at most on average; a task computes as many of them at once as HELD scores allow."""
HELD = 4_000_000
LABELLED = 8
"""Rounds that look for connected nodes, to lay them in one part."""
SENT = "part long, block int, query_id long, nodes array<long>, score array<double>, left array<double>, back double, fresh boolean"


def chunks_near(contains: DataFrame, front: DataFrame, before: DataFrame | None, sizes: tuple[int, int] | None) -> tuple[DataFrame, DataFrame]:
    """(chunk_id) of the chunks with one of the entities ``front`` (node) that are not among ``before``, and all their distinct mentions,
    those of chunks of other ``sizes`` left out. Mentions of other chunks hardly ever travel."""
    near = sieved(contains, "entity_id", front).join(front.select(F.col("node").alias("entity_id")), "entity_id", "left_semi").select("chunk_id").distinct()
    near = cut(near if before is None else near.join(before, "chunk_id", "left_anti"))
    rows = sieved(contains.select("chunk_id", "entity_id"), "chunk_id", near).repartition("chunk_id").join(near, "chunk_id", "left_semi").distinct()
    return near, cut(rows if sizes is None else sized_contexts(rows, *sizes))


def reached(contains: DataFrame, seeds: DataFrame, hops: int = 27, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Distinct mentions (chunk_id, entity_id) of the chunks that the entities ``seeds`` (node) reach in so many hops; all links of an
    entity closer than that are among them. With ``sizes`` only chunks with so many entities, least and most, count.

    An entity is looked up once and a chunk's mentions travel once, those of chunks that are not reached hardly ever.
    """
    known = front = cut(seeds.select("node").distinct())
    out = chunks = None
    for _ in range(hops + 1):
        near, rows = chunks_near(contains, front, chunks, sizes)
        out = rows if out is None else out.unionByName(rows)
        front = cut(rows.select(F.col("entity_id").alias("node")).distinct().join(known, "node", "left_anti"))
        if front.isEmpty():
            break
        known = known.unionByName(front)
        chunks = near if chunks is None else chunks.unionByName(near)
    return out


def mention_ranks(contains: DataFrame, seeds: DataFrame, sizes: tuple[int, int] = (2, 25), damping: float = 0.5, most: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(node, score): what ``page_rank`` gives over the co-occurrence of the mentions, both ways, of the nodes with a score; no row a
    pair is made.

    An entity passes an equal share on to each other mention of its chunks, so a chunk adds up the shares of its entities and each
    gets that sum less its own. Only chunks of entities that have a score are looked up, and once; of all other mentions the
    number of entities alone counts, which says when a round has settled.
    """
    sized = contains.select("chunk_id", "entity_id").repartition("chunk_id").distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("chunk_id")))
    count = sized.where(F.col("_n").between(*sizes) & F.col("chunk_id").isNotNull()).agg(F.countDistinct("entity_id")).first()[0]
    front = cut(seeds.select("node").distinct())
    held = chunks = base = ranks = None
    for k in range(most):
        if not front.isEmpty():
            near, rows = chunks_near(contains, front, chunks, sizes)
            chunks = near if chunks is None else chunks.unionByName(near)
            rows = rows.join(rows.groupBy("chunk_id").agg((F.count(F.lit(1)) - 1).alias("others")), "chunk_id")
            held = cut(rows if held is None else held.unionByName(rows))
        if k == 0:
            start = front.join(held.select(F.col("entity_id").alias("node")), "node", "left_semi")
            base = ranks = cut(start.withColumn("score", F.lit(1.0 / max(1, start.count()))))
            if base.isEmpty():
                return base
        sums = held.groupBy("entity_id").agg(F.sum("others").alias("total"), F.count(F.lit(1)).alias("n"))
        own = cut(ranks.join(sums, F.col("node") == F.col("entity_id")).select("entity_id", "score", "n", (damping * F.col("score") / F.col("total")).alias("x")))
        inside = held.join(own.select("entity_id", "x"), "entity_id").groupBy("chunk_id").agg(F.sum("x").alias("s"))
        got = held.join(inside, "chunk_id").groupBy("entity_id").agg(F.sum("s").alias("s"))
        zero = F.lit(0.0)
        start = base.select(F.col("node").alias("entity_id"), ((1 - damping) * F.col("score")).alias("p"))
        new = got.join(own, "entity_id", "left").join(start, "entity_id", "left")
        score = F.col("s") - F.coalesce(F.col("n") * F.col("x"), zero) + F.coalesce("p", zero)
        ranks = cut(new.select(F.col("entity_id").alias("node"), score.alias("score"), F.coalesce("score", zero).alias("was")))
        if ranks.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] < count * tolerance:
            return ranks.select("node", "score")
        front = cut(ranks.where("was = 0").join(own, F.col("node") == F.col("entity_id"), "left_anti").select("node"))
        ranks = ranks.select("node", "score")
    return ranks.limit(0)


def parts_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, part): connected nodes lie in one part if their links are at most PART_LINKS, else in several by hash. What LABELLED
    rounds do not connect lies in different parts, which costs time alone. Links that all fit into one part are not told apart."""
    if edges.count() <= PART_LINKS:
        return nodes.select("node", F.lit(0).cast("long").alias("part"))
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    for _ in range(LABELLED):
        said = edges.join(labels, edges["a"] == labels["node"]).select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        heard = edges.join(labels, edges["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        new = cut(said.unionByName(heard).unionByName(labels.withColumn("was", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        drop(labels)
        labels = new
        if labels.where("label <> was").isEmpty():
            break
    pieces = edges.join(labels, edges["a"] == labels["node"]).groupBy("label").agg(F.ceil(F.count(F.lit(1)) / PART_LINKS).alias("n"))
    placed = labels.join(pieces, "label", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return placed.select("node", F.xxhash64("label", F.pmod(F.xxhash64("node"), "n")).alias("part"))


def packed_links(links: DataFrame) -> DataFrame:
    """(part, a, b, to, share): links (part, a, b, to, share) in rows of many, a part's beside each other."""
    kinds = (np.int64, np.int64, np.int64, np.float64)

    def run(batches):
        for batch in batches:
            part, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(part)]
            cells = [pa.array([np.ascontiguousarray(c[x:y], kind).tobytes() for x, y in zip(starts, ends)], pa.binary()) for c, kind in zip(rest, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int64()), *cells], ["part", "a", "b", "to", "share"])

    rows = links.select("part", "a", "b", "to", "share").repartition("part").sortWithinPartitions("part", "a", "b")  # runs of equal numbers take little room
    return rows.mapInArrow(run, "part long, a binary, b binary, to binary, share binary")


def spread(mass: np.ndarray, source: np.ndarray, target: np.ndarray, share: np.ndarray, onto: np.ndarray) -> None:
    """Adds to ``onto`` what the links pass on of ``mass``, a row a node and a column a seed set; links are in order of their targets."""
    some = (mass > 0).any(axis=1)
    if some.mean() < 0.5:
        kept = some[source]
        source, target, share = source[kept], target[kept], share[kept]
    step = max(1, HELD // (4 * mass.shape[1]))
    for x in range(0, len(source), step):
        to = target[x : x + step]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        onto[to[starts]] += np.add.reduceat(mass[source[x : x + step]] * share[x : x + step, None], starts, axis=0)


def close_to_best(score: np.ndarray, best: int | None) -> np.ndarray:
    """Places of scores above 0; with ``best``, of those that may be among so many largest once they are rounded to 8 digits or more."""
    at = np.flatnonzero(score > 0)
    if best is None or len(at) <= best:
        return at
    return at[score[at] >= np.partition(score[at], len(at) - best)[len(at) - best] - 1e-8]


def page_ranks(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, bound: float = 1e-7, most: int = 60, best: int | None = None) -> DataFrame:
    """(query_id, node, score): personalised PageRank of many seed sets (query_id, node; numbers) in one run. With ``best``, only of
    nodes that can be among a set's so many best; ties at eight digits come along.

    Every set starts with its restart mass as residue on its seeds. Each residue above ``bound`` leaves its share of restarts as
    score, and the rest goes on along the links; what is not above it stays, so a score falls short by the residues that are
    left. Nodes are laid in parts with some PART_LINKS links, connected ones together as far as they fit, and sets in
    blocks, neighbouring seeds together. A task holds a part's links and a block's residues: it goes on until no residue inside its
    part is above the bound, and sends on what left the part, summed for each set and node. Nothing is shuffled for a link and a set.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "weight").repartition("a").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    edges = cut(edges.withColumn("total", F.sum("weight").over(Window.partitionBy("a"))))  # where a's links lie
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("leads")), F.struct(F.col("b").alias("node"), F.lit(False).alias("leads")))))
    nodes = cut(ends.groupBy("node").agg(F.bool_or("leads").alias("leads")))
    leaks = not nodes.where("NOT leads").isEmpty()
    home = cut(parts_of(edges, nodes))
    there = home.select(F.col("node").alias("b"), F.col("part").alias("to"))
    only = [x["part"] for x in home.select("part").distinct().limit(2).collect()]
    ends = edges.join(home.withColumnRenamed("node", "a"), "a").join(there, "b") if len(only) > 1 else edges.withColumn("part", F.lit(only[0] if only else 0).cast("long")).withColumn("to", F.col("part"))
    links = ends.select("part", "a", "b", "to", (damping * F.col("weight") / F.col("total")).alias("share"))
    links = cut(links) if len(only) > 1 else links
    across = links.where("part <> to").select(F.inline(F.array(F.struct("part"), F.struct(F.col("to").alias("part"))))).distinct().withColumn("open", F.lit(True))
    packed = packed_links(links)
    packed = packed.join(across, "part", "left").withColumn("open", F.coalesce("open", F.lit(leaks))) if len(only) > 1 else packed.withColumn("open", F.lit(leaks))
    packed = cut(packed)
    seeds = cut(seeds.select(F.col("query_id").cast("long").alias("query_id"), F.col("node").cast("long").alias("node")).distinct().join(home, "node"))
    sets = cut(seeds.groupBy("query_id").agg((1.0 / F.count(F.lit(1))).alias("p"), F.min("node").alias("first")))
    many = sets.count()
    blocks = max(1, -(-many // min(SETS[1], max(SETS[0], many // 64))))
    ranged = cut(sets.repartitionByRange(blocks, "first", "query_id").select("query_id", "p", F.spark_partition_id().alias("_at")))
    ranges = (ranged.agg(F.max("_at")).first()[0] or 0) + 1  # a part's links travel once for a block, so there are no more blocks where a session deals finer
    block = F.floor(F.col("_at") * min(blocks, ranges) / ranges).cast("int")
    base = cut(seeds.join(ranged.select("query_id", "p", block.alias("block")), "query_id"))
    none = F.lit(0.0)
    fresh = lambda rows: rows.groupBy("part", "block", "query_id").agg(F.collect_list("node").alias("nodes"), F.collect_list(none).alias("score"), F.collect_list("left").alias("left")).select("part", "block", "query_id", "nodes", "score", "left", none.alias("back"), F.lit(True).alias("fresh"))

    def settle(sent: pa.Table, links: pa.Table) -> pa.Table:
        names = ("part", "block", "query_id", "nodes", "score", "left", "back", "fresh")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.bool_())
        rows = []
        if sent.num_rows:
            part, block = sent["part"][0].as_py(), sent["block"][0].as_py()
            a, b, to, share = (np.frombuffer(b"".join(links[c].to_pylist()), kind) for c, kind in zip(("a", "b", "to", "share"), (np.int64, np.int64, np.int64, np.float64)))
            closed = links.num_rows > 0 and not links["open"][0].as_py()
            held = {c: sent[c].combine_chunks() for c in ("nodes", "score", "left")}
            lengths, flat = held["nodes"].value_lengths().to_numpy(), {c: v.flatten().to_numpy() for c, v in held.items()}
            queries, column = np.unique(np.repeat(sent["query_id"].to_numpy(), lengths), return_inverse=True)
            inside = to == part
            own = np.unique(np.concatenate([a, b[inside], flat["nodes"]]))
            place, source = np.searchsorted(own, flat["nodes"]), np.searchsorted(own, a)
            ends = np.setdiff1d(np.arange(len(own)), source)
            order = np.argsort(b, kind="stable")
            inner, outer = order[inside[order]], order[~inside[order]]
            inner = (source[inner], np.searchsorted(own, b[inner]), share[inner])
            beyond, first, at = np.unique(b[outer], return_index=True, return_inverse=True)
            where, outer = to[outer][first], (source[outer], at, share[outer])
            width = max(1, min(SETS[0], HELD // (len(own) + len(beyond))))
            for x in range(0, len(queries), width):
                n = min(width, len(queries) - x)
                mine = (column >= x) & (column < x + n)
                dense = lambda v: np.bincount(place[mine] * n + column[mine] - x, v[mine], len(own) * n).reshape(-1, n)  # noqa: E731, B023
                score, left = dense(flat["score"]), dense(flat["left"])
                gone, back = np.zeros_like(left), np.zeros(n)
                for _ in range(most):
                    going = np.where(left > bound, left, 0.0)
                    if not going.any():
                        break
                    left[left > bound] = 0.0
                    gone += going
                    spread(going, *inner, left)
                score += (1 - damping) * gone
                back += damping * gone[ends].sum(axis=0)
                away = np.zeros((len(beyond), n))
                spread(gone, *outer, away)
                for k in range(n):
                    q = int(queries[x + k])
                    keep = close_to_best(score[:, k], best) if closed else np.flatnonzero((score[:, k] > 0) | (left[:, k] > 0))
                    rows.append((part, block, q, own[keep], score[keep, k], left[keep, k], back[k], False))
                    sends = np.flatnonzero(away[:, k])
                    for other in np.unique(where[sends]):
                        to_it = sends[where[sends] == other]
                        rows.append((int(other), block, q, beyond[to_it], np.zeros(len(to_it)), away[to_it, k], 0.0, True))
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    state = cut(fresh(base.withColumn("left", F.col("p"))))
    for _ in range(most):
        due = cut(state.where("fresh").select("part", "block").distinct())
        if due.isEmpty():
            break
        sent, rest = (state.join(due, ["part", "block"], how) for how in ("left_semi", "left_anti"))
        new = sent.groupBy("part", "block").cogroup(packed.join(due, "part").groupBy("part", "block")).applyInArrow(settle, SENT)
        new = cut(rest.unionByName(new))
        drop(state, due)
        state = new
        if leaks:  # the mass of nodes without links goes back to the seeds of its set
            back = state.groupBy("query_id").agg(F.sum("back").alias("back")).where("back > 0")
            again = fresh(base.join(back, "query_id").withColumn("left", F.col("p") * F.col("back")))
            state = cut(state.withColumn("back", none).unionByName(again))
            drop(new)

    def listed(batches):
        for batch in batches:
            columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            found = []
            for q, held, scores in zip(*(batch.column(k).to_pylist() for k in range(3))):
                keep = close_to_best(np.array(scores), best)
                found.append((np.full(len(keep), q), np.array(held, np.int64)[keep], np.array(scores)[keep]))
            columns = [np.concatenate(c) for c in zip(*found)] if found else columns
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "node", "score"])

    result = state.where("not fresh").select("query_id", "nodes", "score").mapInArrow(listed, "query_id long, node long, score double")
    drop(edges, nodes, home, packed, seeds, sets, ranged, base, *[links] * (len(only) > 1))
    return result


def label_rounds(edges: DataFrame, most: int = 10) -> DataFrame:
    """(node, label): communities by label propagation, until no label changes, ``most`` rounds at most.

    Every node takes the label with the largest weight among its neighbours and itself; the smaller label wins ties.
    """
    both = both_ways(edges.select("a", "b", "weight"))
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    own = labels.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1e-9).alias("weight"))
    links = cut(both.unionByName(own)).repartition("b").persist()
    for _ in range(most):
        votes = links.join(labels, links["b"] == labels["node"]).groupBy("a", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.max_by("label", F.struct(F.round("w", 9), -F.col("label"))).alias("label"))
        new = cut(best.withColumnRenamed("a", "node"))
        changed = new.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was")
        done = changed.isEmpty()
        labels, gone = new, labels
        drop(gone)
        if done:
            break
    links.unpersist()
    return labels


def community_table(labels: DataFrame, entities: DataFrame, excluded: tuple[str, ...] = (), least: int = 3, level: int = 0) -> DataFrame:
    """(community, level, size, member) of communities (node, label) with at least ``least`` members of types that are not excluded."""
    allowed = entities.where(~F.lower("type").isin(*excluded)) if excluded else entities
    rows = labels.join(allowed.select(F.col("entity_id").alias("node")), "node", "left_semi")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return rows.join(sizes, "label").select(F.col("label").alias("community"), F.lit(level).alias("level"), "size", F.col("node").alias("member"))


def related_names(names: DataFrame) -> DataFrame:
    """(type, a, b): names (type, name) of which a's skeleton lies in b's and is long enough, or is b's initials.

    Candidates meet on a four-letter piece of the longer skeleton that starts the shorter one, or on the initials, so
    only names that share one are compared.
    """
    skeleton = X.skeleton(F.col("name"))
    rows = cut(names.select("type", "name", skeleton.alias("s"), X.initials(F.col("name")).alias("i"), X.word_count(F.col("name")).alias("words")))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 3, F.lit(1))), lambda k: F.substring(F.col("s"), k, F.lit(4)))
    longer = rows.select("type", F.col("name").alias("b"), F.col("s").alias("t"), F.explode(F.array_distinct(pieces)).alias("block"))
    inside = rows.where("length(s) >= 4").select("type", F.col("name").alias("a"), "s", F.substring("s", 1, 4).alias("block")).join(longer, ["type", "block"])
    inside = inside.where((F.col("a") != F.col("b")) & (F.length("s") <= F.length("t")) & (F.length("s") * 5 >= F.length("t") * 4) & F.col("t").contains(F.col("s")))
    short = rows.where("length(s) >= 2").select("type", F.col("name").alias("a"), F.col("s").alias("i"))
    spelled = short.join(rows.where("words >= 2").select("type", F.col("name").alias("b"), "i"), ["type", "i"]).where("a <> b")
    return inside.select("type", "a", "b").union(spelled.select("type", "a", "b")).distinct()


def audit_aliases(pairs: DataFrame, vectors: DataFrame, least: float = 0.92) -> DataFrame:
    """(alias, canon, verdict) of pairs (alias, canon, names a and b): equal names and close vectors stay, so do pairs that
    cannot be compared; ``judge`` marks the others."""
    side = lambda name: vectors.select(F.col("id").alias(name), F.col("vec").alias(f"_{name}"))
    both = pairs.join(side("alias"), "alias", "left").join(side("canon"), "canon", "left")
    cosine = F.when(F.col("_alias").isNotNull() & F.col("_canon").isNotNull(), F.round(V.cosine(F.col("_alias"), F.col("_canon")), 4))
    equal = X.normal_name(F.col("a")) == X.normal_name(F.col("b"))
    verdict = F.when(equal, "equal").when(cosine.isNull(), "unknown").when(cosine >= least, "close").otherwise("judge")
    return both.select("alias", "canon", verdict.alias("verdict"))
