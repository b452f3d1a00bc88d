"""Similar names: a join on rare letter pairs, and the exact ratio of matching blocks, as column expressions.

The ratio of two names is twice the letters in their matching blocks over the letters of both: the longest common run
(the earliest in the first name, then in the second), and so on to its left and right. Names with a ratio of at least
``least`` have so many letter pairs in common that they share one of the rarest of each; only those meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.graph import paired, paired_with
from strataloom.sources.shared import cut

SHORT = 8
"""Names of up to this length may also meet on single letters."""


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the letters in matching blocks over all letters; 1 for two empty names."""
    # the longest run of x from each start that y holds too: if a run is in y, so are its beginnings
    here = "size(filter(sequence(1, length(t.x) - i + 1), n -> instr(t.y, substring(t.x, i, n)) > 0))"
    longest = f"""aggregate(sequence(1, length(t.x)), named_struct('n', 0, 'i', 0),
        (r, i) -> element_at(transform(array({here}), n -> if(n > r.n, named_struct('n', n, 'i', i), r)), 1))"""
    sides = """filter(array(
        named_struct('x', substring(t.x, 1, q.i - 1), 'y', substring(t.y, 1, instr(t.y, substring(t.x, q.i, q.n)) - 1)),
        named_struct('x', substring(t.x, q.i + q.n), 'y', substring(t.y, instr(t.y, substring(t.x, q.i, q.n)) + q.n))), z -> z.x <> '' and z.y <> '')"""
    rest = "slice(s.left, 2, greatest(size(s.left) - 1, 0))"
    step = f"""element_at(transform(array(s.left[0]), t -> element_at(transform(array({longest}),
        q -> named_struct('left', if(q.n = 0, {rest}, concat({sides}, {rest})), 'm', s.m + q.n)), 1)), 1)"""
    pair = F.struct(a.cast("string").alias("x"), b.cast("string").alias("y"))
    matched = F.expr(f"""transform(array(_pair), p -> if(p.x = '' or p.y = '', if(p.x = p.y, 1D, 0D), aggregate(sequence(1, length(p.x) + length(p.y)),
        named_struct('left', array(p), 'm', 0), (s, k) -> if(size(s.left) = 0, s, {step}), s -> 2D * s.m / (length(p.x) + length(p.y)))))""")
    return pair, matched


def with_ratio(pairs: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """Pairs with the ratio of two of their columns."""
    pair, matched = block_ratio(F.col(a), F.col(b))
    return pairs.withColumn("_pair", pair).withColumn(name, F.get(matched, F.lit(0))).drop("_pair")


def grams(text: Column, n: int) -> Column:
    """A name's runs of n letters as texts, each with how often it came before."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    runs = F.filter(runs, lambda g: F.length(g) == n)
    before = lambda g, i: F.size(F.filter(F.slice(runs, F.lit(1), i), lambda x: x == g))
    return F.transform(runs, lambda g, i: F.concat(F.lit(f"{n}:"), g, F.lit(":"), before(g, i)))


def similar_names(names: DataFrame, least: float, group: str = "type", name: str = "name", known: DataFrame | None = None) -> DataFrame:
    """(group, a, b, ratio) of different names a < b of a group whose lower-case forms have a ratio of ``least`` or more.

    A pair with the ratio r of names of lengths m and n has r (m + n) / 2 letters in blocks; every other letter breaks at
    most two pairs of letters of its own name and one of the other's, which leaves (1.5 r - 1) (m + n) - 1 pairs in
    common. Of the shortest partner that lengths allow, that is the least a name must share; so two such names have a
    pair in common among the rarest (all but so many less one) of each. Shorter names meet on their letters in the same
    way. Letters in common bound the ratio before it is computed. Rarity is counted over all names. A frequent pair's
    names are dealt to many tasks. With ``known`` (group, name) only pairs with one of those names are compared, so names
    that are none do not meet each other.
    """
    listed_as = lambda rows, flag: rows.select(F.col(group).alias("_group"), F.col(name).alias("_name"), F.lit(flag).alias("_flag"))
    rows = listed_as(names, False) if known is None else listed_as(names, False).unionByName(listed_as(known, True))
    rows = rows.where(F.col("_name").isNotNull()).groupBy("_group", "_name").agg(F.max("_flag").alias("_flag")).withColumn("_low", F.lower("_name"))
    n = F.length("_low")
    shortest = F.ceil(n * least / (2 - least) - 1e-9)
    pairs_needed = F.floor((1.5 * least - 1) * (n + shortest) - 1 + 1e-9)
    letters_needed = F.ceil(least * (n + shortest) / 2 - 1e-9)
    kinds = rows.withColumn("_two", F.when(pairs_needed >= 1, grams(F.col("_low"), 2))).withColumn("_one", F.when((n > 0) & (n <= SHORT), grams(F.col("_low"), 1)))
    listed = kinds.select("_group", "_name", "_flag", "_low", F.explode(F.array(F.struct(F.col("_two").alias("g"), pairs_needed.alias("need")), F.struct(F.col("_one").alias("g"), letters_needed.alias("need")))).alias("k")).where("k.g is not null")
    listed = cut(listed.select("_group", "_name", "_flag", "_low", F.col("k.need").alias("_need"), F.size("k.g").alias("_size"), F.explode("k.g").alias("_gram")))
    often = listed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_often"))
    kind = F.substring("_gram", 1, 1)
    sets = listed.join(often, "_gram").groupBy("_group", "_name", "_flag", "_low", kind.alias("_kind"), "_need", "_size").agg(F.array_sort(F.collect_list(F.struct("_often", "_gram"))).alias("_all"))
    head = F.slice("_all", F.lit(1), F.greatest(F.col("_size") - F.col("_need") + 1, F.lit(0)).cast("int"))
    keyed = sets.select("_flag", F.struct("_group", F.col("_name").alias("n"), F.col("_low").alias("l")).alias("_item"), F.explode(F.transform(head, lambda x: F.struct("_group", x["_gram"].alias("g")))).alias("_key"))
    keyed = cut(keyed)
    met = (paired(keyed, "_key", "_item") if known is None else paired_with(keyed, "_key", "_item", "_flag")).select("a", "b").distinct()
    met = met.select(F.col("a._group").alias(group), F.col("a.n").alias("a"), F.col("b.n").alias("b"), F.col("a.l").alias("_a"), F.col("b.l").alias("_b"))
    total = F.length("_a") + F.length("_b")
    met = met.where(2 * F.least(F.length("_a"), F.length("_b")) >= least * total - 1e-9)
    common = F.size(F.array_intersect(grams(F.col("_a"), 1), grams(F.col("_b"), 1)))
    met = cut(met.where(2 * common >= least * total - 1e-9))
    found = with_ratio(met, "_a", "_b").where(F.col("ratio") >= least)
    return found.select(group, "a", "b", "ratio")
