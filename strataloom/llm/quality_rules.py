"""Quality rules by hashed n-gram log-likelihood ratios, with DataFrame functions only.

Words and word pairs are hashed into a fixed number of features. Two multinomials are counted: one over a
trusted target (labelled good documents) and one over every document of the corpus. A document's score is the
mean of log(target / corpus) over its features; a fixed rule turns labelled scores into the one threshold
that all documents meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import WHITE

FEATURES = 8192
"""Hashed features; also the bound of the weights, which are counted in Spark and sent to every task."""
LABELLED_ROWS = 50_000
"""Bound of the labelled sample of each class: the ids with the smallest hashes."""
SMOOTHING = 1.0
GOOD_COST = 20.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def _repeated_in_order(trigrams: Column) -> Column:
    """Trigram hashes with their places, sorted; empty where no trigram repeats."""
    pairs = F.transform(trigrams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(trigrams)) < F.size(trigrams), F.array_sort(pairs))


def _repeat_words(order: Column) -> Column:
    """Words inside a three-word window that the text has twice or more; each word counts once.

    ``order`` must be a column: lambdas evaluate whatever expression stands in its place for every element.
    """
    same = lambda x, k, d: F.coalesce(F.get(order, k + d)["h"] == x["h"], F.lit(False))
    places = F.transform(F.filter(order, lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"])
    covered = F.aggregate(
        F.array_sort(places),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return F.when(order.isNull(), F.lit(0)).otherwise(covered)


def _features(docs: DataFrame) -> DataFrame:
    """Adds _hw (word hashes), _hp (pair hashes), and _features (hashed words and pairs)."""
    tail = lambda c, n, k: F.slice(c, k, F.greatest(n - k + 1, F.lit(0)))
    out = docs.withColumn("_n", F.size("_words")).withColumn("_hw", F.transform("_words", lambda w: F.xxhash64(w)))
    pairs = F.zip_with(
        F.slice("_hw", 1, F.greatest(F.col("_n") - 1, F.lit(0))), tail(F.col("_hw"), F.col("_n"), 2), lambda a, b: F.xxhash64(a, b)
    )
    out = out.withColumn("_hp", pairs)
    slots = F.transform(F.concat("_hw", "_hp"), lambda h: F.pmod(h, F.lit(FEATURES)).cast("int"))
    return out.withColumn("_features", slots)


def _sample(labels: DataFrame, quality: int) -> DataFrame:
    rows = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(weights, threshold): log ratios per feature, and the least score of a document that stays.

    The corpus multinomial counts every document. The threshold is the ``split`` of the labelled sample's scores.
    Without good labels or without bad ones it is minus infinity: only the base rules reject.
    """
    base = docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_words"))
    sample = _sample(labels, 1).withColumn("_good", F.lit(1)).unionByName(_sample(labels, 0).withColumn("_good", F.lit(0)))
    ids = sample.groupBy(F.col("doc_id").alias("_id")).agg(F.min("_good").alias("_good"))
    marked = _features(base.join(F.broadcast(ids), "_id", "left"))
    counts = (
        marked.select("_good", F.explode_outer("_features").alias("_slot"))
        .where(F.col("_slot").isNotNull())
        .groupBy("_slot")
        .agg(F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("_good") == 1, 1)).alias("good"))
        .collect()  # FEATURES rows at most
    )
    raw, good = [SMOOTHING] * FEATURES, [SMOOTHING] * FEATURES
    for row in counts:
        raw[row["_slot"]] += row["raw"]
        good[row["_slot"]] += row["good"]
    all_raw, all_good = sum(raw), sum(good)
    if all_good <= SMOOTHING * FEATURES:
        return [0.0] * FEATURES, float("-inf")
    weights = [math.log(g / all_good) - math.log(r / all_raw) for g, r in zip(good, raw)]
    scored = _features(base.join(F.broadcast(ids), "_id")).select("_id", "_good", score(weights).alias("_s"))
    scored = scored.groupBy("_id").agg(F.min("_s").alias("_s"), F.min("_good").alias("_good"))  # a row an id, however often ids repeat
    return weights, split([(r["_s"], r["_good"]) for r in scored.collect()])  # 2 * LABELLED_ROWS rows at most


def split(scored: list[tuple[float, int]]) -> float:
    """The cut of least cost between labelled scores: the share of bad rows kept plus GOOD_COST times the share of
    good rows lost. It lies in the middle of the widest gap of that cost; the lower gap wins a tie."""
    n_good = sum(g for _, g in scored)
    n_bad = len(scored) - n_good
    if not n_good or not n_bad:
        return float("-inf")
    scored = sorted(scored)
    lost, held = 0, n_bad
    best = (1.0, 0.0, float("-inf"))  # cost of no cut
    for k, (value, good) in enumerate(scored):
        lost, held = lost + good, held - 1 + good
        if k + 1 < len(scored) and scored[k + 1][0] > value:
            gap = scored[k + 1][0] - value
            best = min(best, (GOOD_COST * lost / n_good + held / n_bad, -gap, value + gap / 2))
    return best[2]


def score(weights: list[float]) -> Column:
    table = F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate("_features", F.lit(0.0), lambda a, f: a + F.element_at(table, f + 1))
    return F.when(F.size("_features") > 0, total / F.size("_features")).otherwise(F.lit(0.0))


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lr_score", "base_failed", "kept")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the counts, ``lr_score``, ``base_failed`` and ``kept`` of each row.

    A null or empty text has no words, scores 0 and fails the base rules. Repeated rows and rows without an id
    are judged one by one. Columns of ``docs`` with the name of an added one are replaced. An empty table gives
    no rows. Labels are a table with doc_id and quality (1 good, 0 bad, null ignored; an id with both is bad).
    """
    rest = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return judged(docs, labels, id_col, text_col).select(*rest, *ADDED)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    return judged(docs, labels, id_col, text_col).where("kept").select("_doc.*")


def judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as structs ``_doc``, whatever their columns are called, with the columns of ADDED."""
    weights, threshold = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    text, lines = F.coalesce(F.col("_text"), F.lit("")), F.col("_lines")
    out = _features(rows.withColumn("_words", words(F.col("_text"))))
    third = F.slice("_hw", 3, F.greatest(F.col("_n") - 2, F.lit(0)))
    heads = F.slice("_hp", 1, F.greatest(F.col("_n") - 2, F.lit(0)))
    out = (
        out.withColumn("_tri", F.zip_with(heads, third, lambda p, w: F.xxhash64(p, w)))
        .withColumn("_order", _repeated_in_order(F.col("_tri")))
        .withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("n_words", F.col("_n").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("n_repeat_words", _repeat_words(F.col("_order")).cast("long"))
        .withColumn("lr_score", score(weights))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = F.lit(True) if threshold == float("-inf") else F.col("lr_score") >= F.lit(threshold)
    # Never false; as it may not be moved, filters on the result stay above it. Moved below, they would put whole
    # array expressions inside lambdas, to be evaluated for every element.
    fence = F.monotonically_increasing_id() >= 0
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & good & fence)
    return out.select("_doc", *ADDED)
