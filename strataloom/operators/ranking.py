"""Ranked retrieval: vector search against all rows, rank fusion, scopes, diversity, reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import score as S
from strataloom.sources.shared import cut

QUERY_BLOCK = 2048
"""Mean number of query vectors that one task holds."""
PART_ROWS = 16_384
"""Mean number of rows that one task compares with its queries."""
SHARPNESS = 10_000
"""Brackets of a percentile hold some 4 / SHARPNESS of a group's rows."""
STRIP = 128
"""Queries whose scores against a part are held at once."""


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    return rows


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores; the smaller id wins ties."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= least)
    else:
        few = np.arange(len(scores))
    return few[np.lexsort((ids[few], -scores[few]))][:k]


def vector_search(rows: DataFrame, queries: DataFrame, k: int | None, floor: float = -2.0, exclude_self: bool = False, within: bool = False, earlier: bool = False) -> DataFrame:
    """(query_id, id, score, rank): for each query vector the k rows with the largest cosine, at least ``floor``; if k is None,
    (query_id, id, score) of all rows at ``floor`` or above, unranked, so that no task has to sort a query's matches.

    ``rows`` and ``queries`` have id or query_id, and vec. With ``exclude_self`` a row's group (column ``grp`` on both
    sides) must differ; with ``within`` it must be the same, and the row another one; with ``earlier`` the row's id must
    be smaller. Rows are dealt into parts and queries into blocks, inside their group if ``within``; one task multiplies
    one part with one block, so neither side is ever whole in a task, and passes on its k best per query. Scores are
    rounded to four digits, and the smaller id wins ties. Rows or queries without an id or a vector have no results.
    """
    grouped = exclude_self or within
    own = rows.where("id is not null and vec is not null").select("id", "vec", (F.col("grp") if grouped else F.lit(0)).alias("grp"))
    asked = queries.where("query_id is not null and vec is not null").select("query_id", "vec", (F.col("grp") if grouped else F.lit(0)).alias("grp"))
    home = F.col("grp") if within else F.lit(0)
    count = lambda df, size, name: df.groupBy(home.alias("_g")).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("long").alias(name))
    sizes = count(own, PART_ROWS, "_parts").join(count(asked, QUERY_BLOCK, "_blocks"), "_g")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = own.withColumn("_g", home).join(sizes, "_g").withColumn("_part", F.pmod(F.xxhash64("id"), "_parts")).withColumn("_block", upto("_blocks"))
    asked = asked.withColumn("_g", home).join(sizes, "_g").withColumn("_block", F.pmod(F.xxhash64("query_id"), "_blocks")).withColumn("_part", upto("_parts"))
    asked = asked.select(F.col("_g").alias("_h"), F.col("_part").alias("_p"), F.col("_block").alias("_b"), F.col("query_id").alias("query"), F.col("vec").alias("asked"), F.col("grp").alias("of"))

    def best(own: pa.Table, sent: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        if own.num_rows and sent.num_rows:
            ids, groups, matrix = own["id"].to_numpy(), own["grp"].to_numpy(), matrix_of(own["vec"])
            names, theirs = sent["query"].to_numpy(), sent["of"].to_numpy()
            for a in range(0, len(names), STRIP):
                scores = matrix_of(sent["asked"].slice(a, STRIP)) @ matrix.T
                np.round(scores, 4, out=scores)
                for q, grp, row in zip(names[a : a + STRIP], theirs[a : a + STRIP], scores):
                    ok = row >= floor
                    if exclude_self:
                        ok &= groups != grp
                    if within:
                        ok &= ids != q
                    if earlier:
                        ok &= ids < q
                    where = np.flatnonzero(ok)
                    if k is not None:
                        where = where[best_of(row[where], ids[where], k)]
                    out.append((np.full(len(where), q), ids[where], row[where]))
        return pa.table(dict(zip(("query_id", "id", "score"), (np.concatenate(c) for c in zip(*out)))))

    found = own.groupBy("_g", "_part", "_block").cogroup(asked.groupBy("_h", "_p", "_b")).applyInArrow(best, "query_id long, id long, score double")
    if k is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(rows: DataFrame, score: str = "score", group=("query_id", "path"), tie: str = "chunk_id") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), F.asc(tie))))


def rank_fusion(candidates: DataFrame, k: int = S.RRF_K, group=("query_id",), scale: float = S.GRAPH_SCALE) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, path, rank, chunk_id, consistency, level, reward)."""
    weight = S.path_weight(F.col("path"), scale) * S.consistency_factor(F.col("consistency")) * S.level_factor(F.col("level")) * F.col("reward")
    scored = candidates.withColumn("_s", weight / (k + F.col("rank")))
    return scored.groupBy(*group, "chunk_id").agg(
        F.round(F.sum("_s"), 9).alias("rrf"), F.array_sort(F.collect_set("path")).alias("paths"), F.max("reward").alias("reward")
    )


def z_scores(rows: DataFrame, group: str, score: str) -> DataFrame:
    """Adds ``z``: the score standardised within a group; groups of one row keep theirs, groups without spread are centred.

    Statistics are aggregated and joined back, so a group that holds most rows stays dealt over all tasks.
    """
    stats = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_spread"))
    centred = F.col(score) - F.col("_mean")
    z = F.when(F.col("_n") < 2, F.col(score)).when(F.col("_spread") > 0, centred / F.col("_spread")).otherwise(centred)
    return rows.join(stats, group).withColumn("z", z).drop("_n", "_mean", "_spread")


def exact_percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the value at place floor(share * n) in ascending order, from 0, for each named share, and ``mean``.

    A sketch brackets each share between two values of the group, and one pass counts the rows below the bracket and the
    rows of each value inside; only those are put in order. The sketch's error in rank is n / SHARPNESS at most, so where
    values lie, and how far outliers reach, makes no difference; were a place outside its bracket, all values of its
    group would be counted. Rows of an equal value are one row here.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    edges = [min(1.0, max(0.0, s + sign * 2 / SHARPNESS)) for s in shares.values() for sign in (-1, 1)]
    sketch = rows.groupBy("_g").agg(F.percentile_approx("_v", edges, SHARPNESS).alias("_edges"), F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("mean"))
    asks = F.array(*[
        F.struct(F.lit(name).alias("name"), F.floor(F.col("_n") * s).alias("at"), F.get("_edges", F.lit(2 * k)).alias("low"), F.get("_edges", F.lit(2 * k + 1)).alias("high"))
        for k, (name, s) in enumerate(shares.items())
    ])
    targets = cut(sketch.select("_g", "mean", F.explode(asks).alias("_ask")).select("_g", "mean", "_ask.*"))

    def placed(targets: DataFrame) -> DataFrame:
        near = rows.join(targets.select("_g", "name", "low", "high"), rows["_g"].eqNullSafe(targets["_g"])).drop(targets["_g"]).where((F.col("_v") <= F.col("high")) | F.col("high").isNull())
        inside = F.when(F.col("low").isNull() | (F.col("_v") >= F.col("low")), F.col("_v"))  # null: below the bracket
        counted = near.groupBy("_g", "name", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy("_g", "name").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("_upto", upto).withColumnsRenamed({"_g": "_h", "name": "_name"})
        both = counted.join(targets.select("_g", "name", "at"), F.col("_h").eqNullSafe(F.col("_g")) & (F.col("_name") == F.col("name")))
        return both.where((F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("_c"))).select("_g", "name", "_v")

    found = cut(placed(targets))
    on = lambda other: targets["_g"].eqNullSafe(other["_g"]) & (targets["name"] == other["name"])
    missed = targets.join(found.where("_v is not null"), on(found), "left_anti")
    if not missed.isEmpty():
        all_ = missed.withColumns({"low": F.lit(None).cast(dict(targets.dtypes)["low"]), "high": F.lit(None).cast(dict(targets.dtypes)["high"])})
        found = found.unionByName(placed(cut(all_)))
    values = targets.join(found.where("_v is not null"), on(found)).select(targets["_g"], targets["name"], "mean", "_v")
    return values.groupBy(F.col("_g").alias(group)).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in shares], F.first("mean").alias("mean"))


def diverse(rows: DataFrame, k: int, weight: float = 0.6, group: str = "query_id") -> DataFrame:
    """Maximal marginal relevance within each group: (group, id, pick) from id, score and vec.

    The best score comes first; each next pick has the largest weight * score - (1 - weight) * its closest pick.
    Groups are candidate lists of a bounded length.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        matrix, score = np.stack(pdf["vec"].to_numpy()).astype(np.float64), pdf["score"].to_numpy(np.float64)
        chosen, closest = [0], matrix @ matrix[0]
        while len(chosen) < min(k, len(pdf)):
            value = weight * score - (1 - weight) * closest
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(np.round(value, 9))))
            closest = np.maximum(closest, matrix @ matrix[chosen[-1]])
        return pd.DataFrame({group: pdf[group].iloc[0], "id": pdf["id"].to_numpy()[chosen], "pick": np.arange(1, len(chosen) + 1)})

    return rows.groupBy(group).applyInPandas(pick, f"{group} long, id long, pick long")


def centroids(rows: DataFrame, key: str, vec: str = "vec", weight: Column | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Unit-length (weighted) mean vector per key, by position. ``vectors`` holds all vectors of ``rows`` where it is cheaper to read."""
    from strataloom.functions import vector as V

    w = weight if weight is not None else F.lit(1.0)
    size = F.size("x")
    rows = rows.select(key, w.alias("w"), F.col(vec).alias("x")).where(size > 0)
    held = (rows if vectors is None else vectors.select(F.col(vec).alias("x")).where(size > 0)).agg(F.min(size).alias("least"), F.max(size).alias("most")).first()
    many = held["most"] or 0  # one sum a position: a key travels as one row
    total = lambda i: F.sum("w") if held["least"] == many else F.sum(F.when(size > i, F.col("w")))
    means = rows.groupBy(key).agg(F.max(size).alias("n"), *[(F.sum(F.col("w") * F.get("x", F.lit(i)).cast("double")) / total(i)).alias(f"m{i}") for i in range(many)])
    return means.select(key, V.unit(F.slice(F.array(*[f"m{i}" for i in range(many)]).cast("array<double>"), F.lit(1), F.col("n"))).alias("vec"))
