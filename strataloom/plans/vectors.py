"""Queries over dense vectors: search, centroids, links, fusion, reranking, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import score as S
from strataloom.functions import text as X
from strataloom.functions import vector as V
from strataloom.operators import graph as G
from strataloom.operators import ranking as R
from strataloom.operators import vector_index as I
from strataloom.plans.registry import CONTAINS, VECTORS, Graph, query
from strataloom.plans.texts import any_sql

QUERY_STEP = 20
"""Searches take every vector whose id this divides as a query, against all vectors."""
COS = "round(list_inner_product(q.vec, v.vec) / (sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(v.vec, v.vec))), 4)"
CENTROIDS = f"""{VECTORS}, parts AS (SELECT grp, pos, avg(vec[pos]) AS m FROM vectors, range(1, 65) t(pos) GROUP BY 1, 2), means AS (SELECT grp, list(m ORDER BY pos) AS m FROM parts GROUP BY 1),
    centers AS (SELECT grp AS query_id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS vec FROM means)"""


def asked(g):
    return g.vectors().where(F.col("id") % QUERY_STEP == 0).select(F.col("id").alias("query_id"), "vec", "grp")


def label_centers(g):
    return R.centroids(g.vectors(), "grp").select(F.col("grp").cast("long").alias("query_id"), "vec")


@query(f"""WITH {VECTORS}, q AS (SELECT id AS query_id, vec FROM vectors WHERE id % {QUERY_STEP} = 0), s AS (SELECT query_id, v.id, {COS} AS score FROM q, vectors v)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 30""")
def top_1_vector_search(spark, d):
    g = Graph(spark, d)
    return R.vector_search(g.vectors(), asked(g).select("query_id", "vec"), 30)


@query(f"""WITH {VECTORS}, s AS (SELECT v.grp AS query_id, v.id, round(sqrt(list_inner_product(v.vec, v.vec)), 4) AS length, round(v.vec[1] / sqrt(list_inner_product(v.vec, v.vec)), 4) AS first FROM vectors v) SELECT * FROM s""")
def fn_30_unit_vectors(spark, d):
    return Graph(spark, d).vectors().select(
        F.col("grp").alias("query_id"), "id", F.round(V.norm(F.col("vec")), 4).alias("length"), F.round(F.element_at(V.unit(F.col("vec")), 1), 4).alias("first")
    )


@query(f"""WITH {VECTORS}, e AS (SELECT id, list_transform(vec, lambda x: exp(x)) AS e FROM vectors) SELECT id, round(e[1] / list_sum(e), 6) AS p1, round(e[64] / list_sum(e), 6) AS p64 FROM e""")
def fn_31_softmax(spark, d):
    rows = Graph(spark, d).vectors().select("id", V.softmax(F.col("vec")).alias("s"))
    return rows.select("id", F.round(F.element_at("s", 1), 6).alias("p1"), F.round(F.element_at("s", -1), 6).alias("p64"))


@query(f"WITH {CENTROIDS} SELECT query_id, pos, round(vec[pos], 4) AS x FROM centers, range(1, 65) t(pos)")
def agg_5_intent_centroids(spark, d):
    rows = label_centers(Graph(spark, d)).select("query_id", F.posexplode("vec").alias("p", "x"))
    return rows.select("query_id", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 4).alias("x"))


@query(f"""WITH {VECTORS}, w AS (SELECT grp, vec, 1.0 + id % 3 AS w FROM vectors), parts AS (SELECT grp, pos, sum(w * vec[pos]) / sum(w) AS m FROM w, range(1, 65) t(pos) GROUP BY 1, 2),
    means AS (SELECT grp, list(m ORDER BY pos) AS m FROM parts GROUP BY 1) SELECT grp, round(m[1] / sqrt(list_inner_product(m, m)), 4) AS first, round(m[64] / sqrt(list_inner_product(m, m)), 4) AS last FROM means""")
def agg_4_weighted_centroids(spark, d):
    rows = R.centroids(Graph(spark, d).vectors(), "grp", weight=1.0 + F.col("id") % 3)
    return rows.select("grp", F.round(F.element_at("vec", 1), 4).alias("first"), F.round(F.element_at("vec", -1), 4).alias("last"))


def nearest(vectors, to):
    """(id, query_id, score): for each vector (id, vec) the nearest of some named vectors (query_id, vec), the smaller name of equals."""
    found = R.vector_search(to.select(F.col("query_id").alias("id"), "vec"), vectors.select(F.col("id").alias("query_id"), "vec"), 1)
    return found.select(F.col("query_id").alias("id"), F.col("id").alias("query_id"), "score")


def routed(g, vectors, among=None):
    """(id, label, score, route, guard) of vectors (id, vec): the guards on a question's text first (the document of the same id), then
    its nearest centroid; below the floors it is out of the domain, or a plain question. ``among`` is a condition that the
    documents of all vectors fulfil, so that no other text is looked at."""
    best = nearest(vectors, label_centers(g))
    texts = g.read("documents").where(F.lit(True) if among is None else among).groupBy(F.col("doc_id").alias("id")).agg(F.max(X.out_of_domain(F.col("text"))).alias("ood"), F.max(X.corpus_wide(F.col("text"))).alias("wide"))
    guard = F.when(F.col("ood"), "out_of_domain").when(F.col("wide"), "global")
    floors = F.when(F.col("score") < 0.40, "out_of_domain").when(F.col("score") < 0.45, "factual").otherwise("label")
    return best.join(texts, "id", "left").select("id", F.col("query_id").alias("label"), "score", F.coalesce(guard, floors).alias("route"), guard.alias("guard"))


@query(f"""WITH {CENTROIDS}, s AS (SELECT v.id, q.query_id AS label, {COS} AS score FROM centers q, vectors v QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY score DESC, label) = 1),
    t AS (SELECT doc_id AS id, bool_or({any_sql("text", X.OUT_OF_DOMAIN)}) AS ood, bool_or({any_sql("text", X.CORPUS_WIDE)}) AS wide FROM documents GROUP BY 1)
    SELECT id, label, score, CASE WHEN ood THEN 'out_of_domain' WHEN wide THEN 'global' WHEN score < 0.40 THEN 'out_of_domain' WHEN score < 0.45 THEN 'factual' ELSE 'label' END AS route FROM s LEFT JOIN t USING (id)""")
def qry_1_router(spark, d):
    """The route of each vector: guards, then centroids."""
    g = Graph(spark, d)
    return routed(g, g.vectors().select("id", "vec")).drop("guard")


@query(f"""WITH {VECTORS}, s AS (SELECT q.id AS query_id, v.id, {COS} AS score FROM vectors q JOIN vectors v ON q.grp <> v.grp)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.25 QUALIFY rank <= 5""")
def join_14_cross_document_links(spark, d):
    """For every chunk its closest chunks of other documents."""
    g = Graph(spark, d)
    return R.vector_search(g.vectors(), g.vectors().withColumnRenamed("id", "query_id"), 5, floor=0.25, exclude_self=True)


@query(f"""WITH {VECTORS}, s AS (SELECT q.id AS a, v.id AS b, {COS} AS score FROM vectors q JOIN vectors v ON q.grp = v.grp AND q.id <> v.id) SELECT a, b, score FROM s WHERE score >= 0.25
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5""")
def join_15_links_in_document(spark, d):
    """For every chunk its closest chunks of the same document."""
    g = Graph(spark, d)
    found = R.vector_search(g.vectors(), g.vectors().withColumnRenamed("id", "query_id"), 5, floor=0.25, within=True)
    return found.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score")


@query(f"""WITH {VECTORS}, s AS (SELECT q.id AS query_id, q.grp AS g1, v.id, v.grp AS g2, {COS} AS score FROM vectors q JOIN vectors v ON q.grp <> v.grp), links AS (SELECT * FROM s WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5),
    edges AS (SELECT DISTINCT least(query_id, id) AS a, greatest(query_id, id) AS b, least(g1, g2) AS d1, greatest(g1, g2) AS d2, score FROM links)
    SELECT d1, d2, count(*) AS edges, round(avg(score), 6) AS avg_score FROM edges GROUP BY 1, 2 HAVING count(*) >= 5 AND avg(score) >= 0.28""")
def join_22_document_links(spark, d):
    """Document pairs by the links between their chunks: five or more, and similar enough on average."""
    g = Graph(spark, d)
    links = R.vector_search(g.vectors(), g.vectors().withColumnRenamed("id", "query_id"), 5, floor=0.25, exclude_self=True)
    pair = links.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "score").distinct()
    owner = g.vectors().select("id", "grp")
    docs = pair.join(owner.toDF("a", "g1"), "a").join(owner.toDF("b", "g2"), "b").select(F.least("g1", "g2").alias("d1"), F.greatest("g1", "g2").alias("d2"), "score")
    return docs.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("score"), 6).alias("avg_score")).where("edges >= 5 and avg_score >= 0.28")


@query(f"""WITH {VECTORS} SELECT id, round(list_inner_product(vec[1:32], vec[33:64]) / (sqrt(list_inner_product(vec[1:32], vec[1:32])) * sqrt(list_inner_product(vec[33:64], vec[33:64]))), 4) AS consistency FROM vectors""")
def agg_12_view_consistency(spark, d):
    rows = Graph(spark, d).vectors().select("id", F.slice("vec", 1, 32).alias("a"), F.slice("vec", 33, 32).alias("b"))
    return rows.select("id", F.round(V.cosine(F.col("a"), F.col("b")), 4).alias("consistency"))


@query(f"""WITH {VECTORS}, s AS (SELECT id, grp, list_inner_product(vec, lag(vec) OVER (PARTITION BY grp ORDER BY id)) AS c FROM vectors) SELECT id, round(c, 4) AS drift, c < 0 AS shift FROM s WHERE c IS NOT NULL""")
def win_3_adjacent_cosine(spark, d):
    from pyspark.sql import Window

    before = F.lag("vec").over(Window.partitionBy("grp").orderBy("id"))
    rows = Graph(spark, d).vectors().select("id", "vec", before.alias("p")).where(F.col("p").isNotNull())
    return rows.withColumn("c", V.dot(F.col("vec"), F.col("p"))).select("id", F.round("c", 4).alias("drift"), (F.col("c") < 0).alias("shift"))


PATHS = f"""paths AS (SELECT query_id, 'original' AS path, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, v.id, {COS} AS score FROM centers q, vectors v) QUALIFY rank <= 30
    UNION ALL SELECT grp, 'entity_pivot', id, n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, id) AS r FROM (SELECT v.grp, v.id, count(*) AS n FROM vectors v JOIN contains_ ON chunk_id = v.id GROUP BY 1, 2) QUALIFY r <= 30)"""
FACTORS = "CASE WHEN id % 100 >= 85 THEN 1.2 WHEN id % 100 >= 60 THEN 1.0 ELSE 0.8 END * CASE id % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 WHEN 2 THEN 1.1 ELSE 0.7 END"


@query(f"""WITH {CONTAINS}, {CENTROIDS}, {PATHS}, w AS (SELECT query_id, id, path, (CASE path WHEN 'original' THEN 1.0 ELSE 1.5 * 0.2 END) * {FACTORS} / (60 + rank) AS s FROM paths)
    SELECT query_id, id AS chunk_id, round(sum(s), 9) AS rrf, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) <= 50""")
def ret_10_rank_fusion(spark, d):
    """A vector path and an entity path per label, fused: the 50 best chunks of each."""
    g = Graph(spark, d)
    dense = R.vector_search(g.vectors(), label_centers(g), 30).select("query_id", F.lit("original").alias("path"), F.col("id").alias("chunk_id"), "rank")
    pivot = g.vectors().join(g.contains(), F.col("id") == F.col("chunk_id")).groupBy(F.col("grp").cast("long").alias("query_id"), "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    pivot = G.top_per(pivot, ["query_id"], [F.desc("n"), F.asc("chunk_id")], 30).select("query_id", F.lit("entity_pivot").alias("path"), "chunk_id", "rank")
    level = F.element_at(F.array(*map(F.lit, ("sentence", "paragraph", "section", "document"))), (F.col("chunk_id") % 4 + 1).cast("int"))
    rows = dense.unionByName(pivot).withColumns({"consistency": (F.col("chunk_id") % 100) / 100, "level": level, "reward": F.lit(1.0)})
    fused = R.rank_fusion(rows).withColumn("paths", F.array_join("paths", ","))
    return G.top_per(fused, ["query_id"], [F.desc("rrf"), F.asc("chunk_id")], 50).select("query_id", "chunk_id", "rrf", "paths")


@query(f"""WITH {CENTROIDS}, s AS (SELECT query_id, v.id, {COS} AS score FROM centers q, vectors v), views AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 30
    UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS r FROM s QUALIFY r <= 30) SELECT query_id, id, round(sum(1.0 / (60 + r)), 9) AS rrf FROM views GROUP BY 1, 2""")
def top_3_multi_view_fusion(spark, d):
    g = Graph(spark, d)
    near = R.vector_search(g.vectors(), label_centers(g), 30).select("query_id", "id", "rank")
    turned = g.vectors().withColumn("vec", F.transform("vec", lambda x: -x))
    views = near.unionByName(R.vector_search(turned, label_centers(g), 30).select("query_id", "id", "rank"))
    return views.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("rrf"))


@query(f"""WITH {CENTROIDS}, s AS (SELECT query_id, v.id, {COS} AS c FROM centers q, vectors v), best AS (SELECT id, max(c) AS c FROM s GROUP BY 1)
    SELECT grp, round(avg(CASE WHEN c >= 0.60 THEN 1.0 WHEN c <= 0.40 THEN 0.0 ELSE (c - 0.40) / 0.20 END), 6) AS grounded FROM best JOIN vectors USING (id) GROUP BY 1""")
def val_1_grounding(spark, d):
    g = Graph(spark, d)
    best = nearest(g.vectors().select("id", "vec"), label_centers(g)).select("id", "score").join(g.vectors().select("id", "grp"), "id")
    return best.groupBy("grp").agg(F.round(F.avg(S.grounding_credit(F.col("score"))), 6).alias("grounded"))


@query()
def top_4_diverse_selection(spark, d):
    g = Graph(spark, d)
    found = R.vector_search(g.vectors(), label_centers(g), 200).select("query_id", "id", "score")
    return R.diverse(found.join(g.vectors().select("id", "vec"), "id"), 20)


@query(f"""WITH {CENTROIDS}, b AS (SELECT v.id, v.grp, exp(list_inner_product(q.vec, v.vec) / 8.0) AS e, q.vec AS k, v.vec AS own FROM centers q, vectors v), z AS (SELECT id, pos, 0.65 * any_value(own[pos]) + 0.35 * sum(e * k[pos]) / sum(e) AS x FROM b, range(1, 65) t(pos) GROUP BY 1, 2),
    n AS (SELECT id, list(x ORDER BY pos) AS x FROM z GROUP BY 1) SELECT id, round(x[1] / sqrt(list_inner_product(x, x)), 4) + 0.0 AS first, round(x[64] / sqrt(list_inner_product(x, x)), 4) + 0.0 AS last FROM n""")
def fn_35_graph_aware_vectors(spark, d):
    g = Graph(spark, d)
    keys = label_centers(g).withColumnRenamed("vec", "k")  # one row per label
    scored = g.vectors().join(F.broadcast(keys)).withColumn("e", F.exp(V.dot(F.col("vec"), F.col("k")) / 8.0))
    parts = scored.select("id", "e", F.posexplode(F.arrays_zip("k", "vec")).alias("pos", "x"))
    mixed = parts.groupBy("id", "pos").agg((0.65 * F.first("x.vec") + 0.35 * F.sum(F.col("e") * F.col("x.k")) / F.sum("e")).alias("m"))
    rows = mixed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).getField("m").alias("v")).withColumn("v", V.unit(F.col("v")))
    return rows.select("id", (F.round(F.element_at("v", 1), 4) + 0.0).alias("first"), (F.round(F.element_at("v", -1), 4) + 0.0).alias("last"))


# through the index; the exact searches above hold the same results to a measured recall


@query()
def top_1_index_search(spark, d):
    g = Graph(spark, d)
    return I.index_search(I.build_index(g.vectors(), k=30), asked(g).select("query_id", "vec"), 30)


@query()
def join_14_index_links(spark, d):
    """Links between documents as in ``join_14_cross_document_links``, each vector compared with its nearest cells."""
    g = Graph(spark, d)
    return I.index_search(I.build_index(g.vectors()), g.vectors().withColumnRenamed("id", "query_id"), 5, floor=0.25, exclude_self=True)


@query()
def join_15_index_links(spark, d):
    g = Graph(spark, d)
    return I.index_search(I.build_index(g.vectors()), g.vectors().withColumnRenamed("id", "query_id"), 5, floor=0.25, within=True)


@query()
def join_22_index_documents(spark, d):
    """Documents with links between their chunks: how many, and their mean cosine."""
    g = Graph(spark, d)
    links = I.index_search(I.build_index(g.vectors()), g.vectors().withColumnRenamed("id", "query_id"), 5, floor=0.25, exclude_self=True)
    ends = g.vectors().select("id", "grp")
    pairs = links.join(ends.toDF("query_id", "g1"), "query_id").join(ends.toDF("id", "g2"), "id")
    grouped = pairs.groupBy(F.least("g1", "g2").alias("d1"), F.greatest("g1", "g2").alias("d2"))
    return grouped.agg(F.count(F.lit(1)).alias("links"), F.round(F.avg("score"), 6).alias("mean")).where("links >= 5")
