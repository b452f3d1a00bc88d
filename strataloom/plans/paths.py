"""Queries of the retrieval paths over real entity vectors, and of the actions that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import score as S
from strataloom.functions import vector as V
from strataloom.operators import graph as G
from strataloom.operators import ranking as R
from strataloom.operators import retrieval as P
from strataloom.plans.graphs import ranked_chunks
from strataloom.plans.joins import ASKED
from strataloom.plans.registry import CONTAINS, ENTITIES, VECTORS, Graph, query
from strataloom.plans.vectors import CENTROIDS, COS, QUERY_STEP, asked, label_centers, routed
from strataloom.sources.shared import cut

EV = f"""{VECTORS}, {CONTAINS}, ev_parts AS (SELECT entity_id, pos, avg(vec[pos]) AS x FROM contains_ JOIN vectors ON chunk_id = id, range(1, 65) t(pos) GROUP BY 1, 2), ev_mean AS (SELECT entity_id, list(x ORDER BY pos) AS m FROM ev_parts GROUP BY 1),
    ev AS (SELECT entity_id AS id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS vec FROM ev_mean), q AS (SELECT id AS query_id, vec FROM vectors WHERE id % {QUERY_STEP} = 0)"""
CENTERS = CENTROIDS.removeprefix(f"{VECTORS}, ")
AWARE = f"""{EV}, b AS (SELECT c.chunk_id, exp(list_inner_product(e.vec, v.vec) / 8.0) AS e, e.vec AS k, v.vec AS own FROM contains_ c JOIN ev e ON e.id = c.entity_id JOIN vectors v ON v.id = c.chunk_id),
    z AS (SELECT chunk_id, pos, 0.65 * any_value(own[pos]) + 0.35 * sum(e * k[pos]) / sum(e) AS x FROM b, range(1, 65) t(pos) GROUP BY 1, 2), n AS (SELECT chunk_id, list(x ORDER BY pos) AS x FROM z GROUP BY 1),
    aware AS (SELECT v.id, coalesce(x, v.vec) AS vec FROM vectors v LEFT JOIN n ON chunk_id = id)"""
FOUND = f"s AS (SELECT query_id, v.id AS entity_id, {COS} AS score FROM q, ev v), near AS (SELECT query_id, entity_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM s QUALIFY rank <= {{k}})"

LEVEL = "CASE WHEN n >= 6 THEN 'document' WHEN n >= 4 THEN 'section' WHEN n >= 2 THEN 'paragraph' ELSE 'sentence' END"
"""A chunk's level by its number of entities, n."""


def parts(spark, d):
    g = Graph(spark, d)
    return g, P.entity_vectors(g.held(), g.vectors()), asked(g)


@query(f"WITH {EV}, {FOUND.format(k=20)} SELECT query_id, entity_id, score, rank FROM near")
def top_6_entity_search(spark, d):
    g, entities, queries = parts(spark, d)
    return P.entity_search(entities, queries)


@query(f"""WITH {EV}, {FOUND.format(k=90)}, c AS (SELECT query_id, chunk_id, count(*) AS matches, round(avg(score), 9) AS score FROM near JOIN contains_ USING (entity_id) GROUP BY 1, 2)
    SELECT query_id, chunk_id, matches, score, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, score DESC, chunk_id) AS rank FROM c QUALIFY rank <= 30""")
def ret_3_graph_path(spark, d):
    """Chunks of the closest entities, with the mean cosine of those in them."""
    g, entities, queries = parts(spark, d)
    return P.graph_path(entities, g.contains(), queries)


@query(f"""WITH {EV}, s AS (SELECT query_id, v.id AS entity_id, {COS} AS score FROM q, ev v) SELECT query_id, chunk_id, round(avg(score), 9) AS score, count(*) AS matches FROM s JOIN contains_ USING (entity_id) WHERE score >= 0.2 GROUP BY 1, 2""")
def agg_21_graph_scores(spark, d):
    """Per query and chunk the mean cosine of the entities that match."""
    g, entities, queries = parts(spark, d)
    return P.graph_scores(entities, g.listed(), queries, 0.2)


@query(f"""WITH {EV}, df AS (SELECT entity_id, count(DISTINCT o_custkey) AS df FROM contains_ JOIN orders ON chunk_id = o_orderkey GROUP BY 1), n AS (SELECT count(DISTINCT o_custkey) AS n FROM contains_ JOIN orders ON chunk_id = o_orderkey),
    seeds AS (SELECT query_id, v.id AS chunk_id, {COS} AS score FROM q, vectors v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 100),
    inside AS (SELECT query_id, entity_id, count(*) AS m FROM seeds JOIN contains_ USING (chunk_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m DESC, entity_id) <= 200),
    scored AS (SELECT i.query_id, i.entity_id, round({COS} * least(5.0, greatest(0.1, ln((n + 1) / (df + 1)))), 6) AS score FROM inside i JOIN q USING (query_id) JOIN ev v ON v.id = i.entity_id JOIN df USING (entity_id), n),
    best AS (SELECT query_id, entity_id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) <= 20)
    SELECT query_id, chunk_id, count(*) AS matches, round(least(1.0, count(*) / 20.0), 6) AS score FROM best JOIN contains_ USING (entity_id) GROUP BY 1, 2""")
def ret_5_entity_weights(spark, d):
    """Chunks by the 20 entities of the closest chunks with the largest cosine times inverse document frequency."""
    g, entities, queries = parts(spark, d)
    seeds = R.vector_search(g.vectors(), queries.select("query_id", "vec"), 100).select("query_id", F.col("id").alias("chunk_id"))
    scored = P.weighted_entities(seeds, g.contains(), g.mentions(), entities, queries)
    best = G.top_per(scored, ["query_id"], [F.desc("score"), F.asc("id")], 20).select("query_id", F.col("id").alias("entity_id"))
    hits = best.join(g.contains(), "entity_id").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("matches"))
    return hits.withColumn("score", F.round(F.least(F.lit(1.0), F.col("matches") / 20.0), 6))


@query()
def ret_5_entity_cosine(spark, d):
    g, entities, queries = parts(spark, d)
    return P.entity_cosine(g.vectors(), g.contains(), g.mentions(), entities, queries)


@query()
def ret_6_entity_gate(spark, d):
    g, entities, queries = parts(spark, d)
    return P.entity_gate(g.vectors(), g.contains(), g.mentions(), entities, queries)


@query(f"""WITH {EV}, {ENTITIES}, {FOUND.format(k=20)}, both_ AS (SELECT query_id, entity_id FROM near UNION SELECT q.query_id, e.entity_id FROM q, (SELECT entity_id FROM entities WHERE name IN {ASKED} ORDER BY entity_id LIMIT 50) e),
    n AS (SELECT query_id, count(*) AS n FROM both_ GROUP BY 1), c AS (SELECT query_id, chunk_id, count(*) AS matches, round(least(1.0, count(*) / any_value(n)), 9) AS score FROM both_ JOIN n USING (query_id) JOIN contains_ USING (entity_id) GROUP BY 1, 2)
    SELECT query_id, chunk_id, matches, score, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, score DESC, chunk_id) AS rank FROM c QUALIFY rank <= 50""")
def ret_8_entity_first(spark, d):
    """Chunks by the entities that a question names, or else are closest to it."""
    g, entities, queries = parts(spark, d)
    names = g.entities().where(F.col("name").isin(*ASKED)).orderBy("entity_id").limit(50).select("entity_id")  # the names of one question
    return P.entity_first(entities, g.contains(), queries, queries.select("query_id").crossJoin(F.broadcast(names)))


def all_paths(spark, d):
    """The graph, the asked vectors, the graph-aware view, and (query_id, path, chunk_id, rank) of every path for every asked vector.

    What several paths read is made once: the mentions of entities that have vectors, how many documents mention them, entity
    vectors, and the closest chunks. Of all other mentions no path needs the rows."""
    g = Graph(spark, d)
    entities, queries = cut(P.entity_vectors(g.held(), g.vectors())), asked(g)
    contains = cut(G.sieved(g.listed(), "entity_id", entities.select("id")).distinct().join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"))
    g.owners = lambda owners=cut(g.owners()): owners
    within = G.sieved(g.read("orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id")), "chunk_id", contains.select("chunk_id"))
    docs = g.owners().agg(F.count(F.when(F.col("kept") > 0, F.col("doc_id"))).alias("docs"))
    df = cut(P.frequencies(contains.join(within, "chunk_id").select("doc_id", "entity_id").distinct(), docs))
    plain = queries.select("query_id", "vec")
    closest = cut(R.vector_search(g.vectors(), plain, 200))
    named_as = lambda rows, path: rows.select("query_id", F.lit(path).alias("path"), "chunk_id", "rank")
    view = lambda rows: R.vector_search(rows, plain, 30).withColumnRenamed("id", "chunk_id")
    short = g.vectors().select("id", F.concat(F.slice("vec", 1, 32), F.array_repeat(F.lit(0.0).cast("float"), 32)).alias("vec"))  # the summary view
    aware = cut(graph_aware(g, entities, contains))
    centers = label_centers(g)
    near = R.vector_search(centers.select(F.col("query_id").alias("id"), "vec"), plain, 1).select("query_id", F.col("id").alias("grp"))
    members = near.join(g.vectors().select(F.col("id").alias("chunk_id"), F.col("grp").cast("long").alias("grp")), "grp")
    community = G.top_per(members, ["query_id"], [F.asc("chunk_id")], 30)
    named = g.entities().where(F.col("name").isin(*ASKED)).select("entity_id")
    pivot = G.sieved(g.listed(), "entity_id", named).distinct().join(named, "entity_id").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    pivot = pivot.orderBy(F.desc("n"), "chunk_id").limit(30)  # the path's k, the same for all questions that name the parts
    walked = ranked_chunks(g, 20).orderBy(F.desc("score"), "chunk_id").limit(30)  # the path's k
    every = lambda rows, order: queries.select("query_id").crossJoin(F.broadcast(R.ranked(rows.withColumn("_one", F.lit(1)), order, ("_one",)).select("chunk_id", "rank")))  # noqa: E731  30 rows
    out = [
        named_as(closest.where("rank <= 30").withColumnRenamed("id", "chunk_id"), "original:dense"), named_as(view(aware), "original:graph_aware"), named_as(view(short), "original:summary"),
        named_as(P.graph_path(entities, contains, queries), "graph"), named_as(community, "community"), named_as(every(pivot, "n"), "entity_pivot"), named_as(every(walked, "score"), "ppr"),
        named_as(P.entity_cosine(g.vectors(), contains, df, entities, queries, near=closest), "entity_cosine"),
        named_as(P.entity_gate(g.vectors(), contains, df, entities, queries, near=closest), "entity_gate"),
    ]
    for rows in out[1:]:
        out[0] = out[0].unionByName(rows)
    return g, queries, aware, out[0]


def graph_aware(g, entities, contains=None):
    """(id, vec): a chunk's vector drawn towards those of its entities, 0.65 to 0.35, the entities weighed by softmax of their products."""
    held = (g.held() if contains is None else contains).join(g.vectors().select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    rows = held.join(entities.select(F.col("id").alias("entity_id"), F.col("vec").alias("k")), "entity_id")
    rows = rows.join(g.vectors().select(F.col("id").alias("chunk_id"), "vec"), "chunk_id").withColumn("e", F.exp(V.dot(F.col("vec"), F.col("k")) / 8.0))
    # keys and weights are summed position by position, so a chunk travels as one row
    many = g.vectors().agg(F.max(F.size("vec")).alias("n")).first()["n"] or 0
    sums = [F.sum(F.col("e") * F.get("k", F.lit(i)).cast("double")).alias(f"k{i}") for i in range(many)]
    mixed = rows.groupBy("chunk_id").agg(F.sum("e").alias("e"), F.first("vec").alias("own"), *sums)
    keys = F.slice(F.array(*[f"k{i}" for i in range(many)]).cast("array<double>"), F.lit(1), F.size("own"))
    drawn = mixed.select("chunk_id", F.zip_with("own", keys, lambda o, k: 0.65 * o + 0.35 * k / F.col("e")).alias("v"))
    both = g.vectors().join(drawn.withColumnRenamed("chunk_id", "id"), "id", "left")
    return both.select("id", F.coalesce(V.unit(F.col("v")), V.doubles(F.col("vec"))).alias("vec"))


@query(f"""WITH {AWARE} SELECT v.id, round(coalesce(x[1] / sqrt(list_inner_product(x, x)), v.vec[1]), 4) + 0.0 AS first, round(coalesce(x[64] / sqrt(list_inner_product(x, x)), v.vec[64]), 4) + 0.0 AS last FROM vectors v LEFT JOIN n ON chunk_id = id""")
def grf_10_refined_vectors(spark, d):
    """Every chunk's vector refined by the vectors of the entities in it."""
    g, entities, _ = parts(spark, d)
    return graph_aware(g, entities).select("id", (F.round(F.element_at("vec", 1), 4) + 0.0).alias("first"), (F.round(F.element_at("vec", -1), 4) + 0.0).alias("last"))


INTENTS = tuple(P.STRATEGY)


def payload(g, aware):
    """What a store keeps beside a chunk's vector: its payload columns, n and level by its entities, the agreement of its dense and
    graph-aware views, its reward by the closeness to its label, its source's share of chunks with entities, and keep (has one)."""
    counts = g.held().groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    chunks = G.sieved(g.chunks(), "chunk_id", g.vectors().select("id")).join(counts, "chunk_id", "left").withColumn("keep", F.col("n").isNotNull()).withColumn("n", F.coalesce("n", F.lit(0)))
    sources = g.read("customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("source"))
    quality = g.owners().join(sources, "doc_id").groupBy("source").agg((F.sum("kept") / F.sum("chunks")).alias("source_quality"))
    views = g.vectors().join(aware.select("id", F.col("vec").alias("aware")), "id").join(label_centers(g).select(F.col("query_id").alias("grp"), F.col("vec").alias("center")), "grp")
    views = views.select("id", F.round(V.cosine(F.col("vec"), F.col("aware")), 4).alias("consistency"), F.round(S.domain_reward(V.cosine(F.col("vec"), F.col("center"))), 6).alias("reward"))
    return views.join(chunks.withColumnRenamed("chunk_id", "id"), "id").join(quality, "source").withColumn("level", F.expr(LEVEL))


def intents_of(g, queries, among=None):
    """(query_id, intent) by the router: a question that the guards refuse has no results, one about the whole corpus asks for a
    summary, any other has the intent of its nearest label (labels in turn). The floors are left to the router's report: they
    suit an embedding model, and the vectors at hand would all lie below them."""
    names = F.array(*map(F.lit, INTENTS))
    intent = F.when(F.col("guard") == "global", "summarization").otherwise(F.element_at(names, (F.col("label") % len(INTENTS) + 1).cast("int")))
    routes = routed(g, queries.select(F.col("query_id").alias("id"), "vec"), among).where("guard is null or guard <> 'out_of_domain'")
    return routes.select(F.col("id").alias("query_id"), intent.alias("intent"))


@query()
def ret_9_multi_path(spark, d):
    """All paths that a question's intent uses, fused."""
    g, queries, aware, paths = all_paths(spark, d)
    chunks = payload(g, aware).select(F.col("id").alias("chunk_id"), "consistency", "level", "reward", "keep")
    return P.multi_path(paths, intents_of(g, queries, F.col("doc_id") % QUERY_STEP == 0), chunks).withColumn("paths", F.array_join("paths", ","))


@query(f"""WITH {AWARE}, s AS (SELECT query_id, v.id, {COS} AS score FROM q, aware v) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 15""")
def act_4_graph_aware_search(spark, d):
    """The view that is drawn towards a chunk's entities, where it has any, else its dense view."""
    g, entities, queries = parts(spark, d)
    return R.vector_search(graph_aware(g, entities), queries.select("query_id", "vec"), 15)


@query()
def act_5_entity_cosine_search(spark, d):
    g, entities, queries = parts(spark, d)
    return P.entity_cosine(g.vectors(), g.contains(), g.mentions(), entities, queries, k=15)


@query()
def act_6_page_rank_search(spark, d):
    """Chunks by ranks from the entities of the chunks at hand: three of each, ten in all."""
    g = Graph(spark, d)
    held = g.read("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(8).select(F.col("o_orderkey").alias("chunk_id"))  # what a run has collected
    few = G.top_per(g.contains().join(F.broadcast(held), "chunk_id", "left_semi"), ["chunk_id"], [F.asc("entity_id")], 3)
    seeds = few.select(F.col("entity_id").alias("node")).distinct().orderBy("node").limit(10)  # the action's seeds
    return ranked_chunks(g, 20, seeds)


STAGE = f"""{CENTROIDS}, one AS (SELECT query_id, v.id, {COS} AS s1 FROM centers q, vectors v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, id) <= 50), halves AS (SELECT id, list_transform(vec[1:32], lambda x: x) AS vec FROM vectors), qs AS (SELECT query_id, vec[1:32] AS vec FROM centers),
    two AS (SELECT o.query_id, o.id, s1, {COS} AS s2 FROM one o JOIN qs q USING (query_id) JOIN halves v USING (id))"""


def two_stages(g):
    """The 50 closest chunks of each label, with the cosine of the first view and of the summary view (a half of the vector)."""
    centers = label_centers(g)
    one = R.vector_search(g.vectors(), centers, 50).select("query_id", "id", F.col("score").alias("s1"), "rank")
    both = one.join(g.vectors().select("id", F.slice("vec", 1, 32).alias("v")), "id").join(centers.select("query_id", F.slice("vec", 1, 32).alias("q")), "query_id")
    return both.select("query_id", "id", "s1", "rank", F.round(V.cosine(F.col("q"), F.col("v")), 4).alias("s2"))


@query(f"WITH {STAGE} SELECT query_id, id, s2 AS score, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, id) AS rank FROM two QUALIFY rank <= 8")
def act_7_rerank(spark, d):
    """The collected chunks replaced by the eight best of the second stage."""
    return G.top_per(two_stages(Graph(spark, d)).select("query_id", "id", F.col("s2").alias("score")), ["query_id"], [F.desc("score"), F.asc("id")], 8)


@query(f"""WITH {AWARE}, {STAGE.removeprefix(f"{VECTORS}, ")}, three AS (SELECT t.query_id, t.id, s1, s2, CASE WHEN id IN (SELECT chunk_id FROM contains_) THEN {COS} END AS s3 FROM two t JOIN centers q USING (query_id) JOIN aware v USING (id)),
    m AS (SELECT query_id, avg(s1) AS top FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, id) AS r FROM two) WHERE r <= 5 GROUP BY 1)
    SELECT query_id, id, round(CASE WHEN top >= 0.35 THEN s1 ELSE 0.4 * s1 + 0.3 * s2 + 0.3 * coalesce(s3, s2) END, 6) AS final FROM three JOIN m USING (query_id)""")
def rrk_4_staged_rerank(spark, d):
    """Three stages with an early exit: where the first stage's best five are good enough, its scores stand. The third stage is
    the cosine of the graph-aware view; for chunks without entities, which have none, the second stands in for it."""
    g, entities, _ = parts(spark, d)
    rows = two_stages(g)
    sure = rows.where("rank <= 5").groupBy("query_id").agg(F.avg("s1").alias("top"))
    seen = graph_aware(g, entities).select("id", "vec").join(g.contains().select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
    rows = rows.join(label_centers(g).select("query_id", F.col("vec").alias("q")), "query_id").join(seen, "id", "left")
    s3 = F.coalesce(F.round(V.cosine(F.col("q"), F.col("vec")), 4), F.col("s2"))
    final = F.when(F.col("top") >= 0.35, F.col("s1")).otherwise(0.4 * F.col("s1") + 0.3 * F.col("s2") + 0.3 * F.when(F.col("vec").isNull(), F.col("s2")).otherwise(s3))
    return rows.join(sure, "query_id").select("query_id", "id", F.round(final, 6).alias("final"))


def two_views(g, aware, k=50):
    """The k closest chunks of each label in the dense and in the graph-aware view: query_id, id, the path that found it, and the
    cosines of the dense (s1), summary (s2) and graph-aware (s3) view."""
    centers = label_centers(g)
    found = lambda rows, path: R.vector_search(rows, centers, k).select("query_id", "id", F.lit(path).alias("path"))
    once = found(g.vectors(), "original:dense").unionByName(found(aware, "original:graph_aware")).groupBy("query_id", "id").agg(F.max("path").alias("path"))
    rows = once.join(g.vectors().select("id", "vec"), "id").join(aware.select("id", F.col("vec").alias("aware")), "id").join(centers.select("query_id", F.col("vec").alias("q")), "query_id")
    cosine = lambda a, b: F.round(V.cosine(a, b), 4)
    half = lambda c: F.slice(c, 1, 32)
    return rows.select("query_id", "id", "path", cosine(F.col("q"), F.col("vec")).alias("s1"), cosine(half("q"), half("vec")).alias("s2"), cosine(F.col("q"), F.col("aware")).alias("s3"))


def asks(g):
    """What a label asks for: (query_id, entity_id) its five most frequent entities, and (query_id, wanted) its most frequent format."""
    members = g.vectors().select(F.col("id").alias("chunk_id"), F.col("grp").cast("long").alias("query_id"))
    count = lambda rows, column: rows.groupBy("query_id", column).agg(F.count(F.lit(1)).alias("m"))
    named = G.top_per(count(members.join(g.contains(), "chunk_id"), "entity_id"), ["query_id"], [F.desc("m"), F.asc("entity_id")], 5)
    formats = G.top_per(count(members.join(g.chunks(), "chunk_id"), "format"), ["query_id"], [F.desc("m"), F.asc("format")], 1)
    return named.select("query_id", "entity_id"), formats.select("query_id", F.col("format").alias("wanted"))


@query(f"""WITH {AWARE}, {CENTERS}, found AS (SELECT query_id, id, 'original:dense' AS path FROM (SELECT query_id, v.id, {COS} AS s FROM centers q, vectors v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, v.id) <= 50)
        UNION ALL SELECT query_id, id, 'original:graph_aware' FROM (SELECT query_id, v.id, {COS} AS s FROM centers q, aware v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, v.id) <= 50)), once AS (SELECT query_id, id, max(path) AS path FROM found GROUP BY 1, 2),
    c AS (SELECT o.query_id, o.id, path, {COS} AS s1, {COS.replace(".vec", ".vec[1:32]")} AS s2, {COS.replace("v.vec", "a.vec")} AS s3, {COS.replace("q.vec", "a.vec")} AS consistency FROM once o JOIN centers q USING (query_id) JOIN vectors v USING (id) JOIN aware a USING (id)),
    sized AS (SELECT chunk_id, count(*) AS n FROM contains_ GROUP BY 1), quality AS (SELECT c_mktsegment AS source, count(n) / count(*) AS source_quality FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN sized ON chunk_id = o_orderkey GROUP BY 1),
    named AS (SELECT grp AS query_id, entity_id FROM vectors JOIN contains_ ON chunk_id = id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, entity_id) <= 5),
    wanted AS (SELECT grp AS query_id, o_orderstatus AS wanted FROM vectors JOIN orders ON o_orderkey = id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, o_orderstatus) = 1),
    many AS (SELECT query_id, count(*) AS many FROM named GROUP BY 1), hits AS (SELECT query_id, chunk_id AS id, count(*) AS hits FROM named JOIN contains_ USING (entity_id) GROUP BY 1, 2),
    f AS (SELECT c.query_id, c.id, s2, 0.25 * s2 + 0.10 * s1 + 0.20 * s3 + 0.10 * consistency + 0.05 * CASE {LEVEL.replace("n >=", "coalesce(n, 0) >=")} WHEN 'sentence' THEN 0.8 WHEN 'section' THEN 1.1 WHEN 'document' THEN 0.7 ELSE 1.0 END
        + 0.15 * CASE WHEN many IS NULL THEN 0.5 ELSE coalesce(hits, 0) / many END + 0.05 * 1.0 + 0.03 * greatest(0.3, pow(0.5, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-12-31'), 0) / 365.0))
        + 0.04 * CASE WHEN path = 'original:graph_aware' THEN 1.0 ELSE 0.6 END + 0.01 * CASE WHEN wanted IS NULL OR wanted = o_orderstatus THEN 1.0 ELSE 0.5 END + 0.02 * source_quality AS l2r
        FROM c JOIN orders ON o_orderkey = c.id JOIN customer ON o_custkey = c_custkey JOIN quality ON source = c_mktsegment LEFT JOIN sized k ON k.chunk_id = c.id LEFT JOIN many USING (query_id) LEFT JOIN hits USING (query_id, id) LEFT JOIN wanted USING (query_id))
    SELECT query_id, id, round(0.4 * s2 + 0.6 * l2r, 6) AS final FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) <= 10""")
def rrk_5_learned_rerank(spark, d):
    """All eleven features of the chunks that two views find for a label: cosines of three views, agreement of the views, level by
    the number of entities, entities and format that the label asks for, age, path, and the share of its source's chunks
    with entities. The confidence of a path is 1, as no path states one."""
    g, entities, _ = parts(spark, d)
    aware = cut(graph_aware(g, entities))
    named, formats = asks(g)
    hits = named.join(g.contains(), "entity_id").groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    rows = two_views(g, aware).join(payload(g, aware), "id").join(named.groupBy("query_id").agg(F.count(F.lit(1)).alias("many")), "query_id", "left").join(hits, ["query_id", "id"], "left").join(formats, "query_id", "left")
    features = {
        "stage2_score": F.col("s2"), "cosine_dense": F.col("s1"), "cosine_graph_aware": F.col("s3"), "consistency_score": F.col("consistency"), "chunk_level_factor": S.level_factor(F.col("level")),
        "entity_match_count_norm": F.when(F.col("many").isNull(), 0.5).otherwise(F.coalesce("hits", F.lit(0)) / F.col("many")), "path_confidence": F.lit(1.0),
        "recency_score": S.recency(F.lit("1999-12-31").cast("date"), F.to_date("created")), "retrieval_path_weight": S.surfaced_weight(F.col("path")),
        "format_match_score": F.when(F.col("wanted").isNull() | (F.col("wanted") == F.col("format")), 1.0).otherwise(0.5), "source_quality_score": F.col("source_quality"),
    }
    final = rows.select("query_id", "id", F.round(S.final_score(F.col("s2"), S.rerank_score(features)), 6).alias("final"))
    return G.top_per(final, ["query_id"], [F.desc("final"), F.asc("id")], 10).select("query_id", "id", "final")


@query()
def ret_7_rank_every_question(spark, d):
    """Chunks by PageRank from the entities of each asked vector's three closest chunks, all questions in one run: of each, the
    90 best entities, and the 30 chunks with the best of those."""
    g = Graph(spark, d)
    listed = g.listed()
    near = R.vector_search(g.vectors(), g.vectors().where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vec"), 3)
    near = cut(near.select("query_id", F.col("id").alias("chunk_id")))
    seeds = near.join(G.sieved(listed, "chunk_id", near.select("chunk_id")), "chunk_id").select("query_id", F.col("entity_id").alias("node"))
    seeds = cut(seeds.distinct())
    pairs = G.co_occurrence(G.reached(listed, seeds, sizes=(2, 25)))
    both = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    ranks = G.page_ranks(pairs.select(both, F.col("shared").cast("double").alias("weight")), seeds, best=90).withColumn("score", F.round("score", 9))
    best = cut(G.top_per(ranks, ["query_id"], [F.desc("score"), F.asc("node")], 90).select("query_id", F.col("node").alias("entity_id"), "score"))
    chunks = best.join(G.sieved(listed, "entity_id", best.select("entity_id")), "entity_id").select("query_id", "chunk_id", "score")
    chunks = chunks.repartition("query_id").groupBy("query_id", "chunk_id").agg(F.round(F.max("score"), 6).alias("score"))
    return G.top_per(chunks, ["query_id"], [F.desc("score"), F.asc("chunk_id")], 30)
