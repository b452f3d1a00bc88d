"""Queries that iterate over the entity graph, read files' forms, or stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.operators import communities as C
from strataloom.operators import graph as G
from strataloom.plans.registry import CONTAINS, ENTITIES, SIZED, Graph, query, table
from strataloom.sources import files
from strataloom.sources.shared import cut, folder
from strataloom.streaming import events as E
from strataloom.streaming import expiry

ROUNDS = 16
"""Rounds that the SQL below spells out; more than ranks need to settle on the given tables, where they do after 5 to 13."""
PAIRS = f"""{SIZED}, pairs AS (SELECT x.entity_id AS a, y.entity_id AS b, CAST(count(*) AS DOUBLE) AS w FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id < y.entity_id GROUP BY 1, 2),
    edges AS (SELECT a, b, w FROM pairs UNION ALL SELECT b, a, w FROM pairs), total AS (SELECT a, sum(w) AS t FROM edges GROUP BY 1), steps AS MATERIALIZED (SELECT a, b, w / t AS share FROM edges JOIN total USING (a)),
    seeds AS (SELECT p_partkey AS node FROM part WHERE p_name = 'small ring' AND p_partkey IN (SELECT a FROM edges)), base AS MATERIALIZED (SELECT a AS node, CASE WHEN a IN (SELECT node FROM seeds) THEN 1.0 / (SELECT count(*) FROM seeds) ELSE 0 END AS p FROM total),
    r0 AS MATERIALIZED (SELECT node, p AS score, CAST(NULL AS DOUBLE) AS was FROM base)"""
RANKS = PAIRS + "".join(
    f", r{k + 1} AS MATERIALIZED (SELECT base.node, 0.5 * coalesce(g.s, 0) + 0.5 * p AS score, o.score AS was FROM base JOIN r{k} o USING (node) LEFT JOIN (SELECT b, sum(score * share) AS s FROM r{k} JOIN steps ON node = a GROUP BY 1) g ON g.b = base.node)" for k in range(ROUNDS)
) + f", every_round AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM r{k}" for k in range(1, ROUNDS + 1)) + """), settled AS (SELECT min(k) AS k FROM (SELECT k FROM every_round GROUP BY k HAVING sum(abs(score - was)) < count(*) * 1e-6)), ranks AS (SELECT node, score FROM every_round JOIN settled USING (k))"""


def ranks(g, seeds=None):
    pairs = G.co_occurrence(g.contains()).select("a", "b", F.col("shared").cast("double").alias("weight"))
    edges = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))), "weight")
    return G.page_rank(edges, seeds if seeds is not None else g.entities().where("name = 'small ring'").select(F.col("entity_id").alias("node")))


def ranked_chunks(g, k=60, seeds=None):
    seeds = seeds if seeds is not None else g.entities().where("name = 'small ring'").select(F.col("entity_id").alias("node"))
    ranks = G.mention_ranks(g.listed(), seeds)
    top = ranks.select("node", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "node").limit(k)  # the path's k
    found = g.listed().join(F.broadcast(top), F.col("entity_id") == F.col("node"))
    return found.groupBy("chunk_id").agg(F.round(F.max("score"), 6).alias("score"))


@query(f"WITH {RANKS} SELECT node, round(score, 6) + 0.0 AS score FROM ranks")
def grf_2_page_rank(spark, d):
    return ranks(Graph(spark, d)).select("node", (F.round("score", 6) + 0.0).alias("score"))


@query(f"""WITH {RANKS}, top AS (SELECT node, round(score, 9) AS score FROM ranks ORDER BY 2 DESC, 1 LIMIT 60) SELECT chunk_id, round(max(score), 6) AS score FROM contains_ JOIN top ON node = entity_id GROUP BY 1""")
def grf_3_ranked_chunks(spark, d):
    return ranked_chunks(Graph(spark, d))


LABEL_ROUNDS = 10
NPMI = """t AS (SELECT count(DISTINCT chunk_id) AS n FROM sized), c AS (SELECT entity_id, count(*) AS c FROM sized GROUP BY 1),
    p AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS s FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id < y.entity_id GROUP BY 1, 2 HAVING count(*) >= 2),
    npmi AS (SELECT a, b, ln((s / n) / ((ca.c / n) * (cb.c / n))) / -ln(s / n) AS w FROM p JOIN c ca ON ca.entity_id = a JOIN c cb ON cb.entity_id = b, t WHERE s < n AND ln((s / n) / ((ca.c / n) * (cb.c / n))) / -ln(s / n) > 0)"""
LABELS = f"{SIZED}, {NPMI}" + """, both_ AS (SELECT a, b, w FROM npmi UNION SELECT b, a, w FROM npmi), links AS MATERIALIZED (SELECT * FROM both_ UNION ALL SELECT DISTINCT a, a, 1e-9 FROM both_), l0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS label FROM both_)""" + "".join(
    f", l{k + 1} AS MATERIALIZED (SELECT a AS node, arg_max(label, struct_pack(w := w, l := -label)) AS label FROM (SELECT a, label, round(sum(w), 9) AS w FROM links JOIN l{k} ON b = node GROUP BY 1, 2) GROUP BY 1)" for k in range(LABEL_ROUNDS)
)


def communities(g):
    """Communities of entities with informative co-occurrence."""
    return G.label_rounds(G.npmi_edges(g.contains(), shared=2).withColumnRenamed("npmi", "weight"), LABEL_ROUNDS)


@query(f"WITH {LABELS} SELECT node, label FROM l{LABEL_ROUNDS}")
def grf_4_communities(spark, d):
    return communities(Graph(spark, d))


@query(f"""WITH {LABELS}, {ENTITIES}, allowed AS (SELECT node, label FROM l{LABEL_ROUNDS} JOIN entities ON node = entity_id WHERE lower(type) NOT IN ('promo')),
    big AS (SELECT label, count(*) AS size FROM allowed GROUP BY 1 HAVING count(*) >= 3) SELECT label AS community, 0 AS level, size, node AS member FROM big JOIN allowed USING (label)""")
def grf_5_community_build(spark, d):
    """Communities of at least three members, excluded types left out, with their level and members."""
    g = Graph(spark, d)
    return G.community_table(communities(g), g.entities(), excluded=("promo",), least=3)


def community_levels(g):
    return C.modularity_communities(G.npmi_edges(g.contains(), shared=2).withColumnRenamed("npmi", "weight"))


@query()
def grf_4_modularity(spark, d):
    """Communities of level 0 by modularity, each named after its smallest member."""
    return community_levels(Graph(spark, d)).where("level = 0").select("node", "label")


@query()
def grf_5_community_levels(spark, d):
    """Communities of at least three members at every level; each lies in one of the next level."""
    g = Graph(spark, d)
    rows = community_levels(g).join(g.entities().where("lower(type) <> 'promo'").select(F.col("entity_id").alias("node")), "node", "left_semi")
    sizes = rows.groupBy("level", "label").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    return rows.join(sizes, ["level", "label"]).select(F.col("label").alias("community"), "level", "size", F.col("node").alias("member"))


@query(f"""WITH {SIZED}, p AS (SELECT DISTINCT x.entity_id AS a, y.entity_id AS b FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id <> y.entity_id), s AS (SELECT p_partkey AS n FROM part WHERE p_name = 'small ring'),
    h1 AS (SELECT n FROM s UNION SELECT b FROM p JOIN s ON a = n), h2 AS (SELECT n FROM h1 UNION SELECT b FROM p JOIN h1 ON a = n) SELECT n AS node FROM h2""")
def grf_11_two_hops(spark, d):
    g = Graph(spark, d)
    edges = cut(G.both_ways(G.co_occurrence(g.contains()).select("a", "b")))
    reached = g.entities().where("name = 'small ring'").select(F.col("entity_id").alias("node"))
    for _ in range(2):
        near = edges.join(reached, F.col("a") == F.col("node"), "left_semi").select("b")
        reached = cut(reached.union(near).distinct())
    return reached


@query(f"""WITH {CONTAINS}, {ENTITIES}, votes AS (SELECT type, entity_id, count(*) AS n FROM contains_ JOIN entities USING (entity_id) GROUP BY 1, 2) SELECT type, arg_max(entity_id, struct_pack(n := n, e := -entity_id)) AS best, max(n) AS n FROM votes GROUP BY 1""")
def grf_6_community_heads(spark, d):
    g = Graph(spark, d)
    votes = g.contains().join(g.entities(), "entity_id").groupBy("type", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("type").agg(F.max_by("entity_id", F.struct("n", -F.col("entity_id"))).alias("best"), F.max("n").alias("n"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '\\.(html|htm)$') THEN 'html' WHEN regexp_matches(url, '\\.(json|jsonl)$') THEN 'chat' WHEN regexp_matches(url, '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(html), '^\\s*(<!doctype html|<html)') THEN 'html' ELSE 'txt' END AS format FROM pages""")
def src_1_formats(spark, d):
    return table(spark, d, "pages").select("page_id", files.format_of(F.col("url"), F.substring("html", 1, 2048)).alias("format"))


@query("SELECT coalesce(nullif(role, ''), 'user') AS role, coalesce(nullif(text, ''), '') AS content, CAST(turn AS VARCHAR) AS timestamp, CAST(conv_id AS VARCHAR) AS thread_id FROM conversations")
def src_8_messages(spark, d):
    rows = table(spark, d, "conversations").select(F.from_json(F.to_json(F.struct(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("ts"), "role", "text")), "map<string,string>").alias("m"))
    return files.messages(rows, lambda k: F.element_at(F.col("m"), k))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT c_custkey, c_name || '*', coalesce(nullif(c_acctbal, 0), c_acctbal) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def snk_2_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    new = old.join(changed, "c_custkey", "left_semi").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    return files.upsert(old, new, ["c_custkey"], keep_old_if_null=["c_acctbal"])


@query("""WITH e AS (SELECT *, date_trunc('hour', ts) AS start, max(ts) OVER () - INTERVAL 10 MINUTE AS mark FROM events) SELECT start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY start, event_type""")
def str_windowed_counts(spark, d):
    """Tumbling windows of the event stream; an empty batch at the end would close the last ones, so these are read in complete mode."""
    rows = E.stream(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    rows = rows.select(F.col("window.start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))
    return E.drain(rows, spark, folder(spark), "complete")


@query("SELECT DISTINCT user_id, event_type, date_trunc('minute', ts) AS minute FROM events")
def str_first_per_minute(spark, d):
    """One event per user, type and minute; which of them came first is the stream's own affair."""
    return E.drain(E.first_per_minute(E.stream(spark, d)).select("user_id", "event_type", "minute"), spark, folder(spark))


@query("SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def str_5_flushed_lines(spark, d):
    """The audit trail as JSON lines, as the flushing sink leaves it."""
    run = f"{folder(spark)}/lines-{uuid.uuid4().hex}"
    rows = E.stream(spark, d).select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    E.flush_lines(rows, f"{run}/out", f"{run}/state", None).awaitTermination()
    return spark.read.schema(rows.schema).json(f"{run}/out")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def snk_7_recent_events(spark, d):
    return E.recent(table(spark, d, "events")).select("event_id", "event_type")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, count(*) AS n, round(avg(value), 9) AS mean FROM r WHERE k <= 500 GROUP BY 1""")
def str_4_rolling_mean(spark, d):
    rows = E.rolling_mean(E.stream(spark, d)).select("user_id", "n", F.round("mean", 9).alias("mean"))
    return E.drain(rows, spark, folder(spark), "update", ["user_id"])


@query("""WITH e AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1)
    SELECT user_id, n FROM e WHERE last + INTERVAL 6 HOUR > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def str_3_expiring_stream(spark, d):
    """Users with an event in the last six hours of the stream, and how many they had; the others' state has expired."""
    expiry.use_store(spark)
    put = f"{folder(spark)}/expiry-{uuid.uuid4().hex}"
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{put}/out/batch={k}")
    changes = expiry.with_expiry(E.stream(spark, d), ttl="6 hours")
    changes.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{put}/state").trigger(availableNow=True).start().awaitTermination()
    return expiry.live_keys(spark.read.schema(f"{expiry.OUTPUT}, batch long").parquet(f"{put}/out")).select("user_id", "n")
