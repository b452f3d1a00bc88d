"""Queries of stores and their upkeep: sinks, loaders, community reports, audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.functions import score as S
from strataloom.functions import text as X
from strataloom.operators import chunking as C
from strataloom.operators import graph as G
from strataloom.operators import retrieval as P
from strataloom.plans.joins import ASKED
from strataloom.plans.paths import EV
from strataloom.plans.registry import CONTAINS, ENTITIES, VECTORS, Graph, query, table
from strataloom.sources import files
from strataloom.sources.shared import folder


def fresh(spark, name):
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {VECTORS} SELECT id, round(vec[1], 4) AS dense, round(CASE WHEN id % 2 = 0 THEN -vec[1] ELSE vec[1] END, 4) AS summary FROM vectors WHERE id % 7 <> 0")
def snk_1_vector_upsert(spark, d):
    """Points with two views, put twice: odd ones lack a summary and take the dense view, every seventh has no vector at all."""
    g, path = Graph(spark, d), fresh(spark, "points")
    none = F.lit(None).cast("array<float>")
    rows = g.vectors().select("id", F.when(F.col("id") % 7 != 0, F.col("vec")).alias("dense"), F.when((F.col("id") % 2 == 0) & (F.col("id") % 7 != 0), F.transform("vec", lambda x: -x)).otherwise(none).alias("summary"))
    for _ in range(2):
        files.put_documents(files.filled_views(rows, ["summary"]), path, "id")
    first = lambda c: F.round(F.element_at(c, 1).cast("double"), 4).alias(c)
    return spark.read.parquet(path).select("id", first("dense"), first("summary"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def snk_3_delete_by_document(spark, d):
    path = fresh(spark, "chunks")
    files.put_documents(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, "o_custkey")
    gone = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    files.delete_documents(spark, path, gone, "o_custkey")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey")


@query("SELECT count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) AS kept, count(*) FILTER (WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) AS removed FROM part")
def snk_4_orphan_sweep(spark, d):
    g = Graph(spark, d)
    contains = g.read("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("entity_id"))
    kept, removed = files.sweep_orphans(g.entities(), contains)
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(removed)  # one row each


@query("SELECT c_nationkey AS tenant, c_mktsegment AS community, count(*) + CASE WHEN c_nationkey = 3 THEN 1000 ELSE 0 END AS size FROM customer GROUP BY 1, 2")
def snk_5_community_rebuild(spark, d):
    """Communities of all tenants, then those of one tenant built anew: its old ones go, the others stay."""
    path = fresh(spark, "communities")
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("tenant"), F.col("c_mktsegment").alias("community")).agg(F.count(F.lit(1)).alias("size"))
    stale = rows.unionByName(rows.where("tenant = 3").withColumn("community", F.lit("stale")).distinct())
    files.write_partitions(stale, path, ["tenant"])
    files.write_partitions(rows.where("tenant = 3").withColumn("size", F.col("size") + 1000), path, ["tenant"])
    return spark.read.parquet(path).select("tenant", "community", "size")


@query(f"WITH {VECTORS} SELECT id, 'dense' AS view, round(vec[1], 4) AS first FROM vectors UNION ALL SELECT id, 'graph_aware', round(2 * vec[1], 4) FROM vectors")
def snk_6_update_view(spark, d):
    """One view of all points written anew, the other left alone."""
    path, rows = fresh(spark, "views"), Graph(spark, d).vectors().select("id", F.element_at("vec", 1).cast("double").alias("x"))
    files.put_view(rows.select("id", F.round("x", 4).alias("first")), path, "dense")
    for factor in (5, 2):
        files.put_view(rows.select("id", F.round(factor * F.col("x"), 4).alias("first")), path, "graph_aware")
    return spark.read.parquet(path).select("id", "view", "first")


@query("SELECT 'item' AS kind, item_id AS id, length(text) AS n FROM benchmark UNION ALL SELECT 'total', count(*), sum(length(text)) FROM benchmark")
def snk_8_report(spark, d):
    path, rows = fresh(spark, "report"), table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n"))
    files.write_report(rows, rows.agg(F.lit("total").alias("kind"), F.count(F.lit(1)).alias("id"), F.sum("n").alias("n")), path)
    read = lambda part: spark.read.schema("kind string, id long, n long").json(f"{path}/{part}")
    return read("items").unionByName(read("totals"))


@query("SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 5")
def snk_10_export(spark, d):
    """One tenant's chunks as JSON lines."""
    path, rows = fresh(spark, "export"), Graph(spark, d).chunks().select(F.col("chunk_id").alias("o_orderkey"), F.col("price").alias("o_totalprice"), "tenant")
    files.export_json(rows, path, F.col("tenant") == 5)
    return spark.read.schema("o_orderkey long, o_totalprice double").json(path)


@query("SELECT s_suppkey, s_name FROM supplier")
def src_6_csv(spark, d):
    path = fresh(spark, "csv")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias(" s_suppkey "), F.col("s_name").alias("s_name")).write.csv(path, header=True)
    return files.read_csv(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


@query("SELECT page_id, length(regexp_replace(html, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) AS n FROM pages")
def src_10_texts(spark, d):
    """Pages as texts: stripped, tags left in."""
    return table(spark, d, "pages").select("page_id", F.length(X.strip(F.col("html"))).cast("long").alias("n"))


@query(f"WITH {VECTORS} SELECT id, round(vec[1], 4) AS first, len(vec) AS n FROM vectors WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def src_12_points_by_ids(spark, d):
    g = Graph(spark, d)
    wanted = g.read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return g.vectors().select("id", "vec").join(wanted, "id", "left_semi").select("id", F.round(F.element_at("vec", 1).cast("double"), 4).alias("first"), F.size("vec").cast("long").alias("n"))


@query("SELECT item_id, text AS question FROM benchmark")
def src_15_dataset(spark, d):
    """Questions in the three shapes and four field names that evaluation files have."""
    field = F.element_at(F.array(*map(F.lit, ("question", "user_input", "query", "prompt"))), (F.col("item_id") % 4 + 1).cast("int"))
    row = F.to_json(F.create_map(field, F.col("text"), F.lit("id"), F.col("item_id").cast("string")))
    shape = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("["), row, F.lit("]"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit('{"samples": ['), row, F.lit("]}"))).otherwise(row)
    items = table(spark, d, "benchmark").select(F.explode(files.dataset_items(shape)).alias("item"))
    return items.select(F.element_at("item", "id").cast("long").alias("item_id"), files.question_of(F.col("item")).alias("question"))


@query(f"""WITH {EV}, {ENTITIES}, c AS (SELECT entity_id, name, min(entity_id) OVER (PARTITION BY type, string_split(name, ' ')[2]) AS canon FROM entities), p AS (SELECT c.entity_id AS alias, c.canon, c.name AS a, e.name AS b FROM c JOIN entities e ON e.entity_id = c.canon WHERE c.entity_id <> c.canon),
    s AS (SELECT p.*, round(list_inner_product(x.vec, y.vec), 4) AS cos FROM p LEFT JOIN ev x ON x.id = alias LEFT JOIN ev y ON y.id = canon)
    SELECT alias, canon, CASE WHEN replace(lower(a), ' ', '') = replace(lower(b), ' ', '') THEN 'equal' WHEN cos IS NULL THEN 'unknown' WHEN cos >= 0.92 THEN 'close' ELSE 'judge' END AS verdict FROM s""")
def grf_8_alias_audit(spark, d):
    """Aliases with why they stay: an equal name, close vectors, or no vector; the rest is for a judge."""
    g = Graph(spark, d)
    noun = F.get(F.split("name", " "), 1)
    heads = g.entities().groupBy("type", noun.alias("noun")).agg(F.min("entity_id").alias("canon"))
    pairs = g.entities().withColumn("noun", noun).join(heads, ["type", "noun"]).where("entity_id <> canon").select(F.col("entity_id").alias("alias"), "canon", F.col("name").alias("a"))
    pairs = pairs.join(g.entities().select(F.col("entity_id").alias("canon"), F.col("name").alias("b")), "canon")
    return G.audit_aliases(pairs, P.entity_vectors(g.contains(), g.vectors()))


@query(f"""WITH {CONTAINS}, {ENTITIES}, deg AS (SELECT type, entity_id, name, count(*) AS n FROM contains_ JOIN entities USING (entity_id) GROUP BY 1, 2, 3), e AS (SELECT type, string_agg(name, ', ' ORDER BY n DESC, entity_id) AS entities FROM (SELECT * FROM deg QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, entity_id) <= 15) GROUP BY 1),
    hits AS (SELECT type, chunk_id, count(*) AS m FROM contains_ JOIN entities USING (entity_id) GROUP BY 1, 2), c AS (SELECT type, string_agg(chunk_id, ',' ORDER BY m DESC, chunk_id) AS chunks FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY type ORDER BY m DESC, chunk_id) <= 5) GROUP BY 1)
    SELECT type, entities, chunks FROM e JOIN c USING (type)""")
def svc_2_summary_context(spark, d):
    """What a community's summary is written from: its 15 most connected entities and the five chunks with most of them."""
    return summary_context(Graph(spark, d))


def summary_context(g):
    """(type, entities, chunks) of every community."""
    named = g.contains().join(g.entities(), "entity_id")
    deg = G.top_per(named.groupBy("type", "entity_id", "name").agg(F.count(F.lit(1)).alias("n")), ["type"], [F.desc("n"), F.asc("entity_id")], 15)
    hits = G.top_per(named.groupBy("type", "chunk_id").agg(F.count(F.lit(1)).alias("m")), ["type"], [F.desc("m"), F.asc("chunk_id")], 5)
    text = lambda rows, value, sep, name: rows.groupBy("type").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", F.col(value).cast("string").alias("v")))).getField("v"), sep).alias(name))
    return text(deg, "name", ", ", "entities").join(text(hits, "chunk_id", ",", "chunks"), "type")


@query("""WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn FROM conversations), h AS (SELECT conv_id, substr(string_agg(text, ' ' ORDER BY k), 1, 1500) AS head FROM r WHERE k <= 5 GROUP BY 1)
    SELECT r.conv_id, r.turn, '[' || r.conv_id || ': ' || substr(head, 1, 240) || '] ' || r.text AS text FROM r JOIN h USING (conv_id)""")
def svc_3_document_prefix(spark, d):
    """Chunks with their document's summary in front, here the head of its first five chunks."""
    rows = table(spark, d, "conversations")
    first = G.top_per(rows, ["conv_id"], [F.asc("turn")], 5)
    head = first.groupBy("conv_id").agg(F.substring(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "text"))).getField("text"), " "), 1, 1500).alias("head"))
    prefix = F.concat(F.lit("["), F.col("conv_id").cast("string"), F.lit(": "), F.substring("head", 1, 240), F.lit("] "))
    return rows.join(head, "conv_id").select("conv_id", "turn", F.concat(prefix, "text").alias("text"))


@query("""WITH s AS (SELECT source, count(*) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10), m AS (SELECT source, doc_id, substr(text, 1, 600) AS part, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents JOIN s USING (source))
    SELECT source, any_value(size) AS size, string_agg(part, chr(10) ORDER BY k) AS answer FROM m JOIN s USING (source) WHERE k <= 6 AND NOT contains(part, 'NO_INFO') GROUP BY 1""")
def qry_5_map_reduce(spark, d):
    """The ten largest communities, six chunks of each mapped to a part of an answer, parts without information left out, reduced."""
    docs = table(spark, d, "documents").where("source is not null")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "source").limit(10)  # the answer's communities
    few = G.top_per(docs.join(F.broadcast(sizes), "source").select("source", "size", "doc_id", F.substring("text", 1, 600).alias("part")), ["source"], [F.asc("doc_id")], 6)
    said = few.where(~F.col("part").contains("NO_INFO"))
    return said.groupBy("source").agg(F.first("size").alias("size"), F.array_join(F.array_sort(F.collect_list(F.struct("rank", "part"))).getField("part"), "\n").alias("answer"))


@query(f"""WITH {VECTORS}, s AS (SELECT id, grp, round(list_inner_product(vec, lag(vec) OVER w) / (sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(lag(vec) OVER w, lag(vec) OVER w))), 9) AS c FROM vectors WINDOW w AS (PARTITION BY grp ORDER BY id)),
    t AS (SELECT grp, id, sum(CASE WHEN c < 0.0 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY id) AS k FROM s) SELECT grp, CAST(k AS INTEGER) AS k, string_agg(id, ' ' ORDER BY id) AS chunk FROM t GROUP BY 1, 2""")
def chk_4_topic_groups(spark, d):
    """Units in order, a new group where the topic turns away from the unit before."""
    rows = Graph(spark, d).vectors().select("grp", "id", F.col("id").cast("string").alias("text"), "vec")
    return C.topic_chunks(rows, "grp", "id", "text", "vec", least=0.0, most=1 << 30)


@query()
def fn_25_temporal_intent(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.temporal_intent(F.col("text")).alias("t")).select("conv_id", "turn", "t.*")


@query(f"""WITH {CONTAINS}, {ENTITIES}, deg AS (SELECT type, entity_id, name, count(*) AS n FROM contains_ JOIN entities USING (entity_id) GROUP BY 1, 2, 3), e AS (SELECT type, string_agg(name, ', ' ORDER BY n DESC, entity_id) AS entities FROM (SELECT * FROM deg QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, entity_id) <= 15) GROUP BY 1),
    size AS (SELECT type, count(*) AS member_count FROM entities GROUP BY 1), asked(name) AS (SELECT unnest({list(ASKED)})), hit AS (SELECT DISTINCT a.name AS asked, type FROM asked a JOIN entities e ON contains(lower(e.name), lower(a.name)) OR lower(regexp_replace(e.name, '[ _]+', '', 'g')) = lower(regexp_replace(a.name, '[ _]+', '', 'g')))
    SELECT asked, type AS community, 0 AS level, member_count, substr(entities, 1, 300) AS summary FROM hit JOIN size USING (type) JOIN e USING (type) QUALIFY row_number() OVER (PARTITION BY asked ORDER BY member_count DESC, type) <= 5""")
def act_8_expand_community(spark, d):
    """The communities of the entities that a question names, five of each name, largest first: members, and the first 300
    characters of what the summary is written from."""
    g = Graph(spark, d)
    asked = F.broadcast(spark.createDataFrame([(n,) for n in ASKED], "asked string"))  # the names of one question
    norm = lambda c: F.lower(F.regexp_replace(c, "[ _]+", ""))
    named = F.lower("name").contains(F.lower("asked")) | (norm("name") == norm("asked"))
    hit = g.entities().join(asked, named).select("asked", "type").distinct()
    sizes = g.entities().groupBy("type").agg(F.count(F.lit(1)).alias("member_count"))
    rows = G.top_per(hit.join(sizes, "type"), ["asked"], [F.desc("member_count"), F.asc("type")], 5)
    return rows.join(summary_context(g), "type").select("asked", F.col("type").alias("community"), F.lit(0).alias("level"), "member_count", F.substring("entities", 1, 300).alias("summary"))
