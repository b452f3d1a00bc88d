"""Queries of the remaining services: resolution, reranking stages, gates, domains, metrics, micro-batches."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import domain as D
from strataloom.functions import score as S
from strataloom.functions import text as X
from strataloom.functions import vector as V
from strataloom.operators import chunking as C
from strataloom.operators import graph as G
from strataloom.operators import ranking as R
from strataloom.operators.resolution import resolve_entities
from strataloom.plans.registry import CONTAINS, ENTITIES, SIZED, VECTORS, Graph, query, table
from strataloom.plans.vectors import COS
from strataloom.sources import files
from strataloom.sources.shared import cut, folder
from strataloom.streaming import events as E

AXES = {"english": {"the ": 1.0, " of ": 0.5}, "french": {" que ": 1.0, " le ": 0.5}, "german": {" und ": 0.8, " der ": 0.6}, "table": {" | ": 2.0}}
SHAPES = {"table": r"^.* \| .*$"}
_KEYS = ", ".join("0.5 * (" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {v} ELSE 0 END" for w, v in words.items()) + ")" + (" + 0.15 * CAST(regexp_matches(text, '(?mi)^.* \\| .*$') AS INTEGER)" if a == "table" else "") for a, words in AXES.items())


@query(f"""WITH s AS (SELECT doc_id, list_transform([{_KEYS}], lambda x: exp(CAST(x AS DOUBLE))) AS e FROM documents) SELECT doc_id, round(e[1] / list_sum(e), 6) AS english, round(e[4] / list_sum(e), 6) AS tabular,
    ['english', 'french', 'german', 'table'][list_position(e, list_max(e))] AS best FROM s""")
def fn_36_domain_tags(spark, d):
    rows = table(spark, d, "documents").withColumn("p", D.tag(F.col("text"), F.col("source"), AXES, SHAPES))
    return rows.select("doc_id", F.round(F.element_at("p", 1), 6).alias("english"), F.round(F.element_at("p", 4), 6).alias("tabular"), D.dominant(F.col("p"), list(AXES)).alias("best"))


@query(f"""WITH {SIZED}, p AS (SELECT x.entity_id AS a, y.entity_id AS b FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id <> y.entity_id), g AS (SELECT a, count(DISTINCT b) AS deg FROM p GROUP BY 1)
    SELECT a AS entity_id, deg, round((a % 100 + 1) / pow(1 + deg, 0.5), 6) AS score FROM g""")
def fn_46_degree_penalty(spark, d):
    links = G.both_ways(G.co_occurrence(Graph(spark, d).contains()).select("a", "b"))
    deg = links.groupBy(F.col("a").alias("entity_id")).agg(F.count(F.lit(1)).alias("deg"))
    return deg.withColumn("score", F.round(S.degree_penalty((F.col("entity_id") % 100 + 1).cast("double"), F.col("deg"), 0.5), 6))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS valid_from, 1 AS version FROM orders")
def fn_27_default_validity(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.to_date("o_orderdate"), F.current_date()).cast("string").alias("valid_from"), F.lit(1).alias("version"))


EXPANSIONS = {"The": "Definite Article", "Is": "Verb", **X.ACRONYMS}
_EXPANDED = "text"
for _short, _long in EXPANSIONS.items():  # twice, as neighbours share the character between them
    for _ in range(2):
        _EXPANDED = f"regexp_replace({_EXPANDED}, '(^|[^\\pL\\pM\\pN_])({_short})($|[^\\pL\\pM\\pN_])', '\\1{_long}\\3', 'g')"


@query(f"SELECT conv_id, turn, {_EXPANDED} AS text FROM conversations")
def fn_13_expanded_acronyms(spark, d):
    """Short forms spelled out: those of the dictionary, and two words that the synthetic turns have."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.expand_acronyms(F.col("text"), EXPANSIONS).alias("text"))


@query("""SELECT l_orderkey, round(avg(CASE WHEN l_quantity / 50 >= 0.6 THEN 1.0 WHEN l_quantity / 50 <= 0.4 THEN 0.0 ELSE (l_quantity / 50 - 0.4) / 0.2 END), 6) AS grounded, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS cited FROM lineitem GROUP BY 1""")
def agg_13_answer_ratios(spark, d):
    """Per answer (an order) the mean grounding credit of its sentences (lines) and the share of them with a citation."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey")
    return rows.agg(F.round(F.avg(S.grounding_credit(F.col("l_quantity") / 50)), 6).alias("grounded"), F.round(F.avg((F.col("l_discount") >= 0.05).cast("double")), 6).alias("cited"))


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND text <> '' AND NOT contains(text, 'NO_INFO')")
def flt_9_null_and_no_info(spark, d):
    return table(spark, d, "documents").where("lang IS NOT NULL AND text <> '' AND NOT contains(text, 'NO_INFO')").select("doc_id", "lang")


@query("SELECT model FROM (SELECT DISTINCT p_brand AS model FROM part UNION SELECT 'Brand#99') EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size > 49")
def svc_5_missing_models(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_brand").alias("model")).union(spark.range(1).select(F.lit("Brand#99"))).distinct()
    there = table(spark, d, "part").where("p_size > 49").select(F.col("p_brand").alias("model"))
    return wanted.join(there, "model", "left_anti")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT 'stage_seconds{stage="' || event_type || '",quantile="0.95"} ' || printf('%.2f', max(value) FILTER (WHERE k = CAST(floor(n * 0.95) AS BIGINT))) AS line FROM r GROUP BY event_type""")
def svc_4_metrics_text(spark, d):
    p95 = R.exact_percentiles(table(spark, d, "events"), "event_type", "value", {"p95": 0.95})
    return p95.select(F.format_string('stage_seconds{stage="%s",quantile="0.95"} %.2f', "event_type", "p95").alias("line"))


@query("""WITH v AS (SELECT l_orderkey, avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0 END) >= 0.7 AS cited, bool_and(l_returnflag <> 'R') AS known, avg(l_quantity / 50) >= 0.5 AS grounded FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN NOT known THEN 'expand_entities' WHEN NOT cited THEN 'rewrite_with_citations' WHEN NOT grounded THEN 'retrieve_more' ELSE 'accept' END AS action FROM v""")
def val_6_corrective_action(spark, d):
    """What to do about an answer by the first gate that it fails. Quantities are whole, so their mean is exact in any order of rows."""
    gates = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        (F.avg((F.col("l_discount") >= 0.05).cast("double")) >= 0.7).alias("cited"), F.bool_and(F.col("l_returnflag") != "R").alias("known"), (F.avg("l_quantity") >= 0.5 * 50).alias("grounded")
    )
    return gates.select("l_orderkey", S.corrective_action(F.col("known"), F.col("cited"), F.col("grounded")).alias("action"))


@query(f"""WITH {SIZED}, {ENTITIES}, p AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS w FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id <> y.entity_id GROUP BY 1, 2)
    SELECT s.entity_id AS a, t.name AS neighbour, sum(w) AS w FROM entities s JOIN p ON s.entity_id = a JOIN entities t ON t.entity_id = b WHERE s.name = 'red widget' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY s.entity_id ORDER BY sum(w) DESC, t.name) <= 30""")
def act_2_expand_relation(spark, d):
    g = Graph(spark, d)
    links = G.co_occurrence(g.contains())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    start = g.entities().where("name = 'red widget'").select(F.col("entity_id").alias("a"))
    named = both.join(start, "a").join(g.entities().select(F.col("entity_id").alias("b"), F.col("name").alias("neighbour")), "b")
    grouped = named.groupBy("a", "neighbour").agg(F.sum("shared").alias("w"))
    return G.top_per(grouped, ["a"], [F.desc("w"), F.asc("neighbour")], 30).drop("rank")


@query(f"""WITH {CONTAINS}, s AS (SELECT chunk_id, list_sort(list(entity_id)) AS e FROM contains_ GROUP BY 1), o AS (SELECT o_custkey AS doc, o_orderkey AS chunk, o_orderstatus AS mode, e, lag(o_orderstatus) OVER w AS m0, lag(e) OVER w AS e0 FROM orders JOIN s ON chunk_id = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT doc, chunk, coalesce(mode <> m0, false) AS shift, CASE WHEN e0 IS NULL THEN 0.0 ELSE round(1 - len(list_intersect(e, e0)) / len(list_distinct(list_concat(e, e0))), 6) END AS distance FROM o""")
def win_8_previous_mode_and_entities(spark, d):
    """Whether a chunk's mode differs from the one before it in its document, and how far apart their entity sets are."""
    g = Graph(spark, d)
    sets = g.contains().groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("e"))
    rows = g.read("orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("chunk"), F.col("o_orderstatus").alias("mode")).join(sets, F.col("chunk") == F.col("chunk_id"))
    w = Window.partitionBy("doc").orderBy("chunk")
    rows = rows.withColumns({"m0": F.lag("mode").over(w), "e0": F.lag("e").over(w)})
    distance = F.when(F.col("e0").isNull(), 0.0).otherwise(F.round(V.jaccard_distance(F.col("e"), F.col("e0")), 6))
    return rows.select("doc", "chunk", F.coalesce(F.col("mode") != F.col("m0"), F.lit(False)).alias("shift"), distance.alias("distance"))


@query()
def chk_7_hierarchy(spark, d):
    """Sections of a document and their paragraphs, numbered in one order, with each paragraph's section."""
    rows = table(spark, d, "documents").select("doc_id", C.pack(F.split("text", "\n"), 2000, "\n\n").alias("sections"))
    sections = rows.select("doc_id", F.posexplode("sections").alias("s", "section"))
    parts = sections.select("doc_id", "s", "section", F.posexplode(C.pack(F.split("section", "\n\n"), 800, "\n")).alias("p", "text"))
    units = sections.select("doc_id", "s", F.lit(-1).alias("p"), F.lit("section").alias("level"), F.col("section").alias("text")).unionByName(parts.select("doc_id", "s", "p", F.lit("paragraph").alias("level"), "text"))
    w = Window.partitionBy("doc_id").orderBy("s", "p")
    numbered = units.withColumn("k", F.row_number().over(w) - 1)
    parent = F.first("k").over(w.partitionBy("doc_id", "s").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("parent", F.when(F.col("level") == "paragraph", parent)).select("doc_id", "k", "level", "parent", F.length("text").alias("n"))


@query()
def grf_7_entity_resolution(spark, d):
    """Part names of a type folded into the best-connected related name with a close vector; small parts' gray zone needs a verdict."""
    g = Graph(spark, d)
    rows = G.degrees(g.entities(), g.contains()).groupBy("type", "name").agg(F.sum("degree").alias("degree"), F.min("entity_id").alias("entity_id"))
    mentions = g.entities().select("entity_id", "type", "name").join(g.contains(), "entity_id").join(g.vectors().withColumnRenamed("id", "chunk_id"), "chunk_id")
    owners = rows.select("type", "name", F.col("entity_id").alias("owner"))
    vectors = R.centroids(mentions.join(owners, ["type", "name"]).select(F.col("owner").alias("entity_id"), "vec"), "entity_id")
    return resolve_entities(cut(rows.join(vectors, "entity_id", "left")), judged_types=("small",))


@query("SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY 1")
def str_1_upserted_stream(spark, d):
    """Latest event and count per user: a delta per micro-batch, replaced if it runs again, and merged when read."""
    delta = lambda batch: batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
    merge = lambda deltas: deltas.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.sum("n").alias("n"))
    return E.fold(E.stream(spark, d), spark, f"{folder(spark)}/upsert-{uuid.uuid4().hex}", delta, merge)


@query(f"""WITH {VECTORS}, q AS (SELECT id AS query_id, vec FROM vectors WHERE id % 20 = 0), s AS (SELECT query_id, v.id, v.grp, {COS} AS score FROM q, vectors v WHERE v.id <> query_id), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 15),
    n AS (SELECT query_id, grp, count(*) AS votes FROM k GROUP BY 1, 2) SELECT query_id, grp, votes FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, grp) = 1""")
def str_6_incremental_community(spark, d):
    """New vectors take the majority community of their 15 nearest neighbours."""
    g = Graph(spark, d)
    asked = g.vectors().where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")
    near = R.vector_search(g.vectors(), asked, 16).where("id <> query_id")
    near = G.top_per(near.drop("rank"), ["query_id"], [F.desc("score"), F.asc("id")], 15).join(g.vectors().select("id", "grp"), "id")
    votes = near.groupBy("query_id", "grp").agg(F.count(F.lit(1)).alias("votes"))
    return G.top_per(votes, ["query_id"], [F.desc("votes"), F.asc("grp")], 1).select("query_id", "grp", "votes")


@query("SELECT conv_id, turn, coalesce(nullif(role, ''), 'user') AS role, length(text) AS n FROM conversations")
def src_7_json_messages(spark, d):
    """Messages through their JSON line form."""
    lines = table(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    parsed = lines.select(F.from_json("value", "conv_id long, turn long, role string, text string").alias("m")).select("m.*")
    return parsed.select("conv_id", "turn", F.coalesce(F.nullif("role", F.lit("")), F.lit("user")).alias("role"), F.length("text").cast("long").alias("n"))


@query("SELECT page_id, max(start) AS start FROM (SELECT page_id, unnest(range(0, greatest(length(html), 1), 1000)) AS start, length(html) // 2 AS at_ FROM pages) WHERE start <= at_ GROUP BY 1")
def src_3_page_lookup(spark, d):
    """The last part (of 1,000 characters) that starts at or before a text's middle."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.length("html").alias("n"))
    starts = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1, F.lit(1000))).alias("start")).withColumn("page", F.col("start"))
    found = files.page_at(rows.select("doc_id", F.floor(F.col("n") / 2).alias("offset")), starts)
    return found.select(F.col("doc_id").alias("page_id"), F.col("page").cast("long").alias("start"))
