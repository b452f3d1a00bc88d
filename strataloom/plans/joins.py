"""Queries of the entity graph: joins, filters, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import score as S
from strataloom.functions import text as X
from strataloom.functions import vector as V
from strataloom.operators import graph as G
from strataloom.operators import ranking as R
from strataloom.plans.registry import CHUNKS, CONTAINS, ENTITIES, MENTIONS, SIZED, Graph, query, table

ASKED = ("small ring", "red widget", "blue bolt")
"""Names in a user's question."""


@query(f"""WITH {CONTAINS}, {ENTITIES} SELECT chunk_id, count(DISTINCT entity_id) AS matches, array_to_string(list_sort(list(DISTINCT name)), '|') AS matched
    FROM contains_ JOIN entities USING (entity_id) WHERE name IN {ASKED} GROUP BY 1""")
def join_1_entity_chunks(spark, d):
    g = Graph(spark, d)
    found = G.mentions_of(g.entities().where(F.col("name").isin(*ASKED)), g.contains())
    return found.withColumn("matched", F.array_join("matched", "|"))


@query(f"""WITH {ENTITIES} SELECT DISTINCT entity_id, name FROM entities WHERE lower(name) IN {ASKED} OR contains(lower(name), 'ring')
    OR regexp_replace(lower(name), '[\\s_]+', '', 'g') IN ('smallring', 'redwidget')""")
def join_2_fuzzy_names(spark, d):
    e, name = Graph(spark, d).entities(), F.lower("name")
    return e.where(name.isin(*ASKED) | name.contains("ring") | X.normal_name(F.col("name")).isin("smallring", "redwidget")).select("entity_id", "name").distinct()


@query(f"""WITH {ENTITIES}, asked(name, weight) AS (VALUES ('small ring', 1.0), ('red widget', 0.5), ('blue bolt', 0.25))
    SELECT entity_id, name, CAST(weight AS DOUBLE) AS weight FROM entities JOIN asked USING (name)""")
def join_3_parameter_list(spark, d):
    asked = spark.range(1).select(F.explode(F.arrays_zip(F.array(*map(F.lit, ASKED)).alias("name"), F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25)).alias("weight"))).alias("x"))
    return Graph(spark, d).entities().join(F.broadcast(asked.select("x.*")), "name").select("entity_id", "name", "weight")


@query(f"WITH {CHUNKS} SELECT chunk_id, doc_id, coalesce(source, 'unknown') AS source FROM chunks")
def join_4_chunk_document(spark, d):
    return Graph(spark, d).chunks().select("chunk_id", "doc_id", F.coalesce("source", F.lit("unknown")).alias("source"))


@query(f"""WITH {CONTAINS}, {ENTITIES} SELECT entity_id, count(DISTINCT chunk_id) AS degree FROM entities LEFT JOIN contains_ USING (entity_id)
    GROUP BY 1 HAVING count(DISTINCT chunk_id) > 0""")
def join_5_degree(spark, d):
    g = Graph(spark, d)
    return G.degrees(g.entities(), g.contains()).where("degree > 0").select("entity_id", "degree")


@query(f"""WITH {SIZED}, pairs AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS w FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id < y.entity_id GROUP BY 1, 2),
    sym AS (SELECT a, b, w FROM pairs UNION SELECT b, a, w FROM pairs) SELECT p_partkey AS entity_id, b AS neighbour, w FROM part LEFT JOIN sym ON p_partkey = a WHERE p_name = 'small ring'""")
def join_6_expand_relations(spark, d):
    g = Graph(spark, d)
    links = G.both_ways(G.co_occurrence(g.contains()))
    start = g.entities().where("name = 'small ring'")
    return start.join(links, F.col("entity_id") == F.col("a"), "left").select("entity_id", F.col("b").alias("neighbour"), F.col("shared").alias("w"))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')")
def join_7_semi_alias(spark, d):
    used = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(used, "s_suppkey", "left_semi").select("s_suppkey")


@query(f"""WITH {CONTAINS}, scope AS (SELECT o_orderkey AS chunk_id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)
    SELECT chunk_id, entity_id FROM contains_ WHERE chunk_id IN (SELECT chunk_id FROM scope)""")
def join_8_scope(spark, d):
    g = Graph(spark, d)
    scope = g.read("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select(F.col("o_orderkey").alias("chunk_id"))
    return g.contains().join(F.broadcast(scope), "chunk_id", "left_semi")  # 100 rows


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_9_orphans(spark, d):
    used = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(used, "c_custkey", "left_anti").select("c_custkey", "c_name")


SHARED = """, pairs AS (SELECT x.doc_id AS d1, y.doc_id AS d2, count(*) AS shared FROM mentions x JOIN mentions y USING (entity_id) WHERE x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 2),
    size AS (SELECT doc_id, count(*) AS n FROM mentions GROUP BY 1),
    scored AS (SELECT d1, d2, shared, shared / (a.n + b.n - shared) AS jaccard FROM pairs JOIN size a ON a.doc_id = d1 JOIN size b ON b.doc_id = d2)"""


@query(f"""WITH {MENTIONS}{SHARED}, kept AS (SELECT * FROM scored WHERE jaccard >= 0.05)
    SELECT d1, d2, shared, round(jaccard, 6) AS jaccard FROM kept UNION ALL SELECT d2, d1, shared, round(jaccard, 6) FROM kept""")
def join_10_shared_entities(spark, d):
    return G.shared_documents(Graph(spark, d).mentions(), 2, 0.05).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {CONTAINS}, pairs AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(DISTINCT entity_id) AS shared FROM contains_ x JOIN contains_ y USING (entity_id) WHERE x.chunk_id <> y.chunk_id GROUP BY 1, 2)
    SELECT a, b, shared, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM pairs QUALIFY rank <= 20""")
def join_11_chunk_neighbours(spark, d):
    return G.neighbours(Graph(spark, d).contains(), 20)


@query(f"WITH {SIZED} SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS shared FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id < y.entity_id GROUP BY 1, 2")
def join_12_co_occurrence(spark, d):
    return G.co_occurrence(Graph(spark, d).contains())


@query(f"""WITH {SIZED} SELECT x.entity_id AS a, y.entity_id AS b, count(*) / 10.0 AS weight FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id < y.entity_id
    GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 5000""")
def join_13_weighted_pairs(spark, d):
    pairs = G.co_occurrence(Graph(spark, d).contains()).orderBy(F.desc("shared"), "a", "b").limit(5000)  # the report's length
    return pairs.select("a", "b", (F.col("shared") / 10.0).alias("weight"))


@query(r"""WITH n AS (SELECT DISTINCT p_type AS type, lower(p_brand) AS name FROM part UNION SELECT DISTINCT p_type, p_name FROM part UNION SELECT DISTINCT p_type, p_name[1] || string_split(p_name, ' ')[2][1] FROM part),
    k AS (SELECT type, name, regexp_replace(name, '[^0-9a-z]', '', 'g') AS s, array_to_string(list_transform(list_filter(string_split_regex(name, '[^0-9a-z]+'), lambda w: w <> ''), lambda w: w[1]), '') AS i, len(list_filter(string_split_regex(name, '\s+'), lambda w: w <> '')) AS words FROM n)
    SELECT DISTINCT x.type, x.name AS a, y.name AS b FROM k x JOIN k y ON x.type = y.type AND x.name <> y.name WHERE (length(x.s) >= 4 AND length(x.s) * 5 >= length(y.s) * 4 AND length(x.s) <= length(y.s) AND contains(y.s, x.s)) OR (length(x.s) >= 2 AND x.s = y.i AND y.words >= 2)""")
def join_16_lexical_blocking(spark, d):
    """Brands, names and their initials within a type, paired on pieces of their skeletons and on initials."""
    part = table(spark, d, "part")
    short = F.concat(F.substring("p_name", 1, 1), F.substring(F.get(F.split("p_name", " "), 1), 1, 1))
    names = part.select(F.col("p_type").alias("type"), F.lower("p_brand").alias("name")).union(part.select("p_type", "p_name")).union(part.select("p_type", short)).distinct()
    return G.related_names(names)


@query(f"""WITH {ENTITIES}, n AS (SELECT DISTINCT type, name FROM entities), w AS (SELECT DISTINCT type, name, unnest(string_split(name, ' ')) AS w FROM n), p AS (SELECT x.type, x.name AS a, y.name AS b, count(*) AS shared FROM w x JOIN w y ON x.type = y.type AND x.w = y.w AND x.name <> y.name GROUP BY 1, 2, 3)
    SELECT type, a, b, shared FROM p QUALIFY row_number() OVER (PARTITION BY type, a ORDER BY shared DESC, b) <= 10""")
def join_17_full_text_candidates(spark, d):
    """For each name of a type its ten best candidates by words in common."""
    words = Graph(spark, d).entities().select("type", "name").distinct().withColumn("w", F.explode(F.array_distinct(F.split("name", " "))))
    keyed = words.select(F.struct("type", "w").alias("k"), F.struct("type", "name").alias("n"))
    pairs = G.paired(keyed, "k", "n").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")).select("a.type", F.col("a.name").alias("a"), F.col("b.name").alias("b"), "shared")
    return G.top_per(both, ["type", "a"], [F.desc("shared"), F.asc("b")], 10).drop("rank")


VERSIONS = "versions AS (SELECT o_custkey AS name, o_orderkey AS id, CAST(o_orderdate AS DATE) AS valid_from, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS valid_to FROM orders)"


def versions(spark, d):
    later = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("valid_from"), F.to_date(F.lead("o_orderdate").over(later)).alias("valid_to")
    )


@query(f"""WITH {VERSIONS} SELECT name, id, CAST(valid_from AS VARCHAR) AS valid_from, coalesce(CAST(valid_to AS VARCHAR), 'open') AS valid_to FROM versions WHERE valid_from <= DATE '1997-06-30' AND (valid_to IS NULL OR valid_to >= DATE '1997-06-30')
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY valid_from DESC, id DESC) = 1""")
def join_18_version_as_of(spark, d):
    day = F.lit("1997-06-30").cast("date")
    valid = versions(spark, d).where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
    return G.top_per(valid, ["name"], [F.desc("valid_from"), F.desc("id")], 1).select(
        "name", "id", F.col("valid_from").cast("string").alias("valid_from"), F.coalesce(F.col("valid_to").cast("string"), F.lit("open")).alias("valid_to")
    )


@query("""SELECT l.l_orderkey, l.l_linenumber, coalesce(p.l_linenumber, -1) AS parent FROM lineitem l LEFT JOIN lineitem p ON p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber - 1""")
def join_19_parents(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    parents = rows.select("l_orderkey", F.col("l_linenumber").alias("parent"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    found = rows.join(parents, ["l_orderkey", "l_linenumber"], "left")
    return found.select("l_orderkey", "l_linenumber", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("SELECT c_custkey, n_name AS community, r_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_20_communities(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("community"), F.col("r_name").alias("parent"))


@query(f"""WITH {ENTITIES}, asked(name) AS (VALUES ('small ring'), ('red widget'), ('blue bolt'), ('no such thing'))
    SELECT name, count(entity_id) AS n, coalesce(min(entity_id), -1) AS first FROM asked LEFT JOIN entities USING (name) GROUP BY 1""")
def join_21_lookup_with_nulls(spark, d):
    asked = spark.createDataFrame([(n,) for n in (*ASKED, "no such thing")], "name string")
    found = asked.join(Graph(spark, d).entities(), "name", "left")
    return found.groupBy("name").agg(F.count("entity_id").alias("n"), F.coalesce(F.min("entity_id"), F.lit(-1)).alias("first"))


@query(f"WITH {CONTAINS} SELECT chunk_id, count(DISTINCT entity_id) AS n, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS ids FROM contains_ GROUP BY 1")
def agg_1_distinct_per_chunk(spark, d):
    grouped = Graph(spark, d).contains().groupBy("chunk_id").agg(F.countDistinct("entity_id").alias("n"), F.array_sort(F.collect_set("entity_id")).alias("ids"))
    return grouped.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(f"""WITH {MENTIONS}, t AS (SELECT count(DISTINCT doc_id) AS n FROM mentions) SELECT entity_id, count(*) AS df, round(least(5.0, greatest(0.1, ln((n + 1) / (count(*) + 1)))), 6) AS idf
    FROM mentions, t GROUP BY 1, n""")
def agg_2_document_frequency(spark, d):
    m = Graph(spark, d).mentions()
    counted = m.groupBy("entity_id").agg(F.count(F.lit(1)).alias("df"))
    total = m.select(F.countDistinct("doc_id").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("entity_id", "df", F.round(V.idf(F.col("n"), F.col("df")), 6).alias("idf"))  # one row


@query("""WITH v AS (SELECT lower(event_type) AS name, user_id % 7 AS src, count(*) AS votes, max(length(props)) AS l FROM events GROUP BY 1, 2) SELECT name, src, votes, round(votes / 300.0, 6) AS confidence FROM v WHERE votes >= 2""")
def agg_6_votes(spark, d):
    votes = table(spark, d, "events").groupBy(F.lower("event_type").alias("name"), (F.col("user_id") % 7).alias("src")).agg(F.count(F.lit(1)).alias("votes"))
    return votes.where("votes >= 2").withColumn("confidence", F.round(F.col("votes") / 300.0, 6))


@query(f"""WITH {SIZED}, t AS (SELECT count(DISTINCT chunk_id) AS n FROM sized), c AS (SELECT entity_id, count(*) AS c FROM sized GROUP BY 1),
    p AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS s FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id < y.entity_id GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT a, b, round(ln((s / n) / ((ca.c / n) * (cb.c / n))) / -ln(s / n), 6) AS npmi FROM p JOIN c ca ON ca.entity_id = a JOIN c cb ON cb.entity_id = b, t WHERE s < n AND ln((s / n) / ((ca.c / n) * (cb.c / n))) / -ln(s / n) > 0""")
def agg_7_npmi(spark, d):
    return G.npmi_edges(Graph(spark, d).contains(), shared=2).withColumn("npmi", F.round("npmi", 6))


@query("SELECT l_orderkey AS chunk_id, max(l_extendedprice) AS score, min(l_partkey) FILTER (WHERE l_extendedprice = m) AS best FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1")
def agg_8_best_per_chunk(spark, d):
    best = F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_partkey"))).alias("best")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.max("l_extendedprice").alias("score"), best)


@query("""SELECT o_orderkey AS chunk_id, max(s) AS score FROM (SELECT o_orderkey, o_totalprice AS s FROM orders UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def agg_9_best_over_paths(spark, d):
    paths = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("s"))
    paths = paths.unionByName(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_extendedprice").alias("s")))
    return paths.groupBy("chunk_id").agg(F.max("s").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(100)  # the scope's size


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN count(*) OVER w < 2 THEN round(o_totalprice, 6) ELSE round((o_totalprice - avg(o_totalprice) OVER w) / nullif(stddev_pop(o_totalprice) OVER w, 0), 6) END AS z
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus)""")
def agg_11_z_scores(spark, d):
    return R.z_scores(table(spark, d, "orders"), "o_orderstatus", "o_totalprice").select("o_orderkey", "o_orderstatus", F.round("z", 6).alias("z"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(value) FILTER (WHERE k = n // 2) AS p50, max(value) FILTER (WHERE k = CAST(floor(n * 0.95) AS BIGINT)) AS p95, round(avg(value), 6) AS mean FROM r GROUP BY 1""")
def agg_14_percentiles(spark, d):
    found = R.exact_percentiles(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", "p50", "p95", F.round("mean", 6).alias("mean"))


@query("SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_rate, round(sum(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) / greatest(sum(CASE WHEN event_type IN ('view', 'purchase') THEN 1 ELSE 0 END), 1), 6) AS hit_rate FROM events GROUP BY 1")
def agg_15_ratios(spark, d):
    is_ = lambda *names: F.sum(F.col("event_type").isin(*names).cast("double"))
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(is_("error") / F.count(F.lit(1)), 6).alias("error_rate"), F.round(is_("purchase") / F.greatest(is_("view", "purchase"), F.lit(1.0)), 6).alias("hit_rate")
    )


@query("SELECT event_type, user_id % 10 AS endpoint, count(*) AS n FROM events GROUP BY 1, 2")
def agg_16_endpoint_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("endpoint")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS community, count(*) AS size, sum(c_custkey) AS members FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg_17_communities_by_size(spark, d):
    grouped = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("community")).agg(F.count(F.lit(1)).alias("size"), F.sum("c_custkey").alias("members"))
    return grouped.orderBy(F.desc("size"), "community").limit(10)  # the report's length


@query("""WITH v AS (SELECT o_custkey AS entity, o_orderpriority AS community, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT entity, community, n FROM v QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, community DESC) = 1""")
def agg_18_majority_neighbour(spark, d):
    votes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("community")).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("entity").agg(F.max(F.struct("n", "community")).alias("b"))
    return best.select("entity", "b.community", "b.n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS mean, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0 END), 6) AS refusals FROM lineitem GROUP BY 1, 2")
def agg_19_benchmark_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.avg((F.col("l_tax") > 0.04).cast("double")), 6).alias("refusals")
    )


@query("SELECT o_custkey AS doc_id, round(avg(o_totalprice), 6) AS mean, count(*) AS n FROM orders GROUP BY 1")
def agg_20_document_means(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.round(F.avg("o_totalprice"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_type AS type, count(*) AS n, count(DISTINCT p_name) AS names FROM part GROUP BY 1")
def agg_23_stats_by_type(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_name").alias("names"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events")
def win_1_rank_in_path(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("rank"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 2")
def win_2_top_per_group(spark, d):
    return G.top_per(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 2).select("l_orderkey", "l_linenumber")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 9) AS mean, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS n FROM events")
def win_5_rolling_samples(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w.rowsBetween(-999, 0)), 9).alias("mean"), F.count(F.lit(1)).over(w.rowsBetween(-499, 0)).alias("n"))


@query("""SELECT o_custkey, (k - 1) // 20 AS tile, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1, 2""")
def win_6_row_tiles(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor((k - 1) / 20).alias("tile"))
    return rows.groupBy("o_custkey", "tile").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("""SELECT doc_id, pos // 2600 AS k, length(substr(text, CAST(pos + 1 AS BIGINT), 3000)) AS n FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 2600)) AS pos FROM documents)""")
def win_7_text_windows(spark, d):
    starts = F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(2600))
    rows = table(spark, d, "documents").select("doc_id", "text", F.explode(starts).alias("at"))
    return rows.select("doc_id", F.floor(F.col("at") / 2600).alias("k"), F.length(F.substring(F.col("text"), F.col("at") + 1, F.lit(3000))).alias("n"))


@query("SELECT user_id, lower(event_type) AS name, max(value) AS confidence, arg_min(event_id, struct_pack(a := -value, b := event_id)) AS best FROM events GROUP BY 1, 2")
def win_9_best_first(spark, d):
    best = F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("best")
    return table(spark, d, "events").groupBy("user_id", F.lower("event_type").alias("name")).agg(F.max("value").alias("confidence"), best)


@query(f"""WITH {CHUNKS} SELECT chunk_id, format, access FROM chunks WHERE tenant = 3 AND format IN ('F', 'O') AND lower(access) IN ('1-urgent', '2-high')""")
def flt_1_payload_filter(spark, d):
    rows = Graph(spark, d).chunks().where((F.col("tenant") == 3) & F.col("format").isin("F", "O") & F.lower("access").isin("1-urgent", "2-high"))
    return rows.select("chunk_id", "format", "access")


@query("SELECT vec_id FROM embeddings WHERE label <> 3")
def flt_2_must_not(spark, d):
    """Search candidates without those of the query's own document."""
    return table(spark, d, "embeddings").where(F.col("label") != 3).select("vec_id")


@query(r"""SELECT doc_id FROM documents WHERE NOT (length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 80 OR regexp_matches(text, '(?i)^\s*(figure|table)\s*\d+') OR regexp_matches(text, '^\s*\d+(\.\d+)?\s*[A-Z][\w\s]{0,40}\s*$'))""")
def flt_3_fragments(spark, d):
    return table(spark, d, "documents").where(~X.is_fragment(F.col("text"))).select("doc_id")


@query("SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE quality >= 0.6 OR length(text) < 200")
def flt_4_consistency(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where((F.col("quality") >= 0.6) | (F.length("text") < 200)).select("doc_id", "n_chars", "quality")


@query(f"""WITH {VERSIONS} SELECT id, valid_to IS NULL AS active, valid_to IS NOT NULL AS past, (valid_from IS NULL OR valid_from <= DATE '1997-12-31') AND (valid_to IS NULL OR valid_to >= DATE '1997-01-01') AS in_1997 FROM versions""")
def flt_7_temporal(spark, d):
    low, high = F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")
    return versions(spark, d).select(
        "id", F.col("valid_to").isNull().alias("active"), F.col("valid_to").isNotNull().alias("past"), S.overlaps(F.col("valid_from"), F.col("valid_to"), low, high).alias("in_1997")
    )


@query(f"""WITH {SIZED}, {ENTITIES}, keep AS (SELECT entity_id FROM entities WHERE lower(type) NOT IN ('promo', 'economy')), p AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS shared FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id < y.entity_id GROUP BY 1, 2)
    SELECT a, b, shared FROM p WHERE a IN (SELECT entity_id FROM keep) AND b IN (SELECT entity_id FROM keep)""")
def flt_8_type_exclusion(spark, d):
    g = Graph(spark, d)
    out = g.entities().where(F.lower("type").isin("promo", "economy"))
    pairs = G.co_occurrence(g.contains())
    for side in ("a", "b"):
        pairs = pairs.join(out.select(F.col("entity_id").alias(side)), side, "left_anti")
    return pairs.select("a", "b", "shared")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR")
def flt_10_time_to_live(spark, d):
    return table(spark, d, "events").where(F.col("ts") >= F.expr("timestamp '2024-01-30 00:00:00' - interval 24 hours")).select("event_id")


@query(f"WITH {ENTITIES} SELECT type, count(*) AS n, array_to_string(list_sort(list(DISTINCT name))[1:20], '|') AS samples FROM entities GROUP BY 1")
def flt_12_type_lookup(spark, d):
    rows = Graph(spark, d).entities()
    few = G.top_per(rows.select("type", "name").distinct(), ["type"], [F.asc("name")], 20)  # the lookup's samples
    names = few.groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("samples"))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(names, "type", "left")


@query(f"WITH {CHUNKS} SELECT chunk_id, coalesce(source, 'unknown') AS source, coalesce(nullif(format, 'P'), 'paragraph') AS level, round(coalesce(nullif(price, 0), 0.7), 2) AS consistency FROM chunks")
def prj_1_defaults(spark, d):
    return Graph(spark, d).chunks().select(
        "chunk_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce(F.nullif("format", F.lit("P")), F.lit("paragraph")).alias("level"),
        F.round(F.coalesce(F.nullif("price", F.lit(0.0)), F.lit(0.7)), 2).alias("consistency"),
    )


@query("""SELECT conv_id, string_agg('[' || conv_id || '::' || turn || '] ' || substr(text, 1, 1200), chr(10) || '---' || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1""")
def prj_3_context(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("["), "conv_id", F.lit("::"), "turn", F.lit("] "), F.substring("text", 1, 1200)).alias("s"))
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "s"))).getField("s"), "\n---\n").alias("context"))


@query("SELECT doc_id, source, substr(text, 1, 500) AS text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def prj_4_sources(spark, d):
    rows = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(5)  # the answer's sources
    return rows.select("doc_id", "source", F.substring("text", 1, 500).alias("text"))


@query("SELECT o_custkey AS k, 'order' AS path FROM orders UNION ALL SELECT l_suppkey, 'line' FROM lineitem")
def set_1_union_of_paths(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("path"))
    return orders.unionByName(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.lit("line").alias("path")))


@query("SELECT lower(p_name) AS name, min(p_partkey) AS first FROM part GROUP BY 1")
def set_2_distinct_in_order(spark, d):
    rows = table(spark, d, "part").select(F.lower("p_name").alias("name"), F.col("p_partkey").alias("first"))
    return G.top_per(rows, ["name"], [F.asc("first")], 1).drop("rank")


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 45")
def set_3_difference(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def set_4_intersection(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(rows.where("l_linestatus = 'O'").select(F.col("l_partkey").alias("k")))


@query(f"WITH {SIZED}, p AS (SELECT DISTINCT x.entity_id AS a, y.entity_id AS b FROM sized x JOIN sized y USING (chunk_id) WHERE x.entity_id < y.entity_id) SELECT a, b FROM p UNION SELECT b, a FROM p")
def set_5_symmetric_closure(spark, d):
    return G.both_ways(G.co_occurrence(Graph(spark, d).contains()).select("a", "b"))


@query(f"""WITH {CONTAINS}, {ENTITIES} SELECT type, entity_id, count(*) AS degree FROM contains_ JOIN entities USING (entity_id) GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, entity_id) <= 4000""")
def top_7_degree_cap(spark, d):
    g = Graph(spark, d)
    rows = G.degrees(g.entities(), g.contains()).where("degree > 0").select("type", "entity_id", "degree")
    return G.top_per(rows, ["type"], [F.desc("degree"), F.asc("entity_id")], 4000).drop("rank")


@query("""WITH s AS (SELECT o_custkey AS q, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r1, o_orderdate FROM orders QUALIFY r1 <= 20),
    t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o_orderdate DESC, id) AS r2 FROM s QUALIFY r2 <= 10) SELECT q, id, r1, r2 FROM t QUALIFY row_number() OVER (PARTITION BY q ORDER BY r1 + r2, id) <= 5""")
def top_8_stage_cuts(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    one = G.top_per(rows, ["q"], [F.desc("o_totalprice"), F.asc("id")], 20, "r1")
    two = G.top_per(one, ["q"], [F.desc("o_orderdate"), F.asc("id")], 10, "r2")
    return G.top_per(two, ["q"], [F.asc(F.col("r1") + F.col("r2")), F.asc("id")], 5, "r3").select("q", "id", "r1", "r2")


@query(f"WITH {CONTAINS}, {ENTITIES} SELECT name, count(*) AS degree FROM contains_ JOIN entities USING (entity_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def top_10_graph_view(spark, d):
    g = Graph(spark, d)
    counted = g.contains().join(g.entities(), "entity_id").groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    return counted.orderBy(F.desc("degree"), "name").limit(100)  # the view's size


@query("""SELECT user_id, min_by(event_id, ts) AS first, date_trunc('minute', ts) AS minute, event_type FROM events GROUP BY user_id, event_type, date_trunc('minute', ts)""")
def str_2_minute_duplicates(spark, d):
    minute = F.date_trunc("minute", F.col("ts")).alias("minute")
    return table(spark, d, "events").groupBy("user_id", "event_type", minute).agg(F.min_by("event_id", "ts").alias("first")).select("user_id", "first", "minute", "event_type")


@query("""SELECT user_id, event_type, max(ts) AS seen, bool_or(ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR) AS alive FROM events GROUP BY 1, 2""")
def str_3_state_with_ttl(spark, d):
    alive = F.bool_or(F.col("ts") >= F.expr("timestamp '2024-01-30 00:00:00' - interval 24 hours")).alias("alive")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"), alive)


@query("""SELECT conv_id, turn, unnest(range(0, greatest(length(text), 1), 24)) // 24 AS k FROM conversations""")
def str_7_pseudo_tokens(spark, d):
    starts = F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(24))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.transform(starts, lambda x: F.floor(x / 24))).alias("k"))


@query(f"""WITH {CONTAINS} SELECT chunk_id, count(*) AS hits FROM contains_ WHERE entity_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def svc_1_chunks_for_entities(spark, d):
    g = Graph(spark, d)
    hits = g.contains().join(g.entities().where("brand = 'Brand#2'"), "entity_id", "left_semi").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.orderBy(F.desc("hits"), "chunk_id").limit(15)  # the action's result size


@query("SELECT e.event_type AS type, count(*) AS n, max(ts) AS last FROM events e WHERE user_id = 8 GROUP BY 1")
def svc_6_audit_by_tenant(spark, d):
    return table(spark, d, "events").where("user_id = 8").groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


@query(f"WITH {CONTAINS}, {ENTITIES}, {CHUNKS} SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM contains_) AS mentions, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT tenant) FROM chunks) AS tenants")
def svc_7_statistics(spark, d):
    g = Graph(spark, d)
    one = lambda df, c, a: df.agg(a.alias(c))  # noqa: E731  one row each
    out = one(g.entities(), "entities", F.count(F.lit(1))).crossJoin(one(g.contains(), "mentions", F.count(F.lit(1))))
    return out.crossJoin(g.chunks().agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("tenant").alias("tenants")))


@query(f"""WITH {ENTITIES} SELECT entity_id, name FROM entities WHERE contains(lower(name), 'widget') ORDER BY name, entity_id LIMIT 10""")
def act_1_search_entity(spark, d):
    return Graph(spark, d).entities().where(F.lower("name").contains("widget")).orderBy("name", "entity_id").limit(10).select("entity_id", "name")  # the action's result size


@query(f"""WITH {CONTAINS}, {ENTITIES}, seen AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT chunk_id, count(DISTINCT name) AS matches, round(count(DISTINCT name) / 3.0, 6) AS score
    FROM contains_ JOIN entities USING (entity_id) WHERE name IN {ASKED} AND chunk_id NOT IN (SELECT o_orderkey FROM seen) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def act_3_retrieve_chunks(spark, d):
    g = Graph(spark, d)
    hits = g.contains().join(g.entities().where(F.col("name").isin(*ASKED)), "entity_id").groupBy("chunk_id").agg(F.countDistinct("name").alias("matches"))
    seen = g.read("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("chunk_id"))
    new = hits.join(seen, "chunk_id", "left_anti").withColumn("score", F.round(F.col("matches") / 3.0, 6))
    return new.orderBy(F.desc("matches"), "chunk_id").limit(15)  # the action's result size


@query(f"WITH {ENTITIES} SELECT count(*) AS n, array_to_string(list_sort(list(name || ':' || entity_id))[1:20], '|') AS samples FROM entities WHERE type = 'PROMO'")
def act_9_count_entities(spark, d):
    rows = Graph(spark, d).entities().where("type = 'PROMO'")
    few = rows.select(F.concat("name", F.lit(":"), "entity_id").alias("s")).orderBy("s").limit(20)  # the action's samples
    names = few.agg(F.array_join(F.array_sort(F.collect_list("s")), "|").alias("samples"))
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(names)  # one row each
