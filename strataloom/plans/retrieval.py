"""Composite retrieval, resolution and validation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import score as S
from strataloom.functions import text as X
from strataloom.functions import vector as V
from strataloom.operators import graph as G
from strataloom.operators import names as N
from strataloom.operators import ranking as R
from strataloom.operators import retrieval as P
from strataloom.operators import text_index as T
from strataloom.plans.joins import ASKED
from strataloom.plans.registry import CONTAINS, ENTITIES, VECTORS, Graph, query, table
from strataloom.plans.vectors import CENTROIDS, COS, asked, label_centers
from strataloom.sources import files
from strataloom.sources.shared import folder

TERMS = ("thereon", "erthat", "the", "leaux", "schung")


TERM_SEARCH = f"""WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents), n AS (SELECT doc_id, count(*) AS len FROM w WHERE t <> '' GROUP BY 1),
    s AS (SELECT count(*) AS docs, avg(len) AS mean FROM n), tf AS (SELECT doc_id, t, count(*) AS tf FROM w WHERE t IN {TERMS} GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1)
    SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (t) JOIN n USING (doc_id), s GROUP BY 1
    QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 30"""


@query(TERM_SEARCH)
def top_2_term_search(spark, d):
    """BM25 with k1 = 1.2 and b = 0.75: the 30 best documents for a question's terms."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_remove(F.split(F.lower("text"), " "), "")).alias("t"))
    lengths = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("len"))
    stats = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    tf = words.where(F.col("t").isin(*TERMS)).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(df, "t").join(lengths, "doc_id").crossJoin(F.broadcast(stats))  # one row
    weight = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean")))
    scored = rows.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(30)  # the path's k


@query(TERM_SEARCH)
def top_2_index_search(spark, d):
    """The same documents from a stored index, of which only the asked terms' postings are read."""
    path = f"{folder(spark)}/terms-{uuid.uuid4().hex}"
    T.build_index(table(spark, d, "documents"), path)
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.explode(F.array(*map(F.lit, TERMS))).alias("term"))
    return T.search_index(spark, path, asked, 30).select(F.col("doc").alias("doc_id"), "score")


@query(f"""WITH {CONTAINS}, {VECTORS}, m AS (SELECT entity_id, vec FROM contains_ JOIN vectors ON chunk_id = id), parts AS (SELECT entity_id, pos, avg(vec[pos]) AS x FROM m, range(1, 65) t(pos) GROUP BY 1, 2),
    c AS (SELECT entity_id, list(x ORDER BY pos) AS v FROM parts GROUP BY 1) SELECT entity_id, round(v[1] / sqrt(list_inner_product(v, v)), 4) + 0.0 AS first FROM c""")
def agg_3_entity_centroids(spark, d):
    g = Graph(spark, d)
    rows = g.contains().join(g.vectors().withColumnRenamed("id", "chunk_id"), "chunk_id")
    return R.centroids(rows, "entity_id").select("entity_id", (F.round(F.element_at("vec", 1), 4) + 0.0).alias("first"))


@query(f"""WITH {CONTAINS}, {ENTITIES} SELECT chunk_id, count(DISTINCT name) AS matches, round(count(DISTINCT name) / 3.0, 6) AS score FROM contains_ JOIN entities USING (entity_id) WHERE name IN {ASKED} GROUP BY 1
    QUALIFY row_number() OVER (ORDER BY matches DESC, chunk_id) <= 30""")
def ret_2_entity_pivot(spark, d):
    g = Graph(spark, d)
    hits = g.contains().join(g.entities().where(F.col("name").isin(*ASKED)), "entity_id").groupBy("chunk_id").agg(F.countDistinct("name").alias("matches"))
    return hits.orderBy(F.desc("matches"), "chunk_id").limit(30).withColumn("score", F.round(F.col("matches") / 3.0, 6))  # the path's k


@query(f"WITH {CENTROIDS}, s AS (SELECT q.query_id, v.query_id AS community, {COS} AS score FROM centers q JOIN centers v ON q.query_id <> v.query_id) SELECT query_id, community, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) <= 5")
def ret_4_community_path(spark, d):
    centers = label_centers(Graph(spark, d))
    found = R.vector_search(centers.select(F.col("query_id").alias("id"), "vec"), centers, 6).where("id <> query_id")
    return G.top_per(found.select("query_id", F.col("id").alias("community"), "score"), ["query_id"], [F.desc("score"), F.asc("community")], 5).drop("rank")


@query(f"""WITH {CONTAINS}, {CENTROIDS}, s AS (SELECT query_id, v.id, {COS} AS score FROM centers q, vectors v), b AS (SELECT id, max(score) AS best FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)
    SELECT id AS chunk_id, best, count(entity_id) AS entities FROM b LEFT JOIN contains_ ON chunk_id = id GROUP BY 1, 2""")
def ret_11_scope(spark, d):
    """The 100 best-scored chunks over all paths, as the scope of the entity paths."""
    g = Graph(spark, d)
    found = R.vector_search(g.vectors(), label_centers(g), 100)
    scope = found.groupBy(F.col("id").alias("chunk_id")).agg(F.max("score").alias("best")).orderBy(F.desc("best"), "chunk_id").limit(100)  # the scope's size
    return scope.join(g.contains(), "chunk_id", "left").groupBy("chunk_id", "best").agg(F.count("entity_id").alias("entities"))


@query(f"""WITH {VECTORS}, q AS (SELECT id AS query_id, vec FROM vectors WHERE id % 20 = 0), s AS (SELECT query_id, v.id, {COS} AS score FROM q JOIN vectors v ON v.id < query_id)
    SELECT query_id, max(score) AS score, max(score) >= 0.3 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 3 GROUP BY 1""")
def qry_4_history_cache(spark, d):
    """For each asked vector, the closest of the earlier ones, accepted from a similarity on."""
    g = Graph(spark, d)
    near = R.vector_search(g.vectors(), asked(g).select("query_id", "vec"), 3, earlier=True)
    best = near.groupBy("query_id").agg(F.max("score").alias("score"))
    return best.withColumn("hit", F.col("score") >= 0.3)


@query(f"""WITH {VECTORS}, q AS (SELECT id AS query_id, vec FROM vectors WHERE id % 20 = 0 UNION ALL SELECT id, list_concat(vec[1:32], list_transform(range(32), lambda x: CAST(0 AS DOUBLE))) FROM vectors WHERE id % 20 = 0),
    s AS (SELECT query_id, v.id, {COS} AS score FROM q JOIN vectors v ON v.id < query_id) SELECT query_id, max_by(id, struct_pack(s := score, i := -id)) AS id, max(score) AS score FROM s GROUP BY 1 HAVING max(score) >= 0.3""")
def top_9_cached_answer(spark, d):
    """The best earlier entry over two variants of a question, where it is similar enough."""
    g = Graph(spark, d)
    plain = asked(g).select("query_id", "vec")
    spelled = plain.select("query_id", F.concat(F.slice("vec", 1, 32), F.array_repeat(F.lit(0.0).cast("float"), 32)).alias("vec"))
    near = R.vector_search(g.vectors(), plain, 3, earlier=True).unionByName(R.vector_search(g.vectors(), spelled, 3, earlier=True))
    best = near.groupBy("query_id").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))
    return best.where("score >= 0.3")


@query(rf"""WITH p AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), s AS (SELECT conv_id, turn, substr(text, 1, 500) AS query, substr(answer, 1, 4000) AS answer FROM p
    WHERE role = 'user' AND next = 'assistant' AND NOT (length(regexp_replace(answer, '^\s+|\s+$', '', 'g')) < 200 AND regexp_matches(lower(answer), '{"|".join(X.REFUSALS).replace("'", "''")}'))) SELECT * FROM s WHERE turn >= (SELECT max(turn) FROM conversations) - 24""")
def qry_4_history_store(spark, d):
    """Question and answer pairs as the history keeps them: no refusals, cut to length, and none older than the last 24 ticks."""
    rows = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = rows.withColumns({"answer": F.lead("text").over(w), "next": F.lead("role").over(w)}).where("role = 'user' and next = 'assistant'").where(~X.is_refusal(F.col("answer")))
    newest = rows.agg(F.max("turn").alias("now"))
    kept = pairs.crossJoin(F.broadcast(newest)).where("turn >= now - 24")  # one row
    return kept.select("conv_id", "turn", F.substring("text", 1, 500).alias("query"), F.substring("answer", 1, 4000).alias("answer"))


@query()
def val_4_citation_gate(spark, d):
    ratio = X.citation_ratio(F.col("text"))
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", (ratio >= 0.7).alias("citation_pass"))


@query("""WITH u AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations) SELECT conv_id || '::paragraph::' || turn AS chunk_id, coalesce(conv_id || '::paragraph::' || parent, '') AS parent_id FROM u""")
def chk_15_chunk_ids(spark, d):
    name = lambda c: F.concat(F.col("conv_id").cast("string"), F.lit("::paragraph::"), F.col(c).cast("string"))
    units = table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("parent"))
    known = units.select("conv_id", F.col("turn").alias("parent"), name("turn").alias("parent_id"))
    return units.join(known, ["conv_id", "parent"], "left").select(name("turn").alias("chunk_id"), F.coalesce("parent_id", F.lit("")).alias("parent_id"))


@query()
def grf_9_canonical_names(spark, d):
    """Each part name of a type with its canonical name and the tier that found it: an equal name but for space and case, the
    name most alike (matching blocks, .85 at least) of those mentioned more often, or itself."""
    g = Graph(spark, d)
    names = G.degrees(g.entities(), g.contains()).groupBy("type", "name").agg(F.sum("degree").alias("degree"))
    keyed = names.withColumn("key", X.normal_name(F.col("name")))
    first = keyed.groupBy("type", "key").agg(F.max_by("name", F.struct("degree", "name")).alias("equal"))
    keyed = keyed.join(first, ["type", "key"])
    alike = N.similar_names(names, 0.85)
    alike = alike.unionByName(alike.select("type", F.col("b").alias("a"), F.col("a").alias("b"), "ratio"))
    ranked = alike.join(names.toDF("type", "a", "da"), ["type", "a"]).join(names.toDF("type", "b", "db"), ["type", "b"]).where("db > da")
    best = ranked.groupBy("type", F.col("a").alias("name")).agg(F.max_by("b", F.struct("ratio", "db", "b")).alias("close"))
    rows = keyed.join(best, ["type", "name"], "left")
    equal = F.when(F.col("equal") != F.col("name"), F.col("equal"))
    tier = F.when(equal.isNotNull(), "equal").when(F.col("close").isNotNull(), "alike").otherwise("new")
    return rows.select("type", "name", F.coalesce(equal, "close", "name").alias("canonical"), tier.alias("tier"))


@query(f"""WITH {ENTITIES}, c AS (SELECT DISTINCT lower(p_brand) AS candidate FROM part UNION SELECT 'unknown brand' UNION SELECT '#1') SELECT candidate, bool_or(lower(brand) = candidate) AS exact, count(brand) FILTER (WHERE contains(lower(brand), candidate)) AS contained FROM c LEFT JOIN entities ON contains(lower(brand), candidate) GROUP BY 1""".replace("bool_or(lower(brand) = candidate)", "coalesce(bool_or(lower(brand) = candidate), false)"))
def val_3_entity_gate(spark, d):
    g = Graph(spark, d)
    names = g.entities().groupBy(F.lower("brand").alias("known")).agg(F.count(F.lit(1)).alias("n"))
    candidates = names.select(F.col("known").alias("candidate")).union(spark.range(1).select(F.explode(F.array(F.lit("unknown brand"), F.lit("#1")))))
    size = lambda c: F.least(F.length(c), F.lit(5))  # noqa: E731  # short candidates meet on all of their letters
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("known") - n + 1, F.lit(1))), lambda i: F.substring(F.col("known"), i, F.lit(n)))
    blocks = names.select("known", "n", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in range(1, 6)]))).alias("block"))
    pairs = candidates.withColumn("block", F.substring(F.col("candidate"), F.lit(1), size(F.col("candidate")))).join(blocks, "block", "left").withColumn("in_", F.col("known").contains(F.col("candidate")))
    return pairs.groupBy("candidate").agg(
        F.coalesce(F.bool_or(F.col("known") == F.col("candidate")), F.lit(False)).alias("exact"), F.coalesce(F.sum(F.when(F.col("in_"), F.col("n"))), F.lit(0)).alias("contained")
    )


@query()
def val_3_ratio_tier(spark, d):
    """Words of answers that start with a capital, and how the entity names know them: the exact name, the name most alike
    (matching blocks, .80 at least), one that holds the other, or not at all."""
    g = Graph(spark, d)
    word = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][A-Za-z0-9#-]+\b"), F.lit(0))))
    said = table(spark, d, "conversations").where("role = 'assistant'").select(word.alias("name")).distinct()
    known = g.entities().select(F.explode(F.split("name", " ")).alias("name")).union(g.entities().select("brand")).distinct()
    rows = said.select(F.lower("name").alias("candidate")).distinct()
    names = known.select(F.lower("name").alias("known")).distinct()
    alike = N.similar_names(rows.select(F.lit(0).alias("type"), F.col("candidate").alias("name")), 0.80, known=names.select(F.lit(0).alias("type"), F.col("known").alias("name")))
    alike = alike.unionByName(alike.select("type", F.col("b").alias("a"), F.col("a").alias("b"), "ratio"))
    close = alike.join(names.withColumnRenamed("known", "b"), "b", "left_semi").groupBy(F.col("a").alias("candidate")).agg(F.max_by("b", F.struct("ratio", "b")).alias("close"))
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    pieces = lambda c: F.array_distinct(F.concat(*[runs(c, n) for n in (1, 2, 3)]))  # noqa: E731  # shorter names meet on all of their letters
    head = lambda c: F.substring(c, 1, 3)
    inside = rows.withColumn("k", head("candidate")).join(names.select("known", F.explode(pieces(F.col("known"))).alias("k")), "k").where("contains(known, candidate)")
    holds = rows.select("candidate", F.explode(pieces(F.col("candidate"))).alias("k")).join(names.withColumn("k", head("known")), "k").where("contains(candidate, known)")
    held = inside.select("candidate", "known").unionByName(holds.select("candidate", "known")).groupBy("candidate").agg(F.min("known").alias("held"))
    found = rows.join(names.select(F.col("known").alias("candidate"), F.lit(True).alias("exact")), "candidate", "left").join(close, "candidate", "left").join(held, "candidate", "left")
    tier = F.when(F.col("exact"), "exact").when(F.col("close").isNotNull(), "alike").when(F.col("held").isNotNull(), "contained").otherwise("unknown")
    return found.select("candidate", tier.alias("tier"), F.when(tier == "alike", F.col("close")).when(tier == "contained", F.col("held")).alias("known"))


@query("""SELECT l_orderkey, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0 END), 6) AS cited, avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0 END) >= 0.7 AS citation_pass, bool_and(l_returnflag <> 'R') AS entity_pass,
    round(avg(l_quantity / 50) * CASE WHEN bool_and(l_returnflag <> 'R') THEN 1.0 ELSE 0.8 END * CASE WHEN avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0 END) >= 0.7 THEN 1.0 ELSE 0.9 END, 6) AS confidence FROM lineitem GROUP BY 1""")
def val_5_verdict(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.avg((F.col("l_discount") >= 0.05).cast("double")).alias("c"), F.bool_and(F.col("l_returnflag") != "R").alias("entity_pass"), F.avg(F.col("l_quantity") / 50).alias("grounded")
    )
    passed = F.col("c") >= 0.7
    return rows.select("l_orderkey", F.round("c", 6).alias("cited"), passed.alias("citation_pass"), "entity_pass", F.round(S.confidence(F.col("grounded"), F.col("entity_pass"), passed), 6).alias("confidence"))


_CLAIMS = r"""SELECT 'item-' || item_id AS claim_id, text AS claim FROM benchmark UNION ALL SELECT 'order-' || chunk_id, string_agg(upper(substr(name, 1, 1)) || substr(name, 2) || ' of ' || brand, ' and ' ORDER BY entity_id) FROM contains_ JOIN entities USING (entity_id) GROUP BY chunk_id"""


@query(rf"""WITH {CONTAINS}, {ENTITIES}, claims AS ({_CLAIMS}), w AS (SELECT claim_id, unnest(range(len(ws))) AS place, unnest(ws) AS word FROM (SELECT claim_id, list_filter(string_split_regex(claim, '[ \t\n\r\f]+'), lambda w: regexp_matches(w, '^\p{{Lu}}') AND length(w) > 2)[1:5] AS ws FROM claims WHERE length(trim(claim)) >= 5)),
    hits AS (SELECT word, name, entity_id FROM (SELECT DISTINCT word FROM w) JOIN entities ON contains(lower(name), lower(word)) OR lower(regexp_replace(name, '[ _]+', '', 'g')) = lower(regexp_replace(word, '[ _]+', '', 'g')) QUALIFY row_number() OVER (PARTITION BY word ORDER BY name, entity_id) <= 10),
    e AS (SELECT claim_id, place, name, entity_id FROM w JOIN hits USING (word) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY place, name, entity_id) <= 10), n AS (SELECT claim_id, count(*) AS candidates FROM w GROUP BY 1), f AS (SELECT claim_id, count(*) AS found, string_agg(entity_id, ',' ORDER BY place, name, entity_id) AS evidence FROM e GROUP BY 1)
    SELECT claim_id, coalesce(candidates, 0) AS candidates, coalesce(found, 0) AS found, round(coalesce(found / candidates, 0), 6) AS support_ratio, coalesce(found / candidates, 0) >= 0.5 AS supported, coalesce(evidence, '') AS evidence FROM claims LEFT JOIN n USING (claim_id) LEFT JOIN f USING (claim_id)""")
def act_10_verify_facts(spark, d):
    """Claims of the benchmark, and of every order on its parts, held against the entities."""
    g = Graph(spark, d)
    said = F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)"), F.lit(" of "), "brand")
    orders = g.contains().join(g.entities(), "entity_id").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("entity_id", said.alias("s")))).getField("s"), " and ").alias("claim"))
    claims = table(spark, d, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("claim_id"), F.col("text").alias("claim")).unionByName(orders.select(F.concat(F.lit("order-"), "chunk_id").alias("claim_id"), "claim"))
    found = P.verify_facts(claims, g.entities())
    return found.select("claim_id", "candidates", "found", F.round("support_ratio", 6).alias("support_ratio"), "supported", F.array_join(F.transform("evidence", lambda e: e["entity_id"].cast("string")), ",").alias("evidence"))


@query("SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) % 5 = 1")
def src_13_size_sample(spark, d):
    """A systematic sample over the sizes within each source: every fifth document."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    return files.size_sample(rows, 5, ["n_chars", "doc_id"], "source").select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def src_14_not_done(spark, d):
    done = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("SELECT user_id, event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events")
def prj_2_metadata(spark, d):
    decoded = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return table(spark, d, "events").select("user_id", "event_id", F.coalesce(F.element_at(F.map_filter(decoded, lambda k, v: v.isNotNull()), "k").cast("long"), F.lit(0)).alias("k"))


@query()
def fn_14_spans_and_times(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", X.clean_span(F.col("text")).alias("span"), S.temporal_intent(F.col("text")).alias("time"))
