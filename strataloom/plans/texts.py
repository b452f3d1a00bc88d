"""Queries over texts: names, masks, quality, routing, chunking, scores of time and path."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import domain as D
from strataloom.functions import score as S
from strataloom.functions import text as X
from strataloom.functions import vector as V
from strataloom.operators import chunking as C
from strataloom.operators import graph as G
from strataloom.operators import names as N
from strataloom.plans.registry import CONTAINS, ENTITIES, Graph, query, table


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def any_sql(column: str, patterns) -> str:
    return f"regexp_matches({column}, {quoted('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def count_sql(column: str, patterns) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({column}, {quoted('(?i)' + p)}))" for p in patterns) + ")"


def has_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


@query(r"""SELECT c_custkey, substr(regexp_replace(regexp_replace(c_name || ' / ' || c_mktsegment, '\s+', ' ', 'g'), '[^\w\s\-]', '_', 'g'), 1, 200) AS name FROM customer""")
def fn_1_sanitized_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.sanitize_name(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("name"))


@query(r"""SELECT p_partkey, lower(regexp_replace(p_name, '[\s_]+', '', 'g')) AS normal, regexp_replace(lower(p_brand), '[^0-9a-z]', '', 'g') AS skeleton FROM part""")
def fn_3_normal_names(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normal_name(F.col("p_name")).alias("normal"), X.skeleton(F.col("p_brand")).alias("skeleton"))


@query(r"""WITH n AS (SELECT DISTINCT p_brand AS b, regexp_replace(lower(p_brand), '[^0-9a-z]', '', 'g') AS k FROM part) SELECT x.b AS a, y.b AS b FROM n x JOIN n y ON x.k = y.k AND x.k <> ''""")
def fn_4_equal_skeletons(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("a")).distinct().withColumn("k", X.skeleton(F.col("a"))).where("k <> ''")
    return rows.join(rows.withColumnRenamed("a", "b"), "k").select("a", "b")


@query()
def fn_5_similar_names(spark, d):
    """Pairs of different part names of a type whose matching blocks hold .80 of their letters or more."""
    names = Graph(spark, d).entities().select("type", "name").distinct()
    return N.similar_names(names, 0.8).withColumn("ratio", F.round("ratio", 6))


_RUNS = r"list_filter(regexp_extract_all(text, '\d+'), lambda x: {})"


@query(
    rf"""SELECT doc_id, len(regexp_extract_all(text, {quoted(X.MASKS[0][1])})) AS email, len(regexp_extract_all(text, {quoted(X.MASKS[2][1])})) AS url, len(regexp_extract_all(text, {quoted(X.MASKS[3][1])})) AS ip,
    len({_RUNS.format("regexp_full_match(x, '(?:84|0)(?:3[2-9]|5[6-9]|7[06-9]|8[1-9]|9[0-46-9])[0-9]{7}')")}) AS phone, len({_RUNS.format("length(x) BETWEEN 8 AND 14")}) AS account, len({_RUNS.format("length(x) IN (9, 12)")}) AS id_number FROM documents"""
)
def fn_7_personal_values(spark, d):
    """How many values of each kind a text has, each kind for itself."""
    counts = [F.regexp_count("text", F.lit(pattern)).cast("long").alias(kind.lower()) for kind, pattern in X.MASKS]
    return table(spark, d, "documents").select("doc_id", *counts)


@query()
def fn_8_masked_documents(spark, d):
    """Masked text of every document, how many values went, and whether unmasking gives the text back."""
    rows = table(spark, d, "documents").select("doc_id", "text", X.masked(F.col("text")).alias("m"))
    return rows.select("doc_id", F.col("m.text").alias("masked"), F.size("m.values").alias("n"), (X.unmask(F.col("m.text"), F.col("m.values")) == F.col("text")).alias("round_trip"))


@query(f"SELECT conv_id, turn, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 200 AND {any_sql('lower(text)', X.REFUSALS)} AS refusal FROM conversations")
def fn_11_refusals(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.is_refusal(F.col("text")).alias("refusal"))


@query()
def fn_10_citations(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(X.citation_ratio(F.col("text")), 6).alias("ratio"))


@query()
def fn_12_entity_candidates(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.title_entities(F.col("text")).alias("candidates"))


@query("SELECT doc_id, substr(text, 1, 2000) AS a, substr(text, 1, 150) AS b FROM documents")
def fn_16_truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 2000).alias("a"), F.substring("text", 1, 150).alias("b"))


AXES = {"the ": 1.0, "que ": 0.5, "und ": 0.75, "con ": 0.25, "license": 2.0, "@": 1.5}
"""Words and weights of a domain axis that the synthetic prose has."""


@query("SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), {quoted(w)}) THEN CAST({v} AS DOUBLE) ELSE 0 END" for w, v in AXES.items()) + " AS score FROM documents")
def fn_17_keyword_score(spark, d):
    return table(spark, d, "documents").select("doc_id", X.keyword_score(F.col("text"), AXES).alias("score"))


@query(r"""SELECT doc_id, CAST(regexp_matches(text, '(?mi)^\s*[-*+]\s') AS INTEGER) + CAST(regexp_matches(text, '(?mi)^.* \| .*$') AS INTEGER) + CAST(regexp_matches(text, '(?mi)^\d+\.\s') AS INTEGER) AS score FROM documents""")
def fn_18_structure_score(spark, d):
    hit = lambda p: F.col("text").rlike(p).cast("int")
    return table(spark, d, "documents").select("doc_id", (hit(r"(?mi)^\s*[-*+]\s") + hit(r"(?mi)^.* \| .*$") + hit(r"(?mi)^\d+\.\s")).alias("score"))


_WORDS = r"len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))"


@query()
def fn_20_chunk_quality(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.quality(F.col("text"), F.col("n_chars") % 40).alias("q"))
    return rows.select("doc_id", "q.overall", "q.has_structure", *[F.col(f"q.{c}").cast("long").alias(c) for c in ("hedges", "promotion", "drafts")])


@query()
def flt_5_quality_filter(spark, d):
    """Every document with its score, whether it is accepted, and why not."""
    rows = table(spark, d, "documents").select("doc_id", F.length(X.strip(F.col("text"))).alias("n"), X.quality(F.col("text"), F.col("n_chars") % 40).alias("q"))
    why = F.array(F.when(F.col("n") < 50, "too short"), F.when(F.col("n") > 5000, "too long"), F.when(F.col("q.drafts") > 0, "draft"), F.when(F.col("q.promotion") > 2, "promotion"), F.when(~F.col("q.has_structure"), "no structure"))
    reasons = F.when(F.col("q.accept"), F.lit("")).otherwise(F.concat_ws(", ", F.filter(why, lambda w: w.isNotNull())))
    return rows.select("doc_id", "q.overall", "q.accept", reasons.alias("reasons"))


@query()
def fn_14_comparative_spans(spark, d):
    """The names that a turn compares."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.comparative_spans(F.col("text")).alias("names"))


@query("SELECT conv_id, turn, CASE WHEN s = 0 THEN 'factual_definition' ELSE 'comparison_analysis' END AS best FROM (SELECT conv_id, turn, CAST(contains(lower(text), 'compare') AS INTEGER) AS s FROM conversations)")
def fn_37_query_domains(spark, d):
    """The leading axis of each turn; the synthetic turns have none of the patterns but 'compare', so most tie on the first axis."""
    rows = table(spark, d, "conversations").withColumn("p", D.tag_query(F.col("text")))
    return rows.select("conv_id", "turn", D.dominant(F.col("p"), list(D.DOMAIN_AXES)).alias("best"))


_KINDS = {"PROMO": ("research_paper",), "ECONOMY": ("business_finance",), "LARGE": ("technical_code",), "SMALL": ("technical_code", "research_paper"), "STANDARD": ("method_algorithm",), "MEDIUM": ("method_algorithm",)}
_AXIS_COUNTS = ", ".join(f"exp(0.5 * count(*) FILTER (WHERE upper(type) IN ({', '.join(quoted(k) for k, a in _KINDS.items() if axis in a)})))" if any(axis in a for a in _KINDS.values()) else "CAST(1 AS DOUBLE)" for axis in D.DOMAIN_AXES)


@query(f"""WITH {CONTAINS}, {ENTITIES}, e AS (SELECT chunk_id, [{_AXIS_COUNTS}] AS e FROM contains_ JOIN entities USING (entity_id) GROUP BY 1)
    SELECT chunk_id, round(list_max(e) / list_sum(e), 6) AS share, [{', '.join(map(quoted, D.DOMAIN_AXES))}][list_position(e, list_max(e))] AS best FROM e""")
def fn_39_entity_domains(spark, d):
    """The leading axis of a chunk by the types of its entities alone."""
    g = Graph(spark, d)
    rows = g.contains().join(g.entities(), "entity_id").groupBy("chunk_id").agg(F.collect_list("type").alias("types"))
    rows = rows.withColumn("p", D.tag_entities(F.col("types"), D.DOMAIN_AXES, _KINDS))
    return rows.select("chunk_id", F.round(F.array_max("p"), 6).alias("share"), D.dominant(F.col("p"), list(D.DOMAIN_AXES)).alias("best"))


@query(f"SELECT conv_id, turn, {any_sql('text', X.OUT_OF_DOMAIN)} AS ood, {any_sql('text', X.CORPUS_WIDE)} AS corpus_wide FROM conversations")
def fn_21_query_guards(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.out_of_domain(F.col("text")).alias("ood"), X.corpus_wide(F.col("text")).alias("corpus_wide"))


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {has_sql('lower(text)', w)} THEN '{k}'" for k, w in X.INTENT_KEYWORDS) + " ELSE 'factual' END AS intent FROM conversations")
def fn_22_rule_intent(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.rule_intent(F.col("text")).alias("intent"))


@query()
def fn_23_reasoning_gate(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", X.chat_intent(F.col("text")).alias("chat"), X.needs_reasoning(F.lit("analytical"), F.col("text")).alias("reasoning"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn_24_model_json(spark, d):
    answer = F.concat(F.lit("```json\nHere: "), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", X.model_json(answer, "k long").getField("k").alias("k"))


@query("SELECT o_orderkey, round(greatest(0.3, pow(0.5, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-12-31'), 0) / 365.0)), 6) AS recency FROM orders")
def fn_26_recency(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(S.recency(F.lit("1999-12-31").cast("date"), F.to_date("o_orderdate")), 6).alias("recency"))


@query("SELECT event_id, sha256(user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d %H:%M')) AS id FROM events")
def fn_28_minute_ids(spark, d):
    name = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return table(spark, d, "events").select("event_id", F.sha2(name, 256).alias("id"))


@query(f"""WITH {CONTAINS}, r AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R') AS a, list(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)
    SELECT k, round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / greatest(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 1), 6) AS jaccard FROM r""")
def fn_34_set_overlap(spark, d):
    of = lambda c: F.collect_set(F.when(c, F.col("l_partkey")))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(of(F.col("l_returnflag") == "R").alias("a"), of(F.col("l_linestatus") == "O").alias("b"))
    return rows.select("k", F.round(V.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + 1) / 2 * 0.5, 4) AS reward FROM embeddings")
def fn_38_domain_reward(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(S.domain_reward(F.element_at("embedding", 1).cast("double"), 0.5), 4).alias("reward"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 WHEN 2 THEN 1.1 WHEN 3 THEN 0.7 ELSE 1.0 END AS level, CASE WHEN n_chars % 100 >= 85 THEN 1.2 WHEN n_chars % 100 >= 60 THEN 1.0 ELSE 0.8 END AS factor,
    CASE WHEN n_chars % 100 >= 85 THEN 'high' WHEN n_chars % 100 >= 60 THEN 'normal' ELSE 'low' END AS class FROM documents""")
def fn_41_factors(spark, d):
    level = F.element_at(F.array(*map(F.lit, ("sentence", "paragraph", "section", "document", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    score = (F.col("n_chars") % 100) / 100
    return table(spark, d, "documents").select("doc_id", S.level_factor(level).alias("level"), S.consistency_factor(score).alias("factor"), S.consistency_class(score).alias("class"))


@query("""SELECT event_id, round(CAST(CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 1.5 * 0.2 WHEN 'purchase' THEN 1.7 * 0.2 WHEN 'signup' THEN 1.3 ELSE 0.9 END AS DOUBLE), 6) AS weight FROM events""")
def fn_42_path_weights(spark, d):
    path = F.element_at(F.create_map(*[F.lit(x) for p in (("view", "original"), ("click", "entity_pivot"), ("purchase", "ppr"), ("signup", "hyde"), ("error", "keywords")) for x in p]), F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.round(S.path_weight(path), 6).alias("weight"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity / 50 >= 0.6 THEN 1.0 WHEN l_quantity / 50 <= 0.4 THEN 0.0 ELSE (l_quantity / 50 - 0.4) / 0.2 END * CASE WHEN l_returnflag = 'R' THEN 0.8 ELSE 1.0 END * CASE WHEN l_linestatus = 'O' THEN 0.9 ELSE 1.0 END, 6) AS confidence FROM lineitem""")
def fn_45_confidence(spark, d):
    credit = S.grounding_credit(F.col("l_quantity") / 50)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.confidence(credit, F.col("l_returnflag") != "R", F.col("l_linestatus") != "O"), 6).alias("confidence"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS point FROM documents")
def fn_47_point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", V.point_id(F.col("doc_id")).alias("point"))


@query("SELECT vec_id, substr(sha256(array_to_string(list_transform(embedding[1:32], lambda x: printf('%.4f', CAST(x AS DOUBLE))), ',')), 1, 16) AS key FROM embeddings")
def fn_48_cache_keys(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.cache_key(F.col("embedding")).alias("key"))


@query("SELECT doc_id, round((CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'que') AS INTEGER) + CAST(contains(lower(text), 'der') AS INTEGER)) / 3.0, 6) AS share FROM documents")
def fn_49_entity_match(spark, d):
    names = F.array(F.lit("the"), F.lit("que"), F.lit("der"))
    hits = F.size(F.filter(names, lambda n: F.lower("text").contains(n)))
    return table(spark, d, "documents").select("doc_id", F.round(hits / 3.0, 6).alias("share"))


@query()
def chk_1_sentences(spark, d):
    rows = table(spark, d, "documents").withColumn("s", X.sentences(F.col("text")))
    return rows.select("doc_id", F.size("s").alias("n"), "s")


@query()
def chk_3_packed_sentences(spark, d):
    rows = table(spark, d, "documents").withColumn("s", X.sentences(F.col("text")))
    packed = rows.withColumn("p", C.pack(F.col("s"), 800))
    return packed.select("doc_id", F.posexplode(C.merge_short(F.col("p"), 80, 800)).alias("k", "chunk"))


@query(r"""SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+$', ''), '\n\s*\d{1,4}\s*$', ''), '(?i)\n\s*Page\s+\d+\s+of\s+\d+\s*$', ''), '(?i)\n\s*Preprint\.?\s*$', ''), '\n\s*\d{1,4}\s*$', '')) AS n FROM documents""")
def chk_2_page_artifacts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(X.strip_artifacts(F.col("text"))).cast("long").alias("n"))


@query()
def chk_8_boundaries(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    scored = C.boundary_scores(lines, "doc_id", "pos", "line")
    return scored.select("doc_id", "pos", F.round("boundary", 6).alias("boundary"))


@query()
def chk_9_modes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.mode(F.col("text")).alias("mode"))


@query()
def chk_8_grouped(spark, d):
    """Paragraphs of every text: sentences grouped at boundaries, sized by the document's type."""
    return C.signal_chunks(table(spark, d, "documents"), "doc_id", "text", "source")


@query()
def chk_6_sections(spark, d):
    """Sections: paragraphs grouped until the next one would not fit."""
    rows = table(spark, d, "documents").select("doc_id", C.sections(F.split("text", "\n"), 4000).alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("k", "paragraphs")).select("doc_id", "k", F.size("paragraphs").alias("n"), F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.length(p)).alias("chars"))


@query()
def chk_16_dispatched(spark, d):
    """Chunks of all documents, pages, orders and conversations, each by the chunker of its format: orders are tables of up to
    100 keys, conversations chat exports of up to 50 turns."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("doc_id"), F.concat(F.coalesce("source", F.lit("")), F.lit(".txt")).alias("name"), "text")
    pages = table(spark, d, "pages").select(F.concat(F.lit("page-"), "page_id").alias("doc_id"), F.col("url").alias("name"), F.col("html").alias("text"))
    files = docs.unionByName(pages).unionByName(order_tables(table(spark, d, "orders"))).unionByName(chat_exports(table(spark, d, "conversations")))
    return C.dispatch(files, structured=True).select("doc_id", "format", "k", F.length("chunk").alias("n"))


def joined_lines(rows, doc_id, order, line):
    return rows.groupBy(doc_id.alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).getField("_line"), "\n").alias("text"))


def order_tables(orders):
    """(doc_id, name, text): the orders of a hundred keys as comma-separated values under a header."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    line = F.concat_ws(",", *[F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), '"', '""'), F.lit('"')) for c in columns])
    lines = joined_lines(orders, F.concat(F.lit("orders-"), F.floor(F.col("o_orderkey") / 100)), ["o_orderkey"], line)
    return lines.select("doc_id", F.concat("doc_id", F.lit(".csv")).alias("name"), F.concat(F.lit(",".join(columns) + "\n"), "text").alias("text"))


def chat_exports(turns):
    """(doc_id, name, text): fifty turns of a conversation as lines of JSON."""
    line = F.to_json(F.struct("role", F.col("text").alias("content"), F.lpad(F.col("turn").cast("string"), 9, "0").alias("timestamp"), F.col("conv_id").cast("string").alias("thread_id")))
    lines = joined_lines(turns, F.concat(F.lit("chat-"), "conv_id", F.lit("-"), F.floor(F.col("turn") / 50)), ["turn"], line)
    return lines.select("doc_id", F.concat("doc_id", F.lit(".jsonl")).alias("name"), "text")


@query(r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS s FROM documents) SELECT doc_id, sum(CASE WHEN s = '' OR regexp_matches(s, '^#{1,6}\s') OR regexp_matches(s, '^[-*+]\s') OR regexp_matches(s, '^\d+\.\s') OR starts_with(s, '```') THEN 1 ELSE 0 END) AS n FROM l GROUP BY 1""")
def chk_10_structural_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return lines.groupBy("doc_id").agg(F.sum(X.structural(F.col("s")).cast("long")).alias("n"))


@query("""WITH r AS (SELECT s_nationkey AS sheet, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, '| ' || s_suppkey || ' | ' || s_name || ' |' AS line FROM supplier)
    SELECT sheet, (k - 1) // 20 AS chunk, '[Sheet: ' || sheet || ', rows ' || min(k) || '-' || max(k) || ']' || chr(10) || '| s_suppkey | s_name |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY k) AS text FROM r GROUP BY 1, 2""")
def chk_11_table_chunks(spark, d):
    return C.table_chunks(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", ["s_suppkey", "s_name"])


@query("""WITH r AS (SELECT conv_id AS thread, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, '[' || turn || '] ' || role || ': ' || text AS line FROM conversations)
    SELECT thread, (k - 1) // 2 AS window, count(DISTINCT role) AS speakers, string_agg(line, chr(10) ORDER BY k) AS text FROM r GROUP BY 1, 2""".replace("AS window", 'AS "window"'))
def chk_12_chat_windows(spark, d):
    return C.chat_windows(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("""WITH r AS (SELECT conv_id AS thread, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, substr(text, 1, 200) AS head FROM conversations)
    SELECT thread, count(*) AS n, min(turn) AS first, max(turn) AS last, string_agg(head, chr(10) ORDER BY k) FILTER (WHERE k <= 3) AS summary FROM r GROUP BY 1""")
def chk_13_thread_summaries(spark, d):
    return C.thread_summaries(table(spark, d, "conversations"), "conv_id", "turn", "text")


_VOTES = ", ".join("(" + " + ".join(f"CAST(regexp_matches(substr(text, 1, 3000), {quoted(p)}) AS INTEGER)" for p in patterns) + ")" for _, patterns in X.TYPE_SIGNATURES)
_BY_NAME = " ".join(f"WHEN {has_sql('lower(source)', words)} THEN '{kind}'" for kind, words in X.TYPE_NAMES)
_KINDS_SQL = ", ".join(quoted(kind) for kind, _ in X.TYPE_SIGNATURES)
_SIZES_SQL = " ".join(f"WHEN '{kind}' THEN {size}" for kind, (size, _) in X.TYPE_SIZES.items())


@query(rf"""WITH v AS (SELECT doc_id, source, [{_VOTES}] AS v FROM documents), k AS (SELECT doc_id, CASE {_BY_NAME} WHEN regexp_matches(lower(source), '\.(py|js|ts|java|cpp|go|rs)$') THEN 'code' WHEN list_max(v) >= 2 THEN [{_KINDS_SQL}][list_position(v, list_max(v))] ELSE 'generic' END AS kind FROM v)
    SELECT doc_id, kind, CASE kind {_SIZES_SQL} END AS size FROM k""")
def chk_14_document_types(spark, d):
    kind = X.doc_type(F.col("text"), F.col("source"))
    size = S.from_table(kind, {k: v[0] for k, v in X.TYPE_SIZES.items()}, 800).cast("int")
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), size.alias("size"))


@query(r"""WITH n AS (SELECT DISTINCT p_type AS type, p_name AS name FROM part), k AS (SELECT type, name, regexp_replace(lower(name), '[^0-9a-z]', '', 'g') AS s, array_to_string(list_transform(list_filter(string_split_regex(lower(name), '[^0-9a-z]+'), lambda w: w <> ''), lambda w: w[1]), '') AS i, len(list_filter(string_split_regex(name, '\s+'), lambda w: w <> '')) AS words FROM n)
    SELECT x.type, x.name AS a, y.name AS b FROM k x JOIN k y ON x.type = y.type AND x.name <> y.name WHERE (length(x.s) >= 4 AND length(x.s) * 5 >= length(y.s) * 4 AND length(x.s) <= length(y.s) AND contains(y.s, x.s)) OR (length(x.s) >= 2 AND x.s = y.i AND y.words >= 2)""")
def fn_6_related_names(spark, d):
    """Names of a type of which one holds the other's skeleton, or is its initials."""
    names = Graph(spark, d).entities().select("type", "name").distinct()
    return G.related_names(names)


@query(f"""WITH {ENTITIES} SELECT DISTINCT name, len(list_filter(string_split(name, ' '), lambda w: w <> '')) AS words FROM entities""")
def fn_6_name_words(spark, d):
    return Graph(spark, d).entities().select("name", X.word_count(F.col("name")).cast("long").alias("words")).distinct()
