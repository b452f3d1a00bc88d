"""Findings on odd inputs and larger tables, each against plain Python."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import graph as G
from strataloom.plans.catalog import QUERIES


def test_corrective_action_at_the_limit(spark, tmp_path):
    """A mean of exactly one half is grounded, whatever the order of the rows (their quotients' sums may round below it)."""
    orders = list(itertools.permutations([41.0, 6.0, 45.0, 8.0])) + list(itertools.permutations([11.0, 19.0, 35.0, 35.0])) + [(41.0, 6.0, 45.0, 7.0)]
    rows = [(k, q, 0.05, "N") for k, order in enumerate(orders) for q in order]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_discount double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.action for r in QUERIES["val_6_corrective_action"](spark, str(tmp_path)).collect()}
    assert got == {k: "accept" if sum(order) >= 100 else "retrieve_more" for k, order in enumerate(orders)}


@pytest.mark.parametrize("deal", [4, 1000])
def test_met_counts(spark, monkeypatch, deal):
    """Pairs of items and the keys they share, in one list a key and in many; marks below 0 come through."""
    monkeypatch.setattr(G, "DEAL", deal)
    monkeypatch.setattr(G, "PAIRS", 50)
    r = np.random.default_rng(1)
    keys = {i: {0} | set(r.integers(1, 30, 6).tolist()) for i in range(40)}
    mark = {i: -7 if i % 11 == 0 else 5 for i in keys}
    rows = spark.createDataFrame([(k, i, mark[i]) for i, ks in keys.items() for k in ks], "k long, i long, m int")
    got = {(x.a, x.b): x for x in G.met_counts(rows, "k", "i", "m").collect()}
    assert {p: x.met for p, x in got.items()} == {(a, b): len(keys[a] & keys[b]) for a in keys for b in keys if a < b}
    assert all(x.x == mark[a] and (x.y == mark[b] if mark[b] < 0 else x.y in (None, 5)) for (a, b), x in got.items())


def test_neighbours_by_what_they_share(spark, monkeypatch):
    """Chunks of few and of many entities, hot and rare ones, against counting all pairs; no pair of an entity that ranks nowhere."""
    monkeypatch.setattr(G, "WIDE", 6)
    r = np.random.default_rng(2)
    sets = {c: {0} | set(r.integers(1, 25, r.integers(0, 12)).tolist()) for c in range(60)} | {99: {77}}
    frame = spark.createDataFrame([(c, e) for c, es in sets.items() for e in es] + [(None, 1), (3, None)], "chunk_id long, entity_id long")
    for k in (1, 5, 100):
        want = {}
        for a in sets:
            best = sorted((-len(sets[a] & sets[b]), b) for b in sets if b != a and sets[a] & sets[b])[:k]
            want |= {(a, b): (-s, n + 1) for n, (s, b) in enumerate(best)}
        assert {(x.a, x.b): (x.shared, x["rank"]) for x in G.neighbours(frame, k).collect()} == want


def test_graph_scores(spark, monkeypatch):
    """Finished rows from every part and block, against all cosines in numpy; entities without a vector and unknown ones count nowhere."""
    from strataloom.operators import retrieval as P

    monkeypatch.setattr(P, "SCORED_ROWS", 40)
    monkeypatch.setattr(P, "SCORED_QUERIES", 3)
    r = np.random.default_rng(3)
    vecs, asked = r.normal(size=(30, 8)), r.normal(size=(10, 8))
    held = {c: set(r.integers(0, 35, 4).tolist()) for c in range(50)}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine, want = np.round(unit(asked) @ unit(vecs).T, 4), {}
    for q in range(10):
        for c, es in held.items():
            if hits := [cosine[q, e] for e in es if e < 30 and cosine[q, e] >= 0.2]:
                want[q, c] = (pytest.approx(sum(hits) / len(hits), abs=1e-8), len(hits))
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = P.graph_scores(frame([(e, v.tolist()) for e, v in enumerate(vecs)], "id long, vec array<double>"), frame([(c, e) for c, es in held.items() for e in es], "chunk_id long, entity_id long"), frame([(q, v.tolist()) for q, v in enumerate(asked)], "query_id long, vec array<double>"), 0.2)
    assert {(x.query_id, x.chunk_id): (x.score, x.matches) for x in got.collect()} == want


def test_means_travel_as_one_row(spark):
    """Mean vectors by key: unequal lengths, elements that are missing, weights, empty input; no row an element is shuffled."""
    from strataloom.operators import ranking as R

    data = [(k % 3, 1.0 + k % 2, [float(k), None if k == 4 else 2.0] + [1.0] * (k % 4)) for k in range(12)] + [(5, 1.0, None), (6, 1.0, [])]
    rows = spark.createDataFrame(data, "g int, w double, vec array<float>")
    got = R.centroids(rows, "g", weight=F.col("w"))
    want = {}
    for g in range(3):
        at = [(w, v) for k, w, v in data if k == g]
        mean = [sum(w * (v[i] or 0) for w, v in at if len(v) > i) / sum(w for w, v in at if len(v) > i) for i in range(max(len(v) for _, v in at))]
        want[g] = [pytest.approx(x / np.linalg.norm(mean)) for x in mean]
    assert {x.g: x.vec for x in got.collect()} == want and R.centroids(rows.where("g > 9"), "g").count() == 0
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_similar_names_of_known_ones(spark, monkeypatch):
    """Only pairs with a known name are compared and returned; dealt to many tasks or not, they are those of the whole join."""
    from strataloom.operators import names as N

    monkeypatch.setattr(G, "DEAL", 7)
    r = np.random.default_rng(5)
    said = sorted({"".join(r.choice(list("abcd"), r.integers(2, 9))) for _ in range(150)})
    frame = lambda words: spark.createDataFrame([("t", w) for w in words], "type string, name string")
    known = set(said[::9]) | {"abcd", "dcba"}
    rows = lambda df: {(x.a, x.b): x.ratio for x in df.collect()}
    whole = rows(N.similar_names(frame(set(said) | known), 0.8))
    want = {p: s for p, s in whole.items() if set(p) & known}
    assert rows(N.similar_names(frame(said), 0.8, known=frame(known))) == want and 0 < len(want) < len(whole)


def test_search_holds_small_parts(spark):
    """A search task gets Arrow columns of some 16,000 rows, not 50,000 vectors as objects, and finds what one product finds."""
    from strataloom.operators import ranking as R

    r = np.random.default_rng(6)
    m = r.normal(size=(400, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, vec array<float>")
    found = R.vector_search(rows, rows.limit(9).withColumnRenamed("id", "query_id"), 5)
    assert R.PART_ROWS <= 20_000 and "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = {(x.query_id, x.id) for x in found.collect()}
    assert got == {(q, int(i)) for q in {q for q, _ in got} for i in np.lexsort((np.arange(400), -np.round(u @ u[q], 4)))[:5]} and len(got) == 45


def test_tags_read_a_text_once(spark):
    """A text is put in lower case once for all axes and words, and the softmax is that of plain Python."""
    from strataloom.functions import domain as D

    axes = {"a": {"one": 1.0, "two": 0.5}, "b": {"three": 2.0}, "c": {}}
    data = [(0, "One, TWO", "c.txt"), (1, "three | one", ""), (2, None, "a"), (3, "", None)]
    rows = spark.createDataFrame(data, "id long, text string, name string")
    got = rows.select("id", D.tag(F.col("text"), F.coalesce("name", F.lit("")), axes, {"b": r"^.* \| .*$"}).alias("p"))
    assert str(got._jdf.queryExecution().optimizedPlan()).count("lower(text") == 1
    for r in got.collect():
        text, name = (data[r.id][1] or "").lower(), (data[r.id][2] or "")
        raw = [0.5 * sum(w for k, w in words.items() if k in text) + 0.15 * (axis == "b" and " | " in text) + 0.05 * (axis in name) for axis, words in axes.items()]
        e = np.exp(raw)
        assert r.p == ([None] * 3 if data[r.id][1] is None else pytest.approx((e / e.sum()).tolist()))


def test_signal_chunks_stay_in_their_row(spark):
    """Boundaries as by windows over sentences, without a shuffle; the counts' cosines are those of ``bag_vector``."""
    from strataloom.functions import text as X
    from strataloom.operators import chunking as C

    r = np.random.default_rng(7)
    words = ["Paris", "Anna Lee", "the", "a", "42%", "However", "please", "LÀ gì", "có thể", "- x", "# Abstract"]
    said = lambda: " ".join(". ".join(" ".join(r.choice(words, r.integers(1, 9))) for _ in range(r.integers(1, 30))).split(" "))
    docs = spark.createDataFrame([(k, said(), "a.md") for k in range(40)] + [(97, None, None), (98, "", "b"), (99, " ? ! ", "c")], "doc_id long, text string, name string")
    got = C.signal_chunks(docs, "doc_id", "text", "name")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    same = C.signal_chunks(docs, "doc_id", "text", "name", vector=C.bag_vector)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, same.collect())) and got.count() > 40
    modes = spark.createDataFrame([(t,) for t in ["Step 1", "Bước 2 x", "FIRST, a", "next. b", "PLEASE", "let us", "Let's", "HÃY", "a 5%", "là x", "maybe", "posſibly", "ın my opinion", "definİtely", "Terrıble", "RẤT", "x", "pleaſe", "19999"]], "t string")
    plain = F.lit("NARRATIVE")
    for name, patterns in reversed(X.MODES):
        plain = F.when(X.any_of(F.col("t"), patterns, "(?iuU)"), F.lit(name)).otherwise(plain)
    assert modes.where(X.mode(F.col("t")) != plain).collect() == []


def test_dispatch_keeps_formats_without_a_join(spark):
    """Chunks carry their format along; files are not joined back to their chunks."""
    from strataloom.operators import chunking as C

    files = spark.createDataFrame([("a", "a.txt", "One. Two."), ("b", "b.csv", "x,y\n1,2"), ("c", "c.pdf", "Three. Four.")], "doc_id string, name string, text string")
    got = C.dispatch(files)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(x.doc_id, x.format) for x in got.collect()} == {("a", "txt"), ("b", "csv"), ("c", "pdf")}


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Pairs of entities lie in as many tasks as their number asks for, whatever the session's partitions, and are those of plain Python."""
    monkeypatch.setattr(G, "MENTIONS", 20)
    monkeypatch.setattr(G, "LINKS", 10)
    r = np.random.default_rng(8)
    sets = {c: set(r.integers(0, 30, r.integers(1, 8)).tolist()) for c in range(60)}
    got = G.co_occurrence(spark.createDataFrame([(c, e) for c, es in sets.items() for e in es] * 2, "chunk_id long, entity_id long"), 2, 6)
    want = {}
    for es in sets.values():
        for p in itertools.combinations(sorted(es), 2) if 2 <= len(es) <= 6 else ():
            want[p] = want.get(p, 0) + 1
    assert got.rdd.getNumPartitions() == -(-sum(want.values()) // 10) > 4
    assert {(x.a, x.b): x.shared for x in got.collect()} == want


def test_ranks_travel_by_part(spark, monkeypatch):
    """Ranks of many seed sets over parts that links cross, with and without nodes that lead nowhere: the rounds of one set in
    numpy; ``best`` keeps each set's best."""
    r = np.random.default_rng(5)
    pairs = {(int(a) + 100 * g, int(b) + 100 * g) for g in range(3) for a, b in r.integers(0, 40, (150, 2)) if a != b}
    for ends, size, best in ((set(), 10**6, 5), ({3, 105}, 60, None)):
        links = {(a, b): float(1 + (a * b) % 3) for a, b in pairs | {(b, a) for a, b in pairs} if a not in ends}
        nodes = sorted({n for link in links for n in link})
        sets = {q: sorted({int(n) for n in r.choice(nodes, 1 + q % 3)}) for q in range(90)}
        step = np.zeros((len(nodes), len(nodes)))
        for (a, b), w in links.items():
            step[nodes.index(a), nodes.index(b)] = w
        total = step.sum(axis=1, keepdims=True)
        start = np.array([[(n in held) / len(held) for n in nodes] for held in sets.values()])
        step = 0.5 * np.where(total > 0, step / np.maximum(total, 1), 0)
        score, left = np.zeros_like(start), start.copy()
        for _ in range(80):
            score, left = score + 0.5 * left, left @ step + start * (0.5 * left[:, total[:, 0] == 0].sum(axis=1, keepdims=True))
        edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a long, b long, weight double")
        seeds = spark.createDataFrame([(q, n) for q, held in sets.items() for n in held], "query_id long, node long")
        monkeypatch.setattr(G, "PART_LINKS", size)
        monkeypatch.setattr(G, "HELD", 600)
        got = np.zeros_like(score)
        rows = G.page_ranks(edges, seeds, best=best).collect()
        assert len({(x.query_id, x.node) for x in rows}) == len(rows)
        for x in rows:
            got[x.query_id, nodes.index(x.node)] = x.score
        kept = score > 1e-4 if best is None else score >= np.sort(score, axis=1)[:, -best, None] + 1e-5
        assert np.abs(got - score)[kept].max() < 2e-5


def test_reached_mentions(spark):
    """Chunks reached from an entity over others, all of their mentions; none of what is apart."""
    rows = spark.createDataFrame([(c, e) for c in range(20) for e in (c, c + 1)] + [(50, 70), (50, 71)], "chunk_id long, entity_id long")
    got = {tuple(x) for x in G.reached(rows, spark.createDataFrame([(4,)], "node long")).collect()}
    assert got == {(c, e) for c in range(20) for e in (c, c + 1)}
    assert {x.chunk_id for x in G.reached(rows, spark.createDataFrame([(4,)], "node long"), hops=1).collect()} == {2, 3, 4, 5}


def test_text_index_shuffles_postings_once(spark, tmp_path, monkeypatch):
    """Repeated ids are one document, and a row's terms are counted without an exchange."""
    from strataloom.operators import text_index as T

    monkeypatch.setattr(T, "BLOCK", 3)
    docs = spark.createDataFrame([(1, "a b a"), (1, "B c"), (2, "a"), (3, None), (None, "a"), (4, "")] + [(k, "x a") for k in range(10, 20)], "doc_id long, text string")
    assert "Exchange" not in T.counted(docs.select(F.col("doc_id").alias("doc"), T.terms_of(F.col("text")).alias("terms")))._jdf.queryExecution().executedPlan().toString()
    T.build_index(docs, str(tmp_path))
    rows = spark.read.parquet(str(tmp_path)).collect()
    got = sorted((x.term, d) for x in rows for d in x.docs)
    assert got == sorted([("a", 1), ("b", 1), ("c", 1), ("a", 2)] + [(t, k) for t in "ax" for k in range(10, 20)])
    assert all(len(x.docs) <= 3 and x.total == 12 and x.most == max(x.parts) for x in rows)
    mean = (5 + 1 + 20) / 12
    score = lambda df, tf, n: np.log(1 + (12 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    want = [(1, round(score(12, 2, 5) + score(1, 2, 5), 6)), (2, round(score(12, 1, 1), 6))] + [(k, round(score(12, 1, 2), 6)) for k in range(10, 20)]
    asked = spark.createDataFrame([(0, "A"), (0, "b"), (0, "none")], "query_id long, term string")
    assert [(x.doc, x.score) for x in T.search_index(spark, str(tmp_path), asked, 20).orderBy("rank").collect()] == want


def test_index_queries_travel_once_to_a_part(spark, monkeypatch):
    """Over all cells the index gives what the exact search gives, in parts and blocks of any size; a query is not sent to each cell."""
    from strataloom.operators import ranking as R
    from strataloom.operators import vector_index as I

    r = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, k % 3, [float(x) for x in r.normal(size=6)]) for k in range(400)], "id long, grp int, vec array<float>")
    index = I.build_index(rows, k=5, cells=40)
    asked = rows.withColumnRenamed("id", "query_id").where("query_id % 4 = 0")
    monkeypatch.setattr(I, "PART_ROWS", 150)
    monkeypatch.setattr(I, "QUERY_BLOCK", 30)
    assert [x.tolist() for x in I.parts_of(np.array([100, 40, 20, 0, 400, 7]))] == [[0, 0, 1, 1, 2, 5], [1, 1, 1, 1, 3, 1]]
    sent = []
    for options in ({}, {"exclude_self": True, "floor": 0.6}, {"within": True}):
        found = I.index_search(index, asked, 5, probes=40, **options)
        got = sorted((x.query_id, x["rank"], round(x.score, 3)) for x in found.collect())
        want = sorted((x.query_id, x["rank"], round(x.score, 3)) for x in R.vector_search(rows, asked, 5, **options).collect())
        assert len(got) == len(want) and sum(abs(a[2] - b[2]) > 0.0011 or a[:2] != b[:2] for a, b in zip(got, want)) == 0
        sent.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert all("cells" in plan for plan in sent)


def test_router_looks_at_asked_texts_only(spark):
    """With a condition on the documents the asked ones' routes stay, and no other text is scanned."""
    from strataloom.plans import vectors as W
    from strataloom.plans.registry import Graph

    g = Graph(spark, "/root/testdata/sf0.001")
    rows = W.asked(g).select(F.col("query_id").alias("id"), "vec")
    few = W.routed(g, rows, F.col("doc_id") % W.QUERY_STEP == 0)
    assert sorted(few.collect()) == sorted(W.routed(g, rows).collect())
    assert re.search(r"doc_id#\d+L? % 20", few._jdf.queryExecution().optimizedPlan().toString())


def test_sieve(spark):
    """What is wanted stays, of a hundred times as much hardly anything else does; numbers of another width are the same numbers."""
    rows = spark.range(-100_000, 100_000).select(F.col("id").alias("chunk_id"), F.lit(1).alias("n"))
    wanted = spark.range(0, 100_000, 100).select(F.col("id").cast("int").alias("x")).union(spark.createDataFrame([(None,), (7,), (7,)], "x int"))
    got = G.sieved(rows, "chunk_id", wanted)
    kept = {x.chunk_id for x in got.collect()}
    assert got.columns == rows.columns and got.count() == len(kept)
    assert {7, *range(0, 100_000, 100)} <= kept and len(kept) < 1_300
    assert G.sieved(rows, "chunk_id", wanted.where("x < 0")).count() == 0


def test_reached_by_chunks_of_a_size(spark):
    """Chunks of a size carry on, others do not and are left out; repeated mentions count once. Few links make one part."""
    r = np.random.default_rng(7)
    sets = {c: {int(e) for e in r.integers(0, 60, r.integers(1, 6))} for c in range(40)} | {99: set(range(30, 90))}
    rows = spark.createDataFrame([(c, e) for c, es in sets.items() for e in es] * 2, "chunk_id long, entity_id long")
    known, front = {3}, {3}
    while front:
        front = {e for es in sets.values() if 2 <= len(es) <= 4 and es & known for e in es} - known
        known |= front
    want = {(c, e) for c, es in sets.items() if 2 <= len(es) <= 4 and es & known for e in es}
    got = [tuple(x) for x in G.reached(rows, spark.createDataFrame([(3,)], "node long"), sizes=(2, 4)).collect()]
    assert sorted(got) == sorted(want)
    edges = spark.createDataFrame([(1, 2), (2, 1), (8, 9)], "a long, b long")
    assert len({x.part for x in G.parts_of(edges, spark.createDataFrame([(n,) for n in (1, 2, 8, 9)], "node long")).collect()}) == 1


def test_scores_send_vectors_once(spark):
    """Thousands of queries are one block, and only mentions that can match are shuffled."""
    from strataloom.operators import retrieval as P

    rows = spark.range(5000).select(F.col("id").alias("chunk_id"), F.col("id").alias("entity_id"))
    entities = spark.createDataFrame([(3, [1.0, 0.0]), (4, [0.6, 0.8])], "id long, vec array<double>")
    asked = spark.range(3000).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    found = P.graph_scores(entities, rows, asked, 0.5)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().optimizedPlan().toString() and P.SCORED_QUERIES > 3000
    assert {(x.chunk_id, x.score, x.n) for x in found.groupBy("chunk_id", "score").agg(F.count(F.lit(1)).alias("n")).collect()} == {(3, 1.0, 3000), (4, 0.6, 3000)}


def test_ranks_by_mentions(spark):
    """Ranks over chunks' sums are those over a row a pair, settled in as many rounds; chunks that are too large, repeated mentions, seeds
    without a link, and no seeds."""
    r = np.random.default_rng(8)
    sets = {c: {int(e) for e in r.integers(0, 80, r.integers(1, 6))} for c in range(90)} | {200: set(range(70, 120)), 201: {300, 301}}
    rows = spark.createDataFrame([(c, e) for c, es in sets.items() for e in es] * 2, "chunk_id long, entity_id long")
    pairs = G.co_occurrence(rows, 2, 4).select("a", "b", F.col("shared").cast("double").alias("weight"))
    for seeds, tolerance in (([3, 5, 119, 999], 1e-6), ([3], 1e-3), ([300], 1e-6), ([999], 1e-6)):
        frame = spark.createDataFrame([(n,) for n in seeds], "node long")
        want = {x.node: x.score for x in G.page_rank(G.both_ways(pairs), frame, tolerance=tolerance).collect() if x.score > 0}
        got = {x.node: x.score for x in G.mention_ranks(rows, frame, (2, 4), tolerance=tolerance).collect() if abs(x.score) > 1e-12}
        assert got.keys() == want.keys() and all(abs(got[n] - s) < 1e-12 for n, s in want.items())
    assert len(want) == 0


def test_ranked_chunks_make_no_row_a_pair(spark, monkeypatch):
    """The ranked chunks need no pairs of entities, and a document's chunks with and without entities are counted."""
    from strataloom.plans.registry import Graph

    monkeypatch.setattr(G, "co_occurrence", None)
    data = "/root/testdata/sf0.001"
    assert QUERIES["grf_3_ranked_chunks"](spark, data).count() > 0
    g = Graph(spark, data)
    has = {x.chunk_id for x in g.contains().collect()}
    want = {}
    for x in g.chunks().select("chunk_id", "doc_id").collect():
        n, m = want.get(x.doc_id, (0, 0))
        want[x.doc_id] = (n + 1, m + (x.chunk_id in has))
    assert {x.doc_id: (x.chunks, x.kept) for x in g.owners().collect()} == want


def test_rank_blocks_of_a_session_that_deals_finer(spark, monkeypatch):
    """Links travel for as many blocks of seed sets as their number asks for, into however many partitions a session deals them."""
    frame, cut, blocks = type(spark.range(0)), G.cut, set()
    deal = frame.repartitionByRange

    def seen(df):
        table = cut(df)
        if table.columns == ["part", "block"]:
            blocks.update(x.block for x in table.collect())
        return table

    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols: deal(self, max(n, 40), *cols))
    monkeypatch.setattr(G, "cut", seen)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(a, b, 1.0) for a in range(100) for b in ((a + 1) % 100, (a - 1) % 100)], "a long, b long, weight double")
        rows = G.page_ranks(edges, spark.range(100).select(F.col("id").alias("query_id"), F.col("id").alias("node")), best=1).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert blocks == {0, 1} and {(x.query_id, x.node) for x in rows} == {(n, n) for n in range(100)}
