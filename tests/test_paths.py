"""Retrieval paths and indexes against plain Python on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import graph as G
from strataloom.operators import ranking as R
from strataloom.operators import retrieval as P


def cosines(a, b):
    a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (np.asarray(a, float), np.asarray(b, float)))
    return np.round(a @ b.T, 4)


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(8)
    vectors = {k: r.normal(size=6) for k in range(40)}
    contains = sorted({(int(r.integers(0, 40)), int(r.integers(100, 125))) for _ in range(120)})
    queries = {k: r.normal(size=6) for k in range(3)}
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    return {
        "vectors": vectors, "contains": contains, "queries": queries,
        "v": frame([(k, v.tolist(), k % 4) for k, v in vectors.items()], "id long, vec array<double>, grp long"), "c": frame(contains, "chunk_id long, entity_id long"),
        "q": frame([(k, v.tolist(), k % 4) for k, v in queries.items()], "query_id long, vec array<double>, grp long"), "m": frame([(c // 2, e) for c, e in contains], "doc_id long, entity_id long").distinct(),
    }


def brute_gate(s, seeds, pick, k, floor, scope=False):
    entities = sorted({e for _, e in s["contains"]})
    unit = {c: v / np.linalg.norm(v) for c, v in s["vectors"].items()}
    mean = {e: np.mean([s["vectors"][c] for c, x in s["contains"] if x == e], axis=0) for e in entities}
    mean = {e: v / np.linalg.norm(v) for e, v in mean.items()}
    docs = {c // 2 for c, _ in s["contains"]}
    idf = {e: min(5.0, max(0.1, np.log((len(docs) + 1) / (len({c // 2 for c, x in s["contains"] if x == e}) + 1)))) for e in entities}
    out = {}
    for q, v in s["queries"].items():
        cos = {c: round(float(unit[c] @ v / np.linalg.norm(v)), 4) for c in unit}
        near = sorted(cos, key=lambda c: (-cos[c], c))[:seeds]
        inside = sorted({e for c, e in s["contains"] if c in near})
        score = {e: round(round(float(mean[e] @ v / np.linalg.norm(v)), 4) * idf[e], 6) for e in inside}
        if not score or max(score.values()) < floor:
            continue
        rest = sorted(score, key=lambda e: (-score[e], e))
        chosen = [rest[0]]
        while len(chosen) < min(pick, len(rest)):
            value = lambda e: round(0.6 * score[e] - 0.4 * max(float(mean[e] @ mean[x]) for x in chosen), 9)
            chosen.append(max((e for e in rest if e not in chosen), key=lambda e: (value(e), -rest.index(e))))
        hits = {}
        for c, e in s["contains"]:
            if e in chosen and (not scope or c in near):
                hits[c] = hits.get(c, 0) + 1
        for r, c in enumerate(sorted(hits, key=lambda c: (-hits[c], c))[:k]):
            out[q, c] = (hits[c], r + 1)
    return out


def test_entity_paths(small):
    s = small
    entities = P.entity_vectors(s["c"], s["v"])
    got = P.entity_gate(s["v"], s["c"], s["m"], entities, s["q"], seeds=10, floor=0.2, pick=4, k=7)
    assert {(r.query_id, r.chunk_id): (r.matches, r["rank"]) for r in got.collect()} == brute_gate(s, 10, 4, 7, 0.2)
    got = P.entity_cosine(s["v"], s["c"], s["m"], entities, s["q"], k=5, scope=12, pick=3)
    assert {(r.query_id, r.chunk_id): (r.matches, r["rank"]) for r in got.collect()} == brute_gate(s, 12, 3, 5, -9.0, scope=True)
    assert P.entity_gate(s["v"], s["c"], s["m"], entities, s["q"], floor=99.0).count() == 0


@pytest.mark.parametrize("options", [{}, {"within": True}, {"exclude_self": True}, {"earlier": True}, {"floor": 0.1}])
def test_search_in_parts(small, monkeypatch, options):
    monkeypatch.setattr(R, "PART_ROWS", 7)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    own = small["v"]
    got = {(r.query_id, r.id): (r.score, r["rank"]) for r in R.vector_search(own, own.withColumnRenamed("id", "query_id"), 4, **options).collect()}
    matrix, want = cosines(list(small["vectors"].values()), list(small["vectors"].values())), {}
    for q in range(40):
        ok = [i for i in range(40) if matrix[q, i] >= options.get("floor", -2)]
        if options.get("within"):
            ok = [i for i in ok if i != q and i % 4 == q % 4]
        if options.get("exclude_self"):
            ok = [i for i in ok if i % 4 != q % 4]
        if options.get("earlier"):
            ok = [i for i in ok if i < q]
        for r, i in enumerate(sorted(ok, key=lambda i: (-matrix[q, i], i))[:4]):
            want[q, i] = (pytest.approx(matrix[q, i], abs=1e-9), r + 1)
    assert got == want


def test_multi_path(spark):
    rows = [(1, "original:dense", 10, 1), (1, "original:dense", 11, 2), (1, "graph", 11, 1), (1, "community", 12, 1), (1, "ppr", 13, 1), (2, "graph", 10, 1), (2, "graph", 14, 2)]
    paths = spark.createDataFrame(rows, "query_id long, path string, chunk_id long, rank int")
    intents = spark.createDataFrame([(1, "factual"), (2, "comparison")], "query_id long, intent string")
    chunks = spark.createDataFrame([(c, 0.7, "paragraph", 1.0, c != 13) for c in range(10, 15)], "chunk_id long, consistency double, level string, reward double, keep boolean")
    got = {(r.query_id, r.chunk_id): r.rrf for r in P.multi_path(paths, intents, chunks).collect()}
    # a factual question takes no graph and no community path, and fragments are left out
    assert got == {(1, 10): pytest.approx(1 / 61), (1, 11): pytest.approx(1 / 62), (2, 10): pytest.approx(0.2 / 61), (2, 14): pytest.approx(0.2 / 62)}


def test_hot_entities(spark, monkeypatch):
    """Documents that all share two entities, and pairs that share rare ones, against counting all pairs."""
    monkeypatch.setattr(G, "DEAL", 5)
    r = np.random.default_rng(4)
    sets = {d: {0, 1} | {int(x) for x in r.integers(2, 40, r.integers(1, 9))} for d in range(60)}
    frame = spark.createDataFrame([(d, e) for d, es in sets.items() for e in es], "doc_id long, entity_id long")
    for least, share in ((2, 0.05), (3, 0.4), (1, 0.0)):
        got = {(x.d1, x.d2): (x.shared, x.jaccard) for x in G.shared_documents(frame, least, share).collect()}
        want = {}
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if a != b and n >= least and n / len(sets[a] | sets[b]) >= share:
                    want[a, b] = (n, pytest.approx(n / len(sets[a] | sets[b])))
        assert got == want
    near = G.neighbours(frame.withColumnRenamed("doc_id", "chunk_id"), 3).where("a = 7").orderBy("rank").collect()
    best = sorted((-len(sets[7] & sets[b]), b) for b in sets if b != 7)[:3]
    assert [(-x.shared, x.b) for x in near] == best


def test_percentiles_and_samples(spark):
    from strataloom.sources import files

    r = np.random.default_rng(6)
    rows = [(f"g{k % 3}", float(v)) for k, v in enumerate(np.round(r.normal(size=500), 2))] + [("one", 4.0), ("same", 1.0), ("same", 1.0)]
    got = {x.g: (x.p50, x.p95) for x in R.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in got:
        own = sorted(v for k, v in rows if k == g)
        assert got[g] == (own[len(own) // 2], own[int(len(own) * 0.95)])
    sized = spark.createDataFrame([(f"f{k}", k * 7 % 31) for k in range(31)], "path string, length long").repartition(4)
    assert sorted(x.length for x in files.size_sample(sized, 5).collect()) == [0, 5, 10, 15, 20, 25, 30]


def test_percentiles_with_outliers(spark, monkeypatch):
    """One far value does not gather a group, and places outside their bracket are counted out."""
    from strataloom.operators import ranking as R

    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") == 7, F.lit(1e9)).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)) / 5000).alias("v")).union(spark.createDataFrame([(None, 2.0), (None, 1.0), (9, None), (8, 4.0)], "g long, v double"))
    want = {}
    for r in rows.where("v is not null").collect():
        want.setdefault(r.g, []).append(r.v)
    want = {g: (sorted(v)[int(len(v) * 0.5)], sorted(v)[int(len(v) * 0.95)], sorted(v)[int(len(v) * 0.001)]) for g, v in want.items()}
    shares = {"p50": 0.5, "p95": 0.95, "low": 0.001}
    check = lambda: {r.g: (r.p50, r.p95, r.low) for r in R.exact_percentiles(rows, "g", "v", shares).collect()}
    assert check() == want
    monkeypatch.setattr(R, "SHARPNESS", 1000)
    assert check() == want
    monkeypatch.setattr(R.F, "percentile_approx", lambda *a: F.array(*[F.lit(0.25)] * 6))  # brackets that hold no place
    assert check() == want


def test_all_rows_above_a_floor(small):
    found = {(r.query_id, r.id): r.score for r in R.vector_search(small["v"], small["q"], None, floor=0.1).collect()}
    want = cosines(list(small["queries"].values()), list(small["vectors"].values()))
    assert found == {(q, v): want[q, v] for q in range(3) for v in range(40) if want[q, v] >= 0.1}
    with_ties = small["v"].unionByName(small["v"].withColumn("id", F.col("id") + 100))
    assert R.vector_search(with_ties, small["q"], None, floor=0.1).count() == 2 * len(found)
    assert R.vector_search(small["v"], small["q"], None, floor=1.5).count() == 0 and R.vector_search(small["v"].limit(0), small["q"], None).count() == 0


def test_paths_fused_by_intent(spark):
    """The fused result of all asked vectors against plain Python over the paths' own results."""
    from strataloom.functions import score as S
    from strataloom.plans import paths as Q

    data = "/root/testdata/sf0.001"
    g, queries, aware, found = Q.all_paths(spark, data)
    intents = {r.query_id: r.intent for r in Q.intents_of(g, queries).collect()}
    chunks = {r.id: r for r in Q.payload(g, aware).collect()}
    levels = {r.level for r in chunks.values()}
    assert levels <= set(S.LEVEL_FACTORS) and len(levels) > 1 and len(set(intents.values())) > 1
    sums, by = {}, {}
    for r in found.collect():
        views, graph, community, pivot, _ = P.STRATEGY[intents[r.query_id]]
        head, _, view = r.path.partition(":")
        used = view in views if view else {"graph": graph, "community": community, "entity_pivot": pivot}.get(head, True)
        c = chunks.get(r.chunk_id)
        if used and c is not None and c.keep:
            agreed = 1.2 if c.consistency >= 0.85 else 1.0 if c.consistency >= 0.6 else 0.8
            weight = S.PATH_WEIGHTS[head] * (S.GRAPH_SCALE if head in S.GRAPH_PATHS else 1.0) * agreed * S.LEVEL_FACTORS[c.level] * c.reward
            key = r.query_id, r.chunk_id
            sums[key] = sums.get(key, 0.0) + weight / (S.RRF_K + r.rank)
            by.setdefault(key, set()).add(head)
    want = {}
    for q, intent in intents.items():
        best = sorted((k for k in sums if k[0] == q), key=lambda k: (-round(sums[k], 9), k[1]))
        want |= {k: (round(sums[k], 9), ",".join(sorted(by[k])), n) for n, k in enumerate(best[: 50 * P.STRATEGY[intent][4]], 1)}
    got = {(r.query_id, r.chunk_id): (round(r.rrf, 9), r.paths, r["rank"]) for r in Q.ret_9_multi_path(spark, data).collect()}
    assert got and got.keys() == want.keys()
    for key, (rrf, paths, _) in got.items():
        assert abs(rrf - want[key][0]) < 2e-9 and paths == want[key][1]


def test_router_guards(spark, tmp_path):
    """The guards come before the centroids, whatever the vector; a text that is missing has no guard."""
    from strataloom.plans import vectors as W

    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.0, 1.0], 1), (3, [-1.0, -1.0], 1)] + [(k, [0.0, 1.0], 1) for k in (4, 5, 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    texts = [(0, "How is the weather?"), (1, "The main themes of all."), (2, None), (4, "A plain question."), (4, "Which football team?"), (None, "weather")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.label, r.route) for r in W.qry_1_router(spark, str(tmp_path)).collect()}
    assert got == {0: (0, "out_of_domain"), 1: (0, "global"), 2: (1, "label"), 3: (1, "out_of_domain"), 4: (1, "out_of_domain"), 5: (1, "label"), 6: (1, "label")}
