"""The vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import ranking as R
from strataloom.operators import vector_index as I
from strataloom.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.1"


def recall(got, want):
    got, want = {(r.query_id, r.id) for r in got.collect()}, {(r.query_id, r.id) for r in want.collect()}
    return len(got & want) / max(1, len(want))


@pytest.fixture(scope="module")
def rows(spark):
    """Clusters of unequal size, one with a third of all rows; far ids, a repeated vector, and rows without id or vector."""
    r = np.random.default_rng(0)
    centres = r.normal(size=(60, 32))
    own = np.where(r.random(6000) < 0.33, 0, r.integers(0, 60, 6000))
    vectors = centres[own] + 0.6 * r.normal(size=(6000, 32))
    data = [((1 << 60) + 2 * k + 1, int(k % 7), [float(x) for x in vectors[k - k % 500 if k % 500 == 1 else k]]) for k in range(6000)]
    data += [(None, 1, data[0][2]), (5, 1, None)]
    return spark.createDataFrame(data, "id long, grp int, vec array<float>").repartition(4).cache()


def test_recall(spark, rows):
    index = I.build_index(rows, k=10)
    assert index.rows.count() == 6000 and {r.id for r in index.rows.select("id").collect()} == {r.id for r in rows.where("id is not null and vec is not null").collect()}
    assert index.probes < len(index.centres) / 2  # it visits few cells
    asked = rows.withColumnRenamed("id", "query_id").where("query_id % 20 = 1")
    for options in ({}, {"exclude_self": True}, {"within": True}, {"floor": 0.5}):
        assert recall(I.index_search(index, asked, 10, **options), R.vector_search(rows, asked, 10, **options)) >= 0.9, options
    got = {(r.query_id, r.id): r.score for r in I.index_search(index, asked, 10).collect()}
    want = {(r.query_id, r.id): r.score for r in R.vector_search(rows, asked, 10).collect()}
    assert all(abs(got[k] - want[k]) < 2e-4 for k in got.keys() & want.keys())
    everywhere = I.index_search(index, asked, 10, probes=len(index.centres))
    assert recall(everywhere, R.vector_search(rows, asked, 10)) >= 0.98


def test_parts_and_blocks(spark, rows, monkeypatch):
    """A cell dealt to several tasks gives what one task gives."""
    index = I.build_index(rows, k=10)
    asked = rows.withColumnRenamed("id", "query_id").where("query_id % 20 = 1")
    one = {tuple(r) for r in I.index_search(index, asked, 10).collect()}
    monkeypatch.setattr(I, "PART_ROWS", 50)
    monkeypatch.setattr(I, "QUERY_BLOCK", 7)
    many = {tuple(r) for r in I.index_search(index, asked, 10).collect()}
    assert len(one & many) >= 0.98 * len(one) and len(many) == len(one)  # smaller parts score more rows anew


def test_save(spark, rows, tmp_path):
    index = I.build_index(rows, k=10)
    I.save_index(index, str(tmp_path))
    again = I.load_index(spark, str(tmp_path))
    asked = rows.withColumnRenamed("id", "query_id").where("query_id % 200 = 1")
    assert again.probes == index.probes and {tuple(r) for r in I.index_search(again, asked, 5).collect()} == {tuple(r) for r in I.index_search(index, asked, 5).collect()}


def test_few_rows(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0, 0.0]), (2, 1, [0.0, 0.0, 0.0, 0.0])], "id long, grp int, vec array<float>")
    assert {(r.query_id, r.id) for r in I.index_search(I.build_index(rows), rows.withColumnRenamed("id", "query_id"), 5).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    none = I.build_index(rows.where("id > 5"))
    assert I.index_search(none, rows.withColumnRenamed("id", "query_id"), 5).count() == 0


@pytest.mark.parametrize(("name", "exact"), [("top_1_index_search", "top_1_vector_search"), ("join_14_index_links", "join_14_cross_document_links")])
def test_queries(spark, name, exact):
    got, want = QUERIES[name](spark, DATA), QUERIES[exact](spark, DATA)
    assert got.columns == want.columns and recall(got, want) >= 0.9


def test_document_links(spark):
    got = {(r.d1, r.d2): r.links for r in QUERIES["join_22_index_documents"](spark, DATA).collect()}
    exact = QUERIES["join_14_cross_document_links"](spark, DATA)
    ends = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("g"))
    pairs = exact.join(ends.toDF("query_id", "g1"), "query_id").join(ends.toDF("id", "g2"), "id").groupBy(F.least("g1", "g2").alias("a"), F.greatest("g1", "g2").alias("b")).count()
    want = {(r.a, r.b): r["count"] for r in pairs.collect() if r["count"] >= 5}
    assert sum(min(got.get(k, 0), n) for k, n in want.items()) >= 0.9 * sum(want.values())
    assert recall(QUERIES["join_15_index_links"](spark, DATA).withColumnRenamed("a", "query_id"), QUERIES["join_15_links_in_document"](spark, DATA).toDF("query_id", "id", "score")) >= 0.9


@pytest.mark.parametrize("copies", [0, 300])
def test_closest(monkeypatch, copies):
    """A part's best rows against all products: visited cells, groups, own rows, ties of copies; few pairs are scored twice."""
    r = np.random.default_rng(1)
    matrix = r.normal(size=(1500, 16))
    matrix[:copies] = matrix[0]
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    ids, groups, cells = r.permutation(1500) + 10, r.integers(0, 4, 1500), r.integers(3, 40, 1500)
    names, theirs, asked = ids[:300], groups[:300], matrix[:300]
    visits = [r.permutation(45)[: r.integers(1, 30)].astype(np.int16) for _ in names]
    scored, product = [], np.einsum
    monkeypatch.setattr(I.np, "einsum", lambda how, a, b: scored.append(len(a)) or product(how, a, b))
    for excluded, others in ((False, False), (True, False), (False, True)):
        for k, floor in ((5, 0.25), (5, -2.0), (100, -2.0)):
            scored.clear()
            got = [(int(q), int(i), float(s)) for x in I.closest(ids, groups, cells, matrix, names, theirs, asked, visits, k, floor, excluded, others) for q, i, s in zip(*x)]
            want = set()
            for q in range(300):
                score = np.round(matrix @ asked[q], 4)
                ok = np.isin(cells, visits[q]) & (score >= floor) & ((groups != theirs[q]) | (not excluded)) & ((ids != names[q]) | (not others))
                at = np.flatnonzero(ok)
                want |= {(int(names[q]), int(ids[i]), float(score[i])) for i in at[np.lexsort((ids[at], -score[at]))][:k]}
            assert len(got) == len(set(got)) and len(set(got) ^ want) <= 0.002 * len(want)
            assert copies or k > 5 or sum(scored) < 0.02 * 1500 * 300
