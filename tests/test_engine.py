"""Golden facts of functions and operators on tiny inputs."""

import math

import pytest
from pyspark.sql import functions as F

from strataloom.functions import score as S
from strataloom.functions import text as X
from strataloom.functions import vector as V
from strataloom.operators import chunking as C
from strataloom.operators import graph as G
from strataloom.operators import ranking as R
from strataloom.sources import files


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_")).select(column.alias("x")).first()["x"]


def test_sentences(spark):
    text = "Nguyen et al. 2024 found 12.35 percent. See https://example.com/a.b for more. F. Scott agreed! Really? Yes."
    assert one(spark, X.sentences(F.col("t")), t=text) == ["Nguyen et al. 2024 found 12.35 percent.", "See https://example.com/a.b for more.", "F. Scott agreed!", "Really?", "Yes."]


def test_pack(spark):
    packed = one(spark, C.pack(F.array(*map(F.lit, ["aaaa", "bbb", "cc", "dddddd"])), 10))
    assert packed == ["aaaa bbb", "cc dddddd"]
    assert one(spark, C.pack(F.array().cast("array<string>"), 10)) == []


def test_artifacts(spark):
    assert one(spark, X.strip_artifacts(F.col("t")), t="Body\nPreprint.\nPage 7 of 14\n12\n") == "Body"


def test_masks(spark):
    text = "Mail a.b@example.com or a.b@example.com, call 0912345678, see http://x.org/1, 10.0.0.1, account 12345678901234."
    values = X.mask_values(F.col("t"))
    masked = one(spark, X.mask(F.col("t"), values), t=text)
    assert "example.com or" not in masked and masked.count("<EMAIL_") == 2 and "<PHONE_" in masked and "<URL_" in masked and "<IP_" in masked and "<ACCOUNT_" in masked
    assert one(spark, X.unmask(X.mask(F.col("t"), values), values), t=text) == text


@pytest.mark.parametrize("a,b,related", [("BERT base", "bert-base", True), ("Knowledge Graph", "KG", True), ("GPT-4", "GPT-4o", True), ("graph", "group", False), ("AI", "Bio", False), ("", "x", False)])
def test_lexically_related(spark, a, b, related):
    assert one(spark, X.lexically_related(F.col("a"), F.col("b")), a=a, b=b) == related


def test_answers(spark):
    assert one(spark, X.is_refusal(F.col("t")), t="I don't have enough information.")
    cited = "The first statement is here [doc_a::para::1]. The second statement has none at all."
    assert one(spark, X.citation_ratio(F.col("t")), t=cited) == 0.5


def test_quality(spark):
    good = one(spark, X.quality(F.col("t"), F.lit(1)), t="- item one of the list\n" * 12)
    bad = one(spark, X.quality(F.col("t"), F.lit(0)), t="TODO maybe")
    assert good["accept"] and good["has_structure"] and not bad["accept"] and bad["drafts"] == 1


def test_intents(spark):
    assert one(spark, X.chat_intent(F.col("t")), t="Xin chào!")["intent"] == "greeting"
    assert one(spark, X.chat_intent(F.col("t")), t="còn nữa không")["intent"] == "follow_up"
    assert one(spark, X.chat_intent(F.col("t")), t="What is this")["confidence"] == 0.85
    assert one(spark, X.corpus_wide(F.col("t")), t="What are the main themes?") and one(spark, X.out_of_domain(F.col("t")), t="Weather today")
    assert one(spark, X.needs_reasoning(F.lit("comparison"), F.col("t")), t="LightRAG vs GraphRAG")
    assert one(spark, X.rule_intent(F.col("t")), t="Tại sao?") == "analytical"


def test_document_types(spark):
    kind = lambda t, n: one(spark, X.doc_type(F.col("t"), F.col("n")), t=t, n=n)
    assert kind("", "chat.json") == "chat_log" and kind("", "a.py") == "code" and kind("plain", "a.txt") == "generic"
    assert kind("# Abstract\narXiv:2401.12345", "a.txt") == "research_paper"


def test_times(spark):
    assert one(spark, S.temporal_intent(F.col("t")), t="report of Q2 2023")["quarter"] == 2
    assert str(one(spark, S.temporal_intent(F.col("t")), t="sales in 2021")["high"]) == "2021-12-31"
    assert one(spark, S.temporal_intent(F.col("t")), t="latest version")["type"] == "latest"
    assert one(spark, S.recency(F.lit("2024-01-01").cast("date"), F.lit("2023-01-01").cast("date"))) == 0.5


def test_vectors(spark):
    array = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, V.cosine(array(1.0, 0.0), array(0.0, 1.0))) == 0 and one(spark, V.cosine(array(0.0, 0.0), array(1.0, 1.0))) == 0
    assert sum(one(spark, V.softmax(array(1.0, 2.0, 3.0)))) == pytest.approx(1)
    assert one(spark, V.unit(array(3.0, 4.0))) == [0.6, 0.8]


def test_npmi(spark):
    contexts = [("AB", 1), ("AB", 2), ("CH", 3), ("DH", 4), ("EH", 5)]
    rows = spark.createDataFrame([(k, e) for names, k in contexts for e in names + ("H" if "H" not in names else "")], "chunk_id long, entity_id string")
    got = {(r.a, r.b): r.npmi for r in G.npmi_edges(rows).collect()}
    assert got == {("A", "B"): pytest.approx(1.0)}


def test_page_rank(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("a", "c", 2.0)], "a string, b string, weight double")
    ranks = {r.node: r.score for r in G.page_rank(edges, spark.createDataFrame([("a",)], "node string"), iterations=12).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["a"] > ranks["c"] > ranks["b"] > 0


def test_rank_fusion(spark):
    rows = [(1, "original", k + 1, f"c{k + 1}", 0.9, "section", 1.0) for k in range(3)] + [(1, "hyde", 1, "c1", 0.9, "section", 1.0), (1, "hyde", 2, "c2", 0.9, "section", 1.0)]
    frame = spark.createDataFrame(rows, "query_id long, path string, rank int, chunk_id string, consistency double, level string, reward double")
    got = [r.chunk_id for r in R.rank_fusion(frame).orderBy(F.desc("rrf"), "chunk_id").collect()]
    assert got == ["c1", "c2", "c3"]
    best = R.rank_fusion(frame).where("chunk_id = 'c1'").first()["rrf"]
    assert math.isclose(best, (1.0 + 1.3) * 1.2 * 1.1 / 61, abs_tol=1e-8)


def test_diverse(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.01]), (1, 3, 0.5, [0.0, 1.0])]
    got = R.diverse(spark.createDataFrame(rows, "query_id long, id long, score double, vec array<double>"), 2).orderBy("pick").collect()
    assert [r.id for r in got] == [1, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.jsonl").write_text('{"from": "bob", "text": "hi", "ts": "1"}\nbroken\n{"role": "", "content": "x"}\n')
    (tmp_path / "c.csv").write_text(" a ,b\n1,2\n")
    found = {r.path.rsplit("/", 1)[1]: r.format for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert found == {"a.pdf": "pdf", "b.jsonl": "chat", "c.csv": "csv"}
    got = [(r.role, r.content, r.thread_id) for r in files.read_messages(spark, str(tmp_path / "b.jsonl")).collect()]
    assert got == [("bob", "hi", "default"), ("user", "x", "default")]
    assert files.read_csv(spark, str(tmp_path / "c.csv")).columns == ["a", "b"]


def test_writes_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3)], "doc_id string, chunk int")
    for _ in range(2):
        files.write_partitions(rows, str(tmp_path / "t"), ["doc_id"])
    files.write_partitions(rows.where("doc_id = 'd2'"), str(tmp_path / "t"), ["doc_id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_entry_without_corpus_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
