"""Text functions without SQL against plain Python, on texts with accents, and chunking on small documents."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from strataloom.functions import domain as D
from strataloom.functions import score as S
from strataloom.functions import text as X
from strataloom.operators import chunking as C

ACCENTED = [
    "Có thể là đúng, maybe; có lẽ perhaps. Amazing và tuyệt vời! TODO", "- một mục của danh sách\n" * 6, "éamazing unamazing amazing Amazing, best world best-in", "Bước 1: hãy làm. please", "năm 2021 tăng 12%",
    "cực kỳ tốt theo tôi", "là gì", "x" * 6000, "", "   ", "`code` và chắc chắn", "|a|b|\n|--|:-|\n|1|2|", "đẹp là đẹp", "Hình như TODOX, XXX.", "siêu rẻ, cực kỳ đẹp, tốt nhất, #1 về giá",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)


def python_quality(text, entities):
    t = re.sub(r"^\s+|\s+$", "", text)
    words = max(len(t.split()), 1)
    count = lambda ps: sum(len(re.findall(f"(?:{p})", t, re.I)) for p in ps)
    hedges, promotion, drafts = count(X.HEDGES), count(X.PROMOTION), count(X.DRAFTS)
    structure = any(re.search(p, t) for p in X.STRUCTURE)
    score = 1.0 - (0.5 if len(t) < 50 else 0.2 if len(t) > 5000 else 0)
    density = entities / words
    score += -0.15 if density < 0.005 and len(t) > 200 else 0.05 if density > 0.05 else 0
    score += 0.10 if structure else -0.10 if len(t) < 100 else 0
    score -= min(0.3, hedges / words * 2) if hedges / words > 0.05 else 0
    score -= (0.2 if promotion > 2 else 0) + (0.5 if drafts else 0)
    return round(max(0.0, min(1.0, score)), 6), structure, hedges, promotion, drafts


def test_quality_with_accents(spark):
    got = rows(spark, ACCENTED).select("k", X.quality(F.col("text"), F.lit(1)).alias("q")).select("k", "q.*").collect()
    for r in got:
        assert (pytest.approx(r.overall), r.has_structure, r.hedges, r.promotion, r.drafts) == python_quality(ACCENTED[r.k], 1), ACCENTED[r.k]


def test_modes_with_accents(spark):
    got = {r.k: r.m for r in rows(spark, ACCENTED).select("k", X.mode(F.col("text")).alias("m")).collect()}
    for k, text in enumerate(ACCENTED):
        want = next((name for name, patterns in X.MODES if any(re.search(p, text, re.I) for p in patterns)), "NARRATIVE")
        assert got[k] == want, text


PERSONAL = [
    "account 12345678 and 999123456780001112223", "a@b.co, c@d.org a@b.co", "0912345678 or +84912345678", "http://x.y/z?q=1. 10.0.0.1", "ids 123456789 and 123456789012", "none", "", "<ACCOUNT_ef797c81> 12345678",
    "12345678" + "x" + "12345678", "mail a.b@example.com12345678901",
]


def python_mask(text):
    mark = "<(?:" + "|".join(k for k, _ in X.MASKS) + ")_[0-9a-f]{8}>"
    for kind, pattern in X.MASKS:
        change = lambda m, kind=kind: m[0] if re.fullmatch(mark, m[0]) else f"<{kind}_{hashlib.sha256(m[0].encode()).hexdigest()[:8]}>"
        text = re.sub(f"{mark}|{pattern}", change, text, flags=re.A)
    return text


def test_masks_by_pattern(spark):
    out = rows(spark, PERSONAL).select("k", X.masked(F.col("text")).alias("m")).select("k", "m.*", X.unmask(F.col("m.text"), F.col("m.values")).alias("back")).collect()
    for r in out:
        assert r.text == python_mask(PERSONAL[r.k])
        assert r.k == 7 or r.back == PERSONAL[r.k]
    assert python_mask(PERSONAL[0]).endswith("999123456780001112223")


def test_addresses_end_no_sentence(spark):
    texts = ["See https://example.com/a.b. Next one. Last.", "At www.x.org/p. Then more.", "No address. Two here."]
    got = {r.k: list(r.s) for r in rows(spark, texts).select("k", X.sentences(F.col("text")).alias("s")).collect()}
    assert got == {0: ["See https://example.com/a.b. Next one.", "Last."], 1: ["At www.x.org/p. Then more."], 2: ["No address.", "Two here."]}


@pytest.mark.parametrize(
    ("query", "want"),
    [("so sánh LightRAG và GraphRAG?", ["LightRAG", "GraphRAG"]), ("BiXSE so với InfoNCE", ["BiXSE", "InfoNCE"]), ("Alpha vs Beta", ["Alpha", "Beta"]), ("nothing here", []), ("so sánh RAG và BERT", ["BERT"])],
)
def test_comparisons(spark, query, want):
    assert rows(spark, [query]).select(X.comparative_spans(F.col("text")).alias("x")).first()["x"] == want


def test_domains_and_times(spark):
    p = rows(spark, ["So sánh thuật toán và phương pháp"]).select(D.tag_query(F.col("text")).alias("p")).first()["p"]
    assert sum(p) == pytest.approx(1) and D.DOMAIN_AXES[p.index(max(p))] == "method_algorithm"
    types = spark.createDataFrame([(["GENE", "protein", "MODEL"],), ([],)], "t array<string>").select(D.tag_entities(F.col("t")).alias("p")).collect()
    assert D.DOMAIN_AXES[types[0]["p"].index(max(types[0]["p"]))] == "biological_science" and types[1]["p"] is None
    t = rows(spark, ["Q3 2022 report"]).select(S.temporal_intent(F.col("text")).alias("t")).first()["t"]
    assert (t["type"], t["quarter"], t["year"], str(t["high"])) == ("specific", 3, 2022, "2022-09-30")


def test_groups_of_sentences(spark):
    units = [("d", k, t, s) for k, (t, s) in enumerate([("aaaa", 0.0), ("bbb", 0.1), ("cc", 0.9), ("dddd", 0.2), ("ee", 0.2)])]
    frame = spark.createDataFrame(units, "doc string, pos int, t string, s double")
    got = {r.k: r.chunk for r in C.group_at(frame, "doc", "pos", "t", "s", F.lit(0.5), F.lit(100)).collect()}
    assert got == {0: "aaaa bbb", 1: "cc dddd ee"}
    short = {r.k: r.chunk for r in C.group_at(frame, "doc", "pos", "t", "s", F.lit(0.5), F.lit(7)).collect()}
    assert short == {0: "aaaa bbb", 1: "cc dddd", 2: "ee"}
    sections = spark.range(1).select(C.sections(F.array(*map(F.lit, ["aaaa", "", "bbb", "cc", "dddddddd"])), 7).alias("s")).first()["s"]
    assert sections == [["aaaa", "bbb"], ["cc"], ["dddddddd"]]


def test_dispatch(spark):
    files = [("a", "x.md", "One is here. Two is here."), ("b", "y.json", "[1]\n[2]"), ("c", "z.pdf", "Only text."), ("d", None, None), ("e", "w.csv", "1,2\n3,4")]
    got = {}
    for r in C.dispatch(spark.createDataFrame(files, "doc_id string, name string, text string")).collect():
        got.setdefault((r.doc_id, r.format), []).append(r.chunk)
    assert got == {("a", "md"): ["One is here. Two is here."], ("b", "chat"): ["[1]\n[2]"], ("c", "pdf"): ["Only text."], ("e", "csv"): ["1,2\n3,4"]}


def test_structured_dispatch(spark):
    """Tables and chat exports by their own chunkers, held against plain Python."""
    import csv
    import io
    import json

    table = "name, size\n" + "".join(f'"x, {k}\nof ""{k}""",{k}\n' for k in range(45)) + "\nlast,\n" + "y" * 200_000 + ",1"
    header, *cells = csv.reader(io.StringIO(table, newline=""), strict=False) if csv.field_size_limit(2**31 - 1) else []
    row = lambda r: "| " + " | ".join(r) + " |"
    head = [row([h.strip() for h in header]), "| --- | --- |"]
    groups = [cells[k : k + 20] for k in range(0, len(cells), 20)]
    want = {("t", k): "\n".join([f"[Sheet: Sheet1, rows {20 * k + 1}-{20 * k + len(g)}]", *head, *map(row, g)]) for k, g in enumerate(groups)}
    said = [{"from": "b", "text": "second", "ts": "2", "thread_id": "u"}, {"role": "a", "content": "other", "conversation_id": "v"}, {"role": "a", "content": "first", "timestamp": "1", "thread_id": "u"}, {"content": "third", "timestamp": "2", "thread_id": "u", "n": 3}, {"x": None}]
    want |= {(c, k): v for c in "jl" for k, v in enumerate(["[1] a: first\n[2] b: second", "[2] user: third", "a: other", "user: "])}
    files = [("t", "t.csv", table), ("j", "j.json", json.dumps(said)), ("l", "l.jsonl", "\n".join(map(json.dumps, said[:2])) + "\nno json\n\n[1]\n" + "\n".join(map(json.dumps, said[2:])))]
    files += [("s", "s.tsv", "a\tb\n1\t2"), ("h", "h.csv", "only,header"), ("e", "e.csv", ""), ("n", "n.csv", None), ("m", "m.json", None), ("o", "o.json", "[1]\n[2]")]
    want["s", 0] = "[Sheet: Sheet1, rows 1-1]\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    got = C.dispatch(spark.createDataFrame(files, "doc_id string, name string, text string"), structured=True)
    assert {(r.doc_id, r.k): r.chunk for r in got.collect()} == want


def test_semantic_boundaries(spark):
    """Sentences with the same words stay together; the vector's signal alone parts those without."""
    from strataloom.operators import chunking as C

    a, b = "the red fox runs over the old hill", "market prices of corn were falling slowly today"
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate((a, a + " again", b, b))], "doc_id long, pos int, sentence string")
    scored = C.boundary_scores(rows.withColumn("v", C.bag_vector(F.col("sentence"))), "doc_id", "pos", "sentence", vec="v").orderBy("pos").collect()
    plain = C.boundary_scores(rows, "doc_id", "pos", "sentence").orderBy("pos").collect()
    signal = [x.boundary - y.boundary for x, y in zip(scored, plain)]
    assert signal[0] == 0 and signal[1] < 0.05 and signal[2] > 0.15 and abs(signal[3]) < 1e-9
    vector = spark.range(1).select(C.bag_vector(F.lit("A b a"), 8).alias("v"), C.bag_vector(F.lit(""), 8).alias("none")).first()
    assert sorted(vector.v)[-1] >= 2 and sum(vector.v) == 3 and sum(vector.none) == 0
    docs = spark.createDataFrame([(1, ". ".join([a.capitalize()] * 3 + [b.capitalize()] * 3) + ".", "x.txt")], "doc_id long, text string, name string")
    with_words = C.signal_chunks(docs, "doc_id", "text", "name").collect()
    without = C.signal_chunks(docs, "doc_id", "text", "name", vector=lambda t: F.array(F.lit(1.0))).collect()
    assert len(with_words) >= len(without) >= 1
