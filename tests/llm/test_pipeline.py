"""The stages one after another, each against brute force on what it was given."""

from tests.llm.test_operators import AWKWARD, DATA, brute_components, brute_copies, check_packing, texts_of

import corpus_pipeline


def test_stages(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.quality, corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.repeats, corpus_pipeline.pack]
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, DATA).cache()
        if name != "packing":
            assert out.columns == columns
        if name == "quality rules":
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            lost = {r.doc_id for r in before.join(out, "doc_id", "left_anti").where("size(split(text, ' ')) > 80").collect()}
            assert len(good & lost) <= 1 and out.count() < before.count()
        elif name == "exact dedup":
            assert {r.doc_id for r in out.collect()} == {i for i, _, _, kept, _ in brute_copies(texts_of(before)) if kept}
        elif name == "near dedup":
            assert {r.doc_id for r in out.collect()} == {i for i, _, c in brute_components(texts_of(before), corpus_pipeline.NEAR_PERCENT) if i == c}
        elif name == "repeated strings":
            assert out.count() == before.count()
        else:
            check_packing(before, out.collect())
        docs = out


def test_awkward_rows(spark):
    """Every stage but the last keeps the columns; null, empty and long texts, repeated and missing ids, and no rows at all."""
    for rows in (AWKWARD, []):
        frame = [(i, t, lang, "src", len(t or "")) for i, t, lang in rows]
        docs = spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, DATA).cache()
            if name == "packing":
                check_packing(docs, out.collect())
            else:
                assert out.columns == docs.columns and out.count() <= docs.count()
                docs = out
        first = corpus_pipeline.quality(spark, spark.createDataFrame(frame, docs.schema), DATA)
        assert first.columns == docs.columns and first.count() <= len(rows)


def test_run_leaves_one_table(spark):
    import os

    from strataloom.llm import common

    folder = common.shared_folder(spark).removeprefix("file:")
    tables = lambda: {f"{d}/{t}" for d in os.listdir(folder) if d.startswith("strataloom-") for t in os.listdir(f"{folder}/{d}")}
    before = tables()
    out = corpus_pipeline.run(spark, DATA)
    assert len(tables() - before) == 1 and out.count() > 0 and "sequence_id" in out.columns


def test_stages_clear_what_is_written(spark, tmp_path):
    """A later stage deletes the tables of earlier ones whose result was written elsewhere, and none that it reads."""
    import os

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = corpus_pipeline.exact(spark, docs, DATA)
    kept = next(s for s in reversed(corpus_pipeline._left) if s.paths)
    folder = kept.paths[0].removeprefix("file:")
    n = first.count()
    assert corpus_pipeline.near(spark, first, DATA).count() <= n and os.path.exists(folder)  # read from there
    first.write.parquet(str(tmp_path / "exact"))
    again = spark.read.parquet(str(tmp_path / "exact"))
    assert corpus_pipeline.near(spark, again, DATA).count() <= n and not os.path.exists(folder) and again.count() == n
