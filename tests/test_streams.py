"""Streams over several files, replays and restarts, and sinks that may run twice."""

import time

import pytest
from pyspark.sql import functions as F

from strataloom.sources import files
from strataloom.streaming import events as E

KIND = "event_id long, user_id long, ts timestamp, event_type string, value double"


def event(k):
    return (k, k % 3, __import__("datetime").datetime(2024, 1, 1, k // 60 % 24, k % 60), "view" if k % 2 else "click", float(k))


def put(spark, folder, ks, name):
    spark.createDataFrame([event(k) for k in ks], KIND).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_modes_over_several_batches(spark, tmp_path):
    for name, ks in (("a", range(0, 50)), ("b", range(50, 90)), ("c", range(90, 100))):
        put(spark, tmp_path / "in", ks, name)
    rows = stream(spark, tmp_path / "in")
    counts = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    got = E.drain(counts, spark, str(tmp_path / "w"), "complete")
    assert sorted((r.event_type, r.n) for r in got.collect()) == [("click", 50), ("view", 50)]
    means = {r.user_id: (r.n, r["mean"]) for r in E.drain(E.rolling_mean(rows, 10), spark, str(tmp_path / "w"), "update", ["user_id"]).collect()}
    for u in range(3):
        last = [float(k) for k in range(100) if k % 3 == u][-10:]
        assert means[u] == (10, pytest.approx(sum(last) / 10))
    assert E.drain(E.first_per_minute(rows).select("user_id", "event_type", "minute"), spark, str(tmp_path / "w")).count() == 100


def test_fold_goes_on_after_a_restart(spark, tmp_path):
    delta = lambda b: b.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
    merge = lambda d: d.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.sum("n").alias("n"))
    put(spark, tmp_path / "in", range(0, 30), "a")
    put(spark, tmp_path / "in", range(30, 40), "b")
    run = lambda: {r.user_id: (r.event_id, r.n) for r in E.fold(stream(spark, tmp_path / "in"), spark, str(tmp_path / "w"), delta, merge).collect()}
    want = lambda n: {u: (max(k for k in range(n) if k % 3 == u), sum(k % 3 == u for k in range(n))) for u in range(3)}
    assert run() == want(40)
    put(spark, tmp_path / "in", range(40, 50), "c")
    assert run() == want(50)  # a second start, with the first one's state
    import shutil

    last = max((tmp_path / "w" / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver had died after the batch was written and before it was committed
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == want(50)
    shutil.rmtree(tmp_path / "w", ignore_errors=True)


def test_lines_are_flushed_by_interval(spark, tmp_path):
    put(spark, tmp_path / "in", range(5), "a")
    q = E.flush_lines(stream(spark, tmp_path / "in").select("event_id"), str(tmp_path / "out"), str(tmp_path / "state"), "1 second")
    try:
        until = time.time() + 60
        while time.time() < until and not list((tmp_path / "out").glob("*.json")):
            time.sleep(0.5)
    finally:
        q.stop()
    assert spark.read.schema("event_id long").json(str(tmp_path / "out")).count() == 5
    assert [r.event_id for r in E.recent(spark.read.schema(KIND).parquet(str(tmp_path / "in" / "a")), 2).collect()] == [4, 3]


def test_puts_and_deletes(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "doc string, chunk int")
    for _ in range(2):
        files.put_documents(frame([("a", 1), ("a", 2), ("b", 1), ("c", 1)]), path, "doc", 4)
    files.put_documents(frame([("a", 9)]), path, "doc", 4)
    read = lambda: sorted((r.doc, r.chunk) for r in spark.read.parquet(path).collect())
    assert read() == [("a", 9), ("b", 1), ("c", 1)]
    for _ in range(2):
        files.delete_documents(spark, path, frame([("a", 0), ("zz", 0)]), "doc", 4)
    assert read() == [("b", 1), ("c", 1)]


def test_parsers_may_fail(spark, monkeypatch):
    monkeypatch.setitem(files.PARSERS, "pdf", lambda content: [content.decode("ascii")])
    rows = spark.createDataFrame([("x", "pdf", bytearray(b"ok")), ("y", "pdf", bytearray(b"\xff")), ("z", "docx", bytearray(b"-"))], "doc_id string, format string, content binary")
    assert [tuple(r) for r in files.parse_pages(rows).collect()] == [("x", 0, "ok")]


def test_datasets(spark, tmp_path):
    for name, text in (("a.json", '[{"question": "q1"}, {"query": "q2"}]'), ("b.json", '{"samples": [{"user_input": "q3"}]}'), ("c.json", '{"prompt": "q4", "id": "7"}')):
        (tmp_path / name).write_text(text)
    assert sorted(r.question for r in files.read_dataset(spark, str(tmp_path)).collect()) == ["q1", "q2", "q3", "q4"]


def test_sessions_and_windows(spark, tmp_path):
    put(spark, tmp_path / "in", [0, 3, 6, 90, 93], "a")
    rows = spark.read.schema(KIND).parquet(str(tmp_path / "in" / "a"))
    assert sorted(r.n for r in E.sessions(rows).collect()) == [2, 3] and sorted(r.n for r in E.windowed_counts(rows).collect()) == [1, 1, 1, 2]


def test_state_expires(spark, tmp_path):
    """Two batches and a restart: keys without events for the time to live are gone, others go on counting."""
    import datetime as dt

    from strataloom.streaming import expiry as X

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    schema = "user_id long, ts timestamp"
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    X.use_store(spark)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        put = lambda batch, k: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")
        X.with_expiry(events, ttl="2 hours", late="0 minutes").writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        changes = spark.read.schema(f"{X.OUTPUT}, batch long").parquet(str(tmp_path / "out"))
        return changes, {r.user_id: r.n for r in X.live_keys(changes).collect()}

    try:
        _, live = run([(1, at(0)), (1, at(0.5)), (2, at(1)), (None, at(1)), (3, None)])
        assert live == {1: 2, 2: 1}
        _, live = run([(2, at(2.9)), (4, at(3))])  # the watermark passes 2.5 hours: key 1 is gone, key 2 moved its timer
        assert live == {2: 2, 4: 1}
        changes, live = run([(1, at(4.5)), (4, at(4.6))])  # key 1 begins anew
        assert live == {1: 1, 2: 2, 4: 2}
        changes, live = run([(5, at(9))])
        assert live == {5: 1} and {r.user_id for r in changes.where("status = 'expired'").collect()} == {1, 2, 4}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if store is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)


def test_snapshots_bound_the_deltas(spark, tmp_path):
    from strataloom.streaming import events as E

    schema = "user_id long, event_id long"
    delta = lambda batch: batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
    merge = lambda rows: rows.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.sum("n").alias("n"))
    want = {}
    for k in range(11):
        rows = [(k % 3, k), (7, k)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for u, e in rows:
            want[u] = (e, want.get(u, (0, 0))[1] + 1)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))  # each call is a restart
        got = {r.user_id: (r.event_id, r.n) for r in E.fold(source, spark, str(tmp_path / "w"), delta, merge, every=4).collect()}
        assert got == want
        assert len(E.numbered(spark, f"{tmp_path}/w/delta")) <= 5 and len(E.numbered(spark, f"{tmp_path}/w/snapshot")) <= 1
    E.snapshot(spark, str(tmp_path / "w"), 7, merge)  # done again, it ends the same
    assert {r.user_id: (r.event_id, r.n) for r in merge(E.folded_parts(spark, str(tmp_path / "w"), None)).collect()} == want
