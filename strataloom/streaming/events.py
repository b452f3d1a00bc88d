"""Structured Streaming forms: windows, duplicates, latest state, rolling samples, micro-batch upserts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.sources.shared import delete, exists


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).format("parquet").load(f"{sf_dir}/{name}.parquet*")


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need a time with a zone; times without one are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and mean value per type and tumbling window; later events than ``late`` are dropped."""
    grouped = timed(events).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One event per user, type and minute."""
    marked = timed(events).withColumn("minute", F.date_trunc("minute", "ts")).withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(["user_id", "event_type", "minute"])


def rolling_mean(events: DataFrame, last: int = 500) -> DataFrame:
    """After each micro-batch: users with new events, and the mean of their last samples (kept as state)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).sort_values(["ts", "event_id"])["value"].tolist()
        held = (held + new)[-last:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [len(held)], "mean": [sum(held) / len(held)]})

    kept = events.select("user_id", "ts", "event_id", "value")
    return kept.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, mean double", "held array<double>", "update", "NoTimeout")


def drain(rows: DataFrame, spark: SparkSession, folder: str, mode: str = "append", keys: list[str] = (), at: str | None = None) -> DataFrame:
    """Runs a stream over all there is and returns its result.

    Every micro-batch replaces its own folder, so a batch that is run again after a failure leaves one copy. In complete
    mode the last batch is the result; in update mode the last row of each of ``keys`` is. With ``at`` the run goes on
    from the state of an earlier one there.
    """
    run = at or f"{folder}/stream-{uuid.uuid4().hex}"
    put = lambda batch, k: batch.write.mode("overwrite").parquet(f"{run}/out/batch={k}")
    rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, batch long").parquet(f"{run}/out")
    if mode == "complete":
        last = kept.agg(F.max("batch")).first()[0]
        kept = kept.where(F.col("batch") == F.lit(last))
    elif mode == "update":
        latest = kept.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r"))
        return latest.select("r.*")
    return kept.drop("batch")


EVERY = 16
"""Micro-batches between two snapshots of a folded state."""


def fold(stream_: DataFrame, spark: SparkSession, at: str, delta, merge, every: int = EVERY) -> DataFrame:
    """State kept over restarts: each micro-batch writes delta(batch) to a folder of its own under ``at``, replacing what an
    earlier try left there, and merge() of all deltas is the state. A later call with the same ``at`` goes on.

    Every so many batches the state so far is written as a snapshot, and the deltas and snapshots in it go, so at most
    ``every`` deltas are read beside one snapshot. ``merge`` gives rows of the deltas' columns and may be applied to its
    own results. A snapshot holds batches before the current one only, which are never run again.
    """

    def put(batch: DataFrame, k: int) -> None:
        delta(batch).write.mode("overwrite").parquet(f"{at}/delta/batch={k}")
        if k and k % every == 0:
            snapshot(spark, at, k - 1, merge)

    stream_.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return merge(folded_parts(spark, at, None))


def folded_parts(spark: SparkSession, at: str, upto: int | None) -> DataFrame:
    """The latest finished snapshot and the deltas after it, up to a batch."""
    done = [k for k in numbered(spark, f"{at}/snapshot") if exists(spark, f"{at}/snapshot/{k}/_SUCCESS")]
    base = max(done, default=-1)
    paths = [f"{at}/delta/batch={k}" for k in numbered(spark, f"{at}/delta") if k > base and (upto is None or k <= upto)]
    return spark.read.parquet(*paths, *([f"{at}/snapshot/{base}"] if done else []))


def snapshot(spark: SparkSession, at: str, upto: int, merge) -> None:
    """Writes the state of all batches up to one, then deletes what it holds; done again after a failure, it ends the same."""
    if not exists(spark, f"{at}/snapshot/{upto}/_SUCCESS"):
        merge(folded_parts(spark, at, upto)).write.mode("overwrite").parquet(f"{at}/snapshot/{upto}")
    for k in numbered(spark, f"{at}/snapshot"):
        if k < upto:
            delete(spark, f"{at}/snapshot/{k}")
    for k in numbered(spark, f"{at}/delta"):
        if k <= upto:
            delete(spark, f"{at}/delta/batch={k}")


def numbered(spark: SparkSession, path: str) -> list[int]:
    """The numbers that end the names of a folder's parts."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n.rpartition("=")[2]) for n in names if n.rpartition("=")[2].isdigit())


def flush_lines(events: DataFrame, path: str, state: str, interval: str | None = "5 seconds"):
    """Starts appending events as JSON lines, once per interval; without one, all there is and then no more."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(**trigger).start()


def recent(events: DataFrame, most: int = 1000) -> DataFrame:
    """The latest events, the larger id first among equal times."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
