"""Helpers shared by the corpus operators: shared-folder tables and joins on hot keys."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
"""White space in all contracts of this subpackage; a word is a run of other characters."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session without one (a test) gets a fresh local folder; a cluster must name one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_calls = threading.local()


@contextmanager
def tidy():
    """Around a call (or as a decorator): the Scratch folders made inside, whose tables are deleted if the call fails."""
    made: list[Scratch] = []
    running = _calls.__dict__.setdefault("made", [])
    running.append(made)
    try:
        yield made
    except BaseException:
        for scratch in made:
            scratch.drop()
        raise
    finally:
        running.pop()


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage, survives lost executors, and is computed once, where an eager
    checkpoint() runs its job twice. ``drop`` removes all tables but those to keep.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/strataloom-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.written = 0
        self.at: dict[int, str] = {}
        for made in _calls.__dict__.get("made", ()):
            made.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.folder}/{self.written}"
        df.write.parquet(path)
        self.paths.append(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(table)] = path
        return table

    def adopt(self, table: DataFrame, others: list[Scratch]) -> DataFrame:
        """``table`` as one of this folder's: taken over from the one of ``others`` that wrote it, else written."""
        for other in others:
            path = other.at.pop(id(table), None)
            if path in other.paths:
                other.paths.remove(path)
                self.paths.append(path)
                self.at[id(table)] = path
                return table
        return self.write(table)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def release(self, table: DataFrame) -> None:
        """Delete one table that ``write`` returned and that nothing reads any more."""
        path = self.at.pop(id(table))
        self.paths.remove(path)
        self._delete(path)

    def drop(self, keep: int = 0) -> None:
        """Delete all tables but the last ``keep``."""
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in gone:
            self._delete(path)


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A written copy of ``docs``: its rows as structs ``_doc``, each with a number ``_row`` of its own, whatever the ids are."""
    return scratch.write(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row")))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of ``numbered`` rows whose numbers are not in ``gone``."""
    return rows.join(gone.select("_row"), "_row", "left_anti").select("_doc.*")


HOT_SHARE = 1000
"""A key with more than 1/HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE hot keys."""


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows to one row per group, where one group may hold a third of all rows.

    Hot groups are fewer than HOT_SHARE by arithmetic, so broadcasting them has a fixed bound and leaves
    their rows in place. The other groups, each with at most total / HOT_SHARE rows, are shuffled.
    """
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total)).withColumn("_hot", F.lit(True))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(total))
    values = [c for c in groups.columns if c not in keys]
    first = rows.join(F.broadcast(hot), keys, "left")
    rest = first.where(F.col("_hot").isNull()).select(*rows.columns).join(cold, keys, "left")
    columns = [*rows.columns, *values]
    return first.where(F.col("_hot")).select(*columns).unionByName(rest.select(*columns))


def join_present(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Like ``join_groups`` for one key, without the rows that have no group; the other groups are merged at every size.

    The hot groups' keys, fewer than HOT_SHARE by arithmetic, part the rows by a filter that names them.
    """
    (key,) = keys
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(total))
    warm = F.col(key).isin([r[0] for r in hot.select(key).collect()])
    columns = [*rows.columns, *[c for c in groups.columns if c not in keys]]
    rest = rows.where(~warm).join(cold.hint("merge"), keys)
    return rows.where(warm).join(F.broadcast(hot), keys).select(*columns).unionByName(rest.select(*columns))


SIEVE_WORDS = 1 << 20
"""Bound of a broadcast sieve: 2^20 words of 64 bits. A fuller sieve only lets more rows through."""


def parted(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows with _maybe: whether the sieve of ``ids`` (one column) lets the id pass."""
    slot = lambda c: F.pmod(F.shiftright(F.xxhash64(F.col(c)), 6), F.lit(SIEVE_WORDS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(xxhash64(`{c}`) & 63 as int))")
    name = ids.columns[0]
    bits = ids.groupBy(slot(name).alias("_slot")).agg(F.bit_or(bit(name)).alias("_bits"))
    joined = rows.withColumn("_slot", slot(id_col)).join(F.broadcast(bits), "_slot", "left")
    return joined.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit(id_col)) != 0, F.lit(False))).drop("_slot", "_bits")


def sieve(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids`` (one column), and a few others; a map-side step with a bounded broadcast.

    What must be exact comes after it; the sieve spares most other rows that step's shuffle.
    """
    return parted(rows, id_col, ids).where("_maybe").drop("_maybe")


def join_some(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """Left join of rows to ``some`` with distinct keys; rows that the sieve of its keys stops stay where they are."""
    both = parted(rows, key, some.select(key))
    hits = both.where("_maybe").drop("_maybe").join(some.hint("merge"), key, "left")
    rest = both.where("not _maybe").drop("_maybe").withColumns({c: F.lit(None).cast(t) for c, t in some.dtypes if c != key})
    return hits.unionByName(rest)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the smallest node reachable over links (a, b), for every node with a link to another.

    Alternating large and small stars until the edges stop changing; no node's neighbours are gathered.
    """
    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size")
        large = join_groups(both, scratch.write(least), ["u"], "size", 2 * edges.count())  # a hub's edges stay where they are
        large = scratch.write(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")))
        small = join_groups(large, least, ["u"], "size", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == seen:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
        seen = mark
