"""Exact deduplication by a Golomb-coded fingerprint exchange.

Each partition sorts the distinct fingerprints of its texts (in bundles of at most BUNDLE_ROWS) and sends them, Golomb-coded,
to the owners of the hash ranges; no row is shuffled for that. An owner sees which fingerprints several bundles sent and
answers each with a bitmap. Only rows marked that way, or repeated inside their bundle, are suspects; only their texts are
shuffled and compared byte by byte. Ids never pass through Python.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import golomb
from strataloom.llm.common import WHITE, Scratch, join_groups, numbered, sieve, tidy, without

BUNDLE_ROWS = 1 << 20
OWNER_FINGERPRINTS = 500_000
FALSE_SUSPECT_BITS = 12
"""A fingerprint keeps log2(rows) + FALSE_SUSPECT_BITS bits: about one row in 4096 is a false suspect."""


def repeated(marks: DataFrame, total: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(_f: fingerprints that occur again, how many leading bits of _hash they are) of a written table with _hash."""
    bits = min(64, max(1, total).bit_length() + FALSE_SUSPECT_BITS)
    owner_bits = max(3, math.ceil(math.log2(max(1, total / OWNER_FINGERPRINTS))))

    def send(batches):
        bundle, held, rows = TaskContext.get().partitionId() << 24, [], 0

        def message():
            values, counts = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            owners = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
            parts = golomb.messages(values, bundle, bits, owner_bits)
            own = [np.packbits(counts[owners == o] > 1).tobytes() for o, _, _ in parts]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*parts), own], (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["_owner", "_sender", "_blob", "_own"])

        for batch in batches:
            for a in range(0, batch.num_rows, BUNDLE_ROWS):
                part = batch.column(0).slice(a, BUNDLE_ROWS).to_numpy(zero_copy_only=False).view(np.uint64)
                if held and rows + len(part) > BUNDLE_ROWS:
                    yield message()
                    bundle, held, rows = bundle + 1, [], 0
                held.append(part)
                rows += len(part)
        if held:
            yield message()

    def receive(batches):
        for batch in batches:
            for owner, blob, own, reply in zip(*[c.to_pylist() for c in batch.columns]):
                values = golomb.decode(blob)
                hit = np.unpackbits(np.frombuffer(own, np.uint8), count=len(values)) | np.unpackbits(np.frombuffer(reply, np.uint8), count=len(values))
                values = values[hit.astype(bool)] + np.uint64(owner << (bits - owner_bits))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["_f"])

    sent = scratch.write(marks.select("_hash").mapInArrow(send, f"{golomb.OWNED}, _own binary"))
    found = sent.join(golomb.answer(sent), ["_owner", "_sender"]).select("_owner", "_blob", "_own", "_map").mapInArrow(receive, "_f long")
    return scratch.write(found.distinct()), bits


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None):
    """Marks copies of texts that are identical after each white-space run became one space.

    Returns (rows, scratch): one row per input row with its number _row (column ``row`` if given), id_col, ``keep_id``,
    ``group_size``, ``kept`` and ``text_sha256``. A null text counts as empty. Of a group the row with the smallest id
    stays, a null id coming last; of rows that repeat that id as well, the first one read. So one row of each group is
    kept, and ``keep_id`` is null only where all ids of a group are. Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    norm = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), WHITE, " ")
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marks = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("_row"), F.col(id_col).alias("_id"), norm.alias("_n"))
    marks = scratch.write(marks.select("_row", "_id", F.xxhash64("_n").alias("_hash"), F.unhex(F.sha2("_n", 256)).alias("_sha")))
    total = marks.count()
    found, bits = repeated(marks, total, scratch)
    again = scratch.write(sieve(marks.withColumn("_f", F.shiftrightunsigned("_hash", 64 - bits)), "_f", found).drop("_f", "_hash"))
    texts = sieve(read, "_id", again.select("_id")).select(F.regexp_replace(F.coalesce(F.col("_text").cast("string"), F.lit("")), WHITE, " ").alias("_n"))
    equal = texts.groupBy("_n").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select(F.unhex(F.sha2("_n", 256)).alias("_sha"))
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row"))
    groups = again.groupBy("_sha").agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = groups.join(equal, "_sha", "left_semi").select("_sha", "group_size", F.col("_first._id").alias("keep_id"), F.col("_first._row").alias("_keep"))
    joined = join_groups(marks.select("_row", "_id", "_sha"), scratch.write(groups), ["_sha"], "group_size", total)
    single = F.col("group_size").isNull()
    rows = joined.select(
        "_row",
        F.col("_id").alias(id_col),
        F.when(single, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_row") == F.col("_keep"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
    return rows, scratch


@tidy()
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdicts of ``duplicate_groups``, as a table; intermediate tables are removed."""
    rows, scratch = duplicate_groups(docs, id_col, text_col)
    out = scratch.write(rows.drop("_row"))
    scratch.drop(keep=1)
    return out


@tidy()
def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without the later copies of a text; ids may be null or repeat."""
    own = Scratch(docs.sparkSession)
    rows = numbered(docs, own)
    verdicts, scratch = duplicate_groups(rows.select("_row", F.col(f"_doc.`{id_col}`").alias("_id"), F.col(f"_doc.`{text_col}`").alias("_text")), "_id", "_text", "_row")
    gone = own.write(verdicts.where(~F.col("kept")).select("_row"))
    out = own.write(without(rows, gone))
    scratch.drop()
    own.drop(keep=1)
    return out
