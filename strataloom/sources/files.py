"""Sources and sinks: format detection, file scans, message forms, idempotent writes, exports."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.sources.shared import cut, delete, exists

# File name extensions of the supported formats.
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "xlsx": "xlsx", "xls": "xlsx", "xlsm": "xlsx", "csv": "csv", "tsv": "csv", "md": "md", "markdown": "md",
    "txt": "txt", "text": "txt", "log": "txt", "html": "html", "htm": "html", "json": "chat", "jsonl": "chat", "eml": "email", "msg": "email",
}

ROWS_PER_BATCH = 1000

PARSERS: dict[str, Callable[[bytes], list[str]]] = {}
"""Parsers of binary formats by format name, registered by the user: bytes to page or section texts."""


def format_of(path: Column, head: Column | None = None) -> Column:
    """Format by extension, else by the first bytes, else txt."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("txt")
    if head is not None:
        text = head.cast("string")
        out = (
            F.when(text.startswith("%PDF"), "pdf")
            .when(text.startswith("PK") & text.contains("word/"), "docx")
            .when(text.startswith("PK") & text.contains("xl/"), "xlsx")
            .when(F.lower(text).rlike(r"^\s*(<!doctype html|<html)"), "html")
            .when(text.rlike(r"^\s*\["), "chat")
            .otherwise(out)
        )
    for name in sorted(EXTENSIONS):
        out = F.when(extension == name, F.lit(EXTENSIONS[name])).otherwise(out)
    return out


def read_corpus(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, doc_id, format, content of all files below a folder; ids are hashes of the content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    doc_id = F.concat(F.lit("doc_"), F.substring(F.sha2("content", 256), 1, 16))
    return rows.select("path", "length", doc_id.alias("doc_id"), format_of(F.col("path"), F.substring("content", 1, 2048)).alias("format"), "content")


def parse_pages(files: DataFrame) -> DataFrame:
    """doc_id, page, text of files whose format has a registered parser; a file that a parser rejects has no pages."""
    parsers = dict(PARSERS)

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, kind, content in zip(pdf["doc_id"], pdf["format"], pdf["content"]):
                try:
                    pages = parsers[kind](content) if kind in parsers else []
                except Exception:  # whatever a user's parser makes of a broken file, the other files go on
                    pages = []
                rows += [(doc, k, page) for k, page in enumerate(pages)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return files.select("doc_id", "format", "content").mapInPandas(run, "doc_id string, page int, text string")


def page_at(offsets: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds the last page whose start is not after the offset; both have doc_id."""
    found = offsets.join(starts.select("doc_id", "page", "start"), "doc_id", "left").where(F.col("start").isNull() | (F.col("start") <= F.col("offset")))
    return found.groupBy("doc_id", "offset").agg(F.max_by("page", "start").alias("page"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    return rows.toDF(*[c.strip() or f"col_{k}" for k, c in enumerate(rows.columns)])


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Chat messages from a JSON array or from lines of JSON; lines that are no objects are dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    items = F.when(F.col("v").startswith("["), F.from_json("v", "array<map<string,string>>")).otherwise(F.transform(F.split("v", "\n"), lambda x: F.from_json(x, "map<string,string>")))
    return messages(lines.select(F.explode(items).alias("m")).where(F.col("m").isNotNull() & (F.size("m") > 0)), lambda k: F.element_at(F.col("m"), k))


def messages(rows: DataFrame, field: Callable[[str], Column], keep: list[str] = ()) -> DataFrame:
    """role, content, timestamp, thread_id from the names that chat exports use; empty counts as missing."""
    first = lambda names, other: F.coalesce(*[F.nullif(field(n), F.lit("")) for n in names], F.lit(other))
    return rows.select(
        *keep, first(("role", "from", "speaker"), "user").alias("role"), first(("content", "text", "message"), "").alias("content"),
        first(("timestamp", "ts", "date"), "").alias("timestamp"), first(("thread_id", "conversation_id"), "default").alias("thread_id"),
    )


def file_messages(files: DataFrame) -> DataFrame:
    """(doc_id, pos, role, content, timestamp, thread_id) of chat exports (doc_id, text): a JSON array of objects, or lines
    of JSON; whatever is no object is left out, and a text without any has no rows."""
    many = F.filter(F.from_json("_t", "array<map<string,string>>"), lambda m: m.isNotNull())
    lines = F.filter(F.transform(F.split("_t", "\\r?\\n"), lambda x: F.from_json(x, "map<string,string>")), lambda m: m.isNotNull() & (F.size(m) > 0))
    items = F.when(F.col("_t").startswith("[") & (F.size(many) > 0), many).otherwise(lines)
    found = files.withColumn("_t", F.trim("text")).select("doc_id", F.posexplode(items).alias("pos", "m"))
    return messages(found, lambda k: F.element_at(F.col("m"), k), ["doc_id", "pos"])


def file_rows(files: DataFrame) -> DataFrame:
    """(doc_id, k, header, cells) of tables in text (doc_id, name, text): rows from 0 after the header.

    Quoted cells may hold separators and line ends and be of any length; a name that ends in tsv separates by tabs. A
    blank line is a row without cells. A null text, and one without rows after its header, has no rows here.
    """
    key = files.schema["doc_id"].dataType.simpleString()

    def run(batches):
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            for doc, name, text in zip(batch["doc_id"].to_pylist(), batch["name"].to_pylist(), batch["text"].to_pylist()):
                rows = csv.reader(io.StringIO(text or "", newline=""), delimiter="\t" if (name or "").lower().endswith("tsv") else ",")
                header = [h.strip() for h in next(rows, [])]
                done = 0
                while part := list(islice(rows, ROWS_PER_BATCH)):
                    ks, done = range(done, done + len(part)), done + len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(part), type=batch.schema.field("doc_id").type), pa.array(ks, type=pa.int64()), pa.array([header] * len(part), type=texts), pa.array(part, type=texts)], ["doc_id", "k", "header", "cells"])

    texts = pa.list_(pa.string())
    return files.select("doc_id", "name", "text").mapInArrow(run, f"doc_id {key}, k long, header array<string>, cells array<string>")


def size_sample(files: DataFrame, step: int, order: list[str] = ("length", "path"), group: str | None = None) -> DataFrame:
    """Every step-th row, from the first, in order of size (and then a unique column): a sample over all sizes, in each group.

    Rows are placed by one range sort, so neither all rows nor a large group meet in one task: only the counts of ranges do.
    """
    key = F.col(group) if group else F.lit(0)
    ranged = files.withColumn("_g", key).repartitionByRange("_g", *order).sortWithinPartitions("_g", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(ranged.withColumn("_pid", F.shiftright("_at", 33)))
    spans = placed.groupBy("_g", "_pid").agg(F.count(F.lit(1)).alias("_m"), F.min("_at").alias("_from"))
    before = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_skip", F.coalesce(F.sum("_m").over(before), F.lit(0)) - F.col("_from")).select(F.col("_g").alias("_h"), F.col("_pid").alias("_q"), "_skip")
    both = placed.join(spans, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_pid") == F.col("_q")))
    return both.where((F.col("_at") + F.col("_skip")) % step == 0).select(*files.columns)


def not_done(files: DataFrame, report: DataFrame, key: str = "path") -> DataFrame:
    return files.join(report.where("status = 'success'").select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: list[str] = ()) -> DataFrame:
    """Rows by key, new ones replacing old; listed columns keep an old value where the new one is null."""
    o, n = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_o")), new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_n"))
    both = o.join(n, keys, "full")
    pick = lambda c: F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")) if c in keep_old_if_null else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


def write_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that ``rows`` has, and no others; a repeated run leaves the same files' rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def put_documents(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Replaces the documents that ``rows`` has, with all rows they had before, and keeps the others.

    The table is partitioned by a hash of the document, so a put rewrites the buckets it touches and a repeated put
    changes nothing.
    """
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if exists(rows.sparkSession, path):
        old = rows.sparkSession.read.parquet(path).join(new.select("bucket").distinct(), "bucket", "left_semi")
        new = new.unionByName(old.join(rows.select(key).distinct(), key, "left_anti").select(*new.columns))
    cut(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def delete_documents(spark: SparkSession, path: str, ids: DataFrame, key: str, buckets: int = 64) -> None:
    """Removes documents (a column ``key``) from a table that ``put_documents`` wrote; a bucket left empty becomes an empty file."""
    gone = ids.select(key).distinct().withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    table = spark.read.parquet(path)
    touched = table.join(gone.select("bucket").distinct(), "bucket", "left_semi")
    kept = cut(touched.join(gone.select(key), key, "left_anti"))
    emptied = [r["bucket"] for r in gone.select("bucket").distinct().join(kept.select("bucket").distinct(), "bucket", "left_anti").collect()]  # ``buckets`` at most
    kept.select(*table.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in emptied:
        delete(spark, f"{path}/bucket={bucket}")


def filled_views(rows: DataFrame, views: list[str], dense: str = "dense") -> DataFrame:
    """Missing view vectors become copies of the dense one; rows without any vector go."""
    found = rows.withColumn("_any", F.coalesce(dense, *views)).where(F.col("_any").isNotNull())
    return found.withColumns({v: F.coalesce(v, dense, "_any") for v in [dense, *views]}).drop("_any")


def put_view(rows: DataFrame, path: str, view: str) -> None:
    """Writes one view of a table partitioned by view; the others stay."""
    rows.withColumn("view", F.lit(view)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("view").parquet(path)


def sweep_orphans(entities: DataFrame, contains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities that some chunk contains, how many others there were)."""
    used = contains.select("entity_id").distinct()
    return entities.join(used, "entity_id", "left_semi"), entities.join(used, "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("removed"))


def write_report(items: DataFrame, totals: DataFrame, path: str) -> None:
    """Items and aggregates of a run as JSON lines, replacing an earlier report."""
    items.write.mode("overwrite").json(f"{path}/items")
    totals.write.mode("overwrite").json(f"{path}/totals")


def dataset_items(content: Column) -> Column:
    """Array of question rows (string maps) of a JSON text: a list, an object with samples, questions or prompts, or one row."""
    many, one = "array<map<string,string>>", "map<string,string>"
    held = F.from_json(content, f"struct<samples: {many}, questions: {many}, prompts: {many}>")
    inside = F.coalesce(held["samples"], held["questions"], held["prompts"])
    return F.when(F.trim(content).startswith("["), F.from_json(content, many)).otherwise(F.coalesce(inside, F.array(F.from_json(content, one))))


def question_of(item: Column) -> Column:
    return F.coalesce(*[F.element_at(item, k) for k in ("question", "user_input", "query", "prompt")])


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(question, item) of evaluation files."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(dataset_items(F.col("value"))).alias("item"))
    return rows.select(question_of(F.col("item")).alias("question"), "item")


def export_json(rows: DataFrame, path: str, tenant: Column | None = None) -> None:
    (rows if tenant is None else rows.where(tenant)).write.mode("overwrite").json(path)
