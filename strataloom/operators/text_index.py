"""A stored inverted index: postings in blocks by impact, of which a search reads the asked terms' and skips those too low.

A posting's impact is the term's whole part in a document's BM25 score, so a score is a sum of impacts. Stored is what a
document has in it; the term's weight, the other factor, follows from the number of its postings. A term's postings lie in
blocks of falling impact, each with its largest. The best block of every asked term gives k documents with at
least some score; a block whose largest impact and the other terms' largest together stay below it holds none of the k
best, and is not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.sources.shared import cut, drop

BLOCK = 128
BUCKETS = 64
"""Folders that terms are dealt to by hash; a search opens those of its terms."""
SATURATION, LENGTH_SHARE = 1.2, 0.75


def terms_of(text):
    return F.array_remove(F.split(F.lower(text), " "), "")


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(docs: DataFrame) -> DataFrame:
    """(doc, term, tf, len, head) of rows (doc, terms): how often each term occurs in a row, and how many terms the row has; head
    is 1 in one posting of each row."""

    def run(batches):
        for batch in batches:
            terms = batch.column(1)
            sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = terms.flatten().dictionary_encode()
            many = max(1, len(coded.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = key // many
            head = np.r_[True, row[1:] != row[:-1]].astype(np.int8) if len(row) else np.zeros(0, np.int8)
            columns = [batch.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(key % many)), pa.array(tf), pa.array(sizes[row]), pa.array(head)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "term", "tf", "len", "head"])

    return docs.select("doc", "terms").mapInArrow(run, f"doc {dict(docs.dtypes)['doc']}, term string, tf long, len long, head byte")


def in_blocks(placed: DataFrame) -> DataFrame:
    """(bucket, term, most, docs, parts, total): postings in order in blocks of BLOCK at most; a block ends where a batch of rows does."""
    size = BLOCK

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            term = batch.column(1).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if n else np.zeros(0, np.int64)
            at = np.arange(n) - np.repeat(begins, np.diff(np.r_[begins, n]))
            starts = np.flatnonzero(at % size == 0)
            heads, offsets = pa.array(starts), pa.array(np.r_[starts, n], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(k)) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(heads), batch.column(1).take(heads), batch.column(3).take(heads), *lists, batch.column(4).take(heads)], ["bucket", "term", "most", "docs", "parts", "total"])

    kind = dict(placed.dtypes)["doc"]
    return placed.select("bucket", "term", "doc", "part", "total").mapInArrow(run, f"bucket int, term string, most double, docs array<{kind}>, parts array<double>, total long")


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the index of texts to a folder. Rows without an id are left out; rows that repeat one are one document.

    Terms are counted in their row. A frequent term's postings are placed by a range sort over term and part, the only time
    that postings are shuffled, so they lie in many tasks, and blocks end where tasks do.
    """
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), terms_of(F.col(text_col)).alias("terms"))
    counts = cut(counted(given))
    again = cut(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"))
    rows, kept = counts.select("doc", "term", "tf", "len", "head"), [counts, again]
    if not again.isEmpty():
        more = counts.join(again, "doc", "left_semi").groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
        lengths = more.groupBy("doc").agg(F.sum("tf").alias("len"), F.min("term").alias("_one"))
        more = more.join(lengths, "doc").select("doc", "term", "tf", "len", (F.col("term") == F.col("_one")).cast("byte").alias("head"))
        rows = cut(counts.join(again, "doc", "left_anti").select("doc", "term", "tf", "len", "head").unionByName(more))
        kept.append(rows)
    stats = rows.agg(F.sum("head").alias("docs"), F.sum("tf").alias("terms")).first()
    mean = (stats["terms"] or 0) / (stats["docs"] or 1) or 1.0
    part = F.col("tf") * (SATURATION + 1) / (F.col("tf") + SATURATION * (1 - LENGTH_SHARE + LENGTH_SHARE * F.col("len") / F.lit(mean)))
    order = [F.col("bucket"), F.col("term"), F.desc("part"), F.col("doc")]
    placed = rows.select(bucket_of(F.col("term")).alias("bucket"), "term", "doc", part.alias("part")).repartitionByRange(*order).sortWithinPartitions(*order)
    in_blocks(placed.withColumn("total", F.lit(stats["docs"] or 0).cast("long"))).write.partitionBy("bucket").mode("overwrite").parquet(path)
    drop(*kept)


def weighed(stored: DataFrame, of: DataFrame) -> DataFrame:
    """Blocks (term, most, docs, impacts) of stored blocks: their parts times the term's weight by how many documents have it (``of``: term, weight)."""
    rows = stored.join(F.broadcast(of), "term")  # a row an asked term
    return rows.select("term", (F.col("weight") * F.col("most")).alias("most"), "docs", F.transform("parts", lambda x: F.col("weight") * x).alias("impacts"))


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, score, rank): the k best documents by BM25 of each query's terms (query_id, term), the smaller id first.

    Queries come in batches whose distinct terms the driver can name in a filter. With k above BLOCK nothing is skipped.
    """
    asked = cut(queries.select("query_id", F.lower("term").alias("term")).distinct())
    named = asked.select("term", bucket_of(F.col("term")).alias("bucket")).distinct().collect()
    stored = spark.read.parquet(path).where(F.col("bucket").isin(sorted({r["bucket"] for r in named})) & F.col("term").isin([r["term"] for r in named]))
    df = stored.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max("total").alias("total"))
    weights = cut(df.select("term", F.ln(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight")))
    blocks = weighed(stored, weights)
    heads = cut(blocks.groupBy("term").agg(F.max("most").alias("top"), F.max_by(F.struct("docs", "impacts"), F.struct("most", F.size("docs"))).alias("first")))
    sums = heads.join(asked, "term").select("query_id", F.explode(F.arrays_zip("first.docs", "first.impacts")).alias("p"))
    sums = sums.groupBy("query_id", "p.docs").agg(F.sum("p.impacts").alias("sum"))
    kth = sums.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sum")))).where(F.col("r") == k).select("query_id", F.col("sum").alias("least"))
    whole = asked.join(heads.select("term", "top"), "term")
    bound = whole.join(whole.groupBy("query_id").agg(F.sum("top").alias("all")), "query_id").join(kth, "query_id", "left")
    bound = cut(bound.select("query_id", "term", F.coalesce(F.col("least") - (F.col("all") - F.col("top")), F.lit(0.0)).alias("least")))
    floors = bound.groupBy("term").agg(F.min("least").alias("least")).collect()  # a row a term
    scale = {r["term"]: r["weight"] for r in weights.collect()}
    reached = reduce(or_, [(F.col("term") == r["term"]) & (F.col("most") >= F.lit((r["least"] - 1e-9) / scale[r["term"]])) for r in floors], F.lit(False))
    kept = weighed(stored.where(reached), weights).join(bound, "term").where(F.col("most") >= F.col("least") - 1e-9)
    found = kept.select("query_id", F.explode(F.arrays_zip("docs", "impacts")).alias("p")).groupBy("query_id", F.col("p.docs").alias("doc")).agg(F.round(F.sum("p.impacts"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
