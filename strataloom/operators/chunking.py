"""Chunking operators: packing of units, boundaries, sections, tables and chats."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from strataloom.functions import score as S
from strataloom.functions import text as X
from strataloom.functions import vector as V
from strataloom.sources.files import file_messages, file_rows, format_of

# Weights of the boundary signals.
SIGNALS = {"semantic": 0.30, "discourse": 0.20, "entities": 0.25, "structure": 0.15, "mode": 0.10}


def pack(units: Column, most: int, joiner: str = " ") -> Column:
    """Greedy groups of units, joined. A unit opens a new group if the group's length would exceed ``most``; every
    unit but the first of a later group is charged with the joiner."""
    unit = F.filter(F.transform(units, X.strip), lambda u: u != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("size"))
    cost = len(joiner)

    def step(s: Column, u: Column) -> Column:
        full = s["held"].isNotNull() & (s["size"] + F.length(u) + cost > most)
        joined = F.when(s["held"].isNull(), u).otherwise(F.concat(s["held"], F.lit(joiner), u))
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"]).alias("done"),
            F.when(full, u).otherwise(joined).alias("held"),
            F.when(full, F.length(u)).otherwise(s["size"] + F.length(u) + cost).alias("size"),
        )

    return F.aggregate(unit, state, step, lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))


def merge_short(parts: Column, least: int, most: int) -> Column:
    """Parts of fewer than ``least`` characters join the one before, unless both have 2 * most or more."""

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.length(p) < least) & (F.length(last) + F.length(p) < 2 * most)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), p)))).otherwise(F.concat(done, F.array(p)))

    return F.when(F.size(parts) > 0, F.aggregate(parts, F.array().cast("array<string>"), step)).otherwise(parts)


def boundary_scores(sentences: DataFrame, key: str, pos: str, text: str, vec: str | None = None, entities: str | None = None) -> DataFrame:
    """Adds ``boundary``: the weighted signals between a sentence and the one before it in the same ``key``."""
    w = Window.partitionBy(key).orderBy(pos)
    body, before = F.col(text), F.lag(text).over(w)
    total = SIGNALS["discourse"] * X.discourse(body).cast("double") + SIGNALS["structure"] * X.structural(body).cast("double")
    total = total + SIGNALS["mode"] * F.coalesce(X.mode(body) != F.lag(X.mode(body)).over(w), F.lit(False)).cast("double")
    if vec:
        drop = 1 - V.cosine(F.lag(vec).over(w), F.col(vec))
        total = total + SIGNALS["semantic"] * F.when(before.isNotNull(), drop).otherwise(0.0)
    if entities:
        total = total + SIGNALS["entities"] * F.when(before.isNotNull(), V.jaccard_distance(F.lag(entities).over(w), F.col(entities))).otherwise(0.0)
    return sentences.withColumn("boundary", total)


def folded(units: Column, most: Column) -> Column:
    """Units (t, cut) joined into paragraphs, a new one at a cut or where the lengths would exceed ``most``."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("size"))

    def step(s: Column, u: Column) -> Column:
        fresh = s["held"].isNotNull() & (u["cut"] | (s["size"] + F.length(u["t"]) > most))
        return F.struct(
            F.when(fresh, F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"]).alias("done"),
            F.when(fresh | s["held"].isNull(), u["t"]).otherwise(F.concat(s["held"], F.lit(" "), u["t"])).alias("held"),
            F.when(fresh, F.length(u["t"])).otherwise(s["size"] + F.length(u["t"])).alias("size"),
        )

    return F.aggregate(units, empty, step, lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))


def group_at(rows: DataFrame, key: str, pos: str, text: str, score: str, threshold: Column, most: Column) -> DataFrame:
    """(key, k, chunk): sentences joined into paragraphs, a new one where ``score`` exceeds the threshold or the lengths would
    exceed ``most``. A document's sentences are folded in order; documents are bounded, their number is not."""
    unit = F.struct(F.col(pos).alias("p"), F.col(text).alias("t"), (F.col(score) > threshold).alias("cut"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(unit)).alias("u"), F.first(most).alias("most"))
    return grouped.select(key, F.posexplode(folded(F.col("u"), F.col("most"))).alias("k", "chunk"))


def topic_chunks(rows: DataFrame, key: str, pos: str, text: str, vec: str, least: float = 0.55, most: int = 800) -> DataFrame:
    """(key, k, chunk): a new paragraph where the cosine to the sentence before is below ``least`` or it would grow too long."""
    drop = 1 - V.cosine(F.lag(vec).over(Window.partitionBy(key).orderBy(pos)), F.col(vec))
    return group_at(rows.withColumn("_drop", F.coalesce(drop, F.lit(0.0))), key, pos, text, "_drop", F.lit(1 - least), F.lit(most))


DIMENSIONS = 64


def slots_of(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A text's words, in lower case, as places by hash."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))


def bag_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of a text's words by hash, in lower case: texts with words in common are near each other."""
    held = lambda x: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (F.size(x) - F.size(F.array_remove(x, i))).cast("double"))
    return F.get(F.transform(F.array(slots_of(text, dimensions)), held), F.lit(0))  # the slots are hashed once


BAGS = 4096
"""Texts, or those of one row, whose counts are held at once."""


@F.pandas_udf(ArrayType(DoubleType()))
def bag_cosines(slots: pd.Series) -> pd.Series:
    """For each text of a row (places of its words) the cosine of its counts with those of the text before; 0 for the first."""
    out, at = [], 0
    many = slots.map(len).to_numpy()
    while at < len(slots):
        upto = at + max(1, int(np.searchsorted(np.cumsum(many[at:]), BAGS, "right")))
        texts = [t for row in slots.iloc[at:upto] for t in row]
        own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = np.concatenate([*texts, np.zeros(0)]).astype(np.int64)
        counts = np.bincount(own * DIMENSIONS + flat, minlength=len(texts) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1))
        dot, size = (counts[1:] * counts[:-1]).sum(axis=1), norm[1:] * norm[:-1]
        cosine = np.concatenate([np.zeros(min(1, len(texts))), np.divide(dot, size, out=np.zeros(len(dot)), where=size > 0)])
        ends = np.cumsum(many[at:upto])
        cosine[(ends - many[at:upto])[many[at:upto] > 0]] = 0.0
        out += np.split(cosine, ends[:-1])
        at = upto
    return pd.Series(out)


def signal_chunks(docs: DataFrame, key: str, text: str, name: str, vector: Callable[[Column], Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, k, chunk) by all five boundary signals of sentences; threshold and size follow the document's type.

    ``vector`` gives a sentence's vector from its text, which is compared with that of the sentence before; without it the
    hashed words (``bag_vector``) are. A document's sentences stay in its row: each is looked at once, and nothing is
    shuffled. Columns in ``keep`` come along.
    """
    kind = X.doc_type(F.col(text), F.coalesce(F.col(name), F.lit("")))
    sizes = {k: v[0] for k, v in X.TYPE_SIZES.items()}
    cuts = {k: v[1] for k, v in X.TYPE_SIZES.items()}
    rows = docs.select(key, *keep, kind.alias("_kind"), F.coalesce(X.sentences(F.col(text)), F.array().cast("array<string>")).alias("_said"))
    size, least = S.from_table(F.col("_kind"), sizes, 800).alias("_most"), S.from_table(F.col("_kind"), cuts, 0.55).alias("_cut")
    each = lambda use: F.transform("_said", use)
    if vector is None:
        rows = rows.withColumn("_near", bag_cosines(each(lambda t: slots_of(t))))
    else:
        rows = rows.withColumn("_vectors", each(lambda t: vector(t)))
        rows = rows.withColumn("_near", F.transform("_vectors", lambda v, i: F.when(i > 0, V.cosine(F.get("_vectors", i - 1), v)))).drop("_vectors")
    fixed = lambda t: SIGNALS["discourse"] * X.discourse(t).cast("double") + SIGNALS["structure"] * X.structural_bare(t).cast("double")
    seen = lambda t: F.struct(t.alias("t"), fixed(t).alias("fixed"), X.mode(t).alias("mode"), F.transform(X.title_entities(t), lambda e: F.lower(e)).alias("names"))
    rows = rows.select(key, *keep, size, least, "_near", each(seen).alias("_seen"))

    def unit(u: Column, i: Column) -> Column:
        before = F.get("_seen", i - 1)  # null for the first
        total = u["fixed"] + SIGNALS["mode"] * F.coalesce(u["mode"] != before["mode"], F.lit(False)).cast("double")
        total = total + SIGNALS["semantic"] * F.when(i > 0, 1 - F.get("_near", i)).otherwise(0.0)
        total = total + SIGNALS["entities"] * F.when(i > 0, V.jaccard_distance(before["names"], u["names"])).otherwise(0.0)
        return F.struct(u["t"].alias("t"), (total > F.col("_cut")).alias("cut"))

    rows = rows.select(key, *keep, "_most", F.transform("_seen", unit).alias("_units"))
    return rows.select(key, *keep, F.posexplode(folded(F.col("_units"), F.col("_most"))).alias("k", "chunk"))


def sections(paragraphs: Column, most: int) -> Column:
    """Array of sections, each an array of paragraphs: a new one where a paragraph would take it beyond ``most`` characters."""
    parts = F.filter(F.transform(paragraphs, X.strip), lambda p: p != "")
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("held"), F.lit(0).alias("size"))

    def step(s: Column, p: Column) -> Column:
        full = (F.size(s["held"]) > 0) & (s["size"] + F.length(p) > most)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(s["held"], F.array(p))).alias("held"),
            F.when(full, F.length(p)).otherwise(s["size"] + F.length(p)).alias("size"),
        )

    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"]))


CHUNKERS: dict = {}
"""Chunkers of further formats, registered by the user: format to a function of (doc_id, name, text) rows that returns
(doc_id, k, chunk)."""


def csv_chunks(files: DataFrame, per_chunk: int = 20) -> DataFrame:
    """(doc_id, k, chunk) of tables in text (doc_id, name, text): groups of rows as markdown, the header repeated in each."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rows = file_rows(files).select("doc_id", F.floor(F.col("k") / per_chunk).cast("int").alias("g"), "k", line(F.col("cells")).alias("line"), F.when(F.col("k") % per_chunk == 0, F.col("header")).alias("header"))
    grouped = rows.groupBy("doc_id", "g").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("k", "line"))).getField("line").alias("lines"))
    title = F.concat(F.lit("[Sheet: Sheet1, rows "), (F.col("a") + 1).cast("string"), F.lit("-"), (F.col("b") + 1).cast("string"), F.lit("]"))
    head = F.when(F.size("header") > 0, F.concat(line(F.col("header")), F.lit("\n"), line(F.transform("header", lambda _: F.lit("---")))))
    return grouped.select("doc_id", F.col("g").alias("k"), F.concat_ws("\n", title, head, F.array_join("lines", "\n")).alias("chunk"))


def message_chunks(files: DataFrame, size: int = 2) -> DataFrame:
    """(doc_id, k, chunk) of chat exports (doc_id, text): windows of messages of a thread by time, which do not overlap;
    threads in the order of their first message, messages of one time in the order of the file."""
    thread = Window.partitionBy("doc_id", "thread_id")
    stamp = F.when(F.col("timestamp") != "", F.concat(F.lit("["), "timestamp", F.lit("] "))).otherwise("")
    rows = file_messages(files).withColumn("w", F.floor((F.row_number().over(thread.orderBy("timestamp", "pos")) - 1) / size)).withColumn("start", F.min("pos").over(thread))
    rows = rows.withColumn("line", F.struct("timestamp", "pos", F.concat(stamp, "role", F.lit(": "), "content").alias("line")))
    grouped = rows.groupBy("doc_id", "start", "w").agg(F.array_join(F.array_sort(F.collect_list("line")).getField("line"), "\n").alias("chunk"))
    return grouped.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "w")) - 1).alias("k"), "chunk")


def dispatch(files: DataFrame, structured: bool = False) -> DataFrame:
    """(doc_id, format, k, chunk) of (doc_id, name, text): each format by its own chunker; texts by boundary signals.

    With ``structured`` tables become groups of rows with their header, and chat exports windows of messages; otherwise
    both are packed by lines. A file without rows or messages then has no chunks.
    """
    typed = files.withColumn("format", F.coalesce(format_of(F.col("name"), F.substring("text", 1, 2048)), F.lit("txt"))).withColumn("text", F.coalesce("text", F.lit("")))
    whole = lambda rows: rows.select("doc_id", "format", F.posexplode(merge_short(pack(X.sentences(F.col("text")), 800), 80, 800)).alias("k", "chunk"))
    chat = lambda rows: rows.select("doc_id", F.posexplode(pack(F.split("text", "\n"), 800, "\n")).alias("k", "chunk"))
    own = {"chat": chat, "email": chat, "csv": chat, **({"chat": message_chunks, "csv": csv_chunks} if structured else {}), **CHUNKERS}
    signal = ("md", "txt", "html")
    out = signal_chunks(typed.where(F.col("format").isin(*signal)), "doc_id", "text", "name", keep=("format",))
    for kind, chunker in own.items():
        out = out.unionByName(chunker(typed.where(F.col("format") == kind)).select("doc_id", F.lit(kind).alias("format"), "k", "chunk"))
    return out.unionByName(whole(typed.where(~F.col("format").isin(*signal, *own))))


def table_chunks(rows: DataFrame, sheet: str, key: str, columns: list[str], per_chunk: int = 20, count: str = "sheet") -> DataFrame:
    """Groups of rows of a sheet as markdown with the header repeated: sheet, chunk, text."""
    number = F.row_number().over(Window.partitionBy(sheet).orderBy(key))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    parts = rows.select(F.col(sheet).alias("sheet"), number.alias("k"), line.alias("line")).withColumn("chunk", F.floor((F.col("k") - 1) / per_chunk))
    grouped = parts.groupBy("sheet", "chunk").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.array_sort(F.collect_list(F.struct("k", "line"))).getField("line").alias("lines"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    title = F.concat(F.lit("[Sheet: "), F.col("sheet").cast("string"), F.lit(", rows "), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit("]\n"))
    return grouped.select("sheet", "chunk", F.concat(title, F.lit(head), F.array_join("lines", "\n")).alias("text"))


def chat_windows(messages: DataFrame, thread: str, order: str, role: str, text: str, size: int = 2) -> DataFrame:
    """Windows of consecutive messages that do not overlap: thread, window, text and number of speakers."""
    number = F.row_number().over(Window.partitionBy(thread).orderBy(order))
    rows = messages.select(F.col(thread).alias("thread"), number.alias("k"), F.col(role).alias("role"), F.concat(F.lit("["), F.col(order), F.lit("] "), F.col(role), F.lit(": "), F.col(text)).alias("line"))
    rows = rows.withColumn("window", F.floor((F.col("k") - 1) / size))
    grouped = rows.groupBy("thread", "window").agg(F.countDistinct("role").alias("speakers"), F.array_sort(F.collect_list(F.struct("k", "line"))).getField("line").alias("lines"))
    return grouped.select("thread", "window", "speakers", F.array_join("lines", "\n").alias("text"))


def thread_summaries(messages: DataFrame, thread: str, order: str, text: str) -> DataFrame:
    """Messages, first and last order value, and the first three messages, 200 characters each."""
    number = F.row_number().over(Window.partitionBy(thread).orderBy(order))
    rows = messages.select(F.col(thread).alias("thread"), F.col(order).alias("o"), number.alias("k"), F.substring(text, 1, 200).alias("head"))
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "head")))).getField("head"), "\n")
    return rows.groupBy("thread").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first"), F.max("o").alias("last"), first.alias("summary"))
