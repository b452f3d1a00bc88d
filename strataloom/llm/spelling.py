"""Groups of spelling variants: words that differ by one letter, found with bit-sliced indexes of positions.

Two words at one error share either the first half of the shorter one or its last half, so words meet by halves and
length. What meets is dealt into cells of a bounded size. In a cell the vocabulary is indexed by bits: for each
position and letter, a bit for every word that has the letter there. One pass over the positions of all words at once
keeps three sets of bits a word: those that agree so far (zero errors), those that differ in one place, and those that
run one letter ahead (one error, positions shifted by one).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Scratch, tidy

LETTERS = "[a-zÀ-ÿ]"
LEAST = 7
TIMES = 10
CELL = 4096
"""Rows that a cell holds on average, and in each of its two parts where one half has more words than that."""


def variants(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): every word of at least LEAST letters that occurs twice or more, and how often."""
    text = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{LEAST},}}"), F.lit(0))).alias("run"))
    rows = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    cut = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    rows = rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def entries(words: DataFrame) -> DataFrame:
    """Words by the halves at which they may meet others: as the shorter word of a pair (size: its length), and as the longer."""
    half = lambda size, first: F.struct(
        size.alias("size"), F.lit(first).alias("first"),
        F.xxhash64(size, F.lit(first), F.substring("word", F.lit(1), F.floor(size / 2).cast("int")) if first else F.substring("word", F.length("word") - size + F.floor(size / 2).cast("int") + 1, F.lit(1 << 30))).alias("half"),
    )
    own, shorter = F.length("word"), F.length("word") - 1
    found = words.select("word", "n", F.explode(F.array(*[half(s, first) for s in (own, shorter) for first in (True, False)])).alias("e"))
    return found.select("word", "n", "e.*").where(F.col("size") >= LEAST)


def bits_of(mask: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(mask, axis=-1, bitorder="little")
    return np.pad(packed, [(0, 0)] * (mask.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view("<u8")


def set_places(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every set bit."""
    row, word = np.nonzero(bits)
    k, bit = np.nonzero(np.unpackbits(bits[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[k], 64 * word[k] + bit


def one_error(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, letters) of words of ``size`` or ``size + 1`` letters: word i of ``size`` and word j at exactly one error,
    and the letters of all words as a matrix."""
    codes = np.frombuffer(b"".join(w.encode("latin-1").ljust(size + 1, b"\0") for w in words), np.uint8).reshape(-1, size + 1)
    long = codes[:, size] > 0
    short = np.flatnonzero(~long)
    asked = codes[short]

    def at(position: int):
        """The words with each letter at a position; the first row is for letters that no word has there."""
        letters = np.unique(codes[:, position])
        place = np.zeros(256, np.int64)
        place[letters] = np.arange(1, len(letters) + 1)
        place[0] = 0
        return place, bits_of(np.vstack([np.zeros((1, len(words)), bool), codes[:, position] == letters[:, None]]))

    zero = np.repeat(bits_of(np.ones((1, len(words)), bool)), len(short), axis=0)
    other, ahead = np.zeros_like(zero), np.zeros_like(zero)
    place, index = at(0)
    for k in range(size):
        here = index[place[asked[:, k]]]
        place, index = at(k + 1)
        ahead = (ahead | zero) & index[place[asked[:, k]]]  # a letter of the longer word is passed over before this one, or was before
        other = (other & here) | (zero & ~here)
        zero &= here
    found = (other & bits_of(~long)) | ((ahead | zero) & bits_of(long))
    row, j = set_places(found)
    return short[row], j, codes


def near_words(rows: pa.Table) -> pa.Table:
    """For each word of a cell with a near word here: how many, and the best of them. Every pair counts in one cell only:
    by first halves where those agree, else by last halves; where a half is dealt to several cells, where its parts meet."""
    words, n, piece = np.array(rows["word"].to_pylist(), object), rows["n"].to_numpy(), rows["piece"].to_numpy()
    kind, apart = 2 * rows["size"].to_numpy() + rows["first"].to_numpy(), rows["low"][0] != rows["high"][0]
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    found = [(np.empty(0, np.int64),) * 3]
    for k in np.unique(kind):
        own, size, first = np.flatnonzero(kind == k), int(k) // 2, k % 2 == 1
        i, j, codes = one_error(list(words[own]), size)
        keep = (codes[i, : size // 2] == codes[j, : size // 2]).all(axis=1) == first
        if apart:
            keep &= piece[own[i]] != piece[own[j]]
        i, j = i[keep], j[keep]
        back = codes[j, size] > 0  # pairs of one length are found from both ends, others from the shorter word
        i, j = own[np.concatenate([i, j[back]])], own[np.concatenate([j, i[back]])]
        i, j = (x[np.lexsort((rank[j], -n[j], i))] for x in (i, j))
        heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
        found.append((i[heads], np.diff(np.r_[heads, len(i)]), j[heads]))
    i, many, j = (np.concatenate(x) for x in zip(*found))
    return pa.table({"word": pa.array(words[i], pa.string()), "n_near": many, "less": -n[j], "near": pa.array(words[j], pa.string())})


def neighbours(words: DataFrame, scratch: Scratch, cell: int = CELL) -> DataFrame:
    """(word, n_near, best) of words with near words; best: (less, near), the negative count and the near word itself.

    A half with more than ``cell`` words is split into parts, and every two parts meet in a cell of their own; the
    other halves are dealt to cells by their hash. Halves with so many words are fewer than rows / cell.
    """
    rows = scratch.write(entries(words))
    large = scratch.write(rows.groupBy("half").agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > cell))
    cells = max(1, -(-rows.count() // cell))
    parts = F.ceil(F.col("_many") / cell)
    marked = rows.join(large, "half", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("word"), parts), F.lit(0)))
    few = marked.where("_many is null").select("word", "n", "size", "first", "piece", F.lit(False).alias("split"), F.pmod("half", F.lit(cells)).alias("cell"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    many = marked.where("_many is not null").select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("_other"))
    many = many.select("word", "n", "size", "first", "piece", F.lit(True).alias("split"), F.col("half").alias("cell"), F.least("piece", "_other").alias("low"), F.greatest("piece", "_other").alias("high"))
    met = few.unionByName(many).groupBy("split", "cell", "low", "high").applyInArrow(near_words, "word string, n_near long, less long, near string")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def followed(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of links (word, root): the last word that links lead to. Each round doubles the steps that a link spans."""
    links = scratch.write(links)
    while True:
        ends = links.select(F.col("word").alias("root"), F.col("root").alias("_end"))
        further = scratch.write(links.join(ends, "root", "left").select("word", F.coalesce("_end", "root").alias("root"), F.col("_end").isNotNull().alias("moved")))
        if further.where("moved").limit(1).count() == 0:
            return links
        links = further.drop("moved")


@tidy()
def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, cell: int = CELL) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is the near word that occurs most often (of equals the smallest), where that is ``times`` as often or
    more; counts rise along forms, so they lead to a last word. Of runs of letters, one in 31 (by the hash of id and
    run) is read with a letter left out; a missing id counts as an empty one. Null and empty texts have no words, rows
    that repeat count again, and other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(variants(docs, id_col, text_col))
    found: Column = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best.near"))
    rows = words.join(neighbours(words, scratch, cell), "word", "left").withColumn("form", found)
    rows = scratch.write(rows.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), -F.col("best.less")).alias("form_n")))
    roots = followed(rows.where("form is not null").select("word", F.col("form").alias("root")), scratch)
    out = rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = scratch.write(out)
    scratch.drop(keep=1)
    return out
