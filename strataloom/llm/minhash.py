"""Near-duplicate documents by one-permutation MinHash with optimal densification.

One hash per word shingle fills all bins of a signature; an empty bin copies a full one along a fixed random
sequence. Signatures are cut into bands, and documents with an equal band share a bucket. A bucket proposes stars:
one member against the others. Every proposed edge is confirmed on the full shingle sets. Then members outside a bucket's
largest component are centers as well, so that a link between two texts of which neither is the first center is found;
those stars are compared block by block, without a row per pair. The members of buckets with very many of them (unrelated
texts that share a passage) are dealt anew by the rarest shingles of their full sets first, of which every two texts
that are to be linked share one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Scratch, components, join_groups, join_present, numbered, sieve, tidy, without

SHINGLE = 5
LINK_PERCENT = 85
BANDS = 24
BAND_ROWS = 6
"""A pair at the limit shares a band with probability 1 - (1 - 0.85^6)^24, which is more than 0.99998."""
BINS = BANDS * BAND_ROWS
MISSED = 1.2e-5
MOST_BINS = 160
"""Other limits take the most rows a band, BAND_ROWS at most, at which a pair at the limit shares none of at most MOST_BINS
bins' bands with probability MISSED at most."""
CHUNK = 256
"""Members and centers of a bucket that one block compares."""
BLOCK_PAIRS = 1 << 20
"""The members of buckets whose stars would make more comparisons than this are dealt anew by their rarest shingles."""
COMMON = 1 << 14
"""Shingles whose frequency is known where the rarest are taken. Any order of the shingles is exact; this one saves work."""
SMALL_GROUP = 16
"""A group of texts with a rare shingle in common that has no more members makes a row per pair, so at most 15 a member."""
STAR_ROWS = 1024
"""Edges of a star that one task confirms; a larger star is dealt to several, each with a copy of the center's text."""
CHUNK_BYTES = 1 << 19

_U = np.uint64
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Shingler:
    """Shingle hashes of many texts at once; powers are kept for the life of one task."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << (n - 1).bit_length()
            out = []
            for base in (_BASE, _INVERSE):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                out.append(np.cumprod(row, dtype=np.uint64))
            self.power, self.inverse = out

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each word, in order; long data goes through in parts cut at white space."""
        starts, hashes, at = [], [], 0
        while at < len(data):
            end = at + CHUNK_BYTES
            raw = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
            blank = _BLANK[raw]
            while end < len(data) and not blank.any():  # a word longer than a part
                end += CHUNK_BYTES
                raw = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
                blank = _BLANK[raw]
            if end < len(data):
                cut = len(raw) - int(np.argmax(blank[::-1]))
                raw, blank = raw[:cut], blank[:cut]
            edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
            a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            if len(a):
                self._powers(len(raw) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + _U(1)) * self.power[: len(raw)], dtype=np.uint64)])
                starts.append(a + at)
                hashes.append(mix((total[b] - total[a]) * self.inverse[a]))
            at += len(raw)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(hashes)

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ends): distinct shingle hashes of each text, sorted within it, and where each text's end."""
        parts = [(t or "").encode("utf-8", "replace").lower() for t in texts]  # bytes.lower() changes A-Z alone
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
        starts, word = self.words(b" ".join(parts))
        first = np.searchsorted(starts, offsets)
        count = np.diff(first)
        spans = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))
        ends = np.cumsum(spans)
        text_of = np.repeat(np.arange(len(parts)), spans)
        at = first[text_of] + np.arange(ends[-1] if len(ends) else 0) - (ends - spans)[text_of]
        size = np.minimum(count[text_of], SHINGLE)
        total = size.astype(np.uint64) * _FACTORS[SHINGLE]
        for k in range(SHINGLE):
            here = size > k
            total[here] += word[at[here] + k] * _FACTORS[k]
        total = mix(total)
        for a, b in zip(ends - spans, ends):
            total[a:b].sort()
        new = np.ones(len(total), bool)
        new[1:] = (total[1:] != total[:-1]) | (text_of[1:] != text_of[:-1])
        return total[new], np.cumsum(np.bincount(text_of[new], minlength=len(parts)))


def layout(link_percent: int) -> tuple[int, int]:
    """(bands, rows a band) for a limit; BANDS and BAND_ROWS at LINK_PERCENT."""
    for rows in range(BAND_ROWS, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log(1 - min(link_percent / 100, 0.999) ** rows))
        if bands * rows <= MOST_BINS:
            break
    return bands, rows


def signatures(hashes: np.ndarray, ends: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(texts x bins) least hashes per bin, with empty bins of a text that has shingles densified."""
    n = len(ends)
    size = np.diff(ends, prepend=0)
    text_of = np.repeat(np.arange(n), size)
    slot = text_of * bins + (((hashes >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
    new = np.ones(len(slot), bool)
    new[1:] = slot[1:] != slot[:-1]  # hashes are sorted, so the first of a bin is its least
    out, full = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    out[slot[new]], full[slot[new]] = hashes[new], True
    empty = np.flatnonzero(~full & np.repeat(size > 0, bins))
    base, bin_of, attempt = empty - empty % bins, (empty % bins).astype(np.uint64), 0
    while len(empty):
        attempt += 1
        pick = base + (((mix(bin_of * _FACTORS[0] + _U(attempt * int(_FACTORS[1]) % (1 << 64))) >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
        hit = full[pick]
        out[empty[hit]] = out[pick[hit]]
        empty, base, bin_of = empty[~hit], base[~hit], bin_of[~hit]
    return out.reshape(n, bins)


def _batches(texts: list[str | None], most: int = CHUNK_BYTES):
    """Slices of at most about ``most`` characters, one text at least."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= most):
            chars += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def sketch(texts: DataFrame, link_percent: int = LINK_PERCENT) -> DataFrame:
    """_row, _id, _n (distinct shingles), _s1 and _s2 (fingerprint of the set), _bands (bucket keys) of each row."""
    n_bands, n_rows = layout(link_percent)

    def run(batches):
        shingler = Shingler()
        order = np.arange(n_bands, dtype=np.uint64)
        for batch in (part.slice(a, 512) for part in batches for a in range(0, part.num_rows, 512)):
            own = batch.column(2).to_pylist()
            for a, b in _batches(own):
                hashes, ends = shingler.sets(own[a:b])
                size = np.diff(ends, prepend=0)
                bands = signatures(hashes, ends, n_bands * n_rows).reshape(b - a, n_bands, n_rows)
                keys = mix((bands * _FACTORS[:n_rows]).sum(axis=2, dtype=np.uint64) + order * _FACTORS[5])
                prints = []
                for values in (hashes, mix(hashes ^ _FACTORS[2])):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
                    prints.append(pa.array((total[ends] - total[ends - size]).view(np.int64)))
                full = size > 0
                where = np.concatenate([[0], np.cumsum(np.where(full, n_bands, 0))])
                lists = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(keys[full].ravel().view(np.int64)))
                names = [batch.column(k).slice(a, b - a) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(size, pa.int64()), *prints, lists], ["_row", "_id", "_n", "_s1", "_s2", "_bands"])

    kind = dict(texts.dtypes)["_id"]
    return texts.select("_row", "_id", "_text").mapInArrow(run, f"_row long, _id {kind}, _n long, _s1 long, _s2 long, _bands array<long>")


def confirm(edges: DataFrame, texts: DataFrame, link_percent: int = LINK_PERCENT) -> DataFrame:
    """The edges (a, b) whose full shingle sets are similar enough; ``texts`` has _row and _text, ``edges`` is a written table."""

    def run(batches):
        shingler, last, kept = Shingler(), None, None
        for batch in (part.slice(a, 256) for part in batches for a in range(0, part.num_rows, 256)):
            columns = [batch.column(k).to_pylist() for k in range(4)]
            hits = []
            for k, (a, text_a, text_b) in enumerate(zip(columns[0], columns[2], columns[3])):
                if kept is None or last != (a, text_a):  # rows come sorted by a
                    last, kept = (a, text_a), shingler.sets([text_a])[0]
                other = shingler.sets([text_b])[0]
                both = len(np.intersect1d(kept, other, assume_unique=True))
                if 100 * both >= link_percent * (len(kept) + len(other) - both):
                    hits.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hits, pa.int64())), batch.column(1).take(pa.array(hits, pa.int64()))], ["a", "b"])

    stars = edges.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    parts = F.ceil(F.col("m") / STAR_ROWS).cast("long")
    dealt = join_groups(edges.select("a", "b"), stars, ["a"], "m", max(1, edges.count())).withColumn("part", F.pmod(F.xxhash64("b"), parts)).drop("m")
    centers = stars.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("m")
    right = sieve(texts, "_row", edges.select("b").distinct()).select(F.col("_row").alias("b"), F.col("_text").alias("text_b"))
    left = sieve(texts, "_row", edges.select("a").distinct()).select(F.col("_row").alias("a"), F.col("_text").alias("text_a"))
    pairs = dealt.join(right, "b").join(centers.join(left, "a"), ["a", "part"]).select("a", "b", "text_a", "text_b")
    return pairs.mapInArrow(run, "a long, b long").distinct()


def compare_blocks(live: DataFrame, texts: DataFrame, link_percent: int = LINK_PERCENT) -> DataFrame:
    """Links (a, b) between the members outside each bucket's largest component and all members of other components.

    ``live`` has key, rep, comp, and per bucket top (the largest component), all and most (members of the bucket and of
    top). Members and centers are dealt into chunks; a block is one chunk of each, and full sets are intersected there
    by lookups in the sorted shingles of its centers. Small buckets share a task.
    """
    tasks = max(8, live.count() // 1000)
    chunks = lambda n: F.ceil(n / CHUNK).cast("long")
    sized = live.withColumns({"mc": chunks(F.col("all")), "cc": chunks(F.col("all") - F.col("most"))})
    one = F.lit(1).cast("long")
    members = sized.withColumns({"m": F.pmod(F.xxhash64("rep"), F.col("mc")), "center": F.lit(False)}).withColumn("c", F.explode(F.sequence(one, F.col("cc"))))
    centers = sized.where("comp <> top").withColumns({"c": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("cc")) + 1, "center": F.lit(True)})
    centers = centers.withColumn("m", F.explode(F.sequence(one - 1, F.col("mc") - 1)))
    columns = ["key", "m", "c", "center", "rep", "comp", "mc", "cc"]
    rows = members.select(*columns).unionByName(centers.select(*columns))
    rows = rows.withColumn("task", F.when((F.col("mc") == 1) & (F.col("cc") == 1), F.pmod("key", F.lit(tasks))).otherwise(F.xxhash64("key", "m", "c"))).drop("mc", "cc")
    wanted = sieve(texts, "_row", live.select("rep").distinct()).select(F.col("_row").alias("rep"), "_text")
    sent = rows.select("task", "rep").distinct().join(wanted, "rep").toDF("rep", "for_", "_text")  # a text goes once to each task

    def run(pdf: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        shingler, links = Shingler(), []
        names, sets = first["rep"].tolist(), []
        for a, b in _batches(first["_text"].tolist()):
            hashes, ends = shingler.sets(first["_text"].tolist()[a:b])
            sets += np.split(hashes, ends[:-1])
        by = dict(zip(names, sets))
        for _, block in pdf.groupby(["key", "m", "c"], sort=False):
            own, stars = block[~block["center"]], block[block["center"]]
            if not len(own) or not len(stars):
                continue
            reps, comps = own["rep"].to_numpy(), own["comp"].to_numpy()
            parts = [by[r] for r in reps]
            size = np.array([len(x) for x in parts])
            every, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
            for k in range(0, len(stars), 32):
                few, few_comp = stars["rep"].to_numpy()[k : k + 32], stars["comp"].to_numpy()[k : k + 32]
                known = [by[r] for r in few]
                values, back = np.unique(np.concatenate(known), return_inverse=True)
                has = np.zeros((len(values), len(few)), np.float32)
                has[back, np.repeat(np.arange(len(few)), [len(x) for x in known])] = 1
                at = np.minimum(np.searchsorted(values, every), len(values) - 1)
                hit = np.flatnonzero(values[at] == every)
                both = np.zeros((len(parts), len(few)), np.float32)
                if len(hit):
                    starts = np.flatnonzero(np.diff(owner[hit], prepend=-1))
                    both[owner[hit][starts]] = np.add.reduceat(has[at[hit]], starts, axis=0)
                union = size[:, None] + np.array([len(x) for x in known])[None, :] - both
                for i, j in zip(*np.nonzero((100 * both >= link_percent * union) & (comps[:, None] != few_comp[None, :]))):
                    links.append((min(reps[i], few[j]), max(reps[i], few[j])))
        return pd.DataFrame(sorted(set(links)), columns=["a", "b"])

    return rows.groupBy("task").cogroup(sent.groupBy("for_")).applyInPandas(run, "a long, b long").distinct()


def rarest(reps: DataFrame, texts: DataFrame, link_percent: int = LINK_PERCENT) -> DataFrame:
    """(rep, part): the rarest shingles of each text, so many that two texts that reach the limit share one of them.

    Of n shingles such a text shares limit x n at least, so the first n - limit x n + 1 in any order common to all hold
    one that is shared, and the first of the shared ones is among the first of both. ``reps`` has distinct _row.
    """
    wanted = sieve(texts, "_row", reps).join(reps, "_row", "left_semi")

    def every(batches):
        shingler = Shingler()
        for batch in (part.slice(a, 256) for part in batches for a in range(0, part.num_rows, 256)):
            column = batch.column(0).to_pylist()
            for a, b in _batches(column):
                yield pa.RecordBatch.from_arrays([pa.array(shingler.sets(column[a:b])[0].view(np.int64))], ["part"])

    counted = wanted.select("_text").mapInArrow(every, "part long").groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    common = counted.where(F.col("m") * 1000 > reps.count()).where("m > 1").orderBy(F.desc("m"), "part").limit(COMMON).collect()
    known = np.array([r.part for r in common], np.int64).view(np.uint64)
    times = np.array([r.m for r in common], np.int64)[np.argsort(known)]
    known = np.sort(known)

    def run(batches):
        shingler = Shingler()
        for batch in (part.slice(a, 256) for part in batches for a in range(0, part.num_rows, 256)):
            column = batch.column(1).to_pylist()
            for a, b in _batches(column):
                hashes, ends = shingler.sets(column[a:b])
                often = np.zeros(len(hashes), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    often = np.where(known[at] == hashes, times[at], 0)
                size = np.diff(ends, prepend=0)
                owner = np.repeat(np.arange(b - a), size)
                order = np.lexsort((hashes, often, owner))
                first = np.arange(len(hashes)) - (ends - size)[owner] < (size + link_percent * -size // 100 + 1)[owner]
                ids = batch.column(0).slice(a, b - a).take(pa.array(owner[first]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(hashes[order][first].view(np.int64))], ["rep", "part"])

    return wanted.select("_row", "_text").mapInArrow(run, "rep long, part long").distinct()


def grouped_rows(texts: DataFrame, scratch: Scratch, link_percent: int = LINK_PERCENT) -> DataFrame:
    """_row, _id, _n, component_id and _keep (the number of the row that stays) of a written table with _row, _id and _text."""
    rows = scratch.write(sketch(texts, link_percent))
    total = rows.count()
    classes = rows.where("_n > 0 and _id is not null").groupBy("_s1", "_s2", "_n")
    first = F.min(F.struct("_id", "_row")).alias("_first")
    classes = scratch.write(classes.agg(F.min("_row").alias("rep"), first, F.count(F.lit(1)).alias("size"), F.min_by("_bands", "_row").alias("_bands")))
    bands = classes.select("rep", F.col("_n").alias("n"), F.explode("_bands").alias("key"))
    alike = lambda a, b: 100 * F.least(a, b) >= link_percent * F.greatest(a, b)  # noqa: E731  # sizes alone

    def shared(members: DataFrame, count: int) -> DataFrame:
        """Members (key, rep, n) of buckets with two members at least, and the first of each bucket; ``count`` is about how many there are."""
        members = members.select("key", "rep", "n")
        several = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min_by(F.struct("rep", "n"), "rep").alias("c")).where("m > 1")
        return scratch.write(join_present(members, scratch.write(several), ["key"], "m", max(1, count)).drop("m"))

    def unlinked(members: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with top (the largest), all and most (members of the bucket and of top)."""
        comp = scratch.write(components(links, scratch))
        placed = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
        placed = scratch.write(placed)
        parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
        tops = parts.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"), F.max("m").alias("most")).where("most < all")
        return scratch.write(join_present(placed, scratch.write(tops), ["key"], "all", max(1, placed.count())))

    members = shared(bands, classes.count() * layout(link_percent)[0])
    edges = members.where((F.col("rep") != F.col("c.rep")) & alike("n", "c.n")).select(F.col("c.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = scratch.write(confirm(scratch.write(edges), texts, link_percent))
    live = unlinked(members)
    large = F.col("all") * (F.col("all") - F.col("most")) > BLOCK_PAIRS
    links = links.unionByName(scratch.write(compare_blocks(live.where(~large), texts, link_percent)))
    rest = live.where(large)
    if not rest.isEmpty():
        rest = scratch.write(rest.select("rep", "n").distinct())
        rare = rarest(rest.select(F.col("rep").alias("_row")).distinct(), texts, link_percent)
        rare = scratch.write(rare.join(rest, "rep").withColumnRenamed("part", "key"))
        live = unlinked(shared(rare, rare.count()))
        few = live.where(F.col("all") <= SMALL_GROUP).select("key", "rep", "n", "comp")
        other = few.select("key", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
        edges = few.join(other, "key").where((F.col("rep") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & alike("n", "n_b")).select(F.col("rep").alias("a"), "b").distinct()
        links = links.unionByName(scratch.write(confirm(scratch.write(edges), texts, link_percent)))
        links = links.unionByName(scratch.write(compare_blocks(live.where(F.col("all") > SMALL_GROUP), texts, link_percent)))
    comp = scratch.write(components(links, scratch))
    placed = classes.select("_s1", "_s2", "_n", "size", "_first", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    placed = scratch.write(placed)
    least = placed.groupBy("comp").agg(F.min("_first").alias("_least"), F.count(F.lit(1)).alias("m"))
    groups = join_groups(placed, least, ["comp"], "m", max(1, placed.count()))
    groups = scratch.write(groups.select("_s1", "_s2", "_n", "size", F.col("_least._id").alias("component_id"), F.col("_least._row").alias("_keep")))
    joined = join_groups(rows.select("_row", "_id", "_n", "_s1", "_s2"), groups, ["_s1", "_s2", "_n"], "size", total)
    linked = (F.col("_n") > 0) & F.col("_id").isNotNull()
    return joined.select(
        "_row", "_id", "_n", F.when(linked, F.col("component_id")).otherwise(F.when(F.col("_n") == 0, F.col("_id"))).alias("component_id"),
        F.when(linked, F.col("_keep")).otherwise(F.col("_row")).alias("_keep"),
    )


@tidy()
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link_percent: int = LINK_PERCENT) -> DataFrame:
    """One row per document: its id, n_shingles, component_id and kept (its id is the component's smallest).

    Texts are linked whose shingle sets have a Jaccard similarity of link_percent hundredths at least.
    Rows with equal shingle sets form a class of which one row is compared, so copies are linked without being paired.
    Rows are told apart by a number of their own, so ids may repeat. A null or empty text, or one without words, has no
    shingles and no links. Rows without an id are linked with nothing: they have a null component and stay. Other columns
    are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    texts = scratch.write(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")))
    out = grouped_rows(texts, scratch, link_percent).select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), "component_id")
    out = scratch.write(out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))
    scratch.drop(keep=1)
    return out


@tidy()
def keep_smallest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link_percent: int = LINK_PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of which one row of each near-duplicate group stays: the one with the smallest id, and
    of rows that repeat it the first one read. Rows without words or without an id stay."""
    own, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = numbered(docs, own)
    texts = rows.select("_row", F.col(f"_doc.`{id_col}`").alias("_id"), F.col(f"_doc.`{text_col}`").cast("string").alias("_text"))
    gone = own.write(grouped_rows(texts, scratch, link_percent).where("_row <> _keep").select("_row"))
    scratch.drop()
    out = own.write(without(rows, gone))
    own.drop(keep=1)
    return out
