"""Removal of long repeated strings with a difference cover, one block of text and one bucket of suffixes at a time.

Two positions with an equal string of LENGTH bytes have, at one common distance of less than PERIOD, two positions of
the difference cover, and the strings that start there are equal for LENGTH - PERIOD + 1 bytes. So first the cover
sample alone is judged, as occurring once or again: every cover position whose short string occurs nowhere else rules out
all suffixes that would need it. What remains are the suffixes that may tie for long. They are sorted one bucket at a
time by the names of their first LENGTH bytes, a name being a 64-bit fingerprint and a bucket a range of names; equal
neighbours are candidates. A bucket also tells each block which block has a name first.

Names only propose: before anything is removed, every candidate is compared byte by byte with the first string of its
name, inside its block, or in the block that has the name first, to which runs of candidates are sent as bytes. Strings
whose name turns out to be shared by different strings are grouped by their bytes instead. So results are exact, texts
stay in their blocks, and memory is bounded by a block or a bucket.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import golomb
from strataloom.llm.common import Scratch, join_groups, parted, tidy

LENGTH = 200
PERIOD = 133
# A perfect difference set; every distance modulo PERIOD is a difference of two of its members.
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
SAMPLE_LENGTH = LENGTH - PERIOD + 1
BLOCK_BYTES = 2_500_000
OWNER_VALUES = 2_000_000
SAMPLE_EXTRA_BITS = 12
"""A sample fingerprint has log2(samples) and so many bits more; a false repeat only adds suffixes to sort."""
NAME_EXTRA_BITS = 30
"""A name has log2(bytes) and so many bits more, 64 at most; a shared name costs work only."""
CLAIM_BYTES = 8_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Windows:
    """Fingerprints of all strings of one length in a text, by a rolling sum of powers."""

    def __init__(self):
        self.power = self.inverse = np.ones(0, np.uint64)

    def sums(self, data: bytes) -> np.ndarray:
        if len(self.power) < len(data) + 1:
            n = 1 << len(data).bit_length()
            rows = []
            for base in (_BASE, _INVERSE):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                rows.append(np.cumprod(row, dtype=np.uint64))
            self.power, self.inverse = rows
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        x = (sums[starts + length] - sums[starts]) * self.inverse[starts]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def cover_positions(n_bytes: int) -> np.ndarray:
    """Cover positions of a text of which a repeated string can make use."""
    last = n_bytes - SAMPLE_LENGTH
    if n_bytes < LENGTH:
        return np.zeros(0, np.int64)
    grid = (np.arange(0, last + 1, PERIOD)[:, None] + np.array(COVER)).ravel()
    return grid[grid <= last]


def possible_starts(n_bytes: int, samples: np.ndarray) -> np.ndarray:
    """Starts of strings that hold one of the samples, and so may be repeated."""
    n = n_bytes - LENGTH + 1
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(0, samples - (PERIOD - 1)), 1)
    np.add.at(edge, np.minimum(n, samples + 1), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def cut_spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings at sorted starts."""
    if not len(starts):
        return []
    first = np.flatnonzero(np.diff(starts, prepend=starts[0] - LENGTH - 1) > LENGTH)
    last = np.append(first[1:], len(starts)) - 1
    return list(zip(starts[first].tolist(), (starts[last] + LENGTH).tolist()))


def _owner_bits(values: int) -> int:
    return max(2, math.ceil(math.log2(max(1, values / OWNER_VALUES))))


def joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def sample_names(texts: list[bytes]) -> list[np.ndarray]:
    windows = Windows()
    return [windows.at(windows.sums(t), cover_positions(len(t)), SAMPLE_LENGTH) for t in texts]


class Suffixes:
    """The candidate suffixes of a block: its texts end to end, where each suffix starts there, and the names in order."""

    def __init__(self, pdf: pd.DataFrame, name_bits: int):
        windows, at, starts, names = Windows(), 0, [], []
        self.sizes, self.bases = [], []
        for value, runs in zip(pdf["_value"], pdf["_runs"]):
            own = joined([np.arange(a, b) for a, b in np.frombuffer(runs, "<i8").reshape(-1, 2)], np.int64)
            names.append(windows.at(windows.sums(value), own, LENGTH) >> np.uint64(64 - name_bits))
            starts.append(own + at)
            self.sizes.append(len(own))
            self.bases.append(at)
            at += len(value)
        self.data, self.starts, self.names = b"".join(pdf["_value"]), joined(starts, np.int64), joined(names)
        self.values, self.first, self.back, self.counts = np.unique(self.names, return_index=True, return_inverse=True, return_counts=True)

    def unequal(self, which: np.ndarray, other: np.ndarray, data: bytes) -> np.ndarray:
        """Those of the suffixes ``which`` (ascending) whose LENGTH bytes differ from those at ``other`` in ``data``."""
        if not len(which):
            return which
        mine = self.starts[which]
        cut = np.flatnonzero((np.diff(mine) != 1) | (np.diff(other) != 1)) + 1
        bad = []
        for a, b in zip([0, *cut], [*cut, len(which)]):  # neighbours on both sides are compared as one string
            n = b - a + LENGTH - 1
            if self.data[mine[a] : mine[a] + n] != data[other[a] : other[a] + n]:
                bad += [k for k in range(a, b) if self.data[mine[k] : mine[k] + LENGTH] != data[other[k] : other[k] + LENGTH]]
        return which[bad]


@tidy()
def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_bits: int | None = None) -> DataFrame:
    """One row per input row: its id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end in bytes).

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else too. A null text counts as empty. Rows
    with equal texts, also those that repeat an id or have none, are copies of each other: from LENGTH bytes on they
    go as a whole, and one of them stands for all in the search. Other columns are not read. An empty table gives no
    rows. Fewer ``name_bits`` change the work, not the result.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_sha", F.unhex(F.sha2("_text", 256)))
    rows = scratch.write(base.select("_id", "_sha", F.octet_length("_text").cast("long").alias("_bytes")))
    long = F.col("_bytes") >= LENGTH
    count, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(long, F.col("_bytes"))), F.lit(0))).first()
    classes = scratch.write(rows.where(long).groupBy("_sha").agg(F.count(F.lit(1)).alias("_size"), F.first("_bytes").alias("_n")))
    bits = min(64, max(1, n_bytes * len(COVER) // PERIOD).bit_length() + SAMPLE_EXTRA_BITS)
    owner_bits = _owner_bits(n_bytes * len(COVER) // PERIOD)
    name_bits = name_bits or min(64, max(1, n_bytes).bit_length() + NAME_EXTRA_BITS)
    name_owner_bits = min(name_bits, _owner_bits(n_bytes // 4))
    block_type = f"_block long, _sha binary, _copied boolean, _value binary, {golomb.OWNED}"

    def make_blocks(batches):
        """Blocks of at most about BLOCK_BYTES: their texts, and the coded names of their cover samples."""
        block, held, size = TaskContext.get().partitionId() << 24, [], 0

        def finished():
            for a in range(0, len(held), 512):
                some = held[a : a + 512]
                yield pa.RecordBatch.from_pylist([dict(_block=block, _sha=s, _copied=c, _value=v, _owner=None, _sender=None, _blob=None) for s, c, v in some], schema)
            names = np.unique(joined(sample_names([v for _, _, v in held])) >> np.uint64(64 - bits))
            sent = golomb.messages(names, block, bits, owner_bits)
            if sent:
                yield pa.RecordBatch.from_pylist([dict(_block=block, _sha=None, _copied=None, _value=None, _owner=o, _sender=s, _blob=b) for o, s, b in sent], schema)

        schema = pa.schema([("_block", pa.int64()), ("_sha", pa.binary()), ("_copied", pa.bool_()), ("_value", pa.binary()), ("_owner", pa.int64()), ("_sender", pa.int64()), ("_blob", pa.binary())])
        for batch in (part.slice(a, 256) for part in batches for a in range(0, part.num_rows, 256)):
            for sha, many, value in zip(*[c.to_pylist() for c in batch.columns]):
                value = value.encode("utf-8", "replace")
                if held and size + len(value) > BLOCK_BYTES:
                    yield from finished()
                    block, held, size = block + 1, [], 0
                held.append((sha, many > 1, value))
                size += len(value)
        if held:
            yield from finished()

    # one text of each class goes on; copies collapse before they are shuffled, and other texts stay in place
    kept = parted(base.where(F.octet_length("_text") >= LENGTH).select("_sha", "_text"), "_sha", classes.where("_size > 1").select("_sha"))
    copied = kept.where("_maybe").groupBy("_sha").agg(F.count(F.lit(1)).alias("_size"), F.first("_text").alias("_text"))
    single = copied.unionByName(kept.where("not _maybe").select("_sha", F.lit(1).cast("long").alias("_size"), "_text"))
    blocks = scratch.write(single.mapInArrow(make_blocks, block_type))
    replies = golomb.answer(blocks.where(F.col("_blob").isNotNull()))

    def candidates(key: tuple, pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sha")
        hashes = sample_names(pdf["_value"].tolist())
        values, back, counts = np.unique(joined(hashes) >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        flags = ((counts > 1) | golomb.marked(values, replies, bits, owner_bits))[back]
        out, at = [], 0
        for sha, copied, value, own in zip(pdf["_sha"], pdf["_copied"], pdf["_value"], hashes):
            hit = flags[at : at + len(own)]
            at += len(own)
            if hit.any():
                starts = possible_starts(len(value), cover_positions(len(value))[hit])
                breaks = np.flatnonzero(np.diff(starts, prepend=-2) > 1)
                runs = np.stack([starts[breaks], starts[np.append(breaks[1:], len(starts)) - 1] + 1], 1) if len(starts) else np.zeros((0, 2), int)
                out.append((sha, copied, value, runs.astype("<i8").tobytes()))
        texts = [dict(zip(("_sha", "_copied", "_value", "_runs"), x)) for x in out]
        some = [texts] if texts else []
        return pd.DataFrame({"_block": [int(key[0])] * len(some), "_texts": pd.Series(some, dtype=object)})

    texts = blocks.where(F.col("_value").isNotNull()).select("_block", "_sha", "_copied", "_value")
    by_sender = lambda r: r.groupBy(F.col("_sender").alias("_block"))
    found_type = "_block long, _texts array<struct<_sha: binary, _copied: boolean, _value: binary, _runs: binary>>"
    found = scratch.write(texts.groupBy("_block").cogroup(by_sender(replies)).applyInPandas(candidates, found_type))  # a row a block
    scratch.release(blocks)

    def send_names(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block, texts = (batch.column(c)[k].as_py() for c in (0, 1))
                sent = golomb.messages(Suffixes(pd.DataFrame(texts), name_bits).values, block, name_bits, name_owner_bits)
                if sent:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sent), (pa.int64(), pa.int64(), pa.binary()))], ["_owner", "_sender", "_blob"])

    replies = scratch.write(golomb.answer(found.mapInArrow(send_names, golomb.OWNED), name_first=True))

    def unpacked(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([t for row in pdf["_texts"] for t in row], columns=["_sha", "_copied", "_value", "_runs"])

    spans = "array<struct<start: long, end: long>>"

    def cut(pdf: pd.DataFrame, own: Suffixes, flags: np.ndarray) -> pd.DataFrame:
        """What is removed of each text of a block without copies, given which of its suffixes are repeated."""
        out, at = [], 0
        for sha, copied, value, n, start in zip(pdf["_sha"], pdf["_copied"], pdf["_value"], own.sizes, own.bases):
            hit = own.starts[at : at + n][flags[at : at + n]] - start
            at += n
            if len(hit) and not copied:
                cuts = cut_spans(hit)
                edges = [0, *[x for c in cuts for x in c], len(value)]
                rest = b"".join(value[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((sha, sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in cuts]))
        return pd.DataFrame(out, columns=["_sha", "_removed", "_spans", "_kept", "_cut"])

    def propose(key: tuple, pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """The cuts if all names are right; runs of suffixes that another block has first, as bytes for that block; and names
        that fail inside the block."""
        pdf = unpacked(pdf)
        own = Suffixes(pdf, name_bits)
        flags = golomb.marked(own.values, replies, name_bits, name_owner_bits)
        firsts = golomb.first_senders(own.values, flags, replies, name_bits, name_owner_bits)
        again = np.flatnonzero((own.counts > 1)[own.back])
        again = again[again != own.first[own.back[again]]]
        bad = np.unique(own.names[own.unequal(again, own.starts[own.first[own.back[again]]], own.data)])
        out = [(None, None, int(v)) for v in bad.view(np.int64)]
        ask = np.sort(own.first[flags & (firsts != int(key[0]))])
        to, at = firsts[own.back[ask]], own.starts[ask]
        ends = np.flatnonzero((np.diff(at) != 1) | (np.diff(to) != 0)) + 1
        for a, b in zip([0, *ends] if len(ask) else [], [*ends, len(ask)]):
            out.append((int(to[a]), own.data[at[a] : at[b - 1] + LENGTH], None))
        asked = pd.DataFrame(out, columns=["_to", "_bytes", "_bad"]).astype({"_to": "Int64", "_bad": "Int64"})
        cuts = cut(pdf, own, ((own.counts > 1) | flags)[own.back]).astype({"_removed": "Int64", "_spans": "Int64"})
        return pd.concat([cuts, asked.assign(_cut=None)])

    cut_type = f"_sha binary, _removed long, _spans long, _kept string, _cut {spans}"
    proposed = found.groupBy("_block").cogroup(by_sender(replies)).applyInPandas(propose, f"{cut_type}, _to long, _bytes binary, _bad long")
    proposed = scratch.write(proposed)
    cuts = proposed.where(F.col("_sha").isNotNull()).select("_sha", "_removed", "_spans", "_kept", "_cut")
    asked = proposed.where(F.col("_to").isNotNull()).select("_to", "_bytes").distinct()  # a passage that many blocks have alike is compared once

    # a block that many others ask is copied to several tasks, one for each CLAIM_BYTES of their runs
    load = scratch.write(asked.groupBy("_to").agg(F.count(F.lit(1)).alias("_m"), F.ceil(F.sum(F.octet_length("_bytes")) / CLAIM_BYTES).cast("long").alias("_parts")))
    dealt = join_groups(asked, load, ["_to"], "_m", max(1, proposed.count())).withColumn("_part", F.pmod(F.xxhash64("_bytes"), "_parts"))
    answering = found.join(load.withColumnRenamed("_to", "_block"), "_block").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))

    def compare(key: tuple, pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own, bad, windows = Suffixes(unpacked(pdf), name_bits), [], Windows()
        for data in asked["_bytes"]:
            names = windows.at(windows.sums(data), np.arange(len(data) - LENGTH + 1), LENGTH) >> np.uint64(64 - name_bits)
            at = own.first[np.searchsorted(own.values, names)]
            order = np.argsort(at, kind="stable")
            bad.append(own.names[own.unequal(at[order], order, data)])
        return pd.DataFrame({"_bad": np.unique(joined(bad)).view(np.int64)})

    failed = answering.select("_block", "_part", "_texts").groupBy("_block", "_part").cogroup(dealt.select(F.col("_to").alias("_block"), "_part", "_bytes").groupBy("_block", "_part"))
    failed = failed.applyInPandas(compare, "_bad long").unionByName(proposed.where(F.col("_bad").isNotNull()).select("_bad"))
    failed = scratch.write(failed.distinct())
    if not failed.isEmpty():
        owner = F.shiftrightunsigned("_bad", name_bits - name_owner_bits).alias("_owner")

        def notify(sent: pd.DataFrame, bad: pd.DataFrame) -> pd.DataFrame:
            """Which block has which of the failed names."""
            out = []
            names = np.sort(bad["_bad"].to_numpy(np.int64).view(np.uint64))
            for block, o, blob in zip(sent["_sender"], sent["_owner"], sent["_blob"]) if len(names) else ():
                base = np.uint64(int(o) << (name_bits - name_owner_bits))
                hit = np.intersect1d(golomb.decode(blob) + base, names, assume_unique=True)
                out.append(pd.DataFrame({"_block": int(block), "_bad": hit.view(np.int64)}))
            return pd.concat(out) if out else pd.DataFrame({"_block": [], "_bad": []})

        notices = found.mapInArrow(send_names, golomb.OWNED).groupBy("_owner").cogroup(failed.select("_bad", owner).groupBy("_owner")).applyInPandas(notify, "_block long, _bad long")
        notices = scratch.write(notices)

        def spell_out(key: tuple, pdf: pd.DataFrame, bad: pd.DataFrame) -> pd.DataFrame:
            """The strings of the failed names."""
            pdf = unpacked(pdf)
            own, out, at = Suffixes(pdf, name_bits), [], 0
            names = bad["_bad"].to_numpy(np.int64).view(np.uint64)
            for sha, value, n, start in zip(pdf["_sha"], pdf["_value"], own.sizes, own.bases):
                hits = at + np.flatnonzero(np.isin(own.names[at : at + n], names))
                at += n
                out += [(int(key[0]), sha, int(k), value[k : k + LENGTH]) for k in own.starts[hits] - start]
            return pd.DataFrame(out, columns=["_block", "_sha", "start", "_string"])

        strings = found.groupBy("_block").cogroup(notices.groupBy("_block")).applyInPandas(spell_out, "_block long, _sha binary, start long, _string binary")
        strings = scratch.write(strings)
        often = strings.groupBy("_string").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_string", F.lit(True).alias("again"))
        judged = strings.join(often, "_string", "left").select("_block", "_sha", "start", F.coalesce("again", F.lit(False)).alias("again"))
        sides = judged.unionByName(replies.drop("_first").withColumnRenamed("_sender", "_block"), allowMissingColumns=True)

        def mend(key: tuple, pdf: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
            pdf = unpacked(pdf)
            own = Suffixes(pdf, name_bits)
            flags = ((own.counts > 1) | golomb.marked(own.values, side[side["_map"].notna()], name_bits, name_owner_bits))[own.back]
            base = dict(zip(pdf["_sha"], own.bases))
            known = side[side["_sha"].notna()]
            flags[np.searchsorted(own.starts, [base[s] + int(k) for s, k in zip(known["_sha"], known["start"])])] = known["again"].to_numpy(bool)
            return cut(pdf, own, flags)

        cuts = found.groupBy("_block").cogroup(sides.groupBy("_block")).applyInPandas(mend, cut_type)
    groups = scratch.write(classes.select("_sha", "_size").join(cuts, "_sha", "left").where("_size > 1 or _removed > 0"))
    out = join_groups(rows, groups, ["_sha"], "_size", count)
    whole = F.col("_size") > 1
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_bytes").alias("end")))
    out = out.select(
        F.col("_id").alias(id_col),
        F.col("_bytes").alias("n_bytes"),
        F.when(whole, F.col("_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("_kept", F.lower(F.hex("_sha")))).alias("kept_sha256"),
        F.when(whole, all_).otherwise(F.coalesce("_cut", F.array().cast(spans))).alias("spans"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
    out = scratch.write(out)
    scratch.drop(keep=1)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with repeated strings cut out of the text.

    A character of which a byte was cut goes whole. A null text stays null.
    """
    found = repeated_spans(docs, id_col, text_col)
    spans = found.where("n_removed > 0").groupBy(F.col("text_sha256").alias("_key")).agg(F.first("spans").alias("_cut"), F.count(F.lit(1)).alias("_m"))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for value, cut in zip(texts, cuts):
            data = value.encode("utf-8", "replace")
            edges = [0, *[x for s in cut for x in (s["start"], s["end"])], len(data)]
            out.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    text = F.col(f"_doc.`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).withColumn("_key", F.sha2(text, 256))
    both = parted(rows, "_key", spans.select("_key"))  # texts that lose nothing stay where they are
    marked = join_groups(both.where("_maybe").select("_doc", "_key"), spans, ["_key"], "_m", max(1, found.count()))
    whole = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    less = [(rest(text, F.col("_cut")) if c == text_col else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns]
    same = both.where("not _maybe").select(*whole).unionByName(marked.where(F.col("_cut").isNull()).select(*whole))
    return marked.where(F.col("_cut").isNotNull()).select(*less).unionByName(same)
