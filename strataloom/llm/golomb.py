"""Golomb-coded fingerprint sets, and the exchange by which partitions learn which fingerprints others have too."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OWNED = "_owner long, _sender long, _blob binary"


def encode(values: np.ndarray, span_bits: int) -> bytes:
    """Sorted distinct integers below 2^span_bits as a Golomb code of their differences, for a divisor that is a power of two.

    The divisor is near ln 2 times the mean difference. All unary quotients come first, then all remainders, so that both
    directions are array operations.
    """
    n = len(values)
    low = min(63, max(0, round(span_bits - math.log2(max(1, n)) + math.log2(math.log(2)))))
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(low)).astype(np.int64) + 1)
    unary = np.ones(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 0
    rest = np.empty((n, low), np.uint8)
    for k in range(low):
        rest[:, k] = (gaps >> np.uint64(k)).astype(np.uint8) & 1
    return np.array([n, low, len(unary)], "<u4").tobytes() + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def decode(blob: bytes) -> np.ndarray:
    n, low, n_unary = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    cut = 12 + (n_unary + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob[12:cut], np.uint8), count=n_unary)
    rest = np.unpackbits(np.frombuffer(blob[cut:], np.uint8), count=n * low).reshape(n, low)
    gaps = np.diff(np.flatnonzero(unary == 0), prepend=-1).astype(np.uint64) - np.uint64(1) << np.uint64(low)
    for k in range(low):
        gaps |= rest[:, k].astype(np.uint64) << np.uint64(k)
    return np.cumsum(gaps, dtype=np.uint64)


def messages(values: np.ndarray, sender: int, bits: int, owner_bits: int) -> list[tuple[int, int, bytes]]:
    """One coded message (owner, sender, blob) per owner of a range, from a sender's sorted distinct values of so many bits."""
    owners = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(owners, prepend=-1))
    out = []
    for a, b in zip(starts, [*starts[1:], len(values)]):
        base = np.uint64(int(owners[a]) << (bits - owner_bits))
        out.append((int(owners[a]), sender, encode(values[a:b] - base, bits - owner_bits)))
    return out


def answer(sent: DataFrame, name_first: bool = False) -> DataFrame:
    """(_sender, _owner, _map): a bit per fingerprint of a message, set where another sender has it as well.

    With ``name_first`` also _first: for each set bit the smallest sender that has the fingerprint.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [decode(x) for x in pdf["_blob"]]
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every = every[order]
        again = np.flatnonzero(every[1:] == every[:-1])
        head = again[np.append(True, every[again[1:]] != every[again[:-1]])] if len(again) else again
        shared, maps, firsts = every[head], [], []
        if name_first:
            senders = np.repeat(pdf["_sender"].to_numpy(np.int64), [len(x) for x in sets])[order]
            group = np.searchsorted(shared, every)
            mine = (group < len(shared)) & (shared[np.minimum(group, len(shared) - 1)] == every) if len(shared) else np.zeros(len(every), bool)
            least = np.full(len(shared), np.iinfo(np.int64).max)
            np.minimum.at(least, group[mine], senders[mine])
        for x in sets:
            at = np.searchsorted(shared, x)
            hit = shared[np.minimum(at, len(shared) - 1)] == x if len(shared) else np.zeros(len(x), bool)
            maps.append(np.packbits(hit).tobytes())
            if name_first:
                firsts.append(zlib.compress(least[at[hit]].astype("<i8").tobytes(), 1))
        out = pd.DataFrame({"_sender": pdf["_sender"], "_owner": pdf["_owner"], "_map": maps})
        return out.assign(_first=firsts) if name_first else out

    schema = "_sender long, _owner long, _map binary" + ", _first binary" * name_first
    return sent.select("_owner", "_sender", "_blob").groupBy("_owner").applyInPandas(run, schema)


def marked(values: np.ndarray, replies: pd.DataFrame, bits: int, owner_bits: int) -> np.ndarray:
    """For each of a sender's sorted distinct values, whether a reply says that another sender has it."""
    flags = np.zeros(len(values), bool)
    owners = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
    for owner, reply in zip(replies["_owner"], replies["_map"]):
        a, b = np.searchsorted(owners, [int(owner), int(owner) + 1])
        flags[a:b] = np.unpackbits(np.frombuffer(reply, np.uint8), count=b - a).astype(bool)
    return flags


def first_senders(values: np.ndarray, flags: np.ndarray, replies: pd.DataFrame, bits: int, owner_bits: int) -> np.ndarray:
    """For each marked value the smallest sender that has it, -1 for the others."""
    out = np.full(len(values), -1, np.int64)
    owners = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
    for owner, reply in zip(replies["_owner"], replies["_first"]):
        a, b = np.searchsorted(owners, [int(owner), int(owner) + 1])
        out[a:b][flags[a:b]] = np.frombuffer(zlib.decompress(reply), "<i8")
    return out
