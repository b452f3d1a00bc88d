"""Token sequences of fixed length by sum-of-squares packing.

Texts become token ids inside the tasks that read them; only piece lengths are shuffled. Pieces are dealt at
random into groups of a fixed mean size, and each group is packed on its own: a piece goes where the sum, over
all residual gaps, of the squared count of open bins with that gap becomes smallest. What a group leaves open
is a few bins of thousands.
"""

from __future__ import annotations

import zlib
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Scratch, tidy

SEQUENCE = 2048
END_OF_TEXT = 0
GROUP_PIECES = 50_000
"""Mean number of pieces that one task packs."""
CACHED_CHUNKS = 400_000


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: b if b in plain else next(others) for b in range(256)}


class ChunkCache(dict):
    """Token ids (little-endian unsigned 32-bit) of text chunks that no token crosses."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self[""] = b""

    def __missing__(self, chunk: str) -> bytes:
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():  # one pre-token: the model alone gives its ids
            ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
            out = pack_ids(f"<{len(ids)}I", *ids)
        else:
            out = self.whole(chunk)
        self[chunk] = out
        return out

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack_ids(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of ``Tokenizer.encode(text, add_special_tokens=False)``: the string of an added token has that token's id."""
        if any(t in text for t in self.added):
            return self.whole(text)
        if len(self) > CACHED_CHUNKS:
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, chunks_of(text)))


# Signs of uneven text, by the class of each character: letter or digit, [.,!], white space, other.
CLASSES = bytes(ord("w" if chr(b).isalnum() else " " if chr(b).isspace() else "." if chr(b) in ".,!" else "-") for b in range(256))
UNEVEN = (b" .", b"-.", b"..", b"  ")


def even(text: str) -> bool:
    """No runs of white space, and [.,!] only after letters and digits; other alphabets count as uneven before [.,!]."""
    kinds = text.encode("latin-1", "replace").translate(CLASSES)
    return not any(u in kinds for u in UNEVEN) and "\0" not in text


def chunks_of(text: str) -> list[str]:
    """Cuts where every byte-level BPE pre-tokenizer of this family starts a token.

    In an even text that is before each space, around each line end, and before [.,!] after a letter or digit.
    Elsewhere it is before a single space between two other characters.
    """
    if even(text):
        return text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("!", "\0!").replace("\n", "\0\n\0").split("\0")
    parts = text.split(" ")
    out, held = [], parts[0]
    for p in parts[1:]:
        if p and held and not p[0].isspace() and not held[-1].isspace():
            out.append(held)
            held = " " + p
        else:
            held += " " + p
    return [*out, held]


def token_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32 (and ids if asked for).

    A document is the ids of its text and then END_OF_TEXT; a null or empty text is END_OF_TEXT alone. Only a
    document of more than ``sequence`` ids is cut; all of its pieces but the first are full.
    """

    def run(batches):
        cache = ChunkCache(tokenizer_file)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows, kept = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    raw = cache.encode(text or "") + END_OF_TEXT.to_bytes(4, "little")
                    n = len(raw) // 4
                    first = n - sequence * ((n - 1) // sequence)
                    start = 0
                    for piece, length in enumerate([first, *[sequence] * ((n - first) // sequence)]):
                        rows.append((k, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                        start += length
                    if with_ids:
                        kept.append(raw)
                where, piece, start, length, crc = zip(*rows)
                columns = [part.column(0).take(pa.array(where)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(kept), "<u4").astype("int32"))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack_lengths(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed largest first by the sum-of-squares rule.

    Moving a bin from gap g to gap g - s changes the sum by 2 * (count[g - s] - count[g]) + 2; a new bin counts
    as a gap of ``sequence`` with no open bins. A full bin is closed and counts nothing. Among equal sums the
    smallest gap wins.
    """
    count = np.zeros(sequence + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(sequence + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        gaps = count[size:]
        change = 2 * (count[: sequence + 1 - size] - gaps) + 2
        change[0] = 1 - 2 * gaps[0]  # the bin becomes full
        change[gaps == 0] = sequence * len(lengths) + 9
        change[-1] = 2 * count[sequence - size] + 1 if size < sequence else 0  # a new bin
        gap = size + int(np.argmin(change))
        if gap == sequence:
            bins[k], used = used, used + 1
        else:
            bins[k] = open_bins[gap].pop()
            count[gap] -= 1
        offsets[k] = sequence - gap
        if gap > size:
            open_bins[gap - size].append(int(bins[k]))
            count[gap - size] += 1
    return bins, offsets


def pack(pieces: DataFrame, total: int, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``sequence``."""
    groups = max(1, round(total / group_pieces))
    place = F.xxhash64(F.monotonically_increasing_id())  # rows are dealt by their place, as repeated rows have nothing else to tell them apart

    def run(rows: pa.Table) -> pa.Table:  # ids go through unread
        bins, offsets = pack_lengths(rows["length"].to_numpy(), sequence)
        first = np.int64(rows["_group"][0].as_py()) << np.int64(32)
        return rows.drop_columns("_group").append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return pieces.withColumn("_group", F.pmod(place, F.lit(groups))).groupBy("_group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


@tidy()
def best_fit_packing(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Packs every document into sequences of at most ``sequence`` tokens; one row per piece.

    Adds sequence_id and offset to the rows of ``token_pieces``. Repeated rows and rows without an id are
    packed like any other. Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(token_pieces(docs, tokenizer_file, id_col, text_col, sequence, with_ids))
    out = scratch.write(pack(pieces, pieces.count(), sequence))
    scratch.drop(keep=1)
    return out
