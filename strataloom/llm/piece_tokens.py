"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A normalised text is cut into marked words: no piece of such a vocabulary crosses from a character to the mark of
the next word, so the best segmentation of a text is that of its words. The distinct words of a batch are sorted,
which lists them as a depth-first walk through their trie; forward scores up to the prefix that a word has in common
with the one before are kept, and only the rest is searched.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHED_WORDS = 300_000
BATCH_CHARS = 2_000_000


class PieceModel:
    """Pieces and scores of a model file; words are segmented to the largest sum of scores, longest piece first in ties."""

    def __init__(self, model_file: str | None = None, processor=None):
        from sentencepiece import SentencePieceProcessor

        self.processor = processor or SentencePieceProcessor(model_file=model_file)
        p, n = self.processor, self.processor.get_piece_size()
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.pieces = {p.id_to_piece(i): (p.get_score(i), i) for i in plain}
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.suffixes = {p[k:] for p in self.pieces for k in range(len(p))}
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN_PENALTY
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = p.id_to_piece(i).encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.words: dict[str, tuple[int, ...]] = {}

    def normalise(self, text: str) -> str:
        return self.processor.normalize(text)

    def segment(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Piece ids of distinct words, with one walk through their trie."""
        out: dict[str, tuple[int, ...]] = {}
        # Forward state of the path to the current trie node: best score, where its last piece starts, its id.
        score, start, piece = [0.0], [0], [0]
        last = ""
        find, suffixes = self.pieces.get, self.suffixes
        for word in sorted(words):
            most = min(len(last), len(word))
            same = next((k for k in range(most) if last[k] != word[k]), most)
            del score[same + 1 :], start[same + 1 :], piece[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                best, at, which = None, end - 1, -1
                for a in range(end - 1, -1, -1):  # as far back as some piece ends like this
                    part = word[a:end]
                    if part not in suffixes:
                        break
                    hit = find(part)
                    if hit is not None and (best is None or score[a] + hit[0] >= best):
                        best, at, which = score[a] + hit[0], a, hit[1]
                if word[end - 1] not in self.pieces and (best is None or score[end - 1] + self.unknown > best):
                    best, at, which = score[end - 1] + self.unknown, end - 1, -1
                score.append(best)
                start.append(at)
                piece.append(which)
            ids: list[int] = []
            end = len(word)
            while end:
                if piece[end] >= 0:
                    ids.append(piece[end])
                else:
                    raw = word[start[end] : end].encode("utf-8", "replace")
                    ids += [self.bytes[b] for b in reversed(raw)] if self.bytes else [self.processor.unk_id()]
                end = start[end]
            out[word] = tuple(reversed(ids))
            last = word
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, int, bool]]:
        """(ids, number of marked words, whether the ids decode to the normal form) of each text."""
        normal = [self.normalise(t) if t else "" for t in texts]
        cut = [WORD.findall(n) for n in normal]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if new := set().union(*cut).difference(self.words):
            self.words.update(self.segment(list(new)))
        out = []
        for words, n in zip(cut, normal):
            flat = list(chain.from_iterable(map(self.words.__getitem__, words)))
            out.append((np.array(flat, np.int32), len(words), self.decode(flat) == _plain(n)))
        return out

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _batches(texts: list[str | None]):
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < BATCH_CHARS):
            chars += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_words (marked words), n_tokens, ids, and round_trip.

    round_trip tells whether the decoded ids give the model's normal form of the text back. A null text is encoded
    as an empty one: no ids. Characters outside the vocabulary become byte pieces, or the unknown id where a model
    has none. Repeated rows and rows without an id are encoded like any other. Other columns are not read. An empty
    table gives no rows.
    """

    def run(batches):
        model = PieceModel(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _batches(texts):
                got = model.encode([t or "" for t in texts[a:b]])
                sizes = [len(ids) for ids, _, _ in got]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([ids for ids, _, _ in got])))
                columns = [batch.column(0).slice(a, b - a), pa.array([w for _, w, _ in got], pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array([same for _, _, same in got])]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_tokens", "ids", "round_trip"])

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_words long, n_tokens long, ids array<int>, round_trip boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _plain(normal: str) -> str:
    text = normal.replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def decode_pieces(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ids: its id and the decoded text; null ids give a null text, no ids an empty one."""

    def run(batches):
        model = PieceModel(model_file)
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), 1024):
                part = batch.slice(a, 1024)
                texts = [None if ids is None else model.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` {kind}, text string")
