"""Language identification with string kernels.

The kernel of two texts is the number of letter n-grams, of one to MAX_GRAM characters, that both have, divided by
the geometric mean of their own numbers of n-grams. N-grams are hashed into presence rows. A Nystroem map over
landmark texts and one-versus-rest kernel ridge regression give a weight per landmark and language; because the
kernel is linear in a presence row, landmarks and weights fold into one matrix, and texts are scored by batched
matrix products with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GRAM = 4
SLOT_BITS = 15
ROWS_PER_LANGUAGE = 400
TRAINING_ROWS = 8000
SALTS = 64
"""Bounds of the training sample: per language the ids with the smallest hashes, and all together."""
LANDMARKS = 256
RIDGE = 1e-2
BATCH_TEXTS = 64
BATCH_CHARS = 250_000
UNKNOWN = "und"

_MIX = np.uint32(0x9E3779B1)
_STEP = np.uint32(0x01000193)


def letter_table() -> np.ndarray:
    """Letters of the basic plane map to themselves and all else there to a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


def presence(texts: list[str], letters: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Fills rows of ``out`` (texts x slots) with 1 where a text has an n-gram; True for texts with letters."""
    out[: len(texts)] = 0
    flat, slots = out.reshape(-1), out.shape[1]
    shift = np.uint32(32 - slots.bit_length() + 1)
    has = np.zeros(len(texts), bool)
    for k, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        for a in range(0, len(codes), BATCH_CHARS):  # windows overlap, so no n-gram is lost
            part = codes[a : a + BATCH_CHARS + MAX_GRAM - 1]
            basic = part < len(letters)
            if basic.all():
                part = letters[part]
            else:
                high = np.unique(part[~basic])
                high = high[[chr(c).isalpha() for c in high]]
                part = np.where(basic, letters[np.where(basic, part, 32)], np.where(np.isin(part, high), part, 32))
            has[k] |= bool((part != 32).any())
            grams = np.zeros(len(part), np.uint32)
            for n in range(1, MAX_GRAM + 1):
                if len(part) < n:
                    break
                grams = grams[: len(part) - n + 1] * _STEP + part[n - 1 :] + np.uint32(n)
                flat[((grams * _MIX) >> shift).astype(np.int64) + k * slots] = 1
    return has


def _sample(docs: DataFrame) -> DataFrame:
    """Ids and languages to learn from, one language an id: never of a held-out document."""
    known = docs.where(~F.col("_held") & F.col("_lang").isNotNull() & F.col("_text").isNotNull()).groupBy("_id").agg(F.min("_lang").alias("_lang"))
    order = [F.xxhash64("_id"), F.col("_id")]
    salted = Window.partitionBy("_lang", F.pmod(F.xxhash64("_id"), F.lit(SALTS))).orderBy(*order)
    few = known.select("_id", "_lang", F.row_number().over(salted).alias("_r")).where(F.col("_r") <= ROWS_PER_LANGUAGE)
    by = Window.partitionBy("_lang").orderBy(*order)
    ranked = few.select("_id", "_lang", F.row_number().over(by).alias("_r")).where(F.col("_r") <= ROWS_PER_LANGUAGE)
    return ranked.orderBy("_r", "_lang").limit(TRAINING_ROWS).select("_id", "_lang")


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, folded weights: slots x languages) from columns _id, _text, _lang and _held."""

    def rows(batches):
        letters, one = letter_table(), np.zeros((1, 1 << SLOT_BITS), np.float32)
        for batch in batches:
            langs, bits = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if presence([text], letters, one)[0]:
                    langs.append(lang)
                    bits.append(np.packbits(one[0].astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bits, pa.binary())], ["_lang", "_bits"])

    sample = F.broadcast(_sample(docs).select("_id", F.col("_lang").alias("_want")))
    found = docs.where(~F.col("_held")).join(sample, "_id").where((F.col("_lang") == F.col("_want")) & F.col("_text").isNotNull())
    found = found.groupBy("_id", "_lang").agg(F.min("_text").alias("_text")).select("_lang", "_text")  # one text an id, so TRAINING_ROWS at most
    got = sorted(found.mapInArrow(rows, "_lang string, _bits binary").collect(), key=lambda r: (r[0], bytes(r[1])))
    languages = sorted({r[0] for r in got})
    if not languages:
        return [], np.zeros((1 << SLOT_BITS, 0), np.float32)
    texts = np.array([np.unpackbits(np.frombuffer(r[1], np.uint8)) for r in got], np.float32)
    texts /= np.sqrt(texts.sum(axis=1, keepdims=True))
    index = np.array([languages.index(r[0]) for r in got])
    each = max(1, LANDMARKS // len(languages))
    marks = texts[np.concatenate([np.flatnonzero(index == c)[:: max(1, (index == c).sum() // each)][:each] for c in range(len(languages))])]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # the Nystroem map of a text is its kernel row times this
    mapped = (texts @ marks.T).astype(np.float64) @ root
    target = (index[:, None] == np.arange(len(languages))).astype(np.float64)
    balance = (1 / np.bincount(index))[index][:, None] * len(got) / len(languages)
    beta = np.linalg.solve(mapped.T @ (mapped * balance) + RIDGE * np.eye(mapped.shape[1]), mapped.T @ (target * balance))
    return languages, (marks.T.astype(np.float64) @ (root @ beta)).astype(np.float32)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: its id, held_out, lang_pred and score (0 to 1).

    A document is held out if crc32 of its id as text leaves 1 when divided by 3; a null id counts as held out for
    learning and as False in ``held_out``. A null text, or one without a letter, is UNKNOWN with score 0, and so is
    every text where there is nothing to learn from. Ties go to the first language in order. Repeated rows get equal
    results. Other columns are not read. An empty table gives no rows.
    """
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    held = F.coalesce(crc % 3 == 1, F.lit(True))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).alias("_lang"), held.alias("_held"))
    languages, weights = fit(base)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        letters, rows = letter_table(), np.zeros((BATCH_TEXTS, 1 << SLOT_BITS), np.float32)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(a, BATCH_TEXTS)
                texts = [t or "" for t in part.column(2).to_pylist()]
                has = presence(texts, letters, rows)
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if languages:
                    x = rows[: len(texts)]
                    got = (x @ sent.value) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
                    best = got.argmax(axis=1)
                    scores = np.where(has, np.clip(got[np.arange(len(texts)), best].astype(np.float64), 0, 1), 0)
                    langs = [languages[b] if h else UNKNOWN for b, h in zip(best, has)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores)], [id_col, "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    rows = base.select("_id", (F.col("_held") & F.col("_id").isNotNull()).alias("held_out"), "_text")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
