"""Secrets in texts: three patterns, and a character network over every other long token with what surrounds it.

The patterns' findings label the tokens that the network learns from, all of them: distinct windows are dealt to
blocks, each round learns in every block from the same network and takes the mean. Its score is calibrated on held-out
findings, and the threshold is the highest one that keeps the wanted recall on others. Tokens that score at least that
are reported beside the patterns' spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import Scratch, tidy

# The kinds of findings, in order, with their patterns and the least length of what they match.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more; a shorter run holds no longer match
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "net")

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
BEFORE, PIECE, AFTER = 24, 64, 8
WINDOW = BEFORE + PIECE + AFTER
"""Characters of a window: those before a piece of a token, the piece, those after it. Longer tokens have several pieces."""

BLOCK = 8192
"""Labelled windows of a block, on average; a block is what learns by itself in a round."""
LEAST_EACH = 64
"""Windows of either label in a block, on average: those of a rarer label are dealt to as many blocks as this takes."""
ROUNDS = 3
"""More rounds learn the odd secret that no pattern found as what is none: of 80 such keys the test's tables lose 15 at 3 rounds and 39 at 6."""
FINE = 1 << 32
"""Networks are summed as whole numbers of 1/FINE, so the order of the blocks does not matter."""
LEAST_FINDINGS = 20
"""With fewer distinct labelled findings than this, nothing is learnt and only the patterns report."""
RECALL = 0.98
LETTERS, VECTOR, TAPS, FILTERS = 128, 8, 5, 16
PLACES = WINDOW - TAPS + 1
PARTS = (0, BEFORE - TAPS // 2, BEFORE + PIECE - TAPS // 2, PLACES)
"""Where the network pools: over what comes before, the piece, and what comes after."""


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def written(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def windows(text: str, start: int, end: int) -> bytes:
    """A fixed-length window for each piece of a token, a byte a character; characters beyond ASCII are all 1, none is 0."""
    raw = []
    for a in range(start, end, PIECE):
        b = min(end, a + PIECE)
        left = text[max(0, a - BEFORE) : a].encode("ascii", "replace").replace(b"?", b"\x01")
        right = text[b : b + AFTER].encode("ascii", "replace").replace(b"?", b"\x01")
        raw.append(left.rjust(BEFORE, b"\0") + text[a:b].encode("ascii").ljust(PIECE, b"\0") + right.ljust(AFTER, b"\0"))
    return b"".join(raw)


FOUND = "n_assign long, n_access long, n_hex long, base string, base_sha256 string, starts array<int>, ends array<int>, labels array<int>, windows binary"


def found(text: str) -> tuple:
    """The patterns' findings and all tokens of a text. A token's label: 1 in a finding (-1 if that is digits alone, which
    may be any number), 0 elsewhere."""
    spans = pattern_spans(text)
    base = written(spans)
    starts, ends, labels, raw, at = [], [], [], [], 0
    reach = 0  # where the findings so far end
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            reach, at = max(reach, spans[at][2]), at + 1
        starts.append(a)
        ends.append(b)
        labels.append(0 if reach <= a else -1 if m[0].isdigit() else 1)
        raw.append(windows(text, a, b))
    kinds = [kind for _, kind, _ in spans]
    return (*(kinds.count(k) for k in range(3)), base, hashlib.sha256(base.encode()).hexdigest(), starts, ends, labels, b"".join(raw))


def find_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    names, kinds = zip(*[(x.split(" ")[0], {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}[x.split(" ")[1]]) for x in FOUND.split(", ")])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                columns = zip(*[found(text or "") for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds))], [id_col, *names])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {FOUND}")


def first_windows(tokens: DataFrame) -> DataFrame:
    """(label, window) of labelled tokens, by their first pieces."""

    def run(batches):
        for batch in batches:
            labels, out = [], []
            for begin, end, known, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                at = 0
                for a, b, label in zip(begin, end, known):
                    if label >= 0:
                        labels.append(label)
                        out.append(raw[at : at + WINDOW])
                    at += WINDOW * -(-(b - a) // PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(out, pa.binary())], ["label", "window"])

    return tokens.select("starts", "ends", "labels", "windows").mapInArrow(run, "label int, window binary")


def labelled(tokens: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """(label, window, h): the distinct labelled windows; at most ``sample_rows`` of either label if that is given."""
    rows = first_windows(tokens).distinct().withColumn("h", F.xxhash64("window"))
    if sample_rows is None:
        return rows
    some = [rows.where(F.col("label") == label).orderBy("h", "window").limit(sample_rows) for label in (0, 1)]
    return some[0].unionByName(some[1])


def deal(rows: DataFrame, many: dict[int, int]) -> DataFrame:
    """(block, labels, parts, windows): a row per block. Of five windows of a label, three (parts 0 to 2) are to learn
    from, one (3) to calibrate, one (4) to set the threshold; only those to learn from are dealt to several blocks."""
    blocks = max(1, sum(many.values()) // BLOCK)
    of = lambda by: F.when(F.col("label") == 1, F.lit(by(many[1]))).otherwise(F.lit(by(many[0])))
    home = F.pmod("h", of(lambda n: max(1, n // BLOCK)))
    place = F.row_number().over(Window.partitionBy("label", "home").orderBy("h", "window"))
    copies = F.when(F.col("part") < 3, of(lambda n: min(blocks, -(-LEAST_EACH * blocks // n)))).otherwise(F.lit(1))
    dealt = rows.withColumn("home", home).withColumn("part", (place % 5).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))

    def pack(group):
        order = group.sort_by([("label", "ascending"), ("window", "ascending")])
        labels, parts = (order[c].to_numpy().astype(np.uint8).tobytes() for c in ("label", "part"))
        return pa.table({"block": order["block"][:1], "labels": [labels], "parts": [parts], "windows": [b"".join(order["window"].to_pylist())]}, PACKED)

    dealt = dealt.select(F.pmod(F.col("h") + F.col("copy"), F.lit(blocks)).cast("long").alias("block"), "label", "part", "window")
    return dealt.groupBy("block").applyInArrow(pack, "block long, labels binary, parts binary, windows binary")


PACKED = pa.schema([("block", pa.int64()), ("labels", pa.binary()), ("parts", pa.binary()), ("windows", pa.binary())])


def unpacked(batches):
    """(block, characters, labels, parts) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            labels, parts, raw = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8) for c in (1, 2, 3))
            yield batch.column(0)[k].as_py(), raw.reshape(-1, WINDOW), labels.astype(int), parts


@dataclass
class Network:
    """Letter vectors, one convolution, the largest value of each filter in each part of the window, and a weighted sum."""

    vectors: np.ndarray
    taps: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    shift: float
    calibration: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.0

    NAMES = ("vectors", "taps", "bias", "weights", "shift")

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(getattr(self, k)) for k in self.NAMES])

    def filled(self, flat: np.ndarray) -> Network:
        """This network with the numbers of ``flat``."""
        shapes = [np.shape(getattr(self, k)) for k in self.NAMES]
        cut = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
        return replace(self, **{k: v.reshape(s) for k, v, s in zip(self.NAMES, cut, shapes)})

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, 1, shape) / np.sqrt(shape[0])
        return cls(r.normal(0, 1, (LETTERS, VECTOR)), draw(TAPS * VECTOR, FILTERS), np.zeros(FILTERS), draw(3 * FILTERS), 0.0)

    def pooled(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(N, 3, FILTERS) largest values and the places where they are."""
        by_letter = self.vectors @ self.taps.reshape(TAPS, VECTOR, FILTERS)  # TAPS, LETTERS, FILTERS: what a letter adds under a tap
        made = by_letter[0].take(chars[:, :PLACES], axis=0)
        for k in range(1, TAPS):
            made += by_letter[k].take(chars[:, k : PLACES + k], axis=0)
        where = np.stack([a + made[:, a:b].argmax(axis=1) for a, b in zip(PARTS, PARTS[1:])], axis=1)
        return np.take_along_axis(made, where, axis=1) + self.bias, where

    def logits(self, chars: np.ndarray) -> np.ndarray:
        out = [np.maximum(self.pooled(chars[a : a + 128])[0], 0).reshape(-1, 3 * FILTERS) @ self.weights + self.shift for a in range(0, len(chars), 128)]
        return np.concatenate(out) if out else np.empty(0)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return sigmoid(a * logits + b)

    def probabilities(self, chars: np.ndarray) -> np.ndarray:
        return self.probability(self.logits(chars))

    def learn(self, chars: np.ndarray, labels: np.ndarray, rounds: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the logistic loss, both labels weighing the same and spread evenly over the batches."""
        r, step = np.random.default_rng(seed), 0
        share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        mean = {k: np.zeros_like(np.asarray(getattr(self, k), float)) for k in self.NAMES}
        square = {k: np.zeros_like(v) for k, v in mean.items()}
        for _ in range(rounds):
            place = np.empty(len(chars))
            for label in (0, 1):
                of = np.flatnonzero(labels == label)
                place[r.permutation(of)] = (np.arange(len(of)) + 0.5) / max(1, len(of))
            order = np.argsort(place, kind="stable")
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x = chars[pick]
                most, where = self.pooled(x)
                active = np.maximum(most, 0).reshape(-1, 3 * FILTERS)
                error = (sigmoid(active @ self.weights + self.shift) - labels[pick]) * share[pick] / len(pick)
                back = ((error[:, None] * self.weights).reshape(most.shape)) * (most > 0)  # N, 3, FILTERS
                near = x[np.arange(len(x))[:, None, None, None], where[..., None] + np.arange(TAPS)]  # letters under the winning taps
                slot = (np.arange(TAPS) * LETTERS + near) * FILTERS + np.arange(FILTERS)[:, None]
                sent = np.bincount(slot.ravel(), np.repeat(back.ravel(), TAPS), TAPS * LETTERS * FILTERS).reshape(TAPS, LETTERS, FILTERS)
                slope = {"weights": error @ active, "shift": error.sum(), "bias": back.sum(axis=(0, 1)), "taps": (self.vectors.T @ sent).reshape(-1, FILTERS)}
                slope["vectors"] = (sent @ self.taps.reshape(TAPS, VECTOR, FILTERS).transpose(0, 2, 1)).sum(axis=0)
                step += 1
                for k, g in slope.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * np.square(g)
                    setattr(self, k, getattr(self, k) - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def newton(sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """The two numbers where the convex loss is least; ``sums`` gives loss, slopes and curvature at a place."""
    w = np.zeros(2)
    loss, slope, curve = sums(w)
    for _ in range(50):
        step = np.linalg.solve(curve + 1e-6 * np.eye(2), slope)
        if np.abs(step).max() < 1e-7:
            break
        for _ in range(40):
            made = sums(w - step)
            if made[0] <= loss + 1e-9 + 1e-12 * abs(loss):
                break
            step = step / 2
        w, (loss, slope, curve) = w - step, made
    return float(w[0]), float(w[1])


def targets(none: float, some: float) -> tuple[float, float]:
    """What to aim at for either label, kept off 0 and 1."""
    return 1 / (none + 2), (some + 1) / (some + 2)


def calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability sigmoid(a * logit + b), by Newton steps."""
    target = np.array(targets((labels == 0).sum(), (labels == 1).sum()))[labels]
    x = np.stack([logits, np.ones(len(logits))], axis=1)

    def sums(w):
        z = x @ w
        p = sigmoid(z)
        return np.logaddexp(0, z).sum() - target @ z, x.T @ (p - target), (x * (p * (1 - p))[:, None]).T @ x

    return newton(sums)


def calibrated_rows(rows: DataFrame) -> tuple[float, float]:
    """``calibrated`` for rows (label, weight, logit): a job of six sums a step."""
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    none, some = targets(count.get(0, 0), count.get(1, 0))
    x, weight, target = F.col("logit"), F.col("weight"), F.when(F.col("label") == 1, F.lit(some)).otherwise(F.lit(none))

    def sums(w):
        z = x * F.lit(float(w[0])) + F.lit(float(w[1]))
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z
        wanted = (loss, (p - target) * x, p - target, p * (1 - p) * x * x, p * (1 - p) * x, p * (1 - p))
        made = rows.agg(*[F.sum(weight * c).alias(f"s{k}") for k, c in enumerate(wanted)]).first()
        return made[0], np.array(made[1:3]), np.array([[made[3], made[4]], [made[4], made[5]]])

    return newton(sums)


def kth(rows: DataFrame, k: int, few: int = 4096) -> float:
    """The value of rank k (from 0) in the only column, exactly: ranges with the rank are cut by 1,024 until few values are left."""
    name = rows.columns[0]
    while True:
        n, low, high = rows.agg(F.count(name), F.min(name), F.max(name)).first()
        if low == high:
            return low
        if n <= few:
            return sorted(r[0] for r in rows.collect())[k]
        cut = F.floor((F.col(name) - F.lit(low)) / F.lit(high - low) * 1024)
        for at, size in sorted(rows.groupBy(cut).count().collect()):
            if k < size:
                break
            k -= size
        rows = rows.where(cut == at)


AROUND = np.r_[:BEFORE, BEFORE + PIECE : WINDOW]


def moved(chars: np.ndarray, others: np.ndarray, seed) -> np.ndarray:
    """Findings in the surroundings of tokens that are none."""
    out = chars.copy()
    if len(others):
        out[:, AROUND] = others[np.random.default_rng(seed).integers(0, len(others), len(chars))][:, AROUND]
    return out


def train_round(net: Network, blocks: DataFrame, number: int) -> Network:
    """The mean of the networks that the blocks make of ``net``, each in one pass over its windows to learn from."""

    def run(batches):
        total, n = np.zeros(len(net.flat), np.int64), 0
        for block, chars, labels, parts in unpacked(batches):
            own, fit = replace(net), parts < 3
            more = moved(chars[fit & (labels == 1)], chars[labels == 0], [number, block])
            own.learn(np.concatenate([chars[fit], more]), np.r_[labels[fit], np.ones(len(more), int)], rounds=1, seed=[number, block])
            total, n = total + np.rint(own.flat * FINE).astype(np.int64), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], ["at", "total", "n"])

    means = blocks.mapInArrow(run, "at long, total long, n long").groupBy("at").agg(F.sum("total"), F.sum("n")).collect()  # a row a number of the network
    return net.filled(np.array([total / n / FINE for _, total, n in sorted(means)]))


def held_out(net: Network, blocks: DataFrame) -> DataFrame:
    """(part, label, moved, weight, logit) of the windows not learnt from; each finding comes twice, so others weigh two."""

    def run(batches):
        for block, chars, labels, parts in unpacked(batches):
            for part in (3, 4):
                own = parts == part
                more = moved(chars[own & (labels == 1)], chars[labels == 0], [part, block])
                known = np.r_[labels[own], np.ones(len(more), int)]
                columns = (np.full(len(known), part), known, np.arange(len(known)) >= own.sum(), 2.0 - known, net.logits(np.concatenate([chars[own], more])))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "label", "moved", "weight", "logit"])

    return blocks.mapInArrow(run, "part long, label long, moved boolean, weight double, logit double")


def train_rows(rows: DataFrame, recall: float, scratch: Scratch) -> Network | None:
    """``train`` for any number of rows (label, window, h), over all of them; the driver holds one network and a few sums."""
    many = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if min(many.get(0, 0), many.get(1, 0)) < LEAST_FINDINGS:
        return None
    blocks, net = scratch.write(deal(rows, many)), Network.fresh()
    for number in range(ROUNDS):
        net = train_round(net, blocks, number)
    held = scratch.write(held_out(net, blocks))
    net.calibration = calibrated_rows(held.where("part = 3"))
    kept = held.where("part = 4 and moved").select("logit")
    net.threshold = float(net.probability(kth(kept, int((1 - recall) * kept.count()))))
    return net


def train(rows: list[tuple[int, bytes]], recall: float = RECALL) -> Network | None:
    """The network of labelled windows in memory: three parts in five to learn from, one to calibrate, one to set the threshold.

    Each finding comes twice, once in the surroundings of a token that is none: the token's own letters are judged
    too, and the recall is that of findings moved so. None with fewer than LEAST_FINDINGS of either label.
    """
    rows = sorted(rows)
    labels = np.array([label for label, _ in rows])
    if min((labels == 1).sum(), (labels == 0).sum()) < LEAST_FINDINGS:
        return None
    chars = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    part = np.concatenate([np.arange((labels == k).sum()) % 5 for k in (0, 1)])  # labels are sorted
    twice = chars.copy()
    twice[labels == 1] = moved(chars[labels == 1], chars[labels == 0], 0)
    net, fit = Network.fresh(), part < 3
    net.learn(np.concatenate([chars[fit], twice[fit]]), np.concatenate([labels[fit]] * 2))
    held = np.concatenate([chars[part == 3], twice[part == 3]])
    net.calibration = calibrated(net.logits(held), np.concatenate([labels[part == 3]] * 2))
    kept = np.sort(net.probabilities(twice[(part == 4) & (labels == 1)]))
    net.threshold = float(kept[int((1 - recall) * len(kept))])
    return net


@tidy()
def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, sample_rows: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, n_assign, n_access, n_hex, base_sha256, spans, and for each token that the
    network reports its probability (``net_scores``).

    Spans are kind:start:end in code points, by start and then kind; the network's (``net``) lie outside all findings
    of the patterns. A token of several pieces has the score of its highest piece. Null and empty texts have no
    spans. Repeated rows, and rows without an id, are scanned one by one. Other columns are not read. An empty table
    gives no rows. The network learns from every labelled window, unless ``sample_rows`` bounds those of either label.
    """
    scratch = Scratch(docs.sparkSession)
    tokens = scratch.write(find_tokens(docs, id_col, text_col))
    net = train_rows(scratch.write(labelled(tokens, sample_rows)), recall, scratch)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                raw = b"".join(part.column(9).to_pylist())
                scores = net.probabilities(np.frombuffer(raw, np.uint8).reshape(-1, WINDOW)) if net else None
                spans, sure, at = [], [], 0
                for base, starts, ends, labels in zip(*(part.column(k).to_pylist() for k in (4, 6, 7, 8))):
                    own, kept = [], []
                    for start, end, label in zip(starts, ends, labels):
                        pieces = -(-(end - start) // PIECE)
                        if net and label == 0 and (best := float(scores[at : at + pieces].max())) >= net.threshold:
                            own.append((start, 3, end))
                            kept.append(best)
                        at += pieces
                    known = [x.split(":") for x in base.split(",") if x]
                    spans.append(written(sorted(own + [(int(s), KINDS.index(k), int(e)) for k, s, e in known])))
                    sure.append(kept)
                columns = [*(part.column(k) for k in (0, 1, 2, 3, 5)), pa.array(spans, pa.string()), pa.array(sure, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "net_scores"])

    kind = dict(docs.dtypes)[id_col]
    out = scratch.write(tokens.mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, net_scores array<double>"))
    scratch.drop(keep=1)
    return out
