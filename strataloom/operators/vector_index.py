"""An index over all vectors: coarse cells, of which a query visits the nearest.

Centres of cells are fitted on a bounded sample; every row is then put into the cell of its nearest centre. A query goes to
its nearest cells only and is scored with the vectors in them. How many cells a query needs for a wanted recall is
measured when the index is built, by an exact search for a bounded sample of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators.ranking import PART_ROWS, STRIP, matrix_of, vector_search
from strataloom.sources.shared import cut, drop

SAMPLE_ROWS = 20_000
"""Rows, those with the smallest hashes of their ids, that centres are fitted on."""
MOST_CELLS = 4096
QUERY_BLOCK = 16_384
"""Mean number of queries that one task holds; a row travels once for so many."""
SEGMENT = 16
"""Rows of a cell of which the best alone is compared at first."""
REACH = 2e-4
"""Below a bound in single precision, what may still round to as much in four digits."""
NOWHERE = -3.0
"""A score below every cosine."""
EXACT = 65_536
"""Pairs that are scored in double precision at once."""
TRIALS = 200
"""Rows that are searched for exactly to measure recall."""


@dataclass
class VectorIndex:
    """``rows``: id, grp, cell and the unit vector of every row; centres by cell; cells that a query visits."""

    rows: DataFrame
    centres: np.ndarray
    probes: int


def nearest_centres(vectors: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k centres with the largest inner products, best first."""
    out = []
    for a in range(0, len(vectors), 1024):
        score = vectors[a : a + 1024] @ centres.T
        few = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
        out.append(np.take_along_axis(few, np.argsort(-np.take_along_axis(score, few, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def means(points: np.ndarray, k: int, rounds: int = 10, spherical: bool = False) -> np.ndarray:
    """Centres by k-means from evenly spread starting points; a centre without points keeps its place."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([((points[a : a + 2048] @ centres.T) - 0.5 * (centres * centres).sum(axis=1) * (not spherical)).argmax(axis=1) for a in range(0, len(points), 2048)])
        count = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, points[:, d], k) for d in range(points.shape[1])], axis=1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def build_index(rows: DataFrame, k: int = 10, recall: float = 0.95, cells: int | None = None) -> VectorIndex:
    """Index of rows (id, vec, and grp if there is one); rows without an id or a vector are left out.

    ``probes`` is the least number of cells that hold the ``recall`` share of the k nearest of sampled rows, measured
    against an exact search over all rows. Vectors have one length. The table is written to the shared
    folder.
    """
    grp = F.col("grp") if "grp" in rows.columns else F.lit(0)
    given = rows.where("id is not null and vec is not null").select("id", grp.alias("grp"), "vec")
    total = given.count()
    chosen = given.orderBy(F.xxhash64("id"), "id").limit(min(total, SAMPLE_ROWS)).toArrow()
    sample = matrix_of(chosen["vec"])
    cells = max(1, min(cells or int(2 * total**0.5), MOST_CELLS, len(sample)))
    centres = means(sample, cells, spherical=True) if len(sample) else np.zeros((1, 1))

    def place(batches):
        for batch in batches:
            vectors = matrix_of(batch.column(2))
            own = nearest_centres(vectors, centres)[:, 0] if len(vectors) else np.zeros(0, np.int64)
            kept = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), kept], ["id", "grp", "cell", "vec"])

    kinds = dict(given.dtypes)
    placed = given.mapInArrow(place, f"id {kinds['id']}, grp {kinds['grp']}, cell int, vec array<float>")
    table = cut(placed.repartitionByRange("cell", "id").sortWithinPartitions("cell"))  # a large cell lies in several files; files hold few cells
    index = VectorIndex(table, centres, cells)
    if total:
        index.probes = probes_for(index, k, recall)
    return index


def probes_for(index: VectorIndex, k: int, recall: float) -> int:
    """The least number of cells that hold the ``recall`` share of the k nearest rows of TRIALS rows, in sum."""
    asked = index.rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIALS).select(F.col("id").alias("query_id"), "vec")
    asked = cut(asked)
    found = vector_search(index.rows.select("id", "vec"), asked, k).join(index.rows.select("id", "cell"), "id").select("query_id", "cell").toArrow()  # TRIALS * k rows
    queries = asked.toArrow()
    drop(asked)
    order = nearest_centres(matrix_of(queries["vec"]), index.centres, len(index.centres))
    rank = np.argsort(order, axis=1)  # of each cell, for each query
    row = {q: n for n, q in enumerate(queries["query_id"].to_pylist())}
    depth = np.sort([rank[row[q], c] for q, c in zip(found["query_id"].to_pylist(), found["cell"].to_pylist())])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1 if len(depth) else 1


def parts_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, pieces) of each cell by its number of rows: cells that follow each other share a part of some PART_ROWS rows, a larger
    cell has parts of its own from ``first`` on."""
    first, pieces, at, held = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // PART_ROWS)), 0, 0
    for cell, n in enumerate(counts):
        if held and held + n > PART_ROWS:
            at, held = at + 1, 0
        first[cell], held = at, held + n
        if pieces[cell] > 1:
            at, held = at + pieces[cell], 0
    return first, pieces


def in_groups(mine: np.ndarray, theirs: np.ndarray):
    """(places in mine, places in theirs) of each group that is in both."""
    places = lambda held: dict(zip((u := np.unique(held, return_counts=True))[0].tolist(), np.split(np.argsort(held, kind="stable"), np.cumsum(u[1])[:-1])))
    own, other = places(mine), places(theirs)
    return [(own[g], other[g]) for g in own.keys() & other.keys() if g == g]


def closest(ids, groups, cells, matrix, names, theirs, asked, visits, k: int, floor: float, exclude_self: bool, without_own: bool) -> list[tuple]:
    """(query, id, score), a tuple of arrays a strip: the k best rows of the cells that each query visits, unit vectors all.

    Rows are laid in segments of one cell. A strip's scores are made at once in single precision; the k-th largest of the
    segments' best bounds what can be among a query's k best, so only a few segments are looked into. What is in reach of the bound is
    scored anew in double precision, so rounded scores, the floor and ties are exact.
    """
    order = np.argsort(cells, kind="stable")
    held, lengths = np.unique(cells, return_counts=True)
    room = -(-lengths // SEGMENT) * SEGMENT
    at = np.repeat(np.cumsum(room) - room - np.cumsum(lengths) + lengths, lengths) + np.arange(len(ids))
    row, laid = np.full(room.sum(), -1), np.zeros((room.sum(), matrix.shape[1]), np.float32)
    row[at], laid[at] = order, matrix[order]
    of, local = np.repeat(np.arange(len(held)), room // SEGMENT), np.full(MOST_CELLS, -1)
    local[held] = np.arange(len(held))
    same = lambda keys, wanted: (keys[1], np.searchsorted(keys[0], wanted), np.searchsorted(keys[0], wanted, "right"))
    sort = np.argsort(kind := ids[order] if without_own else groups[order], kind="stable") if without_own or exclude_self else None
    keys = None if sort is None else (kind[sort], at[sort])
    near, out = np.argsort([c[0] for c in visits], kind="stable"), []  # queries of one cell visit much the same cells
    for a in range(0, len(near), STRIP):
        strip = near[a : a + STRIP]
        seen = local[np.concatenate([visits[q] for q in strip])]
        query = np.repeat(np.arange(len(strip)), [len(visits[q]) for q in strip])[seen >= 0]
        visited = np.zeros((len(held), len(strip)), bool)
        visited[seen[seen >= 0], query] = True
        segments = np.flatnonzero(visited.any(axis=1)[of])
        if not len(segments):
            continue
        if len(segments) > 0.8 * len(of):
            segments, place, part = np.arange(len(of)), None, laid
        else:
            part = laid.reshape(len(of), SEGMENT, -1)[segments].reshape(len(segments) * SEGMENT, -1)
            place = np.full(len(of), -1)
            place[segments] = np.arange(len(segments))
        lies = lambda x, place=place: x if place is None else np.where(place[x // SEGMENT] < 0, -1, place[x // SEGMENT] * SEGMENT + x % SEGMENT)
        scores = part @ asked[strip].astype(np.float32).T
        rows = row.reshape(-1, SEGMENT)[segments]
        scores[rows.ravel() < 0] = NOWHERE
        if keys is not None:
            wanted, which = np.unique(names[strip] if without_own else theirs[strip], return_inverse=True)
            places, start, stop = same(keys, wanted)
            for g in np.flatnonzero((stop > start) & (wanted == wanted)):
                gone = lies(places[start[g] : stop[g]])
                scores[np.ix_(gone[gone >= 0], np.flatnonzero(which == g))] = NOWHERE
        cube = scores.reshape(len(segments), SEGMENT, len(strip))
        top = np.where(visited[of[segments]], cube.max(axis=1), NOWHERE)
        limit = np.full(len(strip), floor)
        if len(segments) > k:
            limit = np.maximum(limit, np.partition(np.ascontiguousarray(top.T), len(segments) - k, axis=1)[:, len(segments) - k])
        limit -= REACH
        seg, q = np.nonzero(top >= limit)
        one, offset = np.nonzero(cube[seg, :, q] >= limit[q, None])
        seg, q = seg[one], q[one]
        found = rows[seg, offset]
        score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", matrix[found[x : x + EXACT]], asked[strip[q[x : x + EXACT]]]) for x in range(0, len(found), EXACT))])
        score = np.round(score, 4)
        good = score >= floor
        q, score, found = q[good], score[good], ids[found[good]]
        order_ = np.lexsort((found, -score, q))
        q, score, found = q[order_], score[order_], found[order_]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k  # since the query's results begin
        out.append((names[strip[q[first]]], found[first], score[first]))
    return out


def index_search(index: VectorIndex, queries: DataFrame, k: int, floor: float = -2.0, exclude_self: bool = False, within: bool = False, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): like ``vector_search``, over the ``probes`` cells nearest to each query.

    Rows are dealt into parts of neighbouring cells and queries into blocks, so that a query travels once to a part, with its
    cells there, and not once to each cell; a cell that holds most rows spreads over parts. A task scores a strip of queries at
    once with the cells that any of them visits. With as many probes as cells every row is scored.
    """
    many = min(probes or index.probes, len(index.centres))
    centres = index.centres
    grouped = exclude_self or within
    counts = np.zeros(len(centres), np.int64)
    for r in index.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # MOST_CELLS rows at most
        counts[r["cell"]] = r["n"]
    first, pieces = parts_of(counts)

    def visit(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                cells = nearest_centres(matrix_of(part.column(2)), centres, many) if counts.any() else np.zeros((part.num_rows, 0), np.int64)
                row, cell = np.repeat(np.arange(len(cells)), cells.shape[1]), cells.ravel()
                row, cell = row[counts[cell] > 0], cell[counts[cell] > 0]
                n = pieces[cell]
                to = np.repeat(first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                order = np.lexsort((to, row))  # stable: the nearest cell comes first
                row, cell, to = row[order], cell[order].astype(np.int16), to[order]
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (to[1:] != to[:-1])]) if len(row) else np.zeros(0, np.int64)
                offsets = (2 * np.r_[starts, len(row)]).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(cell)])
                again = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(again) for c in range(3)), pa.array(to[starts]), held], ["query", "of", "asked", "_p", "cells"])

    given = queries.where("query_id is not null and vec is not null").select("query_id", (F.col("grp") if grouped else F.lit(0)).alias("of"), "vec")
    kinds = dict(given.dtypes)
    blocks = max(1, -(-given.count() // QUERY_BLOCK))
    sent = given.mapInArrow(visit, f"query {kinds['query_id']}, of {kinds['of']}, asked {kinds['vec']}, _p long, cells binary")
    sent = sent.withColumn("_b", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    dealt = F.broadcast(index.rows.sparkSession.createDataFrame([(c, int(a), int(n)) for c, (a, n) in enumerate(zip(first, pieces))], "cell int, _first long, _pieces long"))
    own = index.rows.select("id", "grp", "cell", "vec").join(dealt, "cell").withColumn("_part", F.col("_first") + F.pmod(F.xxhash64("id"), "_pieces"))
    own = own.select("id", "grp", "cell", "vec", "_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))

    def best(own: pa.Table, sent: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        if own.num_rows and sent.num_rows:
            rows = (own["id"].to_numpy(), own["grp"].to_numpy(), own["cell"].to_numpy(), matrix_of(own["vec"]))
            asked = (sent["query"].to_numpy(), sent["of"].to_numpy(), matrix_of(sent["asked"]), [np.frombuffer(x, np.int16) for x in sent["cells"].to_pylist()])
            for mine, theirs in in_groups(rows[1], asked[1]) if within else [(slice(None), slice(None))]:
                few = np.arange(len(asked[0]))[theirs]
                out += closest(*(x[mine] for x in rows), *(x[theirs] for x in asked[:3]), [asked[3][q] for q in few], k, floor, exclude_self, within)
        return pa.table(dict(zip(("query_id", "id", "score"), (np.concatenate(c) for c in zip(*out)))))

    found = own.groupBy("_part", "_block").cogroup(sent.groupBy("_p", "_b")).applyInArrow(best, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def save_index(index: VectorIndex, path: str) -> None:
    """Writes an index to a folder: its rows, and its centres as rows of their own."""
    spark = index.rows.sparkSession
    index.rows.write.mode("overwrite").parquet(f"{path}/rows")
    parts = [(n, c.tolist(), index.probes) for n, c in enumerate(index.centres)]
    spark.createDataFrame(parts, "n int, vec array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    parts = spark.read.parquet(f"{path}/centres").orderBy("n").collect()  # MOST_CELLS rows
    return VectorIndex(spark.read.parquet(f"{path}/rows"), np.array([r["vec"] for r in parts]), parts[0]["probes"])
