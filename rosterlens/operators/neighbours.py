"""The nearest vectors of many queries: an inverted file of cells, blocks of vectors, exact likenesses.

Cells are the centroids of a spherical k-means over a bounded sample (``SAMPLE`` rows of least hash). Every vector goes to its
nearest cell; tasks pack a cell's vectors into blocks of up to ``ROWS``, and a query's rows go to the blocks of
the cells it probes. Blocks meet by cell in a join of stored tables, whose hot cells adaptive execution splits, and one matrix product
scores a pair of blocks, of which each query passes on its best ``k``. Likenesses are those of the vectors themselves.

``exact`` adds a second round: a cell is searched too unless its radius and its distance from the query rule out that it
holds anything better than the ``k``-th likeness found so far, so nothing is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import work_folder

SAMPLE = 20_000
ROWS = 2048
MOST_CELLS = 2048
#: Rows that a task holds of unfinished blocks, and rows of a query block that are scored at once.
HELD = 1 << 16
SLICE = 256
#: Room for rounding in bounds.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length one; zero rows stay."""
    width = len(column[0]) if len(column) else 0
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _kept(vectors: DataFrame, id_col: str, vector_col: str, width: int | None = None) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter("id is not null and size(vec) > 0")
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows if width is None else rows.filter(F.size("vec") == width)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Index:
    """Blocks by cell, centroids, and each cell's least likeness of a member to its centroid."""

    blocks: DataFrame  # cell, ids, rows
    centres: np.ndarray
    least: np.ndarray


def _pack(rows: dict[int, list], cell: int) -> tuple[int, bytes, bytes]:
    ids, x = zip(*rows.pop(cell), strict=True)
    return cell, np.concatenate(ids).tobytes(), np.concatenate(x).tobytes()


def _packed(batches: Iterator[pa.RecordBatch], cells_of) -> Iterator[pa.RecordBatch]:
    """Blocks of rows by cell; ``cells_of(batch, matrix)`` gives row places and cells.

    Rows are taken a few at a time, as one may go to every cell. Once a task holds ``HELD`` rows of unfinished blocks it passes on the
    fullest of them, half of what it holds, so memory doesn't grow with cells or rows; ``_merged`` joins such pieces.
    """
    held: dict[int, list] = {}
    count: dict[int, int] = {}
    total = 0

    def out(blocks: list) -> pa.RecordBatch:
        cells, ids, rows = zip(*blocks, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(ids, pa.binary()), pa.array(rows, pa.binary())], ["cell", "ids", "rows"])

    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            b = whole.slice(start, SLICE)
            x, ids = _matrix(b.column(1)), b.column(0).to_numpy()
            place, cell = cells_of(b, x)
            order = np.argsort(cell, kind="stable")
            place, cell = place[order], cell[order]
            for part in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1) if len(cell) else ():
                for a in range(0, len(part), ROWS):
                    some = part[a : a + ROWS]
                    c = int(cell[some[0]])
                    held.setdefault(c, []).append((ids[place[some]], x[place[some]]))
                    count[c] = count.get(c, 0) + len(some)
                    total += len(some)
                    if count[c] >= ROWS:
                        total -= count.pop(c)
                        yield out([_pack(held, c)])
                    elif total >= HELD:
                        for f in sorted(count, key=lambda f: (-count[f], f)):
                            total -= count.pop(f)
                            yield out([_pack(held, f)])
                            if total <= HELD // 2:
                                break
    for c in sorted(held):
        yield out([_pack(held, c)])


_BLOCK = "cell long, ids binary, rows binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of cells, which come one cell after another, as blocks of ``ROWS`` at most."""
    names, cell, ids, rows, n = ["cell", "ids", "rows"], None, [], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([b"".join(ids)], pa.binary()), pa.array([b"".join(rows)], pa.binary())], names)

    for b in batches:
        for c, i, r in zip(*b.columns, strict=True):
            c, i = c.as_py(), i.as_py()
            if ids and (c != cell or n + len(i) // 8 > ROWS):
                yield out()
                ids, rows, n = [], [], 0
            cell, n = c, n + len(i) // 8
            ids.append(i)
            rows.append(r.as_py())
    if ids:
        yield out()


def _blocks(rows: DataFrame, cells_of, name: str) -> DataFrame:
    """Stored blocks of rows by cell."""
    pieces = rows.mapInArrow(lambda batches: _packed(batches, cells_of), _BLOCK)
    return _stored(pieces.repartition("cell").sortWithinPartitions("cell").mapInArrow(_merged, _BLOCK), name)


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, rounds: int = 8) -> Index:
    """An index over all rows with a vector. Null, empty and non-finite vectors, and those of another length than most, are left out."""
    rows = _kept(vectors, id_col, vector_col)
    widths = rows.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").collect()
    width, n = (widths[0]["w"], widths[0]["n"]) if widths else (1, 0)
    rows = rows.filter(F.size("vec") == width)
    cells = cells or int(min(max(math.isqrt(n), 1), MOST_CELLS))
    sample = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).toArrow()
    x = _matrix(sample["vec"].combine_chunks()) if sample.num_rows else np.zeros((0, width))
    centres = _centres(x, cells, rounds)

    def own(b: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(x)), (x @ centres.T).argmax(1)

    blocks = _blocks(rows, own, "cells")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [float((np.frombuffer(r.as_buffer()).reshape(-1, width) @ centres[c]).min()) for c, r in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(least, pa.float64())], ["cell", "least"])

    least = np.full(len(centres), 1.0)
    for r in blocks.select("cell", "rows").mapInArrow(spread, "cell long, least double").groupBy("cell").agg(F.min("least").alias("least")).collect():
        least[r["cell"]] = r["least"]
    return Index(blocks, centres, least)


def _centres(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centroids of length one; spread over the sample at first, refined by rounds."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = np.unique(x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(np.int64)], axis=0)
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
    return centres


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, rank, neighbour, likeness): each query's ``k`` most alike rows but itself, ties by id. Ids of queries must be distinct."""
    centres, least, width = index.centres, index.least, index.centres.shape[1]
    rows = _kept(queries, id_col, vector_col, width)

    def near(b: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = min(probes, len(centres))
        cell = np.argpartition(-(x @ centres.T), n - 1, axis=1)[:, :n]
        return np.repeat(np.arange(len(x)), n), cell.ravel()

    found = _met(index, rows, near, k, width)
    if exact:
        found = _stored(found, "found")
        limit = _best(found, k).groupBy("id").agg(F.count("*").alias("n"), F.min("likeness").alias("least"))
        limit = limit.select(F.col("id").alias("of"), F.when(F.col("n") >= k, F.col("least")).alias("limit"))
        asked = rows.join(limit, F.col("of") == F.col("id"), "left").select("id", "vec", F.coalesce("limit", F.lit(-2.0)).alias("limit"))

        def rest(b: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            like = x @ centres.T
            n = min(probes, len(centres))
            done = np.zeros(like.shape, bool)
            done[np.arange(len(x))[:, None], np.argpartition(-like, n - 1, axis=1)[:, :n]] = True
            angle = np.arccos(np.clip(like, -1, 1)) - np.arccos(np.clip(least, -1, 1))[None]
            bound = np.cos(np.maximum(angle, 0)) + SLACK
            # A zero vector is as far from everything.
            bound[np.linalg.norm(x, axis=1) < 0.5] = 2
            bound[:, least < SLACK] = 2
            return np.nonzero(~done & (bound >= b.column(2).to_numpy()[:, None]))

        found = found.union(_met(index, asked, rest, k, width))
    best = _best(found, k)
    return best.select(F.col("id").alias(id_col), "rank", "neighbour", "likeness")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("likeness", 9)), "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _met(index: Index, rows: DataFrame, cells_of, k: int, width: int) -> DataFrame:
    """Each query's best ``k`` rows of each pair of blocks that share a cell."""
    asked = _blocks(rows, cells_of, "asked")
    pairs = asked.select("cell", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")).join(index.blocks, "cell").select("q_ids", "q_rows", "ids", "rows")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q_rows, ids, other in zip(*b.columns, strict=True):
                all_q, x = np.frombuffer(q_ids.as_buffer(), np.int64), np.frombuffer(ids.as_buffer(), np.int64)
                mine, theirs = np.frombuffer(q_rows.as_buffer()).reshape(-1, width), np.frombuffer(other.as_buffer()).reshape(-1, width).T
                n = min(k, len(x))
                for a in range(0, len(all_q), SLICE):
                    q, like = all_q[a : a + SLICE], mine[a : a + SLICE] @ theirs
                    like[q[:, None] == x[None]] = -np.inf
                    # Ties at the last place go by id, as in the whole order.
                    order = np.lexsort((np.broadcast_to(x, like.shape), -np.round(like, 9)), axis=1)[:, :n] if len(x) > n else np.broadcast_to(np.arange(n), (len(q), n))
                    value = np.take_along_axis(like, order, 1)
                    some = value > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, n)[some.ravel()]), pa.array(x[order][some]), pa.array(value[some])], ["id", "neighbour", "likeness"])

    return pairs.mapInArrow(score, "id long, neighbour long, likeness double")
