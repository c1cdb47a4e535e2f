"""Neighbours against all likenesses: exact results are equal, probed ones reach the stated recall."""

import os

import numpy as np
import pytest

from rosterlens.operators import neighbours as N
from rosterlens.plans.tables import PROBES

FOLDER = "/root/testdata/sf0.1"


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = {}
    for i, v in queries:
        q = np.array(v, float)
        q /= max(np.linalg.norm(q), 1e-300)
        like = x @ q
        order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-round(like[j], 9), ids[j]))[:k]
        out[i] = [(int(ids[j]), round(float(like[j]), 7)) for j in order]
    return out


def got(df):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault(r["vec_id"], []).append((r["neighbour"], round(r["likeness"], 7)))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize(("block", "cells"), [(2048, None), (7, 5), (2048, 1)])
def test_exact(spark, monkeypatch, block, cells):
    monkeypatch.setattr(N, "ROWS", block)
    rng = np.random.default_rng(block)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(120)] + [(200 + i, [1.0] + [0.0] * 5) for i in range(30)] + [(300, [0.0] * 6), (301, [-1.0] + [0.0] * 5)]
    odd = [(400, None), (401, []), (402, [float("nan")] * 6), (403, [1.0, 2.0]), (None, [1.0] * 6)]
    index = N.build(table(spark, rows + odd), cells=cells)
    queries = rows[::3] + [(999, rng.normal(size=6).tolist()), (300, [0.0] * 6)]
    queries = list({i: (i, v) for i, v in queries}.values())
    assert got(N.search(index, table(spark, queries + odd[:4]), k=5, probes=1, exact=True)) == brute(rows, queries, 5)


def test_few_and_no_rows(spark):
    index = N.build(table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]))
    assert got(N.search(index, table(spark, [(1, [1.0, 0.0])]), k=5, exact=True)) == {1: [(2, 0.0)]}
    empty = N.build(table(spark, [(1, [1.0])]).filter("false"))
    assert N.search(empty, table(spark, [(1, [1.0])]), exact=True).count() == 0
    assert N.search(index, table(spark, [(1, [1.0])]).filter("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_recall(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    queries = e.filter("vec_id % 50 = 0")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    want = brute(rows, [(r["vec_id"], r["embedding"]) for r in queries.collect()], 10)
    index = N.build(e)
    near, whole = got(N.search(index, queries, probes=PROBES)), got(N.search(index, queries, exact=True))
    recall = np.mean([len({n for n, _ in near[i]} & {n for n, _ in want[i]}) / 10 for i in want])
    assert recall >= 0.9, recall
    assert {i: [n for n, _ in v] for i, v in whole.items()} == {i: [n for n, _ in v] for i, v in want.items()}


def test_packing_holds_few_rows(monkeypatch):
    """Blocks of many cells are passed on before the task's input ends."""
    import pyarrow as pa

    monkeypatch.setattr(N, "HELD", 1000)
    monkeypatch.setattr(N, "SLICE", 4)
    vectors = pa.array([[1.0, float(i)] for i in range(200)], pa.list_(pa.float64()))
    taken, given, cells = 0, 0, 64

    def batches():
        nonlocal taken
        for a in range(0, 200, 20):
            taken += 20 * cells
            yield pa.RecordBatch.from_arrays([pa.array(range(a, a + 20), pa.int64()), vectors.slice(a, 20)], ["id", "vec"])

    ids = []
    for out in N._packed(batches(), lambda b, x: (np.repeat(np.arange(len(x)), cells), np.tile(np.arange(cells), len(x)))):
        given += sum(len(i.as_py()) // 8 for i in out.column(1))
        assert taken - given <= 1000 + 20 * cells
        ids += [(c.as_py(), int(i)) for c, b in zip(out.column(0), out.column(1), strict=True) for i in np.frombuffer(b.as_py(), np.int64)]
    assert sorted(ids) == [(c, i) for c in range(cells) for i in range(200)]
