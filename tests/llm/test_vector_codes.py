"""Product codes against a full search in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import vector_codes


def brute(rows, entries, rounds=4, parts=4):
    kept = [(i, v, b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    from fractions import Fraction

    ints = [[math.floor(1024 * Fraction(x)) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [nearest(c[p], book)[1] for c in cut]
            for e in range(len(book)):
                own = [c[p] for c, o in zip(cut, of, strict=True) if o == e]
                if own:
                    book[e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    fit = [e if e < 1 << 63 else None for e in error]
    total = {}
    for (_, _, b), e in zip(kept, fit, strict=True):
        total[b] = None if e is None and total.get(b) is None else (total.get(b) or 0) + (e or 0)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((repr(i), "".join(f"{k:02x}" for _, k in f), e, total[b], digest) for (i, _, b), f, e in zip(kept, found, fit, strict=True))


def got(df):
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


@pytest.mark.parametrize("width", [16, 13, 3, 1])
def test_codes(spark, width):
    rng = np.random.default_rng(width)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.02, width).round(3)], int(rng.integers(3)) or None) for i in rng.permutation(90)]
    rows += [(200, [math.nan] * width, 1), (201, None, 1), (202, [None] * width, 2), (203, [math.inf] * width, 2), (None, [0.0] * width, 2), rows[0], rows[1], (5, [0.25] * width, None), (300, [0.1] * max(width - 2, 0), 1)]
    df = table(spark, rows)
    assert got(vector_codes.encode(df, entries=20)) == brute(rows, 20)
    odd = df.select("*", F.lit("x").alias("id"), F.lit(1).alias("vec"), F.lit(2).alias("code"), F.lit(3).alias("error"), F.lit(4).alias("of"))
    assert got(vector_codes.encode(odd, entries=20)) == brute(rows, 20)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e12, 1e150, 1e305])
def test_any_magnitude(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, scale, 8)], i % 2) for i in range(30)]
    assert got(vector_codes.encode(table(spark, rows), entries=5, rounds=2)) == brute(rows, 5, 2)


def test_ties_and_few_rows(spark):
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(40)]
    assert got(vector_codes.encode(table(spark, rows), entries=7)) == brute(rows, 7)
    assert got(vector_codes.encode(table(spark, rows[:3]))) == brute(rows[:3], 256)
    assert got(vector_codes.encode(table(spark, [(1, [], 1)]))) == brute([(1, [], 1)], 256)
    assert vector_codes.encode(table(spark, rows).filter("false")).count() == 0
    with pytest.raises(ValueError):
        vector_codes.encode(table(spark, rows), entries=257)


def test_bounds_never_drop_the_nearest():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 16, 33):
        entries = rng.integers(-600, 600, (64, width))
        x = np.concatenate([rng.integers(-600, 600, (300, width)), entries, entries[:, ::-1]])
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        code, best = vector_codes.Book(entries).nearest(x)
        assert (code == far.argmin(1)).all() and (best == far.min(1)).all()
