"""Vector code compression: product codes whose nearest entries are found by segment-mean lower bounds.

Vectors become integers and are cut into equal parts; each part is coded by the nearest entry
of its position's codebook. The search for that entry goes from coarse to fine: the distance of
two parts is at least the distance of their block means (weighted by block length) plus the
squared difference of their residual norms, for few blocks first, then for more.
Entries whose bound, lowered by the rounding it can hold, exceeds a distance already found are
dropped; what is left gets exact integer distances, so codes are those of a full search.

Codebooks are refined by rounds over all rows: tasks send one row of sums for each entry,
position and 48-bit limb, Spark adds those up, and the new codebooks (``entries`` times the vector length,
whatever the number of rows) come to the driver and go out with the next round's tasks.

Rows with a null vector, or null or non-finite components, are dropped. A vector shorter than the longest
kept one, or a length that ``parts`` doesn't divide, is filled up with zeros at the end. Fewer rows than
``entries`` give as many entries as there are rows. Rows that repeat an id are coded each; among them
the smaller vector comes first in the codebook, and a null id comes last. An empty table gives no rows.
Components of any finite size are exact: beyond 64-bit sums, Python integers take their place; an error that
64 bits can't hold is null and adds nothing to ``label_error``. Other columns aren't read and may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import named, stored

LIMB = 48
#: Rows searched at once.
BATCH = 2048
#: Blocks of each level's bound, from coarse to fine.
LEVELS = (4, 8)
#: Entries measured at each level before the rest is filtered.
PROBES = 4
#: Relative room for rounding in bounds of float64.
SLACK = 1e-9


class Book:
    """The entries of one part position, with block sums and residual norms for each level."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width = entries.shape[1]
        self.levels = []
        for blocks in sorted({min(n, max(width, 1)) for n in LEVELS}):
            cut = np.linspace(0, width, blocks + 1).astype(np.int64)
            self.levels.append((cut, *self.measure(entries, cut)))

    @staticmethod
    def measure(x: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block sums over the roots of their lengths, and the norm of what the means leave."""
        sums, rest = [], np.zeros(len(x))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            n = int(b - a)
            if n == 0:
                continue
            s = x[:, a:b].sum(1)
            sums.append(_float(s) / np.sqrt(n))
            rest += _float((x[:, a:b] * x[:, a:b]).sum(1) * n - s * s) / n
        return np.array(sums).reshape(len(sums), len(x)).T, np.sqrt(rest)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry (the lower one at ties) and the squared distance."""

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            gap = x[i] - self.entries[j]
            return (gap * gap).sum(1) if gap.dtype == object else np.einsum("ij,ij->i", gap, gap)

        every = np.arange(len(x))
        best, alive = None, None
        for cut, sums, rest in self.levels:
            bound = _bounds(*self.measure(x, cut), sums, rest)
            if alive is not None:
                bound[~alive] = np.inf
            # The entries of least bound are measured, for a closer limit.
            order = bound.copy()
            for _ in range(PROBES):
                probe = order.argmin(1)
                near = exact(every, probe)
                best = near if best is None else np.minimum(best, near)
                order[every, probe] = np.inf
            alive = bound <= _float(best)[:, None] * (1 + SLACK)
        row, entry = np.nonzero(alive)
        far = exact(row, entry)
        best = np.minimum.reduceat(far, np.flatnonzero(np.diff(row, prepend=-1)))
        first = np.flatnonzero(far == best[row])
        first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
        return entry[first], best


def _bounds(own: np.ndarray, left: np.ndarray, sums: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For each row and entry, no more than the squared distance that these block sums and residual norms allow."""
    with np.errstate(invalid="ignore", over="ignore"):
        one, two = (own * own).sum(1)[:, None], (sums * sums).sum(1)[None]
        bound = own @ (-2 * sums.T)
        bound += one * (1 - SLACK)
        bound += two * (1 - SLACK)
        np.maximum(bound, 0, out=bound)
        gap = left[:, None] - rest[None]
        np.abs(gap, out=gap)
        gap -= SLACK * (left[:, None] + rest[None])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        bound += gap
    bound[np.isnan(bound)] = 0
    return bound


def _float(values: np.ndarray) -> np.ndarray:
    """As float64; infinite where a Python integer is beyond it."""
    try:
        return values.astype(float)
    except OverflowError:
        top = 1 << 1023
        return np.array([v if -top < v < top else math.inf if v > 0 else -math.inf for v in values], float)


def _limbs(value: int) -> list[int]:
    """Digits in base 2**48, the least first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _whole(values: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """Floors of scaled doubles as 64-bit or, where ``wide``, as Python integers."""
    if not wide:
        return np.floor(values * scale).astype(np.int64)
    out = np.empty(values.shape, object)
    out.reshape(-1)[:] = [int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in values.ravel().tolist()]
    return out


class Coder:
    """Codebooks of all part positions."""

    def __init__(self, entries: np.ndarray, parts: int, scale: int, wide: bool):
        self.parts, self.scale, self.wide = parts, scale, wide
        self.entries = entries  # position, entry, component
        self.books = [Book(e) for e in entries]

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def rows(self, batch: pa.RecordBatch, at: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Slices of a batch with their vectors: row, position, component."""
        values = batch.column(at)
        for a in range(0, batch.num_rows, BATCH):
            some = values.slice(a, BATCH)
            x = np.frombuffer(b"".join(v.as_buffer() for v in some), "<f8").reshape(len(some), self.parts, self.width)
            yield slice(a, a + len(some)), _whole(x, self.scale, self.wide)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances: row, position."""
        found = [book.nearest(x[:, p]) for p, book in enumerate(self.books)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each used entry, component and limb: what this task's parts add up to."""
        total = np.zeros(self.entries.shape, self.entries.dtype)
        count = np.zeros(self.entries.shape[:2], np.int64)
        for batch in batches:
            for _, x in self.rows(batch, 0):
                codes, _ = self.encode(x)
                for p in range(self.parts):
                    np.add.at(total[p], codes[:, p], x[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=count.shape[1])
        out = [(p, e, -1, 0, int(count[p, e])) for p, e in zip(*np.nonzero(count), strict=True)]
        out += [(p, e, i, k, v) for p, e, *_ in out for i in range(self.width) for k, v in enumerate(_limbs(int(total[p, e, i])))]
        for a in range(0, len(out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int64()) for c in zip(*out[a : a + (1 << 16)], strict=True)], ["part", "entry", "pos", "limb", "value"])

    def refined(self, sums: list) -> Coder:
        """Each used entry becomes the floor of its parts' mean."""
        count = np.zeros(self.entries.shape[:2], object)
        total = np.zeros(self.entries.shape, object)
        used = np.zeros(self.entries.shape, bool)
        for part, entry, pos, limb, value in sums:
            if pos < 0:
                count[part, entry] = int(value)
            else:
                used[part, entry, pos] = True
                total[part, entry, pos] += int(value) << LIMB * limb
        new = self.entries.astype(object)
        new[used] = total[used] // np.broadcast_to(count[:, :, None], used.shape)[used]
        return Coder(new if self.wide else new.astype(np.int64), self.parts, self.scale, self.wide)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel()).encode()).hexdigest()


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """Columns: vec_id, code, error, label_error, codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    source = vectors.select(named(id_col).alias("id"), named(label_col).alias("label"), named(vector_col).cast("array<double>").alias("vec"))
    source = source.filter(F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = source.agg(F.max(F.size("vec")).alias("n"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))).alias("x")).first()
    width = -(-(most["n"] or 0) // parts)
    # Everything up to the scaled squares of residual norms must fit into 64 bits.
    wide = (scale * (most["x"] or 0.0) + 1) * max(width, 1) >= 2.0**30

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            x = np.zeros((b.num_rows, parts * width))
            lens = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(b.num_rows), lens)
            x[owner, np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)] = lists.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "vec"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    rows = stored(source.mapInArrow(whole, f"id {kinds['id']}, label {kinds['label']}, vec binary"), "vectors")
    first = source.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    start = np.zeros((len(first), parts * width))
    for i, r in enumerate(first):
        start[i, : len(r["vec"])] = r["vec"]
    start = start.reshape(len(first), parts, width).swapaxes(0, 1)
    coder = Coder(_whole(np.ascontiguousarray(start), scale, wide), parts, scale, wide)
    for _ in range(rounds if first else 0):
        sums = rows.select("vec").mapInArrow(coder.sums, "part long, entry long, pos long, limb long, value long")
        coder = coder.refined(sums.groupBy("part", "entry", "pos", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in coder.rows(b, 2):
                codes, far = coder.encode(x)
                errors = [int(v) for v in far.sum(1)]
                part = b.slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())],
                    ["id", "label", "code", "error"],
                )

    coded = stored(rows.mapInArrow(apply, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    # Stored, so that both sides of the join are plain shuffles, of which a hot label's can be split.
    totals = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(coder.digest()).alias("codebooks_sha256"))
