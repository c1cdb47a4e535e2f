"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a fixed vector of transformed statistics, counted from its whole bytes.
Each class has a mean and a covariance shrunk towards the pooled one and towards its
diagonal; the score is the logistic of the difference of the classes' Mahalanobis
log-densities, from Cholesky factors computed once, scaled on the training rows.

Statistics are computed from the text alone. At most ``max_rows`` labelled rows, those of
least hash of the id, are used for fitting. Null and empty texts have the statistics of no
bytes and get a score like all others; without labelled rows of both classes each score
is the share of class 1 (one half, if there is none). Equal texts get equal scores, repeated
rows and ids are scored each, and an empty table gives no rows. An id labelled more than
once has the larger label; of an id with more than one text, the one of least hash is used
for fitting. Other columns of either table aren't read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, Block, ids_out, prefix_hash, span_hash, streamed, token_spans
from .shared import named

MAX_ROWS = 20_000
SHRINK = 0.1
RIDGE = 0.02

_KINDS = 12
#: Class of each byte: letters, case, digits, space, line ends, and kinds of punctuation.
_KIND = np.zeros(256, np.int64)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9, 11, 12]] = 4
_KIND[[10, 13]] = 5
_KIND[[ord("."), ord(",")]] = 6
_KIND[[ord("!"), ord("?")]] = 7
_KIND[ord("|")] = 8
_KIND[[ord(c) for c in "*#%$&@^~=+<>_\\"]] = 9
_KIND[128:] = 10
NAMES = (
    "log_bytes", "upper", "digit", "line", "stop", "shout", "bar", "symbol", "other", "high", "word_length", "word_spread",
    "distinct", "repeat", "line_repeat", "words_per_stop",
)


def statistics(block: Block) -> np.ndarray:
    """One row of transformed statistics (``NAMES``) for each document."""
    n_docs, lens, offsets = len(block.ids), np.maximum(block.lens, 0), block.offsets
    owner = np.repeat(np.arange(n_docs), lens)
    count = np.bincount(owner * _KINDS + _KIND[block.data], minlength=n_docs * _KINDS).reshape(n_docs, _KINDS).astype(float)
    size = np.maximum(lens, 1).astype(float)
    prefix = prefix_hash(block.data)
    starts, ends, doc = token_spans(block.data, offsets, SPACE)
    words = np.bincount(doc, minlength=n_docs).astype(float)
    some = np.maximum(words, 1)
    width = (ends - starts).astype(float)
    mean = np.bincount(doc, width, n_docs) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, width * width, n_docs) / some - mean * mean, 0))
    h = span_hash(prefix, starts, ends)
    repeat = np.bincount(doc[1:], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), n_docs) / some if len(h) else np.zeros(n_docs)
    distinct = _distinct(h, doc, n_docs) / np.sqrt(some)
    line = np.zeros(256, bool)
    line[10] = True
    a, b, of = token_spans(block.data, offsets, line)
    lines = np.maximum(np.bincount(of, minlength=n_docs), 1)
    again = 1 - _distinct(span_hash(prefix, a, b), of, n_docs) / lines
    again[np.bincount(of, minlength=n_docs) == 0] = 0
    rate = lambda k: np.log(count[:, k] / size + 0.002)
    return np.column_stack([
        np.log1p(lens), rate(2), rate(3), rate(5), rate(6), rate(7), rate(8), rate(9), rate(0), np.sqrt(count[:, 10] / size),
        np.log1p(mean), np.log1p(spread), np.log(distinct + 0.05), np.log(repeat + 0.01), np.sqrt(again), np.log1p(words / (count[:, 6] + 1)),
    ])


def _distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    edge = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
    return np.array([len(np.unique(h[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)], float)


@dataclass
class Discriminant:
    """Two Gaussians with shrunk covariances; ``score`` is the probability of class 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # inverses of the Cholesky factors
    logdets: np.ndarray
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Discriminant:
        d = x.shape[1] if x.ndim == 2 else len(NAMES)
        rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
        prior = float(np.log(rate / (1 - rate)))
        if len(y) < 4 or min((y == k).sum() for k in (0, 1)) < 2:
            flat = np.zeros((2, d))
            return cls(np.zeros(d), np.ones(d), flat, np.zeros((2, d, d)), np.zeros(2), prior)
        centre, scale = x.mean(0), x.std(0) + 1e-6
        z = (x - centre) / scale
        parts = [z[y == k] for k in (0, 1)]
        means = np.array([p.mean(0) for p in parts])
        pooled = sum((p - m).T @ (p - m) for p, m in zip(parts, means, strict=True)) / len(z)
        factors, logdets = [], []
        for p, m in zip(parts, means, strict=True):
            own = (p - m).T @ (p - m) / len(p)
            weight = SHRINK + (1 - SHRINK) * d / (d + len(p))
            cov = (1 - weight) * own + weight * pooled
            cov = (1 - RIDGE) * cov + RIDGE * np.eye(d)
            low = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(low))
            logdets.append(2 * np.log(np.diag(low)).sum())
        out = cls(centre, scale, means, np.array(factors), np.array(logdets), prior)
        out._calibrate(out.margin(x), y)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        logp = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * g for m, f, g in zip(self.means, self.factors, self.logdets, strict=True)]
        return logp[1] - logp[0] + self.prior

    def _calibrate(self, m: np.ndarray, y: np.ndarray) -> None:
        """Newton steps of a logistic fit to the squashed margins."""
        f = np.column_stack([_squash(m), np.ones(len(m))])
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            g = f.T @ (p - y) + 1e-2 * (w - [1, 0])
            step = np.linalg.solve(f.T @ (f * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), g)
            w = w - np.clip(step, -1, 1)
        self.slope, self.offset = float(max(w[0], 1e-3)), float(w[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _squash(self.margin(x)) + self.offset, -30, 30)))


def _squash(m: np.ndarray) -> np.ndarray:
    return np.sign(m) * np.log1p(np.abs(m))


def fold(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id does not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """(id, text, label) of up to ``most`` labelled rows outside the held-out fold."""
    marks = labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("label")).filter("label is not null and id is not null")
    marks = marks.filter(~fold(F.col("id"), modulus, remainder)).groupBy("id").agg(F.max("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    # One row for each id, however often the table repeats it.
    rows = texts.join(F.broadcast(marks), "id").groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return rows.select("id", "text", "label")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 5,
    remainder: int = 0,
    threshold: float = 0.3,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Columns: doc_id, held_out, score, predicted."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in streamed(batches):
            x = statistics(block)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), block.extra["rows"].column(2)], ["x", "label"])

    rows = training_rows(docs, labels, label_col, id_col, text_col, modulus, remainder, max_rows).mapInArrow(vectors, "x array<double>, label int").toPandas()
    x = np.array(rows["x"].tolist()) if len(rows) else np.zeros((0, len(NAMES)))
    order = np.lexsort(x.T) if len(rows) else []
    model = Discriminant.fit(x[order], rows["label"].to_numpy()[order].astype(float))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in streamed(batches):
            s = model.score(statistics(block))
            yield pa.RecordBatch.from_arrays([ids_out(block.ids), block.extra["rows"].column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"), fold(named(id_col), modulus, remainder).alias("held_out"))
    return source.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
