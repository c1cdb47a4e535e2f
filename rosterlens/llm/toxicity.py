"""Toxicity: a support vector machine on a gapped subsequence kernel with Nyström landmarks.

Marks are the word beginnings and words whose presence in a labelled text says most about
its label; one that a longer one explains as well gives way to it. A word's likeness to a
mark is the string kernel of common subsequences of three characters,
each weighed by ``DECAY`` for every character it spans in the mark and by ``GAP`` for
every one in the word, relative to the mark's own. Each three characters of the mark
count once, where the word has them closest together, so that repeats in a long word don't
add up. An insult with a character put in after each of its own keeps 0.65 to 0.8; up to
``LEAST`` counts as nothing. Punctuation inside a word is passed over, and runs of single
characters are read as one word.

A text's string features are its words' summed likenesses and their density, both whitened
by the marks' kernel matrix. Landmarks are labelled texts, as many of either class; the
kernel of a text and a landmark is the Gaussian of the distance between their string
features, and the Nyström map takes a text's kernels with all landmarks through the inverse
root of the landmarks' own kernel matrix. A linear machine with squared hinge loss on these
coordinates, trained on labelled texts, scores them through a logistic. The Gaussian's width
is the one of least errors in a cross-validation over the training texts.

Only texts are read for scores. At most ``max_rows`` labelled rows (of least hash of the id)
are used for fitting; all words of all texts are scored. Null and empty texts have no
likeness to anything. Without labels of both classes every score is the prior share. Equal
texts get equal scores, repeated rows and ids are scored each, and an empty table gives no
rows. An id labelled more than once is toxic if any of its labels says so. Other columns of
either table aren't read and may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, SPACE, U64, Block, ids_out, prefix_hash, span_hash, streamed, token_spans
from .quality import fold, training_rows
from .shared import named, stored

MAX_ROWS = 6000
MARKS = 40
DECAY = 0.6
#: Decay of a character spanned in a text's word: insertions cost less than gaps in the landmark.
GAP = 0.9
WIDTH = 24
LEAST = 0.45
#: Letters, digits and bytes of wide characters; other bytes are punctuation.
KEPT = np.array([chr(c).isalnum() or c > 127 for c in range(256)])
#: Labelled texts that serve as landmarks, at most; widths of the Gaussian that are tried; weight of the machine's norm.
SENTENCES = 200
GAMMAS = (0.03, 0.1, 0.3)
PENALTY = 0.1
STARTS = (4, 5, 6, 7, 8)


# --------------------------------------------------------------------------- the kernel


def kernel(words: np.ndarray, landmark: bytes, decay: float = DECAY, gap: float | None = None) -> np.ndarray:
    """Weight of common subsequences of length three of each row of ``words`` (zero padded) and the landmark.

    ``decay`` is for characters spanned in the landmark, ``gap`` (the same by default) for those in the word.
    """
    gap = decay if gap is None else gap
    n, width = words.shape
    m = len(landmark)
    same = {c: np.ascontiguousarray((words == c).T, np.float64) * (decay * gap) for c in set(landmark)}
    # tail[q][i][j]: subsequences of length q in s[:i], t[:j], weighed to the ends of both.
    below = [np.ones((width + 1, n))] * (m + 1)
    for q in range(2):
        here = [np.zeros((width + 1, n))] * (q + 1)
        for j in range(q + 1, m + 1):
            run = np.zeros((width + 1, n))
            np.multiply(same[landmark[j - 1]], below[j - 1][:-1], out=run[1:])
            for i in range(2, width + 1):
                run[i] += gap * run[i - 1]
            if j > q + 1:
                run += decay * here[j - 1]
            here.append(run)
        below = here
    total = np.zeros(n)
    for j in range(3, m + 1):
        total += np.einsum("ij,ij->j", same[landmark[j - 1]], below[j - 1][:-1])
    return total


def covered(words: np.ndarray, landmark: bytes, decay: float = DECAY, gap: float = GAP) -> np.ndarray:
    """As ``kernel``, but each three characters of the landmark count once, by where a row has them closest together."""
    at = np.array(list(combinations(range(len(landmark)), 3)))
    one, two, three = np.frombuffer(landmark, np.uint8)[at.T]
    weight = decay ** (at[:, 2] - at[:, 0] + 1.0)
    out = np.empty(len(words))
    step = max(1, (1 << 17) // len(at))
    for k in range(0, len(words), step):
        some = words[k : k + step]
        a, b, c = (np.zeros((len(some), len(at))) for _ in range(3))
        for i in range(words.shape[1]):
            here = some[:, i, None]
            np.maximum(c, (here == three) * b, out=c)
            np.maximum(gap * b, (here == two) * (gap * a), out=b)
            np.maximum(gap * a, (here == one) * gap, out=a)
        out[k : k + step] = c @ weight * gap
    return out


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint8)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w[:width], np.uint8)
    return out


def _bare(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ASCII punctuation before a letter or digit, and those rows without any."""
    sign = (words != 0) & ~KEPT[words]
    at = np.flatnonzero((sign[:, :-1] & (words[:, 1:] != 0)).any(1))
    some, sign = words[at], sign[at]
    order = np.argsort(sign | (some == 0), 1, kind="stable")
    return at, np.take_along_axis(np.where(sign, 0, some), order, 1)


def _letters(words: np.ndarray) -> np.ndarray:
    """A set of each row's characters, as bits (of the byte modulo 64)."""
    bits = (U64(1) << (words & 63).astype(U64)) * (words != 0)
    return np.bitwise_or.reduce(bits, 1)


# ------------------------------------------------------------------------- words of texts


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces (rows of WIDTH bytes), and for each occurrence its piece and document.

    A word over WIDTH bytes gives overlapping pieces; three or more single characters in a
    row also give the word they spell.
    """
    data = LOWER[block.data]
    starts, ends, doc = token_spans(data, block.offsets, SPACE)
    short = ends - starts == 1
    if short.any():
        run = np.flatnonzero(np.diff(np.concatenate([[0], short.astype(np.int8), [0]])))
        spelled = [(a, b) for a, b in run.reshape(-1, 2).tolist() if b - a >= 3]
    else:
        spelled = []
    long = np.flatnonzero(ends - starts > WIDTH)
    if len(long):
        step = WIDTH // 2
        more = [(s + k, min(s + k + WIDTH, e), d) for s, e, d in zip(starts[long].tolist(), ends[long].tolist(), doc[long].tolist(), strict=True) for k in range(0, e - s - step, step)]
        keep = ends - starts <= WIDTH
        a, b, c = (np.array(x, np.int64) for x in zip(*more, strict=True))
        starts_, ends_, doc_ = np.concatenate([starts[keep], a]), np.concatenate([ends[keep], b]), np.concatenate([doc[keep], c])
    else:
        starts_, ends_, doc_ = starts, ends, doc
    extra, base = [], len(data)
    for a, b in spelled:
        for k in range(a, b, WIDTH // 2):
            piece = data[starts[k : min(k + WIDTH, b)]]
            # A spelled run may cross documents: cut it there.
            for d in np.unique(doc[k : min(k + WIDTH, b)]).tolist():
                own = piece[doc[k : min(k + WIDTH, b)] == d]
                if len(own) >= 3:
                    extra.append((own, d))
    if extra:
        size = np.array([len(x) for x, _ in extra])
        at = base + np.cumsum(size) - size
        data = np.concatenate([data, *(x for x, _ in extra)])
        starts_, ends_, doc_ = np.concatenate([starts_, at]), np.concatenate([ends_, at + size]), np.concatenate([doc_, [d for _, d in extra]])
    _, first, where = np.unique(span_hash(prefix_hash(data), starts_, ends_), return_index=True, return_inverse=True)
    s, size = starts_[first], (ends_ - starts_)[first]
    col = np.arange(WIDTH)
    rows = np.where(col < size[:, None], data[np.minimum(s[:, None] + col, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(s) else np.zeros((0, WIDTH), np.uint8)
    return rows, where, doc_


@dataclass
class Machine:
    """Marks with their own kernel values and whitening; landmarks with the inverse root of their kernel matrix; the linear machine."""

    marks: list[bytes]
    reach: np.ndarray
    white: np.ndarray
    gamma: float = 0.0
    landmarks: np.ndarray | None = None
    root: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def string_features(self, features: np.ndarray) -> np.ndarray:
        """Density and logarithm of the summed likenesses, whitened."""
        sums, words = features[:, :-1], features[:, -1:]
        return np.hstack([np.sqrt(100 * sums / (words + 20)) @ self.white, np.log1p(sums) @ self.white])

    def mapped(self, strings: np.ndarray) -> np.ndarray:
        """Nyström coordinates of texts with these string features."""
        return gaussian(strings, self.landmarks, self.gamma) @ self.root

    def with_landmarks(self, strings: np.ndarray, gamma: float) -> Machine:
        value, vector = np.linalg.eigh(gaussian(strings, strings, gamma))
        return replace(self, gamma=gamma, landmarks=strings, root=vector / np.sqrt(np.maximum(value, 1e-6)))

    def fitted(self, strings: np.ndarray, y: np.ndarray) -> Machine:
        x = self.mapped(strings)
        weights, bias = _svm(x, y, PENALTY)
        slope, offset = _platt(x @ weights + bias, y)
        return replace(self, weights=weights, bias=bias, slope=slope, offset=offset)

    def likeness(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each mark the pieces that resemble it, and how much (0 to 1)."""
        # A word with punctuation put in counts as the better of itself and its letters alone.
        n, (spoilt, bare) = len(rows), _bare(rows)
        rows = np.concatenate([rows, bare])
        have = _letters(rows)
        for k, mark in enumerate(self.marks):
            need = _letters(_matrix([mark], WIDTH))[0]
            missing = np.bitwise_count(need & ~have)
            at = np.flatnonzero(missing <= int(need).bit_count() // 4)
            if not len(at):
                continue
            size = (rows[at] != 0).sum(1)
            value = np.empty(len(at))
            for width in (8, 16, WIDTH):
                fit = (size <= width) & (size > {8: -1, 16: 8, WIDTH: 16}[width])
                where = np.flatnonzero(fit)
                for part in range(0, len(where), 4096):
                    some = where[part : part + 4096]
                    value[some] = kernel(rows[at[some], :width], mark, gap=GAP) / self.reach[k]
            # The kernel is never less than the likeness.
            more = np.flatnonzero(value > LEAST)
            value[more] = covered(rows[at[more]], mark) / self.reach[k]
            best = np.zeros(len(rows))
            best[at] = np.clip((np.minimum(value, 1) - LEAST) / (1 - LEAST), 0, 1)
            best[spoilt] = np.maximum(best[spoilt], best[n:])
            at = np.flatnonzero(best[:n])
            yield k, at, best[at]

    def features(self, block: Block) -> np.ndarray:
        """Summed likeness of each document's words to each mark, and the number of words."""
        out = np.zeros((len(block.ids), len(self.marks) + 1))
        rows, where, doc = words_of(block)
        if not len(where):
            return out
        out[:, -1] = np.bincount(doc, minlength=len(out))
        order = np.argsort(where, kind="stable")
        edge = np.searchsorted(where[order], np.arange(len(rows) + 1))
        for k, at, value in self.likeness(rows):
            n = edge[at + 1] - edge[at]
            flat = order[np.arange(n.sum()) + np.repeat(edge[at] - (np.cumsum(n) - n), n)]
            out[:, k] += np.bincount(doc[flat], np.repeat(value, n), len(out))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return self.judged(self.string_features(features)) if self.marks else self.judged(np.zeros((len(features), 0)))

    def judged(self, strings: np.ndarray) -> np.ndarray:
        margin = self.mapped(strings) @ self.weights + self.bias if self.marks else np.full(len(strings), self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def gaussian(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.exp(-gamma * np.maximum(far, 0))


def choose_landmarks(strings: np.ndarray, y: np.ndarray, most: int = SENTENCES) -> np.ndarray:
    """Distinct training texts that resemble some mark, evenly from both classes, and the text that resembles none."""
    some = strings.any(1)
    kinds = [np.unique(strings[some & (y == k)], axis=0) for k in (0, 1)]
    share = [min(len(k), most // 2) for k in kinds]
    share = [min(len(k), most - other) for k, other in zip(kinds, share[::-1], strict=True)]
    picked = [k[np.linspace(0, len(k) - 1, n).round().astype(int)] for k, n in zip(kinds, share, strict=True) if n]
    return np.concatenate([np.zeros((1, strings.shape[1])), *picked])


def _errors(machine: Machine, strings: np.ndarray, y: np.ndarray, folds: int = 3) -> int:
    """Wrong verdicts on texts that were left out in turn."""
    out, fold_of = 0, np.arange(len(y)) % folds
    for k in range(folds):
        own, left = fold_of != k, fold_of == k
        if 0 < y[own].sum() < own.sum():
            out += int(((machine.fitted(strings[own], y[own]).judged(strings[left]) >= 0.3) != (y[left] == 1)).sum())
    return out


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared hinge loss with classes weighed alike, by Newton steps."""
    sign = 2 * y - 1
    f = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(f.shape[1])
    reg = np.eye(f.shape[1]) * penalty
    reg[-1, -1] = 1e-6
    for _ in range(50):
        live = sign * (f @ w) < 1
        a = f[live] * weight[live, None]
        new = np.linalg.solve(a.T @ f[live] + reg, a.T @ sign[live])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    f, w = np.column_stack([m, np.ones(len(m))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve(f.T @ (f * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), f.T @ (p - y) + 0.05 * (w - [1, 0]))
        w = w - np.clip(step, -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


# ----------------------------------------------------------------------------- training


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: word beginnings and words, with the numbers of (toxic) texts that have them once, and twice or more."""
    for block in streamed(batches):
        label = block.extra["rows"].column(2).to_numpy(zero_copy_only=False)
        rows, where, doc = words_of(block)
        pair, times = np.unique(doc * (len(rows) + 1) + where, return_counts=True) if len(where) else (np.zeros(0, np.int64),) * 2
        of, piece = pair // (len(rows) + 1), pair % (len(rows) + 1)
        words = [r.tobytes().rstrip(b"\0") for r in rows]
        table: dict[bytes, list[int]] = {}
        edge = np.searchsorted(of, np.arange(len(block.ids) + 1)).tolist()
        for d, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            own: Counter[bytes] = Counter()
            for p, n in zip(piece[a:b].tolist(), times[a:b].tolist(), strict=True):
                w = words[p]
                for k in STARTS:
                    if len(w) > k:
                        own[w[:k]] += n
                if len(w) >= STARTS[0]:
                    own[w] += n
            for mark, n in own.items():
                row = table.setdefault(mark, [0, 0, 0, 0])
                row[0] += 1
                row[2] += n > 1
                if label[d]:
                    row[1] += 1
                    row[3] += n > 1
        cols = list(zip(*table.values(), strict=True)) if table else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.binary()), *(pa.array(c, pa.int64()) for c in cols)], ["mark", "seen", "toxic", "seen2", "toxic2"])


def wilson(toxic, seen, z: float = 2.0):
    """Lower bound of a share; null or zero counts give zero."""
    p = toxic / seen
    return (p + z * z / (2 * seen) - z * ((p * (1 - p) + z * z / (4 * seen)) / seen) ** 0.5) / (1 + z * z / seen)


def choose(marks: list[tuple[bytes, int]], most: int) -> list[bytes]:
    """Marks from (string, toxic texts), best first: none that an earlier one covers."""
    out: list[bytes] = []
    for mark, toxic in sorted(marks, key=lambda x: (-x[1], -len(x[0]), x[0])):
        if len(out) == most:
            break
        if any(mark.startswith(o) or o.startswith(mark) for o in out):
            continue
        # The longest extension that is nearly as frequent says the same and more.
        out.append(max((m for m, t in marks if m.startswith(mark) and t >= 0.98 * toxic), key=len, default=mark))
    return out


def train(rows: DataFrame, most: int = MARKS) -> Machine:
    """A machine from (id, text, label) rows."""
    base = rows.groupBy("label").agg(F.count("*").alias("n")).collect()
    n = {r["label"]: r["n"] for r in base}
    share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1.0)
    empty = Machine([], np.zeros(0), np.zeros((0, 0)), offset=math.log(share / (1 - share)))
    if not n.get(0) or not n.get(1):
        return empty
    columns = ("seen", "toxic", "seen2", "toxic2")
    table = rows.mapInArrow(_candidates, "mark binary" + "".join(f", {c} long" for c in columns)).groupBy("mark").agg(*(F.sum(c).alias(c) for c in columns))
    # Wilson's lower bound of the toxic share, among texts that have the string or have it twice, must be well above the base rate.
    once = F.coalesce(wilson(F.col("toxic"), F.nullif("seen", F.lit(0))), F.lit(0.0))
    twice = F.coalesce(wilson(F.col("toxic2"), F.nullif("seen2", F.lit(0))), F.lit(0.0))
    good = table.filter(F.greatest(once, twice) > min(0.5, 4 * share))
    good = good.orderBy(F.desc("toxic"), F.desc(F.length("mark")), "mark").limit(40 * most).collect()
    marks = choose([(bytes(r["mark"]), r["toxic"]) for r in good], most)
    if not marks:
        return empty
    width = max(map(len, marks))
    own = np.array([kernel(_matrix([m], len(m)), m)[0] for m in marks])
    gram = np.array([kernel(_matrix(marks, width), m) for m in marks]) / np.sqrt(own[:, None] * own[None, :])
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 0.1 * np.eye(len(marks)))
    white = vector / np.sqrt(np.maximum(value, 0.05)) @ vector.T
    reach = np.array([covered(_matrix([m], len(m)), m)[0] for m in marks])
    machine = Machine(marks, reach, white)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in streamed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(machine.features(block)), pa.list_(pa.float64())), block.extra["rows"].column(2)], ["x", "label"])

    got = rows.mapInArrow(vectors, "x array<double>, label int").toPandas()
    x, y = np.array(got["x"].tolist()), got["label"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])
    strings, y = machine.string_features(x[order]), y[order]
    landmarks = choose_landmarks(strings, y)
    tried = [machine.with_landmarks(landmarks, g) for g in GAMMAS]
    return min(tried, key=lambda m: _errors(m, strings, y)).fitted(strings, y)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 4,
    remainder: int = 2,
    threshold: float = 0.3,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Columns: doc_id, held_out, score, predicted; a row for each of ``docs``, repeated ones too."""
    return _judged(docs, labels, label_col, id_col, text_col, modulus, remainder, threshold, max_rows, ())


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows predicted as toxic; all its columns, whatever their names."""
    judged = _judged(docs, labels, **({"label_col": "toxic", "modulus": 4, "remainder": 2, "threshold": 0.3, "max_rows": MAX_ROWS} | options), id_col=id_col, text_col=text_col, keep=tuple(docs.columns))
    return judged.filter("predicted = 0").select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)))


def _judged(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, modulus: int, remainder: int, threshold: float, max_rows: int, keep: tuple[str, ...]) -> DataFrame:
    """``classify`` with the columns named in ``keep`` as kept_0, kept_1 and so on."""
    machine = train(stored(training_rows(docs, labels, label_col, id_col, text_col, modulus, remainder, max_rows), "training"))
    names = [f"kept_{i}" for i in range(len(keep))]
    texts = [i for i, c in enumerate(keep) if c == text_col]
    others = [i for i, c in enumerate(keep) if c != text_col]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in streamed(batches):
            rows = block.extra["rows"]
            s = machine.score(machine.features(block))
            yield pa.RecordBatch.from_arrays([ids_out(block.ids), rows.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *(rows.column(1) for _ in texts), *(rows.column(3 + i) for i in range(len(others)))], ["doc_id", "held_out", "score", "predicted", *(names[i] for i in texts + others)])

    source = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"), fold(named(id_col), modulus, remainder).alias("held_out"), *(named(keep[i]).alias(names[i]) for i in others))
    schema = "doc_id long, held_out boolean, score double, predicted int" + "".join(f", {names[i]} string" for i in texts) + "".join(f", {names[i]} {source.schema[names[i]].dataType.simpleString()}" for i in others)
    return source.mapInArrow(apply, schema)
