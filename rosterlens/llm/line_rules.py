"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Each line with a word has a fixed set of statistics, put into bins; a bin's weight is added to the
line's score for being boilerplate, and a transition weight to each pair of neighbouring marks.
Weights are fitted by likelihood (forward-backward sums) on lines of labelled documents: lines of good
documents are content; those of bad ones are boilerplate at first, and in a second round those of them that
the first model decodes as content are content. Weights are rounded to fixed point, so that decoding adds integers:
its result doesn't hang on order or blocks. Viterbi's best scores and back pointers are composed by doubling
steps over all documents of a block at once, so a text of very many lines takes no loop over lines.

The share of a document's words that stand in content lines decides: below ``share`` it goes. The base rules come
first: too few words, or too many in repeated windows of three words, fail a document whatever its lines are.

Fitting takes at most ``max_rows`` labelled documents (those of least hash of the id, outside of the held-out
fold), and of one with more than ``RUNS`` runs of ``RUN`` lines evenly spaced runs. Everything else reads whole texts.

Null and empty texts have no words and fail the base rules. Without labels of both classes all lines are content.
Equal texts get equal results; repeated rows and ids are judged each. An empty table gives no rows. Other columns of
either table aren't read and may have any name. Words and lines are compared by 64-bit hashes within their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, U64, Block, ids_out, mix, prefix_hash, span_hash, streamed, token_spans
from .quality import training_rows
from .shared import named

MAX_ROWS = 6_000
#: Lines of a training run, and runs of a document.
RUN, RUNS = 64, 8
SHARE = 0.5
#: One in fixed-point weights.
ONE = 1 << 20
ITERATIONS = 200

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Upper edges of each statistic's bins.
EDGES = {
    "words": (1.5, 3.5, 7.5, 15.5, 31.5, 63.5),
    "word_length": (2.5, 4.0, 5.0, 6.0, 8.0, 12.0),
    "upper": (0.02, 0.06, 0.15, 0.3, 0.7),
    "capitals": (0.05, 0.15, 0.3, 0.5, 0.8),
    "symbols": (0.001, 0.05, 0.2, 0.5),
    "bars": (0.001, 0.1, 0.3, 0.45),
    "shouts": (0.001, 0.1, 0.5),
    "digits": (0.001, 0.05, 0.2),
    "stops": (0.001, 0.05, 0.1, 0.2, 0.5),
    "echoes": (0.001, 0.1, 0.3),
    "distinct": (0.3, 0.5, 0.7, 0.9),
    "again": (0.5,),
    "first": (0.5,),
}
_WIDTH = np.array([len(e) + 1 for e in EDGES.values()])
_OFFSET = np.cumsum(_WIDTH) - _WIDTH
FEATURES = int(_WIDTH.sum())


@dataclass
class Lines:
    """Lines with a word of a block's documents, and the counts of the base rules for each document."""

    doc: np.ndarray
    place: np.ndarray  # the line's number in its text, from 0
    words: np.ndarray
    bins: np.ndarray  # line, statistic: index into the weights
    base: dict[str, np.ndarray]

    @classmethod
    def read(cls, block: Block) -> Lines:
        data, offsets, n_docs = block.data, block.offsets, len(block.ids)
        prefix = prefix_hash(data)
        starts, ends, doc = token_spans(data, offsets, SPACE)
        upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        before = upto(data == 10)
        number = before[starts] - before[offsets[doc]]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(fresh)
        line = np.cumsum(fresh) - 1
        n = len(head)
        of, place = doc[head], number[head]
        # The whole line, from the line end before its first word to the one behind its last.
        breaks = np.flatnonzero(data == 10)
        a = np.maximum(offsets[of], np.concatenate([[0], breaks + 1])[np.searchsorted(breaks, starts[head])]) if n else head
        b = np.minimum(offsets[of + 1], np.append(breaks, len(data))[np.searchsorted(breaks, starts[head])]) if n else head
        earlier = _earlier(of, span_hash(prefix, a, b))
        chars = upto((data & 0xC0) != 0x80)
        own = chars[ends] - chars[starts]
        words = np.bincount(line, minlength=n)
        each = lambda weights: np.bincount(line, weights, n)
        inside = lambda mask: (lambda c: c[b] - c[a])(upto(mask)).astype(float)
        h = span_hash(prefix, starts, ends)
        capital = (data[starts] >= 65) & (data[starts] <= 90) if n else fresh
        echo = np.zeros(len(doc), bool)
        echo[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        some, size = np.maximum(words, 1), np.maximum(inside((data & 0xC0) != 0x80), 1)
        upper, lower = inside((data >= 65) & (data <= 90)), inside((data >= 97) & (data <= 122))
        values = {
            "words": words, "word_length": each(own) / some, "upper": upper / np.maximum(upper + lower, 1), "capitals": each(capital) / some,
            "symbols": inside(_SYMBOL[data]) / some, "bars": inside(data == ord("|")) / some, "shouts": inside((data == ord("!")) | (data == ord("?"))) / some,
            "digits": inside((data >= 48) & (data <= 57)) / size, "stops": inside((data == ord(".")) | (data == ord(","))) / some,
            "echoes": each(echo) / some, "distinct": each(~_earlier(line, h)) / some, "again": earlier.astype(float), "first": (place == 0).astype(float),
        }
        bins = np.stack([np.searchsorted(EDGES[k], values[k]) for k in EDGES], 1) + _OFFSET if n else np.zeros((0, len(EDGES)), np.int64)
        count = lambda x: np.bincount(doc, x, n_docs).astype(np.int64)
        symbols = upto(_SYMBOL[data])
        base = {
            "n_words": count(np.ones(len(doc))),
            "word_chars": count(own),
            "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
            "n_dup_lines": np.bincount(of, earlier, n_docs).astype(np.int64),
            "n_repeat_words": count(_repeated(doc, h)),
        }
        return cls(of, place, words, bins, base)


def _earlier(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether an equal value stands before in the same group."""
    order = np.lexsort((h, group))
    g, v = group[order], h[order]
    out = np.zeros(len(h), bool)
    out[order[1:]] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    return out


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a word is in a window of three that its document has twice or more."""
    out = np.zeros(len(h), bool)
    if len(h) < 3:
        return out
    window = mix(mix(mix(h[:-2]) ^ h[1:-1]) ^ h[2:] ^ U64(0x9E3779B97F4A7C15))
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    order = whole[np.lexsort((window[whole], doc[whole]))]
    same = (doc[order[1:]] == doc[order[:-1]]) & (window[order[1:]] == window[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    for k in range(3):
        out[at + k] = True
    return out


# --------------------------------------------------------------------------- the field


@dataclass
class Field:
    """Weights of bins (for boilerplate) and transitions, in fixed point."""

    weights: np.ndarray
    steps: np.ndarray  # from, to

    @classmethod
    def none(cls) -> Field:
        return cls(np.zeros(FEATURES, np.int64), np.zeros((2, 2), np.int64))

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Each line's score for being content (0) and boilerplate (1)."""
        out = np.zeros((len(bins), 2), np.int64)
        out[:, 1] = self.weights[bins].sum(1)
        return out

    def decode(self, doc: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The best marks of each document's lines; 1 is boilerplate. Ties are content."""
        n = len(doc)
        if not n:
            return np.zeros(0, np.int64)
        fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, n))
        at = np.arange(n) - np.repeat(head, size)
        left = np.repeat(size, size) - at - 1
        most = int(size.max())
        emit = self.scores(bins)
        # best[i, x, y]: score of the best marks from behind a mark x to mark y of line i; the first line has no step.
        best = emit[:, None, :] + np.where(fresh[:, None, None], 0, self.steps[None])
        step = 1
        while step < most:
            i = np.flatnonzero(at >= step)
            best[i] = (best[i - step][:, :, :, None] + best[i][:, None, :, :]).max(2)
            step *= 2
        upto = best[:, 0]
        # back[i, y]: the mark of line i before mark y of the next line, then of the document's last.
        back = np.broadcast_to(np.arange(2), (n, 2)).copy()
        i = np.flatnonzero(left > 0)
        back[i] = (upto[i][:, 1, None] + self.steps[None, 1] > upto[i][:, 0, None] + self.steps[None, 0]).astype(np.int64)
        step = 1
        while step < most:
            i = np.flatnonzero(left >= step)
            back[i] = np.take_along_axis(back[i], back[i + step], 1)
            step *= 2
        last = np.repeat(head + size - 1, size)
        return back[np.arange(n), (upto[last, 1] > upto[last, 0]).astype(np.int64)]

    @classmethod
    def fit(cls, bins: np.ndarray, run: np.ndarray, marks: np.ndarray, iterations: int = ITERATIONS, decay: float = 1.0) -> Field:
        """Maximum likelihood with a Gaussian prior, by resilient gradient steps. Runs have up to RUN lines."""
        x, steps = np.zeros(FEATURES), np.zeros((2, 2))
        head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.append(head, len(run)))
        order = np.argsort(-size, kind="stable")  # the longest first: those still running are a prefix
        head, size = head[order], size[order]
        live = [head[: np.searchsorted(-size, -t)] + t for t in range(int(size[0]))]
        seen = np.bincount(bins.ravel(), np.repeat(marks, bins.shape[1]), FEATURES)
        inner = np.flatnonzero(run[1:] == run[:-1])
        pairs = np.bincount(marks[inner] * 2 + marks[inner + 1], minlength=4).reshape(2, 2).astype(float)
        theta, grown = np.concatenate([x, steps.ravel()]), np.zeros(FEATURES + 4)
        pace = np.full(FEATURES + 4, 0.1)
        for _ in range(iterations):
            x, steps = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
            emit = np.zeros((len(run), 2))
            emit[:, 1] = x[bins].sum(1)
            ahead, behind = np.zeros((len(run), 2)), np.zeros((len(run), 2))
            for t, rows in enumerate(live):
                ahead[rows] = emit[rows] + (np.logaddexp.reduce(ahead[rows - 1][:, :, None] + steps, 1) if t else 0)
            for rows in reversed(live[1:]):
                behind[rows - 1] = np.logaddexp.reduce(steps[None] + (emit[rows] + behind[rows])[:, None, :], 2)
            total = np.logaddexp.reduce(ahead + behind, 1)
            expected = np.exp(ahead[:, 1] + behind[:, 1] - total)
            both = np.exp(ahead[inner][:, :, None] + steps + (emit[inner + 1] + behind[inner + 1])[:, None, :] - total[inner][:, None, None]).sum(0)
            gradient = np.concatenate([seen - np.bincount(bins.ravel(), np.repeat(expected, bins.shape[1]), FEATURES), (pairs - both).ravel()]) - decay * theta
            turn = np.sign(gradient) * np.sign(grown)
            pace = np.clip(np.where(turn > 0, pace * 1.2, np.where(turn < 0, pace * 0.5, pace)), 1e-6, 1.0)
            grown = np.where(turn < 0, 0, gradient)
            theta = theta + np.sign(grown) * pace
        fixed = np.clip(np.rint(theta * ONE), -(1 << 30), 1 << 30).astype(np.int64)
        return cls(fixed[:FEATURES], fixed[FEATURES:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0, max_rows: int = MAX_ROWS) -> Field:
    """A field fitted on labelled documents outside of the fold."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in streamed(batches):
            lines = Lines.read(block)
            edge = np.searchsorted(lines.doc, np.arange(len(block.ids) + 1))
            out = []
            for a, b, label in zip(edge[:-1], edge[1:], block.extra["rows"].column(2).to_pylist(), strict=True):
                cuts = np.arange(a, b, RUN)
                for c in cuts[np.unique(np.linspace(0, len(cuts) - 1, min(RUNS, len(cuts))).astype(np.int64))] if len(cuts) else ():
                    out.append((lines.bins[c : min(c + RUN, b)].astype(np.uint8).tobytes(), label))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.binary()), pa.array([y for _, y in out], pa.int32())], ["bins", "label"])

    rows = training_rows(docs, labels, label_col, id_col, text_col, modulus, remainder, max_rows).mapInArrow(runs, "bins binary, label int").collect()
    rows = sorted((bytes(r["bins"]), r["label"]) for r in rows)
    if len({y == 1 for _, y in rows}) < 2:
        return Field.none()
    bins = np.frombuffer(b"".join(b for b, _ in rows), np.uint8).reshape(-1, len(EDGES)).astype(np.int64)
    size = [len(b) // len(EDGES) for b, _ in rows]
    run, bad = np.repeat(np.arange(len(rows)), size), np.repeat([int(y != 1) for _, y in rows], size)
    first = Field.fit(bins, run, bad)
    return Field.fit(bins, run, bad & first.decode(run, bins))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))


def judge(
    docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, least_words: int = 50, repeat_percent: int = 50
) -> DataFrame:
    """Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_content_lines, content_words."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in streamed(batches):
            lines, n = Lines.read(block), len(block.ids)
            content = field.decode(lines.doc, lines.bins) == 0
            words = lines.base["n_words"]
            inside = np.bincount(lines.doc, lines.words * content, n).astype(np.int64)
            failed = (words < least_words) | (100 * lines.base["n_repeat_words"] > repeat_percent * words)
            kept = ~failed & (inside >= share * words)
            yield pa.RecordBatch.from_arrays(
                [ids_out(block.ids), *(pa.array(v) for v in lines.base.values()), pa.array(failed), pa.array(kept), pa.array(np.bincount(lines.doc, minlength=n)), pa.array(np.bincount(lines.doc, content, n).astype(np.int64)), pa.array(inside)],
                ["doc_id", *lines.base, "base_failed", "kept", "n_lines", "n_content_lines", "content_words"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_words long"
    return _source(docs, id_col, text_col).mapInArrow(apply, schema)


def marks(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line with a word: doc_id, line (from 0, counting empty ones), content."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in streamed(batches):
            lines = Lines.read(block)
            yield pa.RecordBatch.from_arrays([ids_out(block.ids[lines.doc]), pa.array(lines.place), pa.array(field.decode(lines.doc, lines.bins) == 0)], ["doc_id", "line", "content"])

    return _source(docs, id_col, text_col).mapInArrow(apply, "doc_id long, line long, content boolean")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``judge`` by a field fitted on the labels."""
    return judge(docs, fit(docs, labels, label_col, id_col, text_col), id_col, text_col, **options)
