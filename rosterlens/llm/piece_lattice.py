"""SentencePiece encoding by sampling over the piece lattice, and lossless decoding.

A text's lattice has a node at each byte and an arc for each vocabulary piece that fits
there (a space stands for the model's word mark; a character that is no piece has its byte
pieces). Forward filtering sums the weights of all paths to each node; backward sampling
draws a path from the end, each arc with its posterior share. Draws come from a hash of the
row's key and the place in the text, so a segmentation is the same on every run, however
rows are dealt. Pieces neither hold an inner space nor a line end, so the lattice falls
into independent words; each distinct word is filtered once per worker. A walk down the
vocabulary's trie from all bytes of the new words at once finds the arcs, and filtering and
sampling run over all words of a block. No normalisation: decoding gives back the bytes.

Weights are ``-theta * log(rank + 2)``, the rank being that of the piece's merge. Null and
empty texts have no pieces; a null id draws as the key 0. Equal ids with equal texts get
equal pieces; repeated rows are encoded each, and an empty table gives no rows. Only the id
and text columns are read; others may have any name. With the exponent of 1, the ranks' Zipf
law, samples are finer than the likeliest path, as wanted for regularisation; a larger
``theta`` brings them nearer to it. The model file is a parameter and is never trained or copied.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import U64, Block, ids_out, mix, prefix_hash, span_hash, streamed
from .shared import named

THETA = 1.0
CACHE_ARCS = 1_000_000
#: Words of more bytes are filtered and sampled one by one; the others all at once, byte by byte.
LONG = 256
#: Added to a draw's counter for each step. Fixed value.
STEP = 0x9E3779B97F4A7C15


class Lattices:
    """The vocabulary as a trie, and the arcs of the words met so far with their posterior shares."""

    def __init__(self, model_path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        own: dict[bytes, tuple[int, float]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_of[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                own.setdefault(self.bytes_of[i], (i, -theta * math.log(2 + max(0.0, -model.get_score(i)))))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so decoding couldn't be lossless")
        self.byte_weight = -1.5 * theta * math.log(n + 2)
        self.in_words = not any(b" " in p.lstrip(b" ") or b"\n" in p for p in own)
        self.lens = np.array([len(x) for x in self.bytes_of], np.int64)
        self.at = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._plant(own)
        self.reset()

    def _plant(self, own: dict[bytes, tuple[int, float]]) -> None:
        """A trie over the pieces: sorted keys (state, byte), the state each leads to, and the piece of each state."""
        child: dict[int, int] = {}
        piece, weight = [-1], [0.0]
        for text, (i, w) in own.items():
            state = 0
            for c in text:
                key = state << 8 | c
                state = child.setdefault(key, len(piece))
                if state == len(piece):
                    piece.append(-1)
                    weight.append(0.0)
            piece[state], weight[state] = i, w
        self.edges = np.array(sorted(child), np.int64)
        self.leads = np.array([child[k] for k in self.edges.tolist()], np.int64)
        self.piece, self.weight = np.array(piece, np.int64), np.array(weight)

    def reset(self) -> None:
        self.words = np.zeros(0, U64)
        self.ends = np.zeros(0, np.int64)  # the last node of each word
        self.into = np.zeros(0, np.int64)  # the first arc into each node
        self.cum, self.ids, self.logp = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.float32)

    def _arcs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, length, piece and log-weight of all arcs; ``ends`` has the end of each position's word."""
        at, state = np.arange(len(data)), np.zeros(len(data), np.int64)
        covered = np.zeros(len(data), bool)
        found = []
        size = 0
        while len(at):
            key = state << 8 | data[at + size]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            live = self.edges[place] == key
            at, state = at[live], self.leads[place[live]]
            size += 1
            hit = self.piece[state] >= 0
            begin, node = at[hit], state[hit]
            found.append((begin, np.full(len(begin), size), self.piece[node], self.weight[node]))
            if size <= 4:
                first = data[begin]
                width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0).astype(int)
                for k in range(size):
                    covered[begin[(width == size) & ~((first >= 0x80) & (first < 0xC0))] + k] = True
            live = at + size < ends[at]
            at, state = at[live], state[live]
        bare = np.flatnonzero(~covered)
        found.append((bare, np.ones(len(bare), np.int64), self.byte_id[data[bare]], np.full(len(bare), self.byte_weight)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Forward filtering of new words: a node for each byte and one more, arcs by node with cumulated shares."""
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        stop = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        start, length, piece, weight = self._arcs(data, stop[word])
        word = word[start]
        source = start + word
        depth = start - (stop - size)[word] + length
        # Arcs in order of their end's place in the word, short words before long ones; ends of all words advance together.
        long = size[word] > LONG
        order = np.argsort(np.where(long, LONG + 1, depth) * (len(data) + len(words) + 1) + source + length, kind="stable")
        source, length, piece, weight, depth, long = (x[order] for x in (source, length, piece, weight, depth, long))
        target = source + length
        new = np.ones(len(target), bool)
        new[1:] = target[1:] != target[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(target)))
        alpha = np.zeros(len(data) + len(words))
        step = np.searchsorted(np.where(long[first], LONG + 1, depth[first]), np.arange(1, LONG + 3))
        for a, b in zip(step[:-1].tolist(), step[1:].tolist(), strict=True):
            if a == b or long[first[a]]:
                continue
            lo, hi = first[a], first[b] if b < len(first) else len(target)
            value = alpha[source[lo:hi]] + weight[lo:hi]
            top = np.maximum.reduceat(value, first[a:b] - lo)
            value = np.exp(value - np.repeat(top, many[a:b]))
            alpha[target[first[a:b]]] = top + np.log(np.add.reduceat(value, first[a:b] - lo))
        if long.any():
            self._forward(alpha, source, target, weight, int(np.argmax(long)))
        logp = alpha[source] + weight - alpha[target]
        # The likeliest arc of each node comes first; the last one is taken by every draw that is left.
        order = np.lexsort((-logp, target))
        target, piece, logp = target[order], piece[order], logp[order]
        into = np.searchsorted(target, np.arange(len(data) + len(words)))
        cum = np.cumsum(np.exp(logp))
        cum -= np.concatenate([[0.0], cum])[into[target]]
        cum[np.append(np.flatnonzero(np.diff(target)), len(target) - 1)] = 2.0
        at = np.searchsorted(self.words, hashes)
        self.words = np.insert(self.words, at, hashes)
        self.ends = np.insert(self.ends, at, len(self.into) + stop + np.arange(len(words)))
        self.into = np.concatenate([self.into, len(self.cum) + into])
        self.cum, self.ids, self.logp = np.concatenate([self.cum, cum]), np.concatenate([self.ids, piece.astype(np.int32)]), np.concatenate([self.logp, logp.astype(np.float32)])

    @staticmethod
    def _forward(alpha: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, at: int) -> None:
        """Arcs from ``at`` on, in order of their target, one after another."""
        base = int(target[at:].min()) - 1
        have = alpha[base:].tolist()
        seen, values = -1, []

        def close() -> None:
            top = max(values)
            have[seen - base] = top + math.log(sum(math.exp(v - top) for v in values))

        for s, t, w in zip(source[at:].tolist(), target[at:].tolist(), weight[at:].tolist(), strict=True):
            if t != seen:
                if values:
                    close()
                seen, values = t, []
            values.append(have[s - base] + w)
        close()
        alpha[base:] = have

    def _sample_one(self, node: int, left: int, seed: np.uint64) -> list[int]:
        """Arcs of a path through one long word, from its end."""
        low = node - left
        lo = int(self.into[low])
        hi = int(self.into[node + 1]) if node + 1 < len(self.into) else len(self.cum)
        into, cum, size = self.into[low : node + 1].tolist(), self.cum[lo:hi].tolist(), self.lens[self.ids[lo:hi]].tolist()
        draws = _uniform(seed + np.arange(1, left + 1).astype(U64) * U64(STEP)).tolist()
        out, at, k = [], left, 0
        while at:
            arc = into[at] - lo
            while cum[arc] <= draws[k]:
                arc += 1
            out.append(arc + lo)
            at -= size[arc]
            k += 1
        return out

    def _sample(self, node: np.ndarray, left: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words and arcs of a path through each word, in reading order."""
        who, arcs, turn = [], [], []
        for w in np.flatnonzero(left > LONG).tolist():
            path = np.array(self._sample_one(int(node[w]), int(left[w]), seed[w]), np.int64)
            who.append(np.full(len(path), w))
            arcs.append(path)
            turn.append(np.arange(len(path)))
        live = np.flatnonzero(left <= LONG)
        node, left, seed = node[live], left[live], seed[live]
        k = 0
        while len(live):
            seed = seed + U64(STEP)
            u = _uniform(seed)
            arc = self.into[node]
            wait = np.flatnonzero(self.cum[arc] <= u)
            while len(wait):
                arc[wait] += 1
                wait = wait[self.cum[arc[wait]] <= u[wait]]
            who.append(live)
            arcs.append(arc)
            turn.append(np.full(len(live), k))
            size = self.lens[self.ids[arc]]
            left = left - size
            keep = left > 0
            live, node, left, seed = live[keep], (node - size)[keep], left[keep], seed[keep]
            k += 1
        who, arcs, turn = (np.concatenate(x) for x in (who, arcs, turn))
        count = np.bincount(who, minlength=int(who.max()) + 1)
        out = np.empty(len(arcs), np.int64)
        out[np.cumsum(count)[who] - 1 - turn] = arcs
        return count, out

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after another; how many each has; their log-probabilities."""
        data, offsets, n_docs = block.data, block.offsets, len(block.ids)
        new = np.zeros(len(data), bool)
        if self.in_words:
            new[1:] = (data[1:] == 32) & (data[:-1] != 32) | (data[1:] == 10) | (data[:-1] == 10)
        new[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(new)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(n_docs, np.int64), np.zeros(n_docs)
        end = np.append(start[1:], len(data))
        doc = np.searchsorted(offsets, start, "right") - 1
        uniq, first, where = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
        if len(self.cum) > CACHE_ARCS:
            self.reset()
        at = np.searchsorted(self.words, uniq)
        fresh = np.ones(len(uniq), bool)
        inside = at < len(self.words)
        fresh[inside] = self.words[at[inside]] != uniq[inside]
        if fresh.any():
            raw = data.tobytes()
            self.learn(uniq[fresh], [raw[a:b] for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)])
            at = np.searchsorted(self.words, uniq)
        order = np.arange(len(start)) - np.searchsorted(doc, np.arange(n_docs))[doc]
        key = np.where(block.ids == np.iinfo(np.int64).max, 0, block.ids).astype(np.int64).view(U64)
        seed = mix(mix(key)[doc] + order.astype(U64) * U64(STEP))
        count, arc = self._sample(self.ends[at][where], end - start, seed)
        of = np.repeat(doc, count)
        return self.ids[arc].astype(np.int64), np.bincount(of, minlength=n_docs).astype(np.int64), np.bincount(of, self.logp[arc], n_docs)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of pieces one after another."""
        size = self.lens[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - (ends - size), size)]


def _uniform(counter: np.ndarray) -> np.ndarray:
    """Draws in [0, 1) from counters."""
    return (mix(counter) >> U64(11)).astype(float) * 2.0**-53


_kept: dict[tuple[str, float], Lattices] = {}


def lattices(model_path: str, theta: float) -> Lattices:
    """One per worker and model."""
    if (model_path, theta) not in _kept:
        _kept[model_path, theta] = Lattices(model_path, theta)
    return _kept[model_path, theta]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", theta: float = THETA, with_ids: bool = False) -> DataFrame:
    """Columns: doc_id, n_bytes, n_pieces, ids_crc32, decoded_sha256, lossless, log_prob.

    The crc is over the ids as little-endian 32-bit numbers; the digest is of the text that
    decoding the ids gives. ``with_ids`` adds ``ids``, an array of int.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(model_path, theta)
        for block in streamed(batches):
            ids, count, logp = model.encode(block)
            back = model.decode(ids)
            same = len(back) == len(block.data)
            raw, flat, text = ids.astype("<u4").tobytes(), back.tobytes(), block.data.tobytes()
            to = np.cumsum(count)
            size = np.concatenate([[0], np.cumsum(model.lens[ids])])
            edge = [0, *size[to].tolist()]
            cut = [0, *to.tolist()]
            off = block.offsets.tolist()
            n = len(block.ids)
            cols = [
                ids_out(block.ids), pa.array(np.maximum(block.lens, 0)), pa.array(count), pa.array([zlib.crc32(raw[4 * cut[i] : 4 * cut[i + 1]]) for i in range(n)], pa.int64()),
                pa.array([hashlib.sha256(flat[edge[i] : edge[i + 1]]).hexdigest() for i in range(n)]), pa.array([same and flat[edge[i] : edge[i + 1]] == text[off[i] : off[i + 1]] for i in range(n)], pa.bool_()), pa.array(logp),
            ]
            names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "lossless", "log_prob"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    source = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean, log_prob double" + ", ids array<int>" * with_ids
    return source.mapInArrow(apply, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``text``, put together from its ids; null ids give null."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(model_path, THETA)
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            text = [None if x is None else model.decode(np.array(x, np.int64)).tobytes().decode() for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "text"])

    encoded = encoded.drop("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(apply, f"{kinds}, text string")
