"""Language-model scoring with a weighted backoff automaton.

States are the root, one for each known word and one for each pair of words seen in
training. A state has an arc for every word that was seen after it, and a failure arc to
the state of its last word (the root, for a word's state). With ``c`` for counts,
``e`` for escape masses and ``p`` for a state's distribution:

* root: ``p(w) = (1 - e0) c(w) / N``, and e0 for the one unknown word, which leads to the root;
* state v: an arc for each pair (v, w) weighs ``log10((1-e) c(vw) / c(v) + e p(w))``;
* state uv: an arc for each triple weighs ``log10((1-e) c(uvw) / c(uv) + e p(w | v))``;
* the failure arc of a state weighs ``log10 e``.

An arc leads to the state of the last two words if that pair was seen, else to the state of
the word. Escape masses are Good-Turing estimates (the share of continuations seen once) by
power of two of the state's count. Every state's distribution sums to one.

Each text is read once from left to right; the state is carried, failure arcs are followed
until the word has an arc, and log-probabilities are added up. Texts of a block are read
side by side. A long text is read in segments, each of which starts from the state that the
two words before it lead to from the root; that state is the same as the one carried.

Counts cover all training documents. They never meet in one place: blocks exchange their
distinct words, pairs and triples by hash range (``blocks.exchange``), so each block builds
just the arcs that its own texts can follow. A pair or triple whose first word or pair
occurs in no other block is counted there and not sent.

Null and empty texts are the end token alone. Repeated rows count as often as they occur.
Documents whose id is null hash as the text of no id (crc32 of "") and are scored too. An
empty table gives no rows. Only the id and text columns are read; others may have any name.
Words are compared by 64-bit hashes; the keys of pairs and triples keep 57 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import LOWER, NULL_ID, SPACE, U64, Block, Blocks, counted, elsewhere, exchange, ids_out, mix, prefix_hash, span_hash, token_spans, told

END = U64(0x5E0D)
BUCKETS = 40
#: Tokens of a segment that is read at one go.
SEGMENT = 256


def held_out(ids: np.ndarray, modulus: int, remainder: int) -> np.ndarray:
    """Whether crc32 of the id as text leaves the remainder."""
    return np.array([zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % modulus == remainder for i in ids.tolist()], bool)


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each token, ends included, in reading order."""
    data, offsets = LOWER[block.data], block.offsets
    starts, ends, doc = token_spans(data, offsets, SPACE)
    hashes = span_hash(prefix_hash(data), starts, ends)
    n = np.bincount(doc, minlength=len(block.ids))
    stop = np.cumsum(n + 1) - 1
    out = np.empty(len(hashes) + len(n), U64)
    is_end = np.zeros(len(out), bool)
    is_end[stop] = True
    out[is_end] = END
    out[~is_end] = hashes
    return out, np.repeat(np.arange(len(n)), n + 1)


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), BUCKETS - 1)


@dataclass
class Grams:
    """Runs of tokens that end at ``at``: sorted distinct keys, each run's place among them, and counts.

    Of each distinct run, ``open`` says whether its context occurs in other blocks too, so
    that its count has to be asked for; ``own`` is its count in this block's training texts.
    """

    at: np.ndarray
    keys: np.ndarray
    where: np.ndarray
    own: np.ndarray
    open: np.ndarray

    @staticmethod
    def of(at: np.ndarray, h: np.ndarray, last: np.ndarray, context: np.ndarray, shared: np.ndarray, trained: np.ndarray) -> Grams:
        """Runs with hashes ``h`` and last words ``last``; ``context`` has their contexts' counts and ``shared`` whether other blocks have those."""
        # The context's bucket and whether a text ends take the low bits: ranges are dealt by the high ones.
        keys, where, own = counted((h & ~U64(127)) | (last == END).astype(U64) << U64(6) | _bucket(context).astype(U64), trained.astype(float))
        open_ = np.zeros(len(keys), bool)
        open_[where] = shared
        return Grams(at, keys, where, own, open_)

    def totals(self, told_: np.ndarray) -> np.ndarray:
        out = self.own.copy()
        out[self.open] = told_
        return out

    def shared(self, told_: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.own), bool)
        out[self.open] = told_
        return out

    def settled(self) -> np.ndarray:
        """``statistics`` of the runs whose counts aren't asked for."""
        return statistics(self.keys[~self.open], self.own[~self.open])


def statistics(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs seen once by bucket of their context, and occurrences of runs that a word follows by bucket of their own count."""
    ones = np.bincount((keys[n == 1] & U64(63)).astype(np.int64), minlength=BUCKETS)
    return np.concatenate([ones, np.bincount(_bucket(n), np.where(keys & U64(64) > 0, 0, n), BUCKETS)]).astype(np.int64)


def _pairs(word: np.ndarray, doc: np.ndarray, known: np.ndarray, shared: np.ndarray, trained: np.ndarray) -> Grams:
    """Pairs of known words; ``known`` has the tokens' counts, ``shared`` whether other blocks have them."""
    at = np.flatnonzero((doc[1:] == doc[:-1]) & (known[1:] > 0) & (known[:-1] > 0)) + 1
    return Grams.of(at, mix(word[at - 1] * U64(0x9E3779B97F4A7C15) + mix(word[at])), word[at], known[at - 1], shared[at - 1], trained[at])


def _triples(word: np.ndarray, pairs: Grams, count: np.ndarray, shared: np.ndarray, trained: np.ndarray) -> Grams:
    """Triples whose both pairs were seen; ``count`` has the totals of the distinct pairs, ``shared`` whether other blocks have them."""
    seen = np.full(len(word), -1)
    seen[pairs.at] = np.where(count[pairs.where] > 0, pairs.where, -1)
    at = np.flatnonzero((seen[1:] >= 0) & (seen[:-1] >= 0)) + 1
    before = seen[at - 1]
    return Grams.of(at, mix(pairs.keys[before] * U64(0xD6E8FEB86659FD93) + mix(word[at])), word[at], count[before], shared[before], trained[at])


@dataclass
class Automaton:
    """States and arcs over a block's words: 0 is the root, then words, then pairs seen in training.

    ``arcs`` are sorted keys ``state * words + word`` with the state each leads to and its weight.
    """

    words: int
    arcs: np.ndarray
    leads: np.ndarray
    weight: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    unknown: float

    @staticmethod
    def build(n_words: int, root: np.ndarray, count: np.ndarray, pairs: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...], escapes: tuple[float, np.ndarray, np.ndarray]) -> Automaton:
        """From the words' root probabilities and counts; pairs (first, second, count) and triples (pair, word, next pair, count), all seen."""
        first, second, n2 = pairs
        pair, third, after, n3 = triples
        e0, e1, e2 = escapes
        p2 = (1 - e1[_bucket(count[first])]) * n2 / count[first] + e1[_bucket(count[first])] * root[second]
        p3 = (1 - e2[_bucket(n2[pair])]) * n3 / n2[pair] + e2[_bucket(n2[pair])] * p2[after]
        known = np.flatnonzero(count > 0)
        keys = np.concatenate([known, (1 + first) * n_words + second, (1 + n_words + pair) * n_words + third])
        leads = np.concatenate([1 + known, 1 + n_words + np.arange(len(first)), 1 + n_words + after])
        weight = np.log10(np.concatenate([root[known], p2, p3]))
        order = np.argsort(keys)
        fail = np.concatenate([np.zeros(1 + n_words, np.int64), 1 + second])
        fail_weight = np.log10(np.concatenate([[1.0], e1[_bucket(count)], e2[_bucket(n2)]]))
        return Automaton(n_words, keys[order], leads[order], weight[order], fail, fail_weight, float(np.log10(e0)))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that the words lead to, and the log-probability added on the way."""
        state, gained = state.copy(), np.zeros(len(state))
        open_ = np.arange(len(state))
        while len(open_):
            here = state[open_]
            key = here * self.words + word[open_]
            place = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            hit = self.arcs[place] == key if len(self.arcs) else np.zeros(len(key), bool)
            done = open_[hit]
            state[done] = self.leads[place[hit]]
            gained[done] += self.weight[place[hit]]
            lost = ~hit & (here == 0)
            gained[open_[lost]] += self.unknown
            back = ~hit & (here > 0)
            open_, here = open_[back], here[back]
            gained[open_] += self.fail_weight[here]
            state[open_] = self.fail[here]
        return state, gained

    def read(self, word: np.ndarray, doc: np.ndarray, n_docs: int, segment: int = SEGMENT) -> np.ndarray:
        """The log-probability of each text."""
        if not len(word):
            return np.zeros(n_docs)
        edge = np.searchsorted(doc, np.arange(n_docs + 1))
        size = np.diff(edge)
        many = -(-size // segment)
        owner = np.repeat(np.arange(n_docs), many)
        begin = edge[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * segment
        end = np.minimum(begin + segment, edge[owner + 1])
        order = np.argsort(begin - end, kind="stable")  # the longest first, so that those still read are a prefix
        owner, begin, end = owner[order], begin[order], end[order]
        total, state = np.zeros(len(owner)), np.zeros(len(owner), np.int64)
        for back in (2, 1):
            some = np.flatnonzero(begin - back >= edge[owner])
            state[some] = self.step(state[some], word[begin[some] - back])[0]
        size = end - begin
        for k in range(int(size[0])):
            n = int(np.searchsorted(-size, -k))
            state[:n], gained = self.step(state[:n], word[begin[:n] + k])
            total[:n] += gained
        return np.bincount(owner, total, n_docs)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 1) -> DataFrame:
    """Scores of all documents under a model of those not held out.

    Held out is a document whose crc32(id as text) mod ``modulus`` is ``remainder``.
    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    blocks = Blocks(docs, id_col, text_col)

    def read(block: Block) -> tuple[np.ndarray, ...]:
        """Tokens, their documents, whether they are for training; distinct words, places and own counts."""
        word, doc = _tokens(block)
        trained = ~held_out(block.ids, modulus, remainder)[doc]
        return word, doc, trained, *counted(word, trained.astype(float))

    def ask_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
        _, _, _, keys, _, n = read(block)
        return keys, n

    def word_stats(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        mass = np.bincount(_bucket(n), np.where((keys == END) | (n == 0), 0, n), BUCKETS)
        return np.concatenate([[n.sum(), (n > 0).sum(), (n == 1).sum()], mass]).astype(np.int64)

    words, sums = exchange(blocks, blocks.df, ask_words, "words", word_stats)
    total, vocab, once, mass = (*sums[:3], sums[3:]) if sums else (0, 0, 0, [0] * BUCKETS)
    unknown = (once + 0.5) / (total + 1.0)

    def pairs_of(block: Block) -> tuple[tuple[np.ndarray, ...], np.ndarray, Grams]:
        got = word, doc, trained, _, where, _ = read(block)
        count = told(block.extra["words"])
        return got, count, _pairs(word, doc, count[where], elsewhere(block.extra["words"])[where], trained)

    def ask_pairs(block: Block) -> tuple[np.ndarray, ...]:
        pairs = pairs_of(block)[2]
        return pairs.keys[pairs.open], pairs.own[pairs.open], pairs.settled()

    asked2, stats2 = exchange(blocks, blocks.with_facts(words), ask_pairs, "pairs", statistics)

    def triples_of(block: Block) -> tuple:
        got, count, pairs = pairs_of(block)
        n2 = pairs.totals(told(block.extra["pairs"]))
        return got, count, pairs, n2, _triples(got[0], pairs, n2, pairs.shared(elsewhere(block.extra["pairs"])), got[2])

    def ask_triples(block: Block) -> tuple[np.ndarray, ...]:
        triples = triples_of(block)[-1]
        return triples.keys[triples.open], triples.own[triples.open], triples.settled()

    asked3, stats3 = exchange(blocks, blocks.with_facts(words, asked2), ask_triples, "triples", statistics)
    stats2, stats3 = (x or [0] * 2 * BUCKETS for x in (stats2, stats3))
    share = lambda ones, mass: np.array([(a + 0.5) / (b + 1.0) for a, b in zip(ones[:BUCKETS], mass, strict=True)])
    escapes = (unknown, share(stats2, mass), share(stats3, stats2[BUCKETS:]))

    def walk(block: Block) -> Iterator[pa.RecordBatch]:
        (word, doc, _, keys, where, _), count, pairs, n2, triples = triples_of(block)
        n3 = triples.totals(told(block.extra["triples"]))
        root = np.where(count > 0, (1 - unknown) * count / max(total, 1), unknown)
        seen, state = np.flatnonzero(n2 > 0), np.cumsum(n2 > 0) - 1
        first, second = np.empty(len(n2), np.int64), np.empty(len(n2), np.int64)
        first[pairs.where], second[pairs.where] = where[pairs.at - 1], where[pairs.at]
        ends = np.full(len(word), -1)
        ends[pairs.at] = pairs.where
        pair, after, third = (np.empty(len(n3), np.int64) for _ in range(3))
        pair[triples.where], after[triples.where], third[triples.where] = ends[triples.at - 1], ends[triples.at], where[triples.at]
        some = n3 > 0
        model = Automaton.build(len(keys), root, count, (first[seen], second[seen], n2[seen]), (state[pair[some]], third[some], state[after[some]], n3[some]), escapes)
        known = count[where]
        base = (known + 0.5) / (total + 0.5 * (vocab + 1))
        n = len(block.ids)
        per = lambda x: np.bincount(doc, x, n)
        yield pa.RecordBatch.from_arrays(
            [
                ids_out(block.ids), pa.array(held_out(block.ids, modulus, remainder)), pa.array(np.bincount(doc, minlength=n)), pa.array(per(known > 0).astype(np.int64)),
                pa.array(np.full(n, total, np.int64)), pa.array(per(np.log10(base))), pa.array(model.read(where, doc, n)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.map(blocks.with_facts(words, asked2, asked3), walk, schema)
