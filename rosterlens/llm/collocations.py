"""Phrase collocations: position bitmaps per word, extended by shift and AND, popcounts summed over shards.

A shard is a block of whole documents. Its words are laid out on positions, with one position
left free between pieces, so that no shift can carry a phrase over a piece's end. Each word
of a language has a bitmap of its positions, of which only bytes with a bit are kept. A phrase
is extended by shifting its bitmap by one and taking the AND with the bitmaps of the words that have a bit in the
same byte; the popcount is the phrase's number of occurrences (overlapping ones too), and what
is left is the bitmap of the longer phrase, which is extended in turn before the next lot of words.

Words are counted over the corpus first, then only words that reach ``least`` take part. The
shards' phrases go through ``blocks.exchange`` by 64-bit hashes: a phrase whose total does not reach
``least`` is not sent as text. A collision of hashes can only let one through; the counts that
results are made of are sums by language and text, so they are exact.

Every part of a phrase occurs at least as often as the phrase, so parts of candidates are found in
the same table of counts. It is written once and joined with the candidates' cuts by language and
text; a word in a third of all cuts is a hot key of plain shuffles, which adaptive execution splits.

Null texts are empty, a null language is ``und``, an empty table gives no rows. Repeated rows and ids count
each, as ids aren't read. Other columns aren't read and may have any name. Long texts are blocks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LOWER, U64, Block, Blocks, carried, counted, exchange, mix, prefix_hash, span_hash, token_spans, told
from .shared import named, stored

#: Bits of one element of a bitmap.
BITS = 8
#: Pairs of bitmap elements that are in memory at once.
LOT = 1 << 21
#: Buckets of a language's candidates for the first of two rankings.
SALTS = 64

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_APART = _END.copy()
_APART[[32, 9]] = True
_FACTOR = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _key(*words: np.ndarray) -> np.ndarray:
    """64-bit keys of phrases from those of their words."""
    out = np.full(len(words[0]), U64(len(words)))
    for w, f in zip(words, _FACTOR, strict=False):
        out = mix(out ^ w) * f
    return mix(out)


class Shard:
    """The words of a block: spans, keys (of language and word), and positions."""

    def __init__(self, block: Block):
        self.langs = carried(block)[0].dictionary_encode()
        text = LOWER[block.data]
        self.data, offsets = text, block.offsets
        self.starts, self.ends, doc = token_spans(text, offsets, _APART)
        lang = self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc] if len(doc) else doc
        names = [x.encode() for x in self.langs.dictionary.to_pylist()]
        joined = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(x) for x in names]).astype(np.int64)
        seeds = span_hash(prefix_hash(joined), ends - [len(x) for x in names], ends) if names else np.zeros(0, U64)
        key = span_hash(prefix_hash(text), self.starts, self.ends)
        key = _key(key ^ mix(seeds[lang])) if len(key) else key
        self.lang = lang
        self.keys, self.word, self.count = counted(key)
        # A new piece begins after an end mark or in another document.
        marks = np.cumsum(_END[text])
        mark = marks[self.starts] if len(self.starts) else self.starts
        fresh = np.zeros(len(doc), bool)
        fresh[1:] = (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])
        self.at = np.arange(len(doc)) + np.cumsum(fresh)
        #: A token for each word, from which to read its text.
        self.sample = np.zeros(len(self.keys), np.int64)
        self.sample[self.word] = np.arange(len(doc))

    def texts(self, *words: np.ndarray) -> pa.Array:
        """Words joined by a space."""
        if not len(words[0]):
            return pa.array([], pa.string())
        tokens = np.stack([self.sample[w] for w in words], 1).ravel()
        size = self.ends[tokens] - self.starts[tokens] + 1
        to = np.cumsum(size)
        out = np.full(to[-1], 32, np.uint8)
        inside = np.ones(to[-1], bool)
        inside[to - 1] = False
        source = np.arange(to[-1]) - np.repeat(to - size - self.starts[tokens], size)
        out[inside] = self.data[source[inside]]
        cut = np.concatenate([[0], to[len(words) - 1 :: len(words)]])
        # The space behind the last word goes.
        keep = np.ones(to[-1], bool)
        keep[cut[1:] - 1] = False
        offs = (cut - np.arange(len(cut))).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(offs), pa.py_buffer(out[keep])).cast(pa.string())

    def lang_of(self, words: np.ndarray) -> pa.Array:
        return self.langs.dictionary.take(pa.array(self.lang[self.sample[words]])).cast(pa.string())


class Bitmaps:
    """Bitmaps of many rows at once: (row, element, bits), without empty elements."""

    def __init__(self, row: np.ndarray, element: np.ndarray, bits: np.ndarray):
        self.row, self.element, self.bits = row, element, bits

    @classmethod
    def of(cls, word: np.ndarray, at: np.ndarray) -> Bitmaps:
        """One for each word, from the positions of all tokens."""
        element = at // BITS
        order = np.lexsort((element, word))
        word, element, bit = word[order], element[order], (1 << (at[order] % BITS)).astype(np.uint8)
        cut = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (element[1:] != element[:-1])])[: len(word)])
        return cls(word[cut], element[cut], np.bitwise_or.reduceat(bit, cut) if len(cut) else bit)

    def some(self, lo: int, hi: int) -> Bitmaps:
        return Bitmaps(self.row[lo:hi], self.element[lo:hi], self.bits[lo:hi])

    def shifted(self) -> Bitmaps:
        """All bits one position later; those that leave an element enter the next one."""
        over = (self.bits >> (BITS - 1)).astype(np.uint8)
        stay, go = (self.bits << 1).astype(np.uint8), np.flatnonzero(over)
        left = np.flatnonzero(stay)
        return Bitmaps(np.concatenate([self.row[left], self.row[go]]), np.concatenate([self.element[left], self.element[go] + 1]), np.concatenate([stay[left], over[go]]))


class Words:
    """The bitmaps of a shard's words by element, for extending phrases."""

    def __init__(self, bitmaps: Bitmaps):
        order = np.argsort(bitmaps.element, kind="stable")
        self.word, self.bits = bitmaps.row[order], bitmaps.bits[order]
        n = int(bitmaps.element.max()) + 3 if len(order) else 2
        self.first = np.searchsorted(bitmaps.element[order], np.arange(n))

    def extend(self, phrases: Bitmaps, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bitmaps]:
        """Phrase row, next word, popcount and bitmap of each phrase one word longer."""
        moved = phrases.shifted()
        lo, hi = self.first[moved.element], self.first[moved.element + 1]
        found = []
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(lo):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOT, "right")))
            size = (hi - lo)[at:to]
            left = np.repeat(np.arange(at, to), size)
            right = np.arange(len(left)) - np.repeat(np.cumsum(size) - size - lo[at:to], size)
            bits = moved.bits[left] & self.bits[right]
            some = np.flatnonzero(bits)
            left, right = left[some], right[some]
            found.append((moved.row[left] * n_words + self.word[right], moved.element[left], bits[some]))
            at = to
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, Bitmaps(none, none, np.zeros(0, np.uint8))
        pair, element, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, element, bits = pair[order], element[order], bits[order]
        cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
        n = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), cut) if len(cut) else cut
        return pair[cut] // n_words, pair[cut] % n_words, n, Bitmaps(np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(pair)))), element, bits)


def mine(shard: Shard, frequent: np.ndarray, longest: int) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """Words (by place among the shard's) and popcounts of phrases of 2 to ``longest`` frequent words, depth-first by lots."""
    token = np.flatnonzero(frequent[shard.word]) if len(shard.word) else np.zeros(0, np.int64)
    if not len(token):
        return
    bitmaps = Bitmaps.of(shard.word[token], shard.at[token])
    words = Words(bitmaps)
    n = len(shard.keys)

    def deeper(phrases: Bitmaps, prefix: tuple[np.ndarray, ...]) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
        row, word, count, longer = words.extend(phrases, n)
        got = (*(p[row] for p in prefix), word)
        yield got, count
        if len(got) < longest and len(count):
            yield from deeper(longer, got)

    at = 0
    while at < len(bitmaps.row):
        to = min(at + LOT // 8, len(bitmaps.row))
        to = int(np.searchsorted(bitmaps.row, bitmaps.row[to - 1], "right"))  # whole words
        lot = bitmaps.some(at, to)
        first, place = np.unique(lot.row, return_inverse=True)
        yield from deeper(Bitmaps(place, lot.element, lot.bits), (first,))
        at = to


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, longest: int = 3) -> DataFrame:
    """(lang, words, phrase, f): all phrases of 1 to ``longest`` words with f >= ``least``; words = 0 has all words' number."""
    if not 2 <= longest <= len(_FACTOR):
        raise ValueError(f"phrases have 2 to {len(_FACTOR)} words")
    source = docs.select(F.lit(0).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"), F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"))
    blocks = Blocks(source, carry=("lang",))

    def ask_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
        shard = Shard(block)
        return shard.keys, shard.count

    words, _ = exchange(blocks, blocks.df, ask_words, "words")

    def ask_phrases(block: Block) -> tuple[np.ndarray, np.ndarray]:
        shard = Shard(block)
        found = [(_key(*(shard.keys[w] for w in got)), n) for got, n in mine(shard, told(block.extra["words"]) >= least, longest)]
        if not found:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        return keys[cut], np.add.reduceat(n, cut) if len(cut) else n

    phrases, _ = exchange(blocks, blocks.with_facts(words), ask_phrases, "phrases")

    def tell(block: Block) -> Iterator[pa.RecordBatch]:
        shard = Shard(block)
        frequent = told(block.extra["words"]) >= least
        totals = told(block.extra["phrases"])

        def rows(got: tuple[np.ndarray, ...], n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([shard.lang_of(got[0]), pa.array(np.full(len(n), len(got)), pa.int64()), shard.texts(*got), pa.array(n, pa.int64())], ["lang", "words", "phrase", "f"])

        n = np.bincount(shard.lang, minlength=len(shard.langs.dictionary)) if len(shard.lang) else np.zeros(0, np.int64)
        langs = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([shard.langs.dictionary.take(pa.array(langs)).cast(pa.string()), pa.array(np.zeros(len(langs)), pa.int64()), pa.array([""] * len(langs), pa.string()), pa.array(n[langs], pa.int64())], ["lang", "words", "phrase", "f"])
        common = np.flatnonzero(frequent)
        yield rows((common,), shard.count[common])
        found = list(mine(shard, frequent, longest))
        if not found:
            return
        # In the order of its sorted keys, as they were asked for.
        _, where = np.unique(np.concatenate([_key(*(shard.keys[w] for w in got)) for got, _ in found]), return_inverse=True)
        at = 0
        for got, n in found:
            good = totals[where[at : at + len(n)]] >= least
            at += len(n)
            yield rows(tuple(g[good] for g in got), n[good])

    sent = blocks.map(blocks.with_facts(words, phrases), tell, "lang string, words long, phrase string, f long")
    return sent.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= F.when(F.col("words") == 0, 1).otherwise(least))


def _part(a: int, b: int | None) -> Column:
    words = F.split("phrase", " ", -1)
    return F.array_join(F.slice(words, a + 1, F.size(words) - a if b is None else F.lit(b - a)), " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, longest: int = 3, cover: int = 50, most: int = 2000, scale: int = 1_000_000
) -> DataFrame:
    """Each language's first ``most`` phrases by the score of their lowest-scoring cut.

    Columns: lang, rank, phrase, a, l, r, n, score.
    """
    counts = stored(phrase_counts(docs, text_col, lang_col, least, longest), "phrases")
    candidates = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    # One row for each part of each cut, and for each shorter candidate inside of a longer one.
    asks = []
    for k in range(1, longest):
        asks += [F.struct(_part(0, k).alias("part"), F.lit(k).alias("cut"), F.lit(0).alias("side")), F.struct(_part(k, None).alias("part"), F.lit(k).alias("cut"), F.lit(1).alias("side"))]
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.slice(F.array(*asks), 1, (2 * (F.col("words") - 1)).cast("int"))).alias("c")).select("lang", "phrase", "a", "c.*")
    parts = counts.filter("words > 0").select(F.col("lang").alias("of"), F.col("phrase").alias("text"), "f")
    sized = cuts.join(parts, (F.col("of") == F.col("lang")) & (F.col("text") == F.col("part"))).select("lang", "phrase", "a", "cut", "side", "f", F.lit(None).cast("long").alias("longer"))
    inside = []
    for n in range(3, longest + 1):
        for m in range(2, n):
            inside += [candidates.filter(F.col("words") == n).select("lang", _part(i, i + m).alias("phrase"), "a") for i in range(n - m + 1)]
    for rows in inside:
        sized = sized.union(rows.select("lang", "phrase", F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("long"), F.col("a")))
    one = lambda k, side: F.max(F.when((F.col("cut") == k) & (F.col("side") == side), F.col("f")))
    whole = sized.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.max("longer").alias("longer"), *(one(k, s).alias(f"part_{k}_{s}") for k in range(1, longest) for s in (0, 1))
    ).filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer").cast("decimal(25,0)") < F.lit(cover) * F.col("a").cast("decimal(25,0)")))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # Decimals of 38 digits: exact up to counts of 10**15.
    of_cut = lambda k: F.call_function("div", F.lit(scale).cast("decimal(10,0)") * wide("a") * wide("a"), wide(f"part_{k}_0") * wide(f"part_{k}_1"))
    scored = [F.when(F.col(f"part_{k}_0").isNotNull(), F.struct(of_cut(k).cast("long").alias("score"), F.lit(k).alias("cut"), F.col(f"part_{k}_0").alias("l"), F.col(f"part_{k}_1").alias("r"))) for k in range(1, longest)]
    lowest = F.array_min(F.filter(F.array(*scored), lambda x: x.isNotNull()))
    ranked = whole.select("lang", "phrase", "a", lowest.alias("low")).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= most)
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    totals = counts.filter("words = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    return top.join(totals, F.col("of") == F.col("lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
