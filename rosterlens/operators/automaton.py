"""All words of a table in all texts, in one pass: an Aho-Corasick automaton in arrays.

The words' trie is built level by level, with failure links and complete transitions over classes of
bytes; it is broadcast, so each worker holds it once. A task reads many texts side by side: texts are cut into
segments that overlap by the longest word less one byte, and one step moves every segment by one byte. What a task
holds is bounded by ``READ`` bytes of text and their matches.

An automaton has at most ``ENTRIES`` transitions. A table of more words is dealt to several by a hash of the word,
each with a pass of its own over the texts, so what is broadcast does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transitions of one automaton, four bytes each.
ENTRIES = 1 << 24
#: Bytes of text that a task reads at once, and of a segment.
READ = 1 << 21
SEGMENT = 1024


@dataclass
class Automaton:
    """States are numbered by depth; 0 is the root."""

    classes: np.ndarray  # of each byte
    step: np.ndarray  # state, class: the next state
    word: np.ndarray  # the word that ends in a state, or -1
    link: np.ndarray  # the longest proper suffix that is a word, or 0
    longest: int

    @classmethod
    def build(cls, words: list[bytes]) -> Automaton:
        """Of distinct words, none of them empty."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        longest = int(size.max()) if len(size) else 0
        used = np.unique(data)
        classes = np.zeros(256, np.int64)
        classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        # One level after the other: each distinct pair of a parent and a byte is a state.
        at = np.zeros(len(words), np.int64)
        levels, n = [], 1
        for depth in range(longest):
            some = np.flatnonzero(size > depth)
            pair, where = np.unique(at[some] * width + classes[data[start[some] + depth]], return_inverse=True)
            at[some] = n + where
            levels.append((pair // width, pair % width, np.arange(n, n + len(pair))))
            n += len(pair)
        step = np.zeros((n, width), np.int32)
        word, link, fail = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        word[at] = np.arange(len(words))
        for depth, (parent, kind, child) in enumerate(levels):
            if depth:
                # What a parent can't do itself its failure state does; where that leads is the child's failure state.
                fail[child] = step[parent, kind]
            step[parent, kind] = child
            link[child] = np.where(word[fail[child]] >= 0, fail[child], link[fail[child]])
            step[child] = step[fail[child]]
        return cls(classes.astype(np.uint8) if width <= 256 else classes, step, word, link, longest)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, end and word of each occurrence in texts that stand one behind the other."""
        if not self.longest or not len(data):
            return (np.zeros(0, np.int64),) * 3
        width = max(SEGMENT, 4 * self.longest)
        lens = np.diff(offsets)
        parts = -(-lens // width)
        text = np.repeat(np.arange(len(lens)), parts)
        first = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * width
        last = np.minimum(first + width, offsets[text + 1])
        begin = np.maximum(first - self.longest + 1, offsets[text])
        order = np.argsort(begin - last, kind="stable")  # the longest first: those still read are a prefix
        text, first, last, begin = text[order], first[order], last[order], begin[order]
        kind = self.classes[data]
        flat, wide = self.step.ravel(), self.step.shape[1]
        ends = (self.word >= 0) | (self.link > 0)
        state = np.zeros(len(text), np.int64)
        size = last - begin
        lane, end, met = [], [], []
        for k in range(int(size[0])):
            n = int(np.searchsorted(-size, -k, "left"))
            now = flat[state[:n] * wide + kind[begin[:n] + k]]
            state[:n] = now
            hit = np.flatnonzero(ends[now])
            if len(hit):
                hit = hit[begin[hit] + k >= first[hit]]
                lane.append(hit)
                end.append(begin[hit] + k + 1)
                met.append(now[hit])
        if not lane:
            return (np.zeros(0, np.int64),) * 3
        lane, end, met = np.concatenate(lane), np.concatenate(end), np.concatenate(met).astype(np.int64)
        found = []
        while len(met):
            some = self.word[met] >= 0
            found.append((text[lane[some]], end[some], self.word[met[some]]))
            met = self.link[met]
            some = met > 0
            lane, end, met = lane[some], end[some], met[some]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def apart(group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which occurrences count if none may overlap the one that counts before it. Sorted by group and start."""
    out = np.ones(len(group), bool)
    near = np.flatnonzero((group[1:] == group[:-1]) & (start[1:] < start[:-1] + size[:-1]))
    if not len(near):
        return out
    # Only overlapping runs need to be walked.
    walk = np.unique(np.concatenate([near, near + 1]))
    key, limit = -1, 0
    for i in walk:
        if i == 0 or group[i] != key or start[i] >= limit:
            key, limit = group[i], start[i] + size[i]
        else:
            out[i] = False
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about READ bytes."""
    _, offsets = _texts(column)
    a = 0
    while a < len(column):
        b = min(len(column), max(a + 1, int(np.searchsorted(offsets, offsets[a] + READ, "right")) - 1))
        yield a, b
        a = b


def _found(batches: Iterator[pa.RecordBatch], automaton: Automaton, size: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice of (id, text): the ids, and row, word, n and n_apart of what the texts hold, by row and word."""
    for b in batches:
        for lo, hi in _slices(b.column(1)):
            part = b.slice(lo, hi - lo)
            row, end, word = automaton.matches(*_texts(part.column(1)))
            order = np.lexsort((end, word, row))
            row, end, word = row[order], end[order], word[order]
            group = row * max(len(size), 1) + word
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            n = np.diff(np.append(cut, len(group)))
            free = apart(group, end - size[word], size[word]) if len(group) else np.zeros(0, bool)
            alone = np.add.reduceat(free.astype(np.int64), cut) if len(cut) else n
            yield part.column(0), row[cut], word[cut], n, alone


def _lowered(docs: DataFrame, text_col: str, id_col: str, text: Column | None) -> DataFrame:
    low = F.lower(F.coalesce(F.col(text_col) if text is None else text, F.lit("")))
    return docs.select(F.col(id_col).alias("__id"), low.alias("__low"))


def _built(names: list[str]) -> tuple[Automaton, np.ndarray]:
    """The automaton of sorted words, and their bytes."""
    coded = [w.encode() for w in names]
    return Automaton.build(coded), np.array([len(w) for w in coded], np.int64)


def _lots(words: DataFrame, word_col: str) -> list[DataFrame]:
    """Rows of words in lots, of which each has an automaton within ENTRIES transitions."""
    size = words.select(word_col).distinct().agg(F.coalesce(F.sum(F.octet_length(word_col)), F.lit(0)).alias("n")).first()["n"]
    lots = max(1, -(-int(size) * 256 // ENTRIES))
    return [words if lots == 1 else words.filter(F.pmod(F.xxhash64(word_col), F.lit(lots)) == k) for k in range(lots)]


def occurrences(docs: DataFrame, words: DataFrame, text_col: str = "text", word_col: str = "word", id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(id, word, n, n_apart): for each text and word of a table that it holds, without case, how often.

    ``n`` counts overlapping occurrences, ``n_apart`` those that a search from the left counts when each
    begins behind the one before. Null texts hold nothing; null and empty words occur nowhere.
    """
    spark = docs.sparkSession
    source = _lowered(docs, text_col, id_col, text)
    table = words.select(F.lower(F.col(word_col).cast("string")).alias("word")).filter("word <> ''").distinct()
    kind = source.schema["__id"].dataType.simpleString()
    out = None
    for lot in _lots(table, "word"):
        # Bounded by ENTRIES; sorted, so that the automaton hangs on the words alone.
        names = sorted(r["word"] for r in lot.collect())
        shared = spark.sparkContext.broadcast((*_built(names), pa.array(names, pa.string())))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton, size, names = shared.value
            for ids, row, word, n, alone in _found(batches, automaton, size):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), names.take(pa.array(word)), pa.array(n), pa.array(alone)], ["__id", "word", "n", "n_apart"])

        found = source.mapInArrow(search, f"__id {kind}, word string, n long, n_apart long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("__id", id_col)


def rule_hits(docs: DataFrame, rules: DataFrame, word_col: str = "word", id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n, n_apart, columns of the rules) for each rule whose word a text holds."""
    found = occurrences(docs, rules, word_col=word_col, id_col=id_col, **options).withColumnRenamed("word", "__word")
    return found.join(rules, F.col("__word") == F.lower(F.col(word_col))).drop("__word")


@dataclass
class _Rules:
    """Rules of sorted words, by word: those of word w are ``first[w]`` to ``first[w + 1]``."""

    first: np.ndarray
    label: np.ndarray  # of each rule, as a place in labels
    labels: pa.Array
    weight: np.ndarray  # 0 where there is none
    known: np.ndarray
    kind: pa.DataType  # of weights and totals
    spaced: np.ndarray  # of each word

    @classmethod
    def of(cls, table: pa.Table, most: int) -> tuple[list[str], _Rules]:
        """The words and rules of a table sorted by word."""
        names, first = np.unique(np.array(table["word"].to_pylist(), object), return_index=True) if len(table) else ([], np.zeros(0, np.int64))
        label = table["label"].combine_chunks().dictionary_encode(null_encoding="encode")
        weight = table["weight"].combine_chunks()
        known = np.array(weight.is_valid().to_pylist(), bool)
        values = np.array([x or 0 for x in weight.to_pylist()], np.float64 if pa.types.is_floating(weight.type) else object)
        if pa.types.is_integer(weight.type) and sum(map(abs, values)) * max(most, 1) < 1 << 63:
            values = values.astype(np.int64)
        return list(names), cls(np.append(first, len(table)), label.indices.to_numpy(), label.dictionary, values, known, weight.type, np.array([" " in w for w in names], bool))

    def totals(self, row: np.ndarray, word: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, label, total, whether a weight is known, and number of words, by row and label."""
        many = self.first[word + 1] - self.first[word]
        rule = np.repeat(self.first[word] - np.cumsum(many) + many, many) + np.arange(many.sum())
        row, times = np.repeat(row, many), np.repeat(times, many)
        order = np.lexsort((self.label[rule], row))
        row, rule, times = row[order], rule[order], times[order]
        group = row * len(self.labels) + self.label[rule]
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        if not len(cut):
            return row, self.label[rule], times.astype(self.weight.dtype), self.known[rule], times
        with localcontext(prec=76):
            total = np.add.reduceat(times.astype(self.weight.dtype) * self.weight[rule], cut)
        return row[cut], self.label[rule[cut]], total, np.logical_or.reduceat(self.known[rule], cut), np.diff(np.append(cut, len(group)))


def label_totals(docs: DataFrame, rules: DataFrame, most: int = 3, id_col: str = "doc_id", lone_words_twice: bool = False, text_col: str = "text", text: Column | None = None) -> DataFrame:
    """(id, label, total, words): weights times occurrences, up to ``most`` of each word, summed by label; distinct words that hit.

    ``rules``: word, label, weight; a table of any size. ``lone_words_twice``: a word without a space needs two occurrences.
    Totals are made where a text is read, so its hits go nowhere. Texts of one id count as one: ids that occur more
    than once are looked for first, by an action over the ids alone, and hits of their texts are summed by word.
    """
    spark = docs.sparkSession
    kind = rules.agg(F.sum(F.lit(most).cast("long") * F.col("weight")).alias("t")).schema["t"].dataType.simpleString()
    table = rules.select(F.lower(F.col("word").cast("string")).alias("word"), "label", "weight").filter("word <> ''")
    table = table.groupBy("word", "label").agg(F.sum("weight").cast(kind).alias("weight"))
    source = _lowered(docs, text_col, id_col, text)
    schema = f"__id {source.schema['__id'].dataType.simpleString()}, label {table.schema['label'].dataType.simpleString()}, total {kind}, words long"
    lots = _lots(table, "word")
    out = None
    for lot in lots:
        names, by_word = _Rules.of(lot.toArrow().sort_by([("word", "ascending")]), most)
        shared = spark.sparkContext.broadcast((*_built(names), by_word))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton, size, by_word = shared.value
            for ids, row, word, _, alone in _found(batches, automaton, size):
                if lone_words_twice:
                    some = (alone > 1) | by_word.spaced[word]
                    row, word, alone = row[some], word[some], alone[some]
                row, label, total, known, words = by_word.totals(row, word, np.minimum(alone, most))
                total = pa.array(total, by_word.kind, mask=~known)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), by_word.labels.take(pa.array(label)), total, pa.array(words)], ["__id", "label", "total", "words"])

        found = source.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    if len(lots) > 1:
        # A word is in one lot.
        out = out.groupBy("__id", "label").agg(F.sum("total").cast(kind).alias("total"), F.sum("words").alias("words"))
    out = out.withColumnRenamed("__id", id_col)
    again = docs.groupBy(F.col(id_col).alias("__again")).count().filter("count > 1").select("__again")
    if not again.count():
        return out
    same = F.col(id_col).eqNullSafe(F.col("__again"))
    hits = rule_hits(docs.join(again, same, "left_semi"), table, id_col=id_col, text_col=text_col, text=text)
    hits = hits.groupBy(id_col, "word", "label", "weight").agg(F.sum("n_apart").alias("n_apart"))
    if lone_words_twice:
        hits = hits.filter((F.col("n_apart") > 1) | F.col("word").contains(" "))
    some = hits.groupBy(id_col, "label").agg(F.sum(F.least("n_apart", F.lit(most)) * F.col("weight")).cast(kind).alias("total"), F.count("*").alias("words"))
    return out.join(again, same, "left_anti").unionByName(some)
