"""Exact removal of repeated byte strings with sharded suffix arrays.

A byte goes when a ``span``-byte string that covers it also starts in a document with a
smaller id. Equal strings of ``span`` bytes hold the same smallest hash among their
``ANCHOR``-byte pieces, so that hash deals the work: strings that could be equal meet in
one shard, without comparing shards pairwise. The steps:

1. Whole copies of a text with a smaller id are settled by their digests.
2. Blocks exchange their distinct anchors; only anchors that occur in two or more
   documents matter from here on.
3. Around those, each block sends its distinct runs of bytes with the smallest id of its
   own documents, dealt by anchor. An anchor in more than ``HOT`` documents (a line in a
   third of all rows) is dealt by the hash of every single window instead.
4. There, shards of bounded size get suffix arrays by Larsson-Sadakane refinement and common
   prefixes by Kasai's pass; their classes of equal windows are merged across shards by
   binary search. One bit per window goes back to the block.

Null and empty texts have no bytes. Rows that repeat an id don't count as smaller than each
other; a null id is larger than every other. An empty table gives no rows. Only the id and
text columns are read; others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U64, Block, Blocks, carried, exchange, gram_hash, ids_out, mix, pack_keys, prefix_hash, range_of, span_hash, told, unpack_keys
from .shared import stored

SPAN = 50
ANCHOR = 25
HOT = 5000
#: Bytes of a shard with a suffix array of its own, and of a stretch of Kasai's pass.
PIECE_BYTES = 1 << 18
KASAI_STEPS = 256
STRETCH = 1 << 16
#: Bytes of documents for each shard.
SHARD_BYTES = 2 << 20


# ----------------------------------------------------------------------- suffix arrays


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one big-endian number (zeros past the end)."""
    out = np.zeros(len(data), U64)
    for j in range(min(8, len(data))):
        out[: len(data) - j] |= data[j:].astype(U64) << U64(56 - 8 * j)
    return out


def suffix_array(data: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``data`` in order of their first ``depth`` bytes (all, if None), and ranks.

    Larsson-Sadakane: sort by eight bytes, then let h double; only groups that are still
    equal are sorted again, by the rank of the suffix h further on.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = packed(data)
    order = np.argsort(key)
    s = key[order]
    # A suffix shorter than eight bytes and one that goes on with zeros pack alike: the shorter comes first.
    zeros = np.flatnonzero((s[1:] == s[:-1]) & (np.maximum(order[1:], order[:-1]) > n - 8))
    if len(zeros):
        tail = np.minimum(n - order, 8)
        order = order[np.lexsort((tail, s))]
        s = key[order]
    tail = np.minimum(n - order, 8)
    new = np.ones(n, bool)
    new[1:] = (s[1:] != s[:-1]) | (tail[1:] != tail[:-1])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size)
    h = 8
    while (depth is None or h < depth) and h < n:
        slots = np.flatnonzero(np.repeat(size > 1, size))
        if not len(slots):
            break
        suffix = order[slots]
        group = rank[suffix]
        ahead = suffix + h
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = group * (n + 1) + then
        by = np.argsort(both)
        suffix, both = suffix[by], both[by]
        order[slots] = suffix
        new[slots[1:]] |= both[1:] != both[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        rank[order] = np.repeat(first, size)
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the suffix array, up to ``most``.

    Kasai's pass: suffixes are taken in text order, and each starts from what the one before
    it had, less one. Stretches of the text go side by side, so that a step is one array
    operation; a stretch's first suffix starts from nothing. ``rank`` is that of an array
    sorted to a depth of ``most`` bytes or more: suffixes of one rank agree so far, and as
    their order is open, the next suffix starts from nothing too.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    key = packed(data)
    lanes = -(-n // KASAI_STEPS)
    length = np.zeros(n, np.int64)
    have = np.zeros(lanes, np.int64)
    base = np.arange(lanes) * KASAI_STEPS
    for t in range(min(KASAI_STEPS, n)):
        at = base + t
        if at[-1] >= n:
            base, have, at = base[:-1], have[:-1], at[:-1]
        other = before[at]
        tied = (rank[at] == rank[other]) & (other >= 0) if rank is not None else np.zeros(len(at), bool)
        room = np.where(other >= 0, np.minimum(n - np.maximum(at, other), most), 0)
        have = np.minimum(np.maximum(have - 1, 0), room)
        live = np.flatnonzero((have < room) & ~tied)
        while len(live):
            x = key[at[live] + have[live]] ^ key[other[live] + have[live]]
            same = np.full(len(live), 8, np.int64)
            some = x != 0
            # The highest byte that differs, from the exponent of a float that can't round up to the next byte.
            hi = np.floor(np.log2((x[some] >> U64(8)).astype(float) * 256 + 1)).astype(np.int64)
            same[some] = 7 - np.minimum(hi, 63) // 8
            have[live] = np.minimum(have[live] + same, room[live])
            live = live[(same == 8) & (have[live] < room[live])]
        length[at] = np.where(tied, most, have)
        have[tied] = 0
    out[:] = length[order]
    return out


def _classes(piece: np.ndarray, own: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of equal ``span``-byte windows for each start in ``own``, and a start of each class in sorted order."""
    order, rank = suffix_array(piece, 64 if span <= 64 else None)
    kind = np.cumsum(common_prefixes(piece, order, span, rank) < span)
    valid = np.full(len(piece), -1, np.int64)
    valid[own] = np.arange(len(own))
    where = valid[order]
    kind, order, where = kind[where >= 0], order[where >= 0], where[where >= 0]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    out = np.empty(len(own), np.int64)
    out[where] = np.cumsum(new) - 1
    return out, order[new]


def window_minima(data: np.ndarray, starts: np.ndarray, values: np.ndarray, span: int) -> np.ndarray:
    """For each ``span``-byte window at ``starts``, the least value among equal windows.

    Shards of bounded size get a suffix array each. They are merged one by one: the sorted
    representatives of a shard's classes are looked up by binary search among those of the
    shards before it, and new ones are put in between; in the end each shard reads its classes'
    least values back the same way.
    """
    out = values.copy()
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data) + PIECE_BYTES, PIECE_BYTES)))
    shards = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a, b = int(starts[lo]), int(starts[hi - 1]) + span
        kind, first = _classes(data[a:b], starts[lo:hi] - a, span)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, values[lo:hi])
        shards.append((lo, hi, kind, least, first + a))
    if len(shards) == 1:
        lo, hi, kind, least, _ = shards[0]
        out[lo:hi] = least[kind]
        return out
    known, lowest = np.zeros(0, f"S{span + 1}"), np.zeros(0, np.int64)
    for *_, least, first in shards:
        rows = _rows(data, first, span)
        at = np.searchsorted(known, rows)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == rows[hit]
        lowest[at[hit]] = np.minimum(lowest[at[hit]], least[hit])
        known, lowest = np.insert(known, at[~hit], rows[~hit]), np.insert(lowest, at[~hit], least[~hit])
    for lo, hi, kind, _, first in shards:
        out[lo:hi] = lowest[np.searchsorted(known, _rows(data, first, span))][kind]
    return out


def _rows(data: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """The windows at ``at`` as comparable strings."""
    text = np.ones((len(at), span + 1), np.uint8)  # a last byte that isn't zero
    text[:, :span] = data[at[:, None] + np.arange(span)]
    return text.view(f"S{span + 1}").ravel()


# --------------------------------------------------------------------- runs of windows


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _lowest(data: np.ndarray, span: int) -> np.ndarray:
    """The smallest anchor hash in each window, a stretch of bytes at a time."""
    out = np.empty(len(data) - span + 1, U64)
    for at in range(0, len(out), STRETCH):
        prefix = prefix_hash(data[at : at + STRETCH + span - 1])
        out[at : at + STRETCH] = _sliding_min(gram_hash(prefix, ANCHOR), span - ANCHOR + 1)
    return out


def _runs(block: Block, skip: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one smallest anchor hash: start, windows, document, hash."""
    n, offsets = len(block.data), block.offsets
    if n < span:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    low = _lowest(block.data, span)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[offsets[:-1][offsets[:-1] < len(low)]] = True
    first = np.flatnonzero(new)
    doc = np.searchsorted(offsets, first, "right") - 1
    # Of a run, the windows count that end within the document.
    count = np.minimum(np.append(first[1:], len(low)), offsets[doc + 1] - span + 1) - first
    keep = (count > 0) & ~skip[doc]
    first, count, doc = first[keep], count[keep], doc[keep]
    return first, count, doc, mix(low[first] ^ U64(0x9E3779B97F4A7C15))  # smallest hashes crowd near zero


def _skip(block: Block) -> np.ndarray:
    out = np.zeros(len(block.ids), bool)
    copies = block.extra["copies"]
    if copies.is_valid:
        out[np.array(copies.as_py(), np.int64)] = True
    return out


def _anchors(block: Block, span: int):
    runs = _runs(block, _skip(block), span)
    uniq, where = np.unique(runs[3], return_inverse=True)
    return runs, uniq, where


def _strings(block: Block, span: int):
    """Runs at shared anchors: start, windows, document, and for the distinct ones the order in which they are sent, their smallest id and route."""
    prefix = prefix_hash(block.data)
    (start, count, doc, low), _, where = _anchors(block, span)
    total = told(block.extra["anchors"])[where] if len(where) else np.zeros(0, np.int64)
    keep = total > 1
    start, count, doc, low, total = (x[keep] for x in (start, count, doc, low, total))
    hot = total > HOT
    if hot.any():
        n = count[hot]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        one = np.repeat(start[hot], n) + step
        start = np.concatenate([start[~hot], one])
        doc = np.concatenate([doc[~hot], np.repeat(doc[hot], n)])
        count = np.concatenate([count[~hot], np.ones(len(one), np.int64)])
        low = np.concatenate([low[~hot], span_hash(prefix, one, one + span)])
    text = span_hash(prefix, start, start + count + span - 1)
    ids = block.ids[doc]
    order = np.lexsort((ids, text, low))
    first = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    first[1:] = (low[a] != low[b]) | (text[a] != text[b])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    return start, count, doc, ids, order[first], place, low


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_text: bool = False) -> DataFrame:
    """What is left of each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    ``with_text`` adds ``text``, the kept bytes; there a character that a removed run cuts
    through stays whole. A null text stays null.
    """
    return _cut_docs(docs, id_col, text_col, span, with_text, ())


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, span: int = SPAN) -> DataFrame:
    """``docs`` with what is left of its texts, without those of which nothing is left; all its columns, whatever their names.

    ``length_col`` is the column that holds a text's characters, to be counted anew.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col, length_col)]
    left = _cut_docs(docs, id_col, text_col, span, True, others).filter("n_bytes = 0 or n_removed < n_bytes")
    back = {id_col: F.col("doc_id"), text_col: F.col("text")} | {c: F.col(f"carry_{i}") for i, c in enumerate(others)}
    if length_col is not None:
        back[length_col] = F.length("text")
    return left.select(*(back[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def _cut_docs(docs: DataFrame, id_col: str, text_col: str, span: int, with_text: bool, keep_columns: Sequence[str]) -> DataFrame:
    """``dedup`` with the columns of ``docs`` named in ``keep_columns`` as carry_0, carry_1 and so on."""
    if span < ANCHOR:
        raise ValueError(f"span must be at least {ANCHOR}")
    blocks = Blocks(docs, id_col, text_col, keep_columns)
    others = [f"carry_{i}" for i in range(len(keep_columns))]

    def digests(block: Block) -> Iterator[pa.RecordBatch]:
        off = block.offsets
        raw = block.data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(block.ids), block.key)), pa.array(np.arange(len(block.ids))), pa.array(block.ids), pa.array([hashlib.sha256(raw[a:b]).digest()[:20] if b - a >= span else None for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())],
            ["block", "place", "id", "digest"],
        )

    rows = stored(blocks.map(blocks.df, digests, "block long, place long, id long, digest binary").filter("digest is not null"), "digests")
    # Stored, so that the join's sides are plain shuffles and a text in many rows is split.
    least = stored(rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("most > least").select("digest", "least"), "least")
    copies = stored(rows.join(least, "digest").filter("id > least").groupBy("block").agg(F.collect_list("place").alias("copies")), "copies")

    def ask(block: Block) -> tuple[np.ndarray, np.ndarray]:
        (_, _, doc, _), uniq, where = _anchors(block, span)
        pair = np.unique(where * (len(block.ids) + 1) + doc)
        return uniq, np.bincount(pair // (len(block.ids) + 1), minlength=len(uniq))

    anchors, _ = exchange(blocks, blocks.with_facts(copies), ask, "anchors")
    ranges = max(blocks.ranges, blocks.n_bytes // SHARD_BYTES)

    def send(block: Block) -> Iterator[pa.RecordBatch]:
        start, count, _, ids, sent, _, low = _strings(block, span)
        if not len(sent):
            return
        r = range_of(low[sent], ranges)
        edges = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            s = sent[a:b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[a]]), pa.array([block.key]), pa.array([pack_keys(low[s])], pa.binary()), pa.array([count[s].astype("<i4").tobytes()], pa.binary()), pa.array([ids[s].astype("<i8").tobytes()], pa.binary()), pa.array([_cut(block.data, start[s], count[s] + span - 1).tobytes()], pa.binary())],
                ["r", "block", "anchors", "counts", "ids", "data"],
            )

    def settle(group: pa.Table) -> pa.Table:
        """For each block, which of the windows it sent also start in a document with a smaller id."""
        group = group.combine_chunks()
        join = lambda n, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group[n]])
        count, ids, data = join("counts", "<i4").astype(np.int64), join("ids", "<i8"), join("data", np.uint8)
        own = np.cumsum([len(x.as_buffer()) // 4 for x in group["counts"]])
        size = count + span - 1
        start = np.cumsum(size) - size
        anchor = np.concatenate([unpack_keys(x.as_buffer()) for x in group["anchors"]])
        # Runs that several blocks sent are kept once, with the least of their ids.
        text = span_hash(prefix_hash(data), start, start + size)
        order = np.lexsort((count, text, anchor))
        a, b = order[1:], order[:-1]
        other = np.ones(len(order), bool)
        other[1:] = anchor[a] != anchor[b]
        new = other.copy()
        new[1:] |= (text[a] != text[b]) | (count[a] != count[b])
        first = np.flatnonzero(new)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[order], first)
        once = order[first]
        n = count[once]
        base = np.cumsum(n) - n
        lowest = np.repeat(least, n)
        # Where an anchor has a single run, its windows equal no others; the rest are sorted.
        alone = other[first] & np.append(other[first][1:], True)
        some = np.flatnonzero(~alone)
        if len(some):
            length = n[some] + span - 1
            begin = np.cumsum(length) - length
            step = np.arange(n[some].sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            lowest[np.repeat(~alone, n)] = window_minima(_cut(data, start[once[some]], length), np.repeat(begin, n[some]) + step, np.repeat(least[some], n[some]), span)
        k = np.repeat(kind, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gone = lowest[base[k] + at] < np.repeat(ids, count)
        ends = np.cumsum(count)[own - 1]
        bits = [np.packbits(x).tobytes() for x in np.split(gone, ends[:-1])]
        return pa.table([group["r"], group["block"], pa.array(bits, pa.binary())], names=["r", "block", "bits"])

    shared = stored(blocks.map(blocks.with_facts(copies, anchors), send, "r long, block long, anchors binary, counts binary, ids binary, data binary").groupBy("r").applyInArrow(settle, "r long, block long, bits binary"), "windows")
    bits = shared.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("r", "bits"))).alias("bits"))

    def keep(block: Block) -> Iterator[pa.RecordBatch]:
        lens, off = np.maximum(block.lens, 0), block.offsets
        gone = np.zeros(len(block.data), bool)
        skip = _skip(block)
        start, count, doc, ids, sent, place, low = _strings(block, span)
        if len(sent):
            r = range_of(low[sent], ranges)
            got = {x["r"]: np.frombuffer(x["bits"], np.uint8) for x in block.extra["bits"].as_py()}
            edges = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r))
            flat = np.concatenate([np.unpackbits(got[r[a]], count=int(count[sent[a:b]].sum())) for a, b in zip(edges[:-1], edges[1:], strict=True)]).astype(bool)
            base = np.cumsum(count[sent]) - count[sent]
            n = count
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            removed = flat[np.repeat(base[place], n) + at] | np.repeat(ids > ids[sent][place], n)
            window = (np.repeat(start, n) + at)[removed]
            edge = np.zeros(len(block.data) + 1, np.int32)
            edge[: len(block.data)] += np.bincount(window, minlength=len(block.data)).astype(np.int32)
            edge[span:] -= np.bincount(window, minlength=len(block.data))[: len(edge) - span].astype(np.int32)
            gone = np.cumsum(edge[:-1]) > 0
        if skip.any():
            gone |= np.repeat(skip, lens)
        owner = np.repeat(np.arange(len(lens)), lens)
        n_removed = np.bincount(owner[gone], minlength=len(lens))
        begin = gone.copy()
        begin[1:] &= ~gone[:-1] | (owner[1:] != owner[:-1])
        n_spans = np.bincount(owner[begin], minlength=len(lens))
        stay = np.concatenate([[0], np.cumsum(lens - n_removed)]).tolist()
        raw = block.data[~gone].tobytes()
        cols = [ids_out(block.ids), pa.array(lens), pa.array(n_removed), pa.array(n_spans), pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(stay[:-1], stay[1:], strict=True)])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            head = np.flatnonzero((block.data & 0xC0) != 0x80)
            whole = np.logical_and.reduceat(gone, head) if len(head) else gone
            left = ~np.repeat(whole, np.diff(np.append(head, len(block.data)))) if len(head) else ~gone
            stay = np.concatenate([[0], np.cumsum(np.bincount(owner[left], minlength=len(lens)))]).tolist()
            raw = block.data[left].tobytes()
            cols.append(pa.array([None if n < 0 else raw[a:b].decode() for n, a, b in zip(block.lens.tolist(), stay[:-1], stay[1:], strict=True)], pa.string()))
            names.append("text")
        yield pa.RecordBatch.from_arrays([*cols, *carried(block)], [*names, *others])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    schema += "".join(f", {n} {k}" for n, k in zip(others, blocks.carry_kinds, strict=True))
    return blocks.map(blocks.with_facts(copies, anchors, bits), keep, schema)
