"""Token ids in binary shard files with a minimal perfect hash index.

Documents are dealt by ranges of their id, so shards follow each other in order of id. A
shard file holds the raw ids of its documents one after another and an index: a minimal
perfect hash (hash and displace) sends each distinct id to a slot with a fingerprint, the
document's place and how many documents share the id. A keyed read takes the file's head,
a displacement, a slot and the places of the document, each by offset, and then the
document's own ids; an absent key is told apart with probability 1 - 2**-32, and for sure
by the stored id. Files are written under a name of the attempt and then renamed, so that
a repeated task leaves a whole file.

File format, little-endian: 8 bytes magic; eight 64-bit numbers (width of an id in bytes,
documents, ids, keys, buckets, seed, 0, 0); 64-bit end of each document counted in ids;
64-bit document ids; 32-bit displacement of each bucket; per slot 32-bit fingerprint,
32-bit first document, 32-bit number of documents; the ids.

Encoding is that of the tokenizers library, piece by piece: texts are cut where its
byte-level pre-tokenizer cuts them, and each worker has the library encode a distinct piece
once. Which characters are letters, numbers or white space is asked of the library itself.
Added tokens in a text are cut out first and get their own ids, as by the library. With a
vocabulary of another make the library encodes whole texts.

Null and empty texts have the end id alone. A null document id comes first and has no key.
Rows that repeat an id follow each other in order of their text's hash. An empty table
writes no shard. Only the id and text columns are read; others may have any name.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import NULL_ID, U64, Block, ids_out, input_bytes, mix, prefix_hash, span_hash, streamed
from .shared import named, stored, work_path

MAGIC = b"RLTOKEN1"
SHARD_BYTES = 16 << 20
SHARD_DOCS = 1 << 19
CACHE_PIECES = 1_500_000
NO_KEY = NULL_ID

# ----------------------------------------------------------------- the pre-tokenizer

_LETTER, _NUMBER, _SPACE, _OTHER, _UNASKED = range(5)
#: Contractions that are pieces of their own. Fixed values.
_SHORT = ("s", "t", "re", "ve", "m", "ll", "d")


class Kinds:
    """Letter, number, white space or other, for each code point, as the library's pre-tokenizer has it.

    A character that goes on from a letter is a letter, and so on; one that goes on from
    nothing is white space. Each code point is asked for when it is first met.
    """

    def __init__(self, pre_tokenizer):
        self.cut = pre_tokenizer.pre_tokenize_str
        self.table = np.full(0x110000, _UNASKED, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        kind = self.table[points]
        if (kind == _UNASKED).any():
            for c in np.unique(points[kind == _UNASKED]).tolist():
                joins = (k for k, before in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(self.cut(before + chr(c))) == 1)
                self.table[c] = next(joins, _SPACE)
            kind = self.table[points]
        return kind


def piece_starts(points: np.ndarray, offsets: np.ndarray, kinds: Kinds) -> np.ndarray:
    """Where pieces begin among code points, texts being cut at ``offsets``.

    A piece is a run of letters, of numbers or of other characters, with one space before
    it if there is one; or white space, whose last character goes to the next piece if it
    is a space and stands alone if not; or a contraction after an apostrophe.
    """
    n = len(points)
    kind = kinds.of(points)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    new = cut[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    white = kind == _SPACE
    start = new.copy()
    # The last of some white space before more text begins anew; a space there takes what follows.
    last = white.copy()
    last[:-1] &= ~white[1:]
    last[-1:] = False
    last &= ~cut[1:]
    start |= last
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (points[:-1] == 32)
    start[joined] = False
    marks = np.flatnonzero((points == 39) & new & ~joined)
    if len(marks):
        ends = offsets[np.searchsorted(offsets, marks, "right")]
        done = np.zeros(len(marks), bool)
        for short in _SHORT:
            fits = ~done & (marks + len(short) < ends)
            for k, c in enumerate(short):
                fits &= points[np.minimum(marks + 1 + k, n - 1)] == ord(c)
            at = marks[fits]
            for k in range(len(short)):
                start[at + 1 + k] = False
            after = at + 1 + len(short)
            after = after[(after < n)]
            # What follows is a new match, unless it is a space or line end that starts one by itself.
            start[after] = True
            done |= fits
    return np.flatnonzero(start)


class PieceEncoder:
    """Ids of texts, by way of their distinct pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        pre = self.model.pre_tokenizer
        self.by_piece = self.model.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
        if self.by_piece:
            self.kinds = Kinds(pre)
        added = list(self.model.get_added_tokens_decoder().values())
        plain = {t.content: not (t.lstrip or t.rstrip or t.single_word) for t in added}
        # Leftmost and longest. A text with a token that takes its surroundings into account is one piece.
        self.plain = {t.encode(): v for t, v in plain.items()}
        self.added = re.compile(b"|".join(re.escape(t) for t in sorted(self.plain, key=len, reverse=True))) if plain else None
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, U64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _added(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Begin and end of the added tokens in the texts, which are pieces of their own."""
        if self.added is None or not self.added.search(raw):
            return np.zeros((0, 2), np.int64)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = list(self.added.finditer(raw, a, b))
            out += [m.span() for m in found] if all(self.plain[m[0]] for m in found) else [(a, b)]
        return np.array(out, np.int64).reshape(-1, 2)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        n_docs = len(block.ids)
        if not len(block.data):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        raw = block.data.tobytes()
        if not self.by_piece:
            off = block.offsets.tolist()
            got = [x.ids for x in self.model.encode_batch_fast([raw[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)], add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
        text = raw.decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        wide = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(wide)])
        cuts = np.searchsorted(at, block.offsets)
        begin, end = np.searchsorted(at, self._added(raw, block.offsets)).T
        starts = piece_starts(points, np.unique(np.concatenate([cuts, begin, end])), self.kinds)
        if len(begin):
            k = np.searchsorted(begin, starts, "right") - 1
            starts = starts[(k < 0) | (starts == begin[k]) | (starts >= end[k])]
        a = at[starts]
        b = np.append(a[1:], len(block.data))
        uniq, first, where = np.unique(span_hash(prefix_hash(block.data), a, b), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES or len(self.ids) > 8 * CACHE_PIECES:
            self.reset()
        place = np.searchsorted(self.keys, uniq)
        fresh = np.ones(len(uniq), bool)
        inside = place < len(self.keys)
        fresh[inside] = self.keys[place[inside]] != uniq[inside]
        if fresh.any():
            f = first[fresh]
            got = [x.ids for x in self.model.encode_batch_fast([raw[i:j].decode() for i, j in zip(a[f].tolist(), b[f].tolist(), strict=True)], add_special_tokens=False)]
            size = np.array([len(x) for x in got], np.int32)
            flat = np.array([i for x in got for i in x], np.uint32)
            begin = len(self.ids) + np.cumsum(size) - size
            keys = np.concatenate([self.keys, uniq[fresh]])
            order = np.argsort(keys)
            self.keys = keys[order]
            self.begin, self.size = np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, flat])
            place = np.searchsorted(self.keys, uniq)
        size = self.size[place][where].astype(np.int64)
        ends = np.cumsum(size)
        out = self.ids[np.arange(ends[-1]) + np.repeat(self.begin[place][where] - (ends - size), size)]
        return out, np.bincount(np.searchsorted(block.offsets, a, "right") - 1, size, n_docs).astype(np.int64)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


# ------------------------------------------------------------------------ the index


def _slots(keys: np.ndarray, seed: int, buckets: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, two slot hashes and fingerprint of each key."""
    h = mix(keys.astype(np.int64).view(U64) ^ mix(np.array([seed], U64)))
    g = mix(h + U64(0x9E3779B97F4A7C15))
    return (h >> U64(32)) % U64(buckets), (h & U64(0xFFFFFFFF)) % U64(n), g % U64(max(n - 1, 1)) + U64(1), (g >> U64(32)).astype(np.uint32)


def build_index(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, displacements, each key's slot and fingerprint for distinct keys: n keys, n slots.

    Buckets of one size are placed together, the largest first: all that are left try the
    same displacement, and where two want a slot the earlier one gets it.
    """
    n = len(keys)
    buckets = max(1, -(-n // 3))
    for seed in range(64):
        bucket, one, two, mark = _slots(keys, seed, buckets, max(n, 1))
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U64))
        size = np.diff(edge)
        moved, slot, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(max(n, 1), bool)
        claim = np.empty(max(n, 1), np.int64)
        failed = False
        for width in range(int(size.max(initial=0)), 1, -1):
            left = np.flatnonzero(size == width)
            d = 0
            while len(left) and not (failed := d >= min(1 << 16, 64 + 16 * n)):
                own = order[edge[left][:, None] + np.arange(width)]
                to = (one[own].astype(np.int64) + d * two[own].astype(np.int64) + (d * d >> 3)) % n
                row = np.sort(to, 1)
                fits = np.flatnonzero(~taken[to].any(1) & (row[:, 1:] != row[:, :-1]).all(1))
                # Written backwards, a slot keeps the first bucket that wants it.
                claim[to[fits][::-1]] = fits[::-1, None]
                fits = fits[(claim[to[fits]] == fits[:, None]).all(1)]
                moved[left[fits]], slot[own[fits]], taken[to[fits]] = d, to[fits], True
                left = np.delete(left, fits)
                d += 1
            if failed:
                break
        if not failed:
            # Lone keys take the free slots in order; the top bit says that a slot is given outright.
            alone = np.flatnonzero(size == 1)
            free = np.flatnonzero(~taken[:n])
            moved[alone], slot[order[edge[alone]]] = U64(0x80000000) | free.astype(U64), free
            return seed, moved, slot, mark
    raise ValueError("no index was found; are the keys distinct?")


HEAD = 72


class Shard:
    """Keyed reads from a shard file by ``read(offset, size)``, each of a bounded number of bytes."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, HEAD)
        if head[:8] != MAGIC:
            raise ValueError("not a shard")
        self.width, self.docs, self.n_ids, self.n_keys, self.buckets, self.seed, _, _ = struct.unpack_from("<8Q", head, 8)
        sizes = (8 * self.docs, 8 * self.docs, 4 * self.buckets, 4 * self.n_keys, 4 * self.n_keys, 4 * self.n_keys)
        self.at = np.concatenate([[HEAD], HEAD + np.cumsum(sizes)]).tolist()

    def _take(self, part: int, kind: str, first: int, n: int = 1) -> np.ndarray:
        wide = np.dtype(kind).itemsize
        return np.frombuffer(self.read(self.at[part] + first * wide, n * wide), kind)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this key."""
        if not self.n_keys:
            return []
        bucket, one, two, mark = _slots(np.array([key], np.int64), self.seed, self.buckets, self.n_keys)
        slot = int(_place(self._take(2, "<u4", int(bucket[0])), one, two, self.n_keys)[0])
        if self._take(3, "<u4", slot)[0] != mark[0]:
            return []
        first, times = int(self._take(4, "<u4", slot)[0]), int(self._take(5, "<u4", slot)[0])
        if self._take(1, "<i8", first)[0] != key:
            return []
        ends = [0, *self._take(0, "<u8", 0, times)] if not first else self._take(0, "<u8", first - 1, times + 1)
        kind = f"<u{self.width}"
        return [self._take(6, kind, int(a), int(b - a)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


class WholeShard(Shard):
    """All documents of a shard in memory, by way of its index."""

    def __init__(self, content: bytes | memoryview):
        view = memoryview(content)
        super().__init__(lambda at, size: bytes(view[at : at + size]))
        kinds = ("<u8", "<i8", "<u4", "<u4", "<u4", "<u4")
        counts = (self.docs, self.docs, self.buckets, self.n_keys, self.n_keys, self.n_keys)
        self.ends, self.keys, self.moved, self.marks, self.first, self.times = (np.frombuffer(view, k, n, at) for k, n, at in zip(kinds, counts, self.at, strict=False))
        self.ids = np.frombuffer(view, f"<u{self.width}", self.n_ids, self.at[6])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents where it is absent."""
        keys = np.asarray(keys, np.int64)
        if not self.n_keys:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        bucket, one, two, mark = _slots(keys, self.seed, self.buckets, self.n_keys)
        slot = _place(self.moved[bucket.astype(np.int64)], one, two, self.n_keys)
        known = self.marks[slot] == mark
        return np.where(known, self.first[slot], 0).astype(np.int64), np.where(known, self.times[slot], 0).astype(np.int64)

    def tokens(self, doc: int) -> np.ndarray:
        return self.ids[int(self.ends[doc - 1]) if doc else 0 : int(self.ends[doc])]


def _place(moved: np.ndarray, one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """Slots of keys with these displacements and slot hashes."""
    d = moved.astype(np.int64)
    slot = np.where(d >= 1 << 31, d - (1 << 31), (one.astype(np.int64) + d * two.astype(np.int64) + (d * d >> 3)) % n)
    return np.minimum(slot, n - 1)


def shard_bytes(keys: np.ndarray, counts: np.ndarray, ids: list[np.ndarray]) -> bytes:
    """A shard of documents in order of key (null keys, as NO_KEY, first)."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    real = np.flatnonzero(keys != NO_KEY)
    distinct, first, times = np.unique(keys[real], return_index=True, return_counts=True)
    seed, moved, slot, mark = build_index(distinct)
    marks, firsts, many = (np.zeros(len(distinct), np.uint32) for _ in range(3))
    marks[slot], firsts[slot], many[slot] = mark, real[first], times
    head = MAGIC + struct.pack("<8Q", width, len(keys), len(flat), len(distinct), len(moved), seed, 0, 0)
    parts = [np.cumsum(counts).astype("<u8"), keys.astype("<i8"), moved.astype("<u4"), marks.astype("<u4"), firsts.astype("<u4"), many.astype("<u4"), flat.astype("<u2" if width == 2 else "<u4")]
    return head + b"".join(p.tobytes() for p in parts)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


# -------------------------------------------------------------------------- write, read


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of all documents to ``path``; returns (shard, file, n_docs, n_ids, low, high, start).

    ``low`` and ``high`` are the least and largest key of a shard, ``start`` the ids of all shards before it.
    """
    spark = docs.sparkSession
    source = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    size = input_bytes(source)
    n = int(min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size // SHARD_BYTES), 1 << 20))
    dealt = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, F.col("id").asc_nulls_first(), "tie")
    dealt = dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "tie").drop("tie")
    fs, base = _file_system(path)
    fs.create_dir(base, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, model = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        keys, counts, ids, held, docs = [], [], [], 0, 0

        for block in streamed(batches):
            flat, count = model.encode(block)
            ends = np.cumsum(count)
            full = np.insert(flat, ends, end_id)
            keys.append(block.ids)
            counts.append(count + 1)
            ids.append(full)
            held += len(full)
            docs += len(block.ids)
            if held * 2 >= SHARD_BYTES or docs >= SHARD_DOCS:
                yield _flush(path, part, number, keys, counts, ids)
                number, keys, counts, ids, held, docs = number + 1, [], [], [], 0, 0
        if keys:
            yield _flush(path, part, number, keys, counts, ids)

    rows = stored(dealt.mapInArrow(put, "shard long, file string, n_docs long, n_ids long, low long, high long"), "shards")
    # Two steps of running sums, so that no task gets all shards.
    rows = rows.withColumn("lot", F.col("shard").bitwiseAND(F.lit(-1 << 34)))
    lots = rows.groupBy("lot").agg(F.sum("n_ids").alias("total"))
    before = lambda w: F.coalesce(F.sum("total" if w is None else "n_ids").over((Window.orderBy("lot") if w is None else w).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = lots.select("lot", before(None).alias("base"))
    rows = rows.withColumn("inner", before(Window.partitionBy("lot").orderBy("shard"))).join(F.broadcast(lots), "lot")
    return rows.select("shard", "file", "n_docs", "n_ids", "low", "high", (F.col("base") + F.col("inner")).alias("start"))


def _flush(path: str, part: int, number: int, keys: list, counts: list, ids: list) -> pa.RecordBatch:
    key, count = np.concatenate(keys), np.concatenate(counts)
    content = shard_bytes(key, count, ids)
    store, folder = _file_system(path)
    name = f"shard-{part:07d}-{number:05d}.tok"
    attempt = f"{folder}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        out.write(content)
    store.move(attempt, f"{folder}/{name}")
    real = key[key != NO_KEY]
    low, high = (int(real.min()), int(real.max())) if len(real) else (None, None)
    cols = [pa.array([part << 24 | number]), pa.array([name]), pa.array([len(key)]), pa.array([int(count.sum())]), pa.array([low], pa.int64()), pa.array([high], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["shard", "file", "n_docs", "n_ids", "low", "high"])


def _open(path: str, name: str):
    store, folder = _file_system(path)
    return store.open_input_file(f"{folder}/{name}")


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """Rows that each stand for a file, over so many tasks; only these rows move."""
    return rows.repartition(int(min(max(n, 1), 1 << 20)), "shard")


def read(path: str, shards: DataFrame) -> DataFrame:
    """Each document as its shard file has it: doc_id, start, n_tokens, ids_crc32.

    The documents of each key come from the index; those without a key follow from their place.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                with _open(path, name) as file:
                    shard = WholeShard(file.read())
                keys = np.unique(shard.keys[shard.keys != NO_KEY])
                first, times = shard.find(keys)
                if (times == 0).any():
                    raise ValueError(f"the index of {name} misses keys")
                place = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
                place = np.concatenate([np.flatnonzero(shard.keys == NO_KEY), place])
                ids = np.concatenate([np.full(len(place) - int(times.sum()), NO_KEY), np.repeat(keys, times)])
                ends = np.concatenate([[0], shard.ends]).astype(np.int64)
                begin, end = ends[place], ends[place + 1]
                raw = memoryview(shard.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids_out(ids), pa.array(begin + start), pa.array(end - begin), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _spread(shards.select("shard", "file", "start"), shards.count()).mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(path: str, shards: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents with these ids: only the shards whose range holds a key are opened, and read by offset."""
    keys = keys.select(named(key_col).cast("long").alias("key")).filter("key is not null").distinct()
    s = shards.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("low").alias("n")).first()
    # Keys and ranges meet by slices of the span of keys; as ranges hardly overlap, they fall into few slices altogether.
    base, wide = float(s["low"] or 0), max((float(s["high"] or 0) - float(s["low"] or 0)) / max(s["n"], 1), 1.0)
    slice_ = lambda c: F.floor((F.col(c).cast("double") - base) / wide)
    ranges = shards.filter("low is not null").select("shard", "file", "low", "high", F.explode(F.sequence(slice_("low"), slice_("high"))).alias("slice"))
    wanted = ranges.join(keys.withColumn("slice", slice_("key")), "slice").filter(F.col("key").between(F.col("low"), F.col("high")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").unique().to_pylist():
                own = b.filter(pc.equal(b.column("file"), name))
                with _open(path, name) as file:
                    shard = Shard(lambda at, size: file.read_at(size, at))
                    hits = [(k, ids.astype(np.int64)) for k in own.column("key").to_pylist() for ids in shard.get(k)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hits], pa.int64()), pa.array([x for _, x in hits], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _spread(wanted.select("shard", "file", "key"), int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(scan, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write all documents and read the files back."""
    path = path or work_path(docs.sparkSession, "tokens")
    return read(path, write(docs, path, tokenizer, end_id))
