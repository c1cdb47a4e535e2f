"""Corpus blocks: the shared ground of the operators that work on bytes.

Documents are packed once into rows of a few MB (``write_blocks``), a bucketed table in
the folder named by ``spark.checkpoint.dir``. Each later pass reads that table, so a
lost executor costs a re-read and never changes what a block holds. Facts about the
whole corpus (how often a key occurs anywhere) come from ``exchange``: every block sends
its *distinct* keys, dealt by ranges of a 64-bit hash, and gets the totals back in the
order of its own sorted keys. A key held by a third of all rows therefore arrives at most
once per block, nothing is broadcast, and nothing reaches the driver but fixed-size sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import made_table, named, stored, work_path

BLOCK_BYTES = 3 << 19
BLOCK_DOCS = 1 << 16
RANGE_BYTES = 8 << 20
#: Stands for a null id inside blocks.
NULL_ID = np.iinfo(np.int64).max

U64 = np.uint64


# --------------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), elementwise."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] a polynomial hash of data[i:j], still shifted by i."""
    out = np.zeros(len(data) + 1, U64)
    terms = _BYTE[data]
    terms *= powers(_BASE, len(data))
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends]; equal bytes have equal hashes anywhere."""
    h = prefix[ends] - prefix[starts]
    h *= powers(_INVERSE, len(prefix))[starts]
    h += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(h)


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, as span_hash has them."""
    h = prefix[k:] - prefix[:-k]
    h *= powers(_INVERSE, len(prefix))[: len(h)]
    h += U64(k * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    return mix(h)


# ------------------------------------------------------------------------ byte classes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Tokens of the language model and of shingles are split at these bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Block:
    """Whole documents: ids, byte lengths (-1: null text) and the bytes, one after another."""

    key: int
    ids: np.ndarray
    lens: np.ndarray
    data: np.ndarray
    extra: dict

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.maximum(self.lens, 0))]).astype(np.int64)


def token_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run without a separator, within documents."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~sep[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = word[cut]
    cut = cut[cut > 0] - 1
    last[cut] = word[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


# ------------------------------------------------------------------------- arrow access


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, lengths and validity of a string or binary column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_string())
        wide = True
    n = len(column)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    _, offs, data = column.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), valid
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    lens = np.where(valid, np.diff(offs), 0)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    if lens.sum() != len(data):  # bytes behind null slots
        keep = np.repeat(valid, np.diff(offs))
        data = data[keep]
    return data, lens, valid


def int_ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


# ------------------------------------------------------------------------------ blocks

_BLOCK_SCHEMA = "block long, n_bytes long, ids binary, lens binary, data binary, carry binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seq, held, size, n = 0, [], 0, 0

    def flush() -> pa.RecordBatch:
        ids, lens, data = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
        carry = None
        if held[0][3].num_columns:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches([h[3] for h in held]).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            carry = sink.getvalue().to_pybytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([part << 24 | seq]), pa.array([len(data)]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([lens.astype("<i8").tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()), pa.array([carry], pa.binary())],
            ["block", "n_bytes", "ids", "lens", "data", "carry"],
        )

    for b in batches:
        ids = int_ids(b.column(0))
        data, lens, valid = utf8_parts(b.column(1))
        rest = b.select(range(2, b.num_columns))
        ends = np.cumsum(lens)
        at = 0
        while at < len(ids):
            base = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES - size, "right"))), at + BLOCK_DOCS - n)
            held.append((ids[at:to], np.where(valid, lens, -1)[at:to], data[base : ends[to - 1]].copy(), rest.slice(at, to - at)))
            size += int(ends[to - 1] - base)
            at = to
            n += len(held[-1][0])
            if size >= BLOCK_BYTES * 0.9 or n >= BLOCK_DOCS:
                yield flush()
                seq, held, size, n = seq + 1, [], 0, 0
    if held:
        yield flush()


#: Estimates of more bytes than this stand for plans whose size isn't known.
UNKNOWN_BYTES = 1 << 50


def input_bytes(source: DataFrame) -> int:
    """Bytes of (id, text) rows as the optimizer estimates them; counted where it can't tell."""
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < UNKNOWN_BYTES:
        return size
    return int(source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


class Blocks:
    """The documents as a table of blocks, bucketed by block key.

    Columns named in ``carry`` travel with the blocks and come back by ``carried``.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()):
        spark = self.spark = docs.sparkSession
        self.carry = list(carry)
        others = [named(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
        source = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"), *others)
        self.carry_kinds = [f.dataType.simpleString() for f in source.schema.fields[2:]]
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = int(min(max(width, input_bytes(source) // (64 << 20)), 100_000))
        name = made_table(f"rosterlens_{uuid.uuid4().hex}")
        (
            source.mapInArrow(_pack, _BLOCK_SCHEMA)
            .write.option("path", work_path(spark, "blocks")).option("compression", "zstd")
            .bucketBy(self.buckets, "block").saveAsTable(name)
        )
        self.df = spark.table(name)
        self.n_bytes = self.df.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        self.ranges = int(max(width, self.n_bytes // RANGE_BYTES, 1))

    def with_facts(self, *facts: DataFrame) -> DataFrame:
        """Blocks beside rows of facts keyed by block. The bucketed side isn't shuffled."""
        out = self.df
        for one in facts:
            out = out.join(one.hint("shuffle_hash"), "block", "left")
        return out

    def map(self, df: DataFrame, f: Callable[[Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``f`` over each block; further columns are in ``Block.extra``."""
        return df.mapInArrow(lambda batches: (out for b in batches for block in _blocks(b) for out in f(block)), schema)


def carried(block: Block) -> list[pa.Array]:
    """The columns that travelled with a block."""
    raw = block.extra.get("carry")
    if raw is None or not raw.is_valid:
        return []
    return [c.combine_chunks() for c in pa.ipc.open_stream(raw.as_buffer()).read_all().columns]


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    names = batch.schema.names
    extra = [n for n in names if n not in ("block", "n_bytes", "ids", "lens", "data")]
    cols = {n: batch.column(names.index(n)) for n in names}
    view = lambda n, i, kind: np.frombuffer(cols[n][i].as_buffer(), kind)
    for i in range(batch.num_rows):
        yield Block(cols["block"][i].as_py(), view("ids", i, "<i8"), view("lens", i, "<i8"), view("data", i, np.uint8), {n: cols[n][i] for n in extra})


# ---------------------------------------------------------------------------- exchange


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as planes of bytes of their differences; the high planes compress well."""
    gaps = np.diff(keys, prepend=U64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(raw: bytes | pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs, which the first byte tells."""
    most = int(counts.max()) if len(counts) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack_counts(raw: pa.Buffer) -> np.ndarray:
    return np.frombuffer(raw, f"<u{memoryview(raw)[0]}", offset=1).astype(np.int64)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


_ASK = "r long, block long, keys binary, vals binary, own binary"
_TOLD = "r long, block long, vals binary, stats array<long>"


def exchange(
    blocks: Blocks,
    df: DataFrame,
    ask: Callable[[Block], tuple[np.ndarray, ...]],
    name: str,
    stats: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[DataFrame, list[int]]:
    """Totals over the corpus of what each block counts.

    ``ask`` gives a block's sorted distinct 64-bit keys, a count for each, and possibly
    statistics of what the block knows without asking. Returned: ``(block, <name>)`` with the
    totals (63 bits) in pieces by range, to be read by ``told`` and ``elsewhere``, and the sums of
    ``stats(keys, totals)`` over all ranges and of the blocks' own statistics.
    """
    ranges = blocks.ranges

    def emit(block: Block) -> Iterator[pa.RecordBatch]:
        keys, vals, *own = ask(block)
        own = own[0].astype("<i8").tobytes() if own and own[0].any() else None
        if not len(keys):
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array([block.key % ranges]), pa.array([block.key]), pa.array([b""], pa.binary()), pa.array([pack_counts(keys)], pa.binary()), pa.array([own], pa.binary())], ["r", "block", "keys", "vals", "own"])
            return
        r = range_of(keys, ranges)
        cut = np.flatnonzero(np.diff(r, prepend=-1))
        ends = np.append(cut[1:], len(keys))
        yield pa.RecordBatch.from_arrays(
            [pa.array(r[cut]), pa.array(np.full(len(cut), block.key)), pa.array([pack_keys(keys[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([pack_counts(vals[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([own] + [None] * (len(cut) - 1), pa.binary())],
            ["r", "block", "keys", "vals", "own"],
        )

    def total(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys = [unpack_keys(x.as_buffer()) for x in group["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        vals = np.concatenate([unpack_counts(x.as_buffer()) for x in group["vals"]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        totals = np.add.reduceat(vals[order], cut) if len(cut) else vals
        back = np.empty(len(keys), np.int64)
        # The last bit says whether more than one block has the key.
        many = np.diff(np.append(cut, len(keys)))
        back[order] = np.repeat(totals * 2 + (many > 1), many)
        parts = [pack_counts(x) for x in np.split(back, ends[:-1])]
        n = len(parts)
        sums = stats(keys[cut], totals) if stats else np.zeros(0, np.int64)
        for own in group["own"]:
            if own.is_valid:
                sums = sums + np.frombuffer(own.as_buffer(), "<i8")
        r = group["r"][0].as_py()
        return pa.table(
            [pa.array([r] * (n + 1), pa.int64()), pa.array([*group["block"].to_pylist(), -1], pa.int64()), pa.array([*parts, None], pa.binary()), pa.array([None] * n + [sums.tolist()], pa.list_(pa.int64()))],
            names=["r", "block", "vals", "stats"],
        )

    out = stored(blocks.map(df, emit, _ASK).groupBy("r").applyInArrow(total, _TOLD), name)
    sums = []
    if stats:
        rows = out.filter("block = -1").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
        sums = [x["s"] for x in rows]
    facts = out.filter("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("r", "vals"))).alias(name))
    return facts, sums


def told(value: pa.Scalar) -> np.ndarray:
    """The totals that ``exchange`` returned to a block, in the order of its keys."""
    return _returned(value) >> 1


def elsewhere(value: pa.Scalar) -> np.ndarray:
    """Whether other blocks asked for a key too, in the order of a block's keys."""
    return _returned(value) % 2 == 1


def _returned(value: pa.Scalar) -> np.ndarray:
    if value is None or not value.is_valid:
        return np.zeros(0, np.int64)
    vals = value.values.field("vals")
    return np.concatenate([unpack_counts(x.as_buffer()) for x in vals] or [np.zeros(0, np.int64)])


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each row's place among them, and the summed weights."""
    uniq, where = np.unique(keys, return_inverse=True)
    n = np.bincount(where, weights, len(uniq)).astype(np.int64) if len(uniq) else np.zeros(0, np.int64)
    return uniq, where, n



def streamed(batches: Iterator[pa.RecordBatch], most: int = BLOCK_DOCS) -> Iterator[Block]:
    """Blocks of about BLOCK_BYTES and up to ``most`` rows straight from batches of (id, text, ...); ``extra`` has the slice."""
    for b in batches:
        ids = int_ids(b.column(0))
        data, lens, valid = utf8_parts(b.column(1))
        ends = np.cumsum(lens)
        at = 0
        while at < len(ids):
            base = int(ends[at - 1]) if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right"))), at + most)
            yield Block(0, ids[at:to], np.where(valid, lens, -1)[at:to], data[base : ends[to - 1]], {"rows": b.slice(at, to - at)})
            at = to
