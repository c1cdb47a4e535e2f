"""Names that hold a query, without case: positional lists of short runs of bytes, intersected.

Ids are dealt to parts by a hash, about ``PART`` bytes of names each, so no list grows with the table. The index has a row for each
part: its distinct names' runs of one, two or three bytes of UTF-8, packed, and behind each the places where it stands; a run
shorter than three, which answers by itself, has a name's first place only. It is a table bucketed by part, so a table of queries
meets it without a shuffle of the lists. A query is covered by runs of three; the shortest list is looked up in the others, and where
places, less the runs' offsets, agree, the name holds the query, so no name is read again. All that is intersected lies in one
part, so places are neither rows nor sent between tasks; ids are attached last, to names that were found.
A task holds a few parts, ``LOT`` queries for each, and about ``HELD`` of the ids they find. All names of one id lie in one part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import work_folder

RUN = 3
PART = 1 << 20
BUCKETS = 10_000
LOT = 10_000
HELD = 1 << 20


class Postings:
    """An index that ``build`` has written: a bucketed table and its number of parts."""

    def __init__(self, spark: SparkSession, table: str, parts: int):
        self.spark, self.table, self.parts = spark, table, parts

    @classmethod
    def build(cls, names: DataFrame, id_col: str, name_col: str, path: str | None = None) -> Postings:
        """Over all rows with a name; rows that repeat an id count as names of one."""
        spark = names.sparkSession
        rows = names.select(F.col(id_col).alias("id"), F.lower(F.col(name_col).cast("string")).cast("binary").alias("low")).filter("id is not null and octet_length(low) > 0")
        size = rows.agg(F.sum(F.octet_length("low"))).first()[0] or 0
        parts = max(1, -(-size // PART))
        # A part is one row of some megabytes, so a bucket has few.
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(parts, BUCKETS), 1)
        dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "low")
        kind = dealt.schema["id"].dataType.simpleString()
        # Dealt as the buckets are, so that each is one file.
        lists = dealt.repartition(buckets, "part").groupBy("part").applyInArrow(_lists, f"part int, runs binary, ends binary, places binary, starts binary, ids array<{kind}>, held binary, held_ends binary")
        table = f"postings_{uuid.uuid4().hex}"
        lists.write.option("path", path or work_folder(spark, "postings")).bucketBy(buckets, "part").sortBy("part").saveAsTable(table)
        return cls(spark, table, parts)

    def search(self, queries: DataFrame, query_col: str = "query") -> DataFrame:
        """(query, id): each distinct query and the ids whose name holds it, without case. Null and empty queries find nothing."""
        asked = queries.select(F.col(query_col).cast("string").alias("query")).filter("query <> ''").distinct()
        lots = max(1, -(-asked.count() // LOT))
        lot = F.pmod(F.xxhash64("query"), F.lit(lots))
        every = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))
        dealt = asked.groupBy(lot.alias("lot")).agg(F.collect_list("query").alias("queries")).select(every.alias("part"), "queries", F.transform("queries", lambda q: F.lower(q).cast("binary")).alias("lows"))
        lists = self.spark.table(self.table)
        # Merged, as the index isn't broadcast either, and each bucket stays a task.
        found = lists.join(dealt.hint("merge"), "part").drop("part").mapInArrow(_found, f"query string, ids {lists.schema['ids'].dataType.simpleString()}")
        return found.select("query", F.explode("ids").alias("id"))


def _bytes(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each name begins and the last ends."""
    names = names.cast(pa.large_binary())
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    return np.frombuffer(names.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _lists(part: pa.Table) -> pa.Table:
    """The index row of a part. Names stand one behind the other, one place apart, so that no run is in two."""
    names, ids = (pa.concat_arrays(part[c].chunks).dictionary_encode() for c in ("low", "id"))
    data, ends = _bytes(names.dictionary)
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    left = ends[1:][owner] - np.arange(len(data))
    codes, at = data.astype(np.int32), np.arange(len(data), dtype=np.int32) + owner
    runs, places = [], []
    for k in range(1, RUN + 1):
        i = np.flatnonzero(left >= k)
        run = sum((codes[i + j] << 8 * j for j in range(k)), np.full(len(i), k << 8 * RUN, np.int32))
        order = np.argsort(run, kind="stable")
        run, i = run[order], i[order]
        if k < RUN:
            first = _first(run) | _first(owner[i])
            run, i = run[first], i[first]
        runs.append(run)
        places.append(at[i])
    run = np.concatenate(runs)
    begin = np.flatnonzero(_first(run))
    n_ids = len(ids.dictionary)
    held = np.unique(names.indices.to_numpy().astype(np.int64) * n_ids + ids.indices.to_numpy())
    packed = {
        "runs": run[begin], "ends": np.append(begin[1:], len(run)), "places": np.concatenate(places), "starts": ends[:-1] + np.arange(len(size)),
        "held": held % n_ids, "held_ends": np.cumsum(np.bincount(held // n_ids, minlength=len(size))),
    }
    row = {"part": part["part"][:1].combine_chunks(), "ids": pa.ListArray.from_arrays(pa.array([0, n_ids], pa.int32()), ids.dictionary)}
    row |= {name: pa.array([values.astype("<i4").tobytes()], pa.binary()) for name, values in packed.items()}
    return pa.table({name: row[name] for name in ("part", "runs", "ends", "places", "starts", "ids", "held", "held_ends")})


def _first(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _found(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries and the ids they find: each row is a part and a lot of queries."""
    for batch in rows:
        for r in range(batch.num_rows):
            runs, ends, places, starts, held, held_ends = (np.frombuffer(batch[c][r].as_buffer(), "<i4") for c in ("runs", "ends", "places", "starts", "held", "held_ends"))
            ids, queries, lows = (batch[c][r].values for c in ("ids", "queries", "lows"))
            several = len(held) > len(ids)
            asked: list[int] = []
            found: list[np.ndarray] = []
            n = 0
            for i, low in enumerate(lows):
                names = _holding(low.as_py(), runs, ends, places, starts)
                if not len(names):
                    continue
                begin = np.where(names > 0, held_ends[names - 1], 0)
                size = held_ends[names] - begin
                who = held[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                asked.append(i)
                found.append(np.unique(who) if several else who)
                n += len(found[-1])
                if n >= HELD:
                    yield _batch(queries, asked, ids, found)
                    asked, found, n = [], [], 0
            if asked:
                yield _batch(queries, asked, ids, found)


def _batch(queries: pa.Array, asked: list[int], ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
    upto = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    return pa.record_batch({"query": queries.take(pa.array(asked, pa.int32())), "ids": pa.ListArray.from_arrays(upto, ids.take(pa.array(np.concatenate(found))))})


def _holding(low: bytes, runs: np.ndarray, ends: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the names that hold ``low``, in order."""
    cover = []
    for at in _cover(len(low)):
        run = low[at : at + RUN]
        key = len(run) << 8 * RUN | int.from_bytes(run, "little")
        i = int(np.searchsorted(runs, key))
        if i == len(runs) or runs[i] != key:
            return starts[:0]
        cover.append((places[ends[i - 1] if i else 0 : ends[i]], at))
    (least, at), *others = sorted(cover, key=lambda c: len(c[0]))
    start = least - at
    for other, at in others:
        i = np.searchsorted(other, start + at)
        start = start[other[np.minimum(i, len(other) - 1)] == start + at]
    names = np.searchsorted(starts, start, "right") - 1
    return names[_first(names)]


def _cover(n: int) -> list[int]:
    """Where runs of three begin, one behind the other, and the last one; a shorter text is one run."""
    return [0] if n <= RUN else sorted({*range(0, n - RUN, RUN), n - RUN})
