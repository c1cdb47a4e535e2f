"""Set-similarity join of documents on word shingles with signature trees.

Documents with one shingle set form a class; links are between classes, found exactly:

1. Blocks exchange their classes' distinct shingles and learn in how many classes each
   occurs. In order of rarity, two sets of similarity t share one of the first
   ``n - ceil(t n) + 1`` shingles of each, so only those are indexed, and only where
   another class has them too. An index key also holds a band of set sizes.
2. Each index group is a star around its least class, its hub. A connected component of
   stars that is small enough is joined by one task; of a larger one, every hub's sets are,
   so that components that chance words tie together cost no more than their stars.
3. There, sets hang in a signature tree whose nodes hold OR- (and AND-) combined token
   bitmaps and size ranges. The tree is traversed against itself, dropping node pairs whose
   largest possible overlap is too small or whose members are all connected already; what is
   left is compared in full.
4. A hub with too many sets for one task is split: parts alone, then the parts' heads in
   rounds, then the sets outside of the largest group against all others.

A text without words is linked with nothing. Null ids and texts, repeated rows and ids are
allowed; a null id counts as larger than all others. Ties go to the smaller id, then to the
earlier block. An empty table gives no rows. Only id and text are read; other columns may
have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, NULL_ID, SPACE, U64, Block, Blocks, carried, exchange, ids_out, mix, prefix_hash, span_hash, token_spans, told
from .components import components
from .shared import stored

#: Sets and bytes of sets of a task that joins them.
PART_BYTES = 12 << 20
PART_SETS = 256
#: Sets on each side of a task that compares groups.
SIDE_SETS = 1000
FANOUT = 8


# ----------------------------------------------------------------------- shingle sets


def shingle_sets(block: Block, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    data, offsets = LOWER[block.data], block.offsets
    starts, ends, doc = token_spans(data, offsets, SPACE)
    h = span_hash(prefix_hash(data), starts, ends)
    edge = np.searchsorted(doc, np.arange(len(block.ids) + 1))
    n = len(h)
    grams = h.copy()
    for j in range(1, words):
        grams = mix(grams[: n - j] * U64(0x9E3779B97F4A7C15) + h[j:]) if n > j else grams[:0]
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            one = h[a : a + 1].copy()
            for j in range(a + 1, b):
                one = mix(one * U64(0x9E3779B97F4A7C15) + h[j : j + 1])
            out.append(one ^ U64(b - a))
        else:
            out.append(h[:0])
    return out


# ----------------------------------------------------------------------- signature tree


class Links:
    """Union-find over sets of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


class SignatureTree:
    """Levels of nodes over sets in order of size, leaves first."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.n = np.array([len(s) for s in sets], np.int64)
        bits = 1 << max(10, min(14, int(4 * np.median(self.n)).bit_length()))
        self.bits = np.zeros((len(sets), bits // 64), U64)
        for i, s in enumerate(sets):
            at = s >> U64(64 - bits.bit_length() + 1)
            np.bitwise_or.at(self.bits[i], (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        self.some, self.all, self.least, self.most = [self.bits], [self.bits], [self.n], [self.n]
        while len(self.least[-1]) > 1:
            cut = np.arange(0, len(self.least[-1]), FANOUT)
            self.some.append(np.bitwise_or.reduceat(self.some[-1], cut))
            self.all.append(np.bitwise_and.reduceat(self.all[-1], cut))
            self.least.append(np.minimum.reduceat(self.least[-1], cut))
            self.most.append(np.maximum.reduceat(self.most[-1], cut))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some set below a could be linked with one below b."""
        least, most, some, every = self.least[level], self.most[level], self.some[level], self.all[level]
        ok = (most[a] * self.den >= self.num * least[b]) & (most[b] * self.den >= self.num * least[a])
        at = np.flatnonzero(ok)
        x, y = a[at], b[at]
        lost_x = np.bitwise_count(every[x] & ~some[y]).sum(1, dtype=np.int64)
        lost_y = np.bitwise_count(every[y] & ~some[x]).sum(1, dtype=np.int64)
        overlap = np.minimum(most[x] - lost_x, most[y] - lost_y)
        ok[at] = overlap * (self.num + self.den) >= self.num * (least[x] + least[y])
        return ok

    def linked(self, i: int, j: int) -> bool:
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return both * self.den >= self.num * (int(self.n[i]) + int(self.n[j]) - both)

    def join(self, links: Links) -> None:
        """Traverse the tree against itself until every link is within one root."""
        group = [links.roots()]
        for level in range(1, len(self.least)):
            below = group[-1]
            cut = np.arange(0, len(below), FANOUT)
            low, high = np.minimum.reduceat(below, cut), np.maximum.reduceat(below, cut)
            low2 = np.where((low == high) & (low >= 0), low, -1)
            group.append(low2)
        top = len(self.least) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            g = group[level]
            keep = ~((g[a] >= 0) & (g[a] == g[b]))
            a, b = a[keep], b[keep]
            keep = self.possible(level, a, b)
            a, b = a[keep], b[keep]
            if not level:
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if i != j and links.root(i) != links.root(j) and self.linked(i, j):
                        links.join(i, j)
                continue
            size = len(self.least[level - 1])
            step = np.arange(FANOUT)
            for at in range(0, len(a), 2048):
                x = (a[at : at + 2048, None] * FANOUT + step)[:, :, None]
                y = (b[at : at + 2048, None] * FANOUT + step)[:, None, :]
                x, y = (z.ravel() for z in np.broadcast_arrays(x, y))
                keep = (x < size) & (y < size) & (x <= y)
                stack.append((level - 1, x[keep], y[keep]))


def link_sets(sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the place of its group's first; ``known`` gives groups found before."""
    if not sets:
        return np.zeros(0, np.int64)
    order = np.argsort([len(s) for s in sets], kind="stable")
    tree = SignatureTree([sets[i] for i in order], num, den)
    links = Links(len(sets))
    if known is not None:
        first: dict[int, int] = {}
        for i, k in enumerate(known[order].tolist()):
            links.join(i, first.setdefault(k, i))
    tree.join(links)
    out = np.empty(len(sets), np.int64)
    roots = links.roots()
    first_of = np.full(len(sets), len(sets))
    np.minimum.at(first_of, roots, order)
    out[order] = first_of[roots]
    return out


# ------------------------------------------------------------------------------- join


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Columns: doc_id, n_shingles, class_id, component_id, for documents linked at similarity num/den.

    ``class_id`` is the smallest id with the same shingle set, ``component_id`` the smallest
    that links lead to.
    """
    rows = resolved(Blocks(docs, id_col, text_col), words, num, den)
    real = lambda c: F.when(F.col(c) != int(NULL_ID), F.col(c))
    return rows.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("class_id").alias("class_id"), real("component_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, the first of repeated rows.

    Documents without words stay. Column names and types are those of ``docs``.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    blocks = Blocks(docs, id_col, text_col, others)
    rows = resolved(blocks, words, num, den)
    first = rows.filter("root is not null").groupBy("root").agg(F.min(F.struct("id", "block", "place")).alias("m")).select("m.block", "m.place")
    kept = first.unionByName(rows.filter("root is null").select("block", "place")).groupBy("block").agg(F.collect_list("place").alias("kept"))

    def emit(block: Block) -> Iterator[pa.RecordBatch]:
        if not block.extra["kept"].is_valid:
            return
        at = np.sort(np.array(block.extra["kept"].as_py(), np.int64))
        off, raw = block.offsets, block.data.tobytes()
        text = [raw[off[i] : off[i + 1]].decode() if block.lens[i] >= 0 else None for i in at]
        yield pa.RecordBatch.from_arrays([ids_out(block.ids[at]), pa.array(text, pa.string()), *(c.take(pa.array(at)) for c in carried(block))], ["id", "text", *(f"carry_{i}" for i in range(len(others)))])

    out = blocks.map(blocks.with_facts(kept), emit, "id long, text string" + "".join(f", carry_{i} {k}" for i, k in enumerate(blocks.carry_kinds)))
    back = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col(f"carry_{i}") for i, c in enumerate(others)}
    return out.select(*(back[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def resolved(blocks: Blocks, words: int, num: int, den: int) -> DataFrame:
    """id, block, place, n, root (of its component; null without words), class_id and component_id of each row."""
    if not 0 < num <= den:
        raise ValueError("similarity must be in (0, 1]")
    packed = lambda arrays: pa.array([x.astype("<u8").tobytes() for x in arrays], pa.binary())

    def signatures(block: Block) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(block, words)
        k = len(sets)
        with np.errstate(over="ignore"):
            s1 = np.array([mix(s).sum(dtype=U64) for s in sets], U64).view(np.int64)
            s2 = np.array([mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) for s in sets], U64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.ids), pa.array(np.full(k, block.key)), pa.array(np.arange(k)), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(s1), pa.array(s2)],
            ["id", "block", "place", "n", "s1", "s2"],
        )

    rows = stored(blocks.map(blocks.df, signatures, "id long, block long, place long, n long, s1 long, s2 long"), "sets")
    kind = rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("class_id"), F.min(F.struct("block", "place")).alias("at"))
    kind = stored(kind.select("n", "s1", "s2", "class_id", F.col("at.block").alias("block"), F.col("at.place").alias("place"), F.expr("shiftleft(at.block, 16) + at.place").alias("cid")), "classes")
    chosen = kind.groupBy("block").agg(F.collect_list("place").alias("chosen"))

    def mine(block: Block) -> tuple[np.ndarray, list[np.ndarray]]:
        if not block.extra["chosen"].is_valid:
            return np.zeros(0, np.int64), []
        places = np.sort(np.array(block.extra["chosen"].as_py(), np.int64))
        sets = shingle_sets(block, words)
        return places, [sets[i] for i in places]

    def ask(block: Block) -> tuple[np.ndarray, np.ndarray]:
        sets = mine(block)[1]
        return np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, U64), np.zeros(0, np.int64))

    asked = blocks.with_facts(chosen)
    df, _ = exchange(blocks, asked, ask, "df")
    scale = (1 - 1e-9) / -math.log(num / den) if num < den else 0.0

    def index(block: Block) -> Iterator[pa.RecordBatch]:
        places, sets = mine(block)
        if not sets:
            return
        total = told(block.extra["df"])
        where = np.unique(np.concatenate(sets), return_inverse=True)[1]
        token, cid, band, at = [], [], [], 0
        for place, s in zip(places.tolist(), sets, strict=True):
            n = len(s)
            d = total[where[at : at + n]]
            at += n
            first = np.argsort(d, kind="stable")[: n - -(-num * n // den) + 1]
            keep = s[first[d[first] > 1]].view(np.int64)
            size = int(math.log(n) * scale) if scale else n
            for b in (size, size + 1) if scale else (size,):
                token.append(keep)
                cid.append(np.full(len(keep), block.key << 16 | place))
                band.append(np.full(len(keep), b, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, band, cid)], ["token", "band", "cid"])

    entries = stored(blocks.map(blocks.with_facts(chosen, df), index, "token long, band int, cid long"), "index")
    hubs = entries.groupBy("token", "band").agg(F.min("cid").alias("v"), F.max("cid").alias("most")).filter("v < most")
    edges = stored(entries.withColumnRenamed("cid", "u").join(hubs, ["token", "band"]).filter("u <> v").select("u", "v").distinct(), "stars")
    near = stored(components(edges, "candidates").select(F.col("node").alias("cid"), F.col("root").alias("comp")), "near")
    sizes = kind.select("cid", "n")
    large = near.join(sizes, "cid").groupBy("comp").agg(F.count("*").alias("k"), F.sum("n").alias("total")).filter((F.col("k") > PART_SETS) | (F.col("total") * 8 > PART_BYTES)).select("comp")
    # Stored, as the sizes below: a small table is broadcast without dealing the classes by component.
    large = stored(large, "large")
    spread = near.join(large, "comp", "left_semi").select("cid")
    stars = edges.join(spread, edges["u"] == spread["cid"], "left_semi")
    stars = stars.unionByName(stars.select(F.col("v").alias("u"), "v").distinct())
    member = stored(near.join(large, "comp", "left_anti").select("cid", "comp").unionByName(stars.select(F.col("u").alias("cid"), F.col("v").alias("comp"))), "members")
    size = member.join(sizes, "cid").groupBy("comp").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    # Stored, so that a small table is broadcast without dealing the members by group, and a large one is a plain shuffle.
    parts = stored(size.select("comp", _pieces(F.col("k"), F.col("total") * 8, PART_SETS).alias("parts")), "parts")
    wanted = member.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))
    wanted = wanted.groupBy(F.expr("shiftright(cid, 16)").alias("block")).agg(F.collect_list(F.struct(F.expr("cid & 65535").alias("place"), "cid", "comp", "part", "parts")).alias("wanted"))

    def send(block: Block) -> Iterator[pa.RecordBatch]:
        if not block.extra["wanted"].is_valid:
            return
        sets = shingle_sets(block, words)
        want = block.extra["wanted"].as_py()
        for at in range(0, len(want), 256):
            some = want[at : at + 256]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([w[c] for w in some], pa.int64()) for c in ("comp", "part", "parts", "cid")), packed([sets[w["place"]] for w in some])],
                ["comp", "part", "parts", "cid", "items"],
            )

    sets = stored(blocks.map(blocks.with_facts(wanted), send, "comp long, part long, parts long, cid long, items binary"), "candidates")

    def join_from(group: pa.Table, known: bool) -> pa.Table:
        group = group.combine_chunks()
        cid, once = np.unique(group["cid"].to_numpy(), return_index=True)
        items = [np.frombuffer(group["items"][i].as_buffer(), "<u8") for i in once.tolist()]
        first = link_sets(items, num, den, group["root"].to_numpy()[once] if known else None)
        same = lambda c: pa.array([group[c][0].as_py()] * len(cid), pa.int64())
        return pa.table([same("comp"), same("parts"), pa.array(cid), pa.array(cid[first])], names=["comp", "parts", "cid", "root"])

    def join(group: pa.Table) -> pa.Table:
        return join_from(group, False)

    def join_more(group: pa.Table) -> pa.Table:
        return join_from(group, True)

    alone = stored(sets.groupBy("comp", "part", "parts").applyInArrow(join, _LINKED), "links")
    links = alone.select(F.col("cid").alias("u"), F.col("root").alias("v"))
    split = alone.filter("parts > 1")
    if not split.isEmpty():
        links = links.unionByName(_across(sets.filter("parts > 1"), split, join, join_more))
    groups = stored(components(links, "joined").select(F.col("node").alias("cid"), "root"), "groups")
    named = kind.join(groups, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "root").select("n", "s1", "s2", "root", "class_id", "component_id")
    wordless = [F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("id")).alias(c) for c in ("class_id", "component_id")]
    return rows.join(named, ["n", "s1", "s2"], "left").select("id", "block", "place", "n", "root", *wordless)


_LINKED = "comp long, parts long, cid long, root long"


def _pieces(sets: Column, size: Column, most: int) -> Column:
    return F.greatest(F.ceil(sets / most), F.ceil(size / PART_BYTES)).cast("long")


def _across(sets: DataFrame, alone: DataFrame, join: Callable, join_more: Callable) -> DataFrame:
    """Links between the parts of split hubs."""
    rooted = alone.select("comp", "cid", "root")
    heads = alone.filter("cid = root").select("comp", "cid")
    turn, before = 0, None
    while True:
        turn += 1
        dealt = sets.select("comp", "cid", "items").join(heads, ["comp", "cid"], "left_semi")
        parts = dealt.groupBy("comp").agg(_pieces(F.count("*"), F.sum(F.octet_length("items")), PART_SETS).alias("parts"))
        dealt = dealt.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("cid", F.lit(turn)), F.col("parts")))
        led = stored(dealt.groupBy("comp", "part", "parts").applyInArrow(join, _LINKED), "heads")
        rooted = stored(rooted.join(led.select("comp", F.col("cid").alias("root"), F.col("root").alias("head")), ["comp", "root"]).select("comp", "cid", F.col("head").alias("root")), "rooted")
        heads = led.filter("cid = root").select("comp", "cid")
        s = led.agg(F.count_if(F.col("cid") == F.col("root")).alias("n"), F.max("parts").alias("parts")).first()
        # Heads meet anew until they all have met, or hardly any of them link.
        if s["parts"] == 1 or (before is not None and s["n"] > 0.9 * before):
            break
        before = s["n"]
    groups = rooted.groupBy("comp", "root").agg(F.count("*").alias("k"))
    open_ = groups.groupBy("comp").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("groups"), (F.sum("k") - F.max("k")).alias("minor"), F.sum("k").alias("all")).filter("groups > 1")
    rest = sets.select("comp", "cid", "items").join(rooted, ["comp", "cid"]).join(open_, "comp")
    mean = F.avg(F.octet_length("items"))
    wide = rest.groupBy("comp").agg(*(_pieces(F.max(c), F.max(c) * mean, SIDE_SETS).alias(f"{c}_parts") for c in ("minor", "all")))
    rest = stored(rest.join(wide, "comp"), "open")
    # Sets outside of the largest group meet all sets, in a task for each pair of parts.
    few = rest.filter("root <> major").withColumn("a", F.pmod(F.xxhash64("cid"), F.col("minor_parts"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_parts") - 1)))
    every = rest.withColumn("b", F.pmod(F.xxhash64("cid", F.lit(0)), F.col("all_parts"))).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minor_parts") - 1)))
    pairs = few.unionByName(every).select("comp", "a", "b", "cid", "root", "items", F.lit(0).cast("long").alias("parts"))
    met = pairs.groupBy("comp", "a", "b").applyInArrow(join_more, _LINKED)
    return met.select(F.col("cid").alias("u"), F.col("root").alias("v")).unionByName(rooted.select(F.col("cid").alias("u"), F.col("root").alias("v")))
