import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import blocks as B
from rosterlens.llm import jaccard_join as J
from rosterlens.llm import media as M
from rosterlens.llm import suffix_dedup as S
from rosterlens.llm import token_shards as K


def block(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return next(B.streamed(iter([pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "text"])])))


def test_spans_and_hashes():
    b = block(["a bb\tccc", None, "", "bb", " bb "])
    start, end, doc = B.token_spans(b.data, b.offsets, B.SPACE)
    assert [b.data[i:j].tobytes() for i, j in zip(start, end, strict=True)] == [b"a", b"bb", b"ccc", b"bb", b"bb"]
    assert doc.tolist() == [0, 0, 0, 3, 4]
    h = B.span_hash(B.prefix_hash(b.data), start, end)
    assert h[1] == h[3] == h[4] and len(set(h.tolist())) == 3
    assert (B.gram_hash(B.prefix_hash(b.data), 2) == B.span_hash(B.prefix_hash(b.data), np.arange(len(b.data) - 1), np.arange(len(b.data) - 1) + 2)).all()


def test_keys_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    assert (B.unpack_keys(B.pack_keys(keys)) == keys).all()
    r = B.range_of(keys, 7)
    assert (np.diff(r) >= 0).all() and r.min() >= 0 and r.max() <= 6


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 60, 400])
def test_suffix_array(n):
    data = np.random.default_rng(n).integers(0, 2, n).astype(np.uint8)
    order, rank = S.suffix_array(data)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
    common = S.common_prefixes(data, order, n)
    near, rank64 = S.suffix_array(data, 64)
    deep = S.common_prefixes(data, near, 50, rank64)
    assert all(deep[i] == min(50, next((k for k in range(50) if data[near[i] + k : near[i] + k + 1].tobytes() != data[near[i - 1] + k : near[i - 1] + k + 1].tobytes() or near[i] + k >= n), 50)) for i in range(1, n))
    for j in range(1, n):
        x, y = raw[order[j] :], raw[order[j - 1] :]
        k = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert common[j] == k


def test_window_minima_merge_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE_BYTES", 300)
    rng = random.Random(2)
    data = np.array([rng.choice(b"ab\x00") for _ in range(2000)], np.uint8)
    data[1200:1300] = data[100:200]
    starts, values = np.arange(0, 1950), np.arange(1950)[::-1].copy()
    got = S.window_minima(data, starts, values, 50)
    least = {}
    for s, v in zip(starts.tolist(), values.tolist(), strict=True):
        w = data[s : s + 50].tobytes()
        least[w] = min(least.get(w, v), v)
    assert got.tolist() == [least[data[s : s + 50].tobytes()] for s in starts.tolist()]


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10), (1, 2)])
def test_signature_tree_finds_every_link(num, den):
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**62, rng.integers(1, 60)).astype(np.uint64) << np.uint64(2)) for _ in range(40)]
    sets = []
    for b in base:
        for _ in range(rng.integers(1, 6)):
            keep = b[rng.random(len(b)) > 0.08]
            sets.append(keep if len(keep) else b)
    got = J.link_sets(sets, num, den)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert got.tolist() == [root(i) for i in range(len(sets))]
    assert J.link_sets([], num, den).tolist() == []


def test_media_round_trip_and_damage():
    for payload in (b"", b"abc", "é→x".encode() * 100, b"z" * 384):
        p = M.padded(payload)
        content = M.pack_pcm(p)
        track = M.probe(content)[0]
        assert M.samples(content, track) == p and track.codec == "raw " and track.seconds == len(p) / M.RATE
        assert track.keyframes() == [(len(content) - len(p), len(p))]
        for cut in range(0, len(content) - len(p), 5):
            for broken in (content[:cut], content[:cut] + b"\xff\xff" + content[cut + 2 :]):
                try:
                    M.probe(broken)
                except ValueError:
                    pass
    with pytest.raises(ValueError):
        M.pack_pcm(b"x")


def test_media_chunks_and_keyframes():
    for n, chunk in ((1, 16), (16, 16), (17, 16), (100, 16), (5, 1), (33, 2)):
        p = bytes(range(192)) * n
        content = M.pack_pcm(p, chunk=chunk)
        track = M.probe(content)[0]
        first = len(content) - len(p)
        assert M.samples(content, track) == p and len(track.sizes) == n
        keys = [(first + 192 * k, 192) for k in range(0, n, chunk)]
        assert track.sync == set(range(1, n + 1, chunk)) and (track.keyframes() == keys or chunk == 1 and track.keyframes() == [(first, len(p))])


def test_probe_raises_value_errors_alone():
    """Every prefix, every byte flipped and every byte set to the extremes of a container."""
    content = M.pack_pcm(b"abc" * 64 * 40, chunk=3)
    head = len(content) - 64 * 3 * 40
    seen = 0
    for i in range(head + 8):
        for broken in (content[:i], content[:i] + bytes([content[i] ^ 255]) + content[i + 1 :], content[:i] + b"\0" + content[i + 1 :], content[:i] + b"\x01" + content[i + 1 :], content[:i] + b"\0\0\0\x08" + content[i + 4 :], content[:i] + content[i + 1 :]):
            try:
                for t in M.probe(broken):
                    t.keyframes()
            except ValueError:
                seen += 1
    assert seen > head


def test_media_columns_survive_damage(spark):
    content = M.pack_pcm(b"x" * 192)
    rows = [(content[:i],) for i in range(0, len(content), 7)] + [(M._box(b"moov", M._box(b"trak", M._box(b"tkhd"))),), (M._box(b"moov", M._box(b"trak", M._box(b"mdhd"))),), (None,), (b"",), (content,)]
    got = M.media_columns(spark.createDataFrame(rows, "content binary").withColumn("media", F.lit(1))).collect()
    assert len(got) == len(rows) and [r["media"]["error"] is None for r in got][-1]


def test_media_fragments_and_sync():
    import struct

    full = lambda kind, *parts, flags=0: M._full(kind, *parts, flags=flags)
    trak = M._box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7)), M._box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0)), full(b"hdlr", bytes(4), b"vide"), M._box(b"minf", M._box(b"stbl", full(b"stsd", struct.pack(">I", 1), M._box(b"avc1", bytes(8))), full(b"stsz", struct.pack(">II", 0, 0)), full(b"stco", struct.pack(">I", 0)), full(b"stsc", struct.pack(">I", 0))))))
    moov = M._box(b"moov", trak)
    trun = full(b"trun", struct.pack(">Ii", 2, 100), struct.pack(">III", 40, 10, 0), struct.pack(">III", 40, 5, 0x10000), flags=0x701)
    moof = M._box(b"moof", M._box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), trun))
    track = M.probe(moov + moof + M._box(b"mdat", bytes(200)))[0]
    assert track.codec == "avc1" and track.sizes == [10, 5] and track.duration == 80
    assert track.keyframes() == [(len(moov) + 100, 10)]


def test_index_is_minimal_and_perfect():
    for n in (0, 1, 2, 3, 10, 700, 60_000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**60), 2**60, n))
        shard = K.WholeShard(K.shard_bytes(keys, np.ones(len(keys), np.int64), [np.arange(len(keys), dtype=np.uint32)]))
        first, times = shard.find(keys)
        assert first.tolist() == list(range(len(keys))) and (times == 1).all()
        assert shard.n_keys == len(keys) and shard.find(keys + 1)[1].sum() == 0


def test_keyed_reads_are_bounded():
    keys, sizes = np.repeat(np.arange(0, 40_000, 2), 1), np.random.default_rng(3).integers(1, 9, 20_000)
    keys[101] = keys[100]
    ids = [np.full(s, k, np.uint32) for k, s in zip(range(20_000), sizes.tolist(), strict=True)]
    content, reads = K.shard_bytes(keys, sizes, ids), []

    def read(at, size):
        reads.append(size)
        return content[at : at + size]

    shard = K.Shard(read)
    for place in (0, 100, 7000, 19_999):
        reads.clear()
        own = [place, 101] if place == 100 else [place]
        assert [x.tolist() for x in shard.get(int(keys[place]))] == [ids[p].tolist() for p in own]
        assert len(reads) <= 6 + len(own) and sum(reads) < 100 + 4 * int(sizes[own].sum())
    assert shard.get(1) == [] and shard.get(10**12) == []


def test_pieces_like_the_library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rng, letters = random.Random(5), "ab'sldvet reRE  \n\t'!?.,12é日ß \u3000🙂|%٣Ⅷ²\r"
    odd = [chr(c) for c in (*range(0x80), *(rng.randrange(0x80, 0xD800) for _ in range(3000)), *(rng.randrange(0xE000, 0x110000) for _ in range(1500)), 0x1C89, 0x1C8A, 0x85, 0xA0, 0x1680, 0x200B)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice((rng.choice(letters), rng.choice(odd), "<|endoftext|>")[min(2, int(rng.expovariate(1)))]) for _ in range(rng.randint(0, 30))) for _ in range(10_000)]
    texts += [a + b + c for a, b, c in zip(*(rng.sample(odd, len(odd)) for _ in range(3)), strict=True)]
    texts += ["it's they'll we've'd I'm 's 'still ''s 've'", "<|endoftext|> a", "  x  ", "a  \n b \n", None, ""]
    ids, count = K.PieceEncoder(path).encode(block(texts))
    parts = [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])]
    assert parts == [e.ids for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_added_tokens_like_the_library(tmp_path):
    public = pytest.importorskip("public_tokenizers")
    import json

    from tokenizers import AddedToken, Tokenizer

    path, rng = public.path("byte_bpe_50k.json"), random.Random(6)
    more = Tokenizer.from_file(path)
    more.add_tokens(["<|end", "é日"])
    more.add_special_tokens([AddedToken("<s>", lstrip=True, rstrip=True, special=True)])
    more.save(str(tmp_path / "more.json"))
    assert "<s>" in json.dumps(json.loads((tmp_path / "more.json").read_text())["added_tokens"])
    parts = ["<|endoftext|>", "<|end", "<|endof", "oftext|>", " <s> ", " ", "  ", "\n", "it's", "'s", "a", "é日", "é", "12", "!"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>'s", "x <|endof", "text|> y", None, "", "  <|endoftext|>  "]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    for file in (path, str(tmp_path / "more.json")):
        want = [e.ids for e in Tokenizer.from_file(file).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        ids, count = K.encoder(file).encode(block(texts))
        assert [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])] == want
    assert K.encoder(path).encode(block(texts[:1]))[0].tolist() == [64, 220, 50256, 275]


def test_lattice_samples_the_posterior_and_decodes():
    public = pytest.importorskip("public_tokenizers")
    import math
    from collections import Counter

    from rosterlens.llm import piece_lattice as P

    model = P.Lattices(public.path("piece_bpe_32k.model"))
    odd = block(["", "Hello  world\n\n ▁x 日本語 é🙂 end ", None, "aaaa", "▁▁ a\tb", "x" * 300, "日" * 60])
    ids, _, _ = model.encode(odd)
    assert model.decode(ids).tobytes() == odd.data.tobytes()
    again, _, _ = model.encode(odd)
    assert (ids == again).all()
    pieces = {model.bytes_of[k]: (k, float(w)) for k, w in zip(model.piece.tolist(), model.weight, strict=True) if k >= 0}
    word, n = " thation", 8000
    ids, count, _ = model.encode(block([word] * n))
    seen = Counter(tuple(x) for x in np.split(ids, np.cumsum(count)[:-1]))
    paths = {}

    def walk(i, path, weight):
        if i == len(word):
            paths[tuple(path)] = weight
        for j in range(i + 1, len(word) + 1):
            if hit := pieces.get(word[i:j].encode()):
                walk(j, [*path, hit[0]], weight + hit[1])

    walk(0, [], 0.0)
    total = sum(map(math.exp, paths.values()))
    for path, w in paths.items():
        assert abs(seen[path] / n - math.exp(w) / total) < 0.03
    # Long words, filtered and sampled one by one, agree with the others.
    text = block(["thé nation 日本 x" * 9, "<" * 250])
    short = model.encode(text)
    before = P.LONG
    try:
        P.LONG = 3
        other = P.Lattices(public.path("piece_bpe_32k.model"))
        assert all(np.allclose(a, b) for a, b in zip(other.encode(text), short, strict=True))
    finally:
        P.LONG = before
    # Draws next to one stay within their node, however many nodes there are.
    many = P.Lattices(public.path("piece_bpe_32k.model"))
    many.encode(block([" ".join(f"w{i:x}" for i in range(40000))]))
    draw, P._uniform = P._uniform, lambda counter: np.full(np.shape(counter), 1 - 2.0**-53)
    try:
        assert len(many.into) > 200000
        assert many.decode(many.encode(odd)[0]).tobytes() == odd.data.tobytes()
    finally:
        P._uniform = draw


def test_kernel_counts_gapped_subsequences():
    from itertools import combinations

    from rosterlens.llm import toxicity as T

    def slow(s, t):
        total = 0.0
        for a in combinations(range(len(s)), 3):
            for b in combinations(range(len(t)), 3):
                if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                    total += T.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    words = [b"idiot", b"id*iot", b"xidxiotx", b"table", b"ab"]
    got = T.kernel(T._matrix(words, 10), b"idiot")
    own = slow(b"idiot", b"idiot")
    want = np.array([slow(w, b"idiot") for w in words])
    assert np.allclose(got / got[0], want / own)
    assert got[1] / got[0] > 0.4 > got[3] / got[0]


@pytest.mark.parametrize("mark", [b"scum", b"idiot", b"moron", b"stupid", b"disgusting"])
def test_gapped_words_keep_their_likeness(mark):
    from rosterlens.llm import toxicity as T

    m = mark.decode()
    machine = T.Machine([mark], T.covered(T._matrix([mark], len(mark)), mark), np.zeros((1, 1)))
    texts = [f"{m[:2]}{c}{m[2:]} {m[0]}{c}{m[1:-1]}{c}{m[-1]} {c.join(m)}" for c in ".x"] + [c.join(m) for c in ".x"] + ["table of the house"]
    got = machine.features(block(texts))[:, 0]
    assert got[0] > 2.9 and got[1] > 1.8 and got[2] > 0.9 and got[3] > 0.3 and got[4] == 0


def test_landmark_parts_count_once():
    from itertools import combinations

    from rosterlens.llm import toxicity as T

    def slow(s, t):
        total = 0.0
        for b in combinations(range(len(t)), 3):
            spans = [a[-1] - a[0] + 1 for a in combinations(range(len(s)), 3) if all(s[i] == t[j] for i, j in zip(a, b, strict=True))]
            total += T.DECAY ** (b[-1] - b[0] + 1) * max((T.GAP**x for x in spans), default=0.0)
        return total

    words = [b"moron", b"ororonron", b"mxoxrxoxn", b"norom", b"ab"]
    got = T.covered(T._matrix(words, 10), b"moron")
    assert np.allclose(got, [slow(w, b"moron") for w in words])
    assert (got <= T.kernel(T._matrix(words, 10), b"moron", gap=T.GAP) + 1e-12).all()


def test_spelled_words_are_read_as_one():
    from rosterlens.llm import toxicity as T

    rows, where, doc = T.words_of(block(["i d i o t here", "a b", "z" * 100]))
    words = [r.tobytes().rstrip(b"\0") for r in rows]
    assert b"idiot" in words and b"ab" not in words
    assert doc[where == words.index(b"idiot")].tolist() == [0]


def test_discriminant():
    from rosterlens.llm.quality import NAMES, Discriminant, statistics

    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(0, 3, (300, 3))])
    y = np.repeat([0.0, 1.0], 300)
    model = Discriminant.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.85  # equal means: only the covariances differ
    assert np.allclose(Discriminant.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))), 0.5)
    s = statistics(block(["", None, "Some words. More words!\nA line\nA line", "x" * 5000]))
    assert s.shape == (4, len(NAMES)) and np.isfinite(s).all() and (s[0] == s[1]).all()
