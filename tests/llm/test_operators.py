"""Operators against brute force on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import decontam, host_reputation, jaccard_join, media, ngram_lm, piece_lattice, quality, suffix_dedup, token_shards, toxicity
from rosterlens.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = "the quick brown fox jumps over the lazy dog while eleven zebras watch quietly from afar"
TEXTS = [
    PASSAGE + " and one more ending", "Intro words first. " + PASSAGE, None, "", "   ", "One", "one", PASSAGE, PASSAGE, "Éa Éb éa " * 30,
    "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u", "x" * 20000, "same line here again\n" * 40, "\x00\x01 odd \x7f bytes", "日本語 テキスト です",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra", i % 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def sets_of(rows, words):
    out = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        out[d] = frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    return out


def test_suffix_dedup(docs, empty):
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(docs, with_text=True).collect()}
    seen: set[bytes] = set()
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        windows = [raw[j : j + 50] for j in range(len(raw) - 49)]
        for j, w in enumerate(windows):
            if w in seen:
                gone[j : j + 50] = b"\1" * 50
        seen.update(windows)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        assert (got[i]["text"] is None) == (t is None)
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_hot_anchors(docs, monkeypatch):
    before = sorted(map(tuple, suffix_dedup.dedup(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert sorted(map(tuple, suffix_dedup.dedup(docs).collect())) == before


@pytest.mark.parametrize("words,num,parts", [(3, 9, 3000), (5, 8, 2)])
def test_jaccard_join(docs, empty, monkeypatch, words, num, parts):
    monkeypatch.setattr(jaccard_join, "PART_SETS", parts)
    rows = list(enumerate(TEXTS)) + [(100 + i, PASSAGE + f" and one more ending {i}") for i in range(6)]
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(rows[len(TEXTS) :], "doc_id long, text string"))
    sets, up = sets_of(rows, words), {d: d for d, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(more, words=words, num=num, den=10).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}
    assert jaccard_join.classes(empty).count() == 0


def test_representatives(docs):
    kept = jaccard_join.representatives(docs, words=3, num=9, den=10)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    left = {r["doc_id"] for r in kept.collect()}
    assert left >= {0, 2, 3, 4, 5, 7, 10} and not left & {6, 8}
    twice = docs.unionByName(docs)
    assert jaccard_join.representatives(twice, words=3, num=9, den=10).filter("trim(text) <> ''").count() == kept.filter("trim(text) <> ''").count()


def test_ids_may_be_null_or_repeated(spark):
    rows = spark.createDataFrame([(None, PASSAGE), (None, PASSAGE), (4, PASSAGE), (4, PASSAGE), (4, "other words entirely here")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.classes(rows).filter("n_shingles > 5").collect()} == {4}
    removed = {(r["doc_id"], r["n_removed"] > 0) for r in suffix_dedup.dedup(rows).collect()}
    assert removed == {(None, True), (4, False)}
    assert ngram_lm.score(rows).count() == 5


@pytest.mark.parametrize("large", [0, 10**6])
def test_components(spark, monkeypatch, large):
    monkeypatch.setattr("rosterlens.llm.components.LARGE", large)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 7), (50, 60), (60, 51)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == 0 and got[50] == got[60] == got[51] == 50
    assert components(edges.filter("false")).count() == 0


def test_language_model(docs, empty):
    got = {r["doc_id"]: r for r in ngram_lm.score(docs).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LOW)), None] for i, t in enumerate(TEXTS)}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in tokens.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1) and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(w in train for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r["score"] < 0
    assert ngram_lm.score(empty).count() == 0


class SlowModel:
    """The backoff model by recursion over dictionaries."""

    def __init__(self, texts):
        self.c = [Counter() for _ in range(4)]
        for ws in texts:
            for n in (1, 2, 3):
                self.c[n].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
        self.total = sum(self.c[1].values())
        self.e0 = (sum(x == 1 for x in self.c[1].values()) + 0.5) / (self.total + 1)
        self.ones, self.mass = Counter(), Counter()
        for n in (2, 3):
            for g, x in self.c[n].items():
                self.ones[n, int(math.log2(self.c[n - 1][g[:-1]]))] += x == 1
            for g, x in self.c[n - 1].items():
                if g[-1] != "":
                    self.mass[n, int(math.log2(x))] += x

    def p(self, context, w):
        if not context:
            return (1 - self.e0) * self.c[1][w,] / self.total if self.c[1][w,] else self.e0
        n, c = len(context) + 1, self.c[len(context)][context]
        if not c:
            return self.p(context[1:], w)
        k = n, int(math.log2(c))
        e = (self.ones[k] + 0.5) / (self.mass[k] + 1)
        return (1 - e) * self.c[n][*context, w] / c + e * self.p(context[1:], w)

    def score(self, ws):
        return sum(math.log10(self.p(tuple(ws[max(0, i - 2) : i]), w)) for i, w in enumerate(ws))


def lm_texts(seed=2, n=200):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice([*"abcdefgh", f"rare{i}"], int(rng.integers(0, 40)), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.06, 0.05, 0.04, 0.05])) for i in range(n)]


def test_language_model_against_recursion(spark, docs):
    rows = [*enumerate(TEXTS), *((100 + i, t) for i, t in enumerate([*lm_texts(), "a b c " * 400, "A b c"]))]
    words = {i: [*WORD.findall((t or "").translate(LOW)), ""] for i, t in rows}
    model = SlowModel([ws for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (1, 7):
        got = {r["doc_id"]: r["score"] for r in ngram_lm.score(df.repartition(width)).collect()}
        assert all(got[i] == pytest.approx(model.score(ws), rel=1e-9) for i, ws in words.items())


def test_language_model_is_a_distribution():
    """What may follow any state adds up to one: every known word, the end, one unknown."""
    model = SlowModel([[*t.split(), ""] for t in lm_texts(5)])
    vocab = [w for (w,) in model.c[1]]
    for context in [(), *model.c[1], *model.c[2]]:
        if not context or context[-1] != "":
            assert sum(model.p(context, w) for w in [*vocab, "unseen word"]) == pytest.approx(1)


def test_automaton_states_add_up_to_one():
    texts = [[*t.split(), ""] for t in lm_texts(7)]
    names = sorted({w for ws in texts for w in ws})
    place = {w: i for i, w in enumerate(names)}
    slow = SlowModel(texts)
    pairs, triples = [[place[w] for w in g] + [n] for g, n in slow.c[2].items()], []
    at = {tuple(g[:2]): k for k, g in enumerate(pairs)}
    for g, n in slow.c[3].items():
        a, b, c = (place[w] for w in g)
        triples.append((at[a, b], c, at[b, c], n))
    count = np.array([slow.c[1][w,] for w in names])
    escape = lambda n: np.array([(slow.ones[n, k] + 0.5) / (slow.mass[n, k] + 1) for k in range(ngram_lm.BUCKETS)])
    root = (1 - slow.e0) * count / slow.total
    model = ngram_lm.Automaton.build(len(names), root, count, tuple(np.array(pairs).T), tuple(np.array(triples).T), (slow.e0, escape(2), escape(3)))
    every = np.arange(len(names) + 1)  # the last stands for an unknown word
    model.words += 1  # keys of a word that no state knows
    model.arcs = model.arcs // len(names) * model.words + model.arcs % len(names)
    stop = place[""]
    for state in range(len(model.fail)):
        if state and (state - 1 if state <= len(names) else pairs[state - 1 - len(names)][1]) == stop:
            continue
        _, gained = model.step(np.full(len(every), state), every)
        assert (10**gained).sum() == pytest.approx(1)
    # Cut into segments, a text gets the score of one traversal.
    words, doc = np.array([place[w] for ws in texts for w in ws]), np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])
    whole = model.read(words, doc, len(texts), 1 << 20)
    assert np.allclose(whole, model.read(words, doc, len(texts), 3)) and np.allclose(whole, [slow.score(ws) for ws in texts])


def test_decontamination(docs, spark, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE.upper()), (3, "One"), (4, None), (5, "éa éb"), (6, "k l m n o p q r s t")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, items).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOW))
    for i, t in enumerate(TEXTS):
        w, hit, found = split(t), set(), set()
        for r in items.collect():
            v = split(r["text"])
            for a in range(max(len(v) - 10, 0) + 1 if v else 0):
                win = v[a : a + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(r["item_id"]))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    clean = decontam.clean(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i in got if not got[i]["contaminated"]}
    assert decontam.contamination(empty, items).count() == 0
    assert decontam.contamination(docs, items.filter("false")).filter("contaminated").count() == 0


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    items = spark.createDataFrame([(1, PASSAGE), (3, "One")], "item_id long, text string")
    before = sorted(map(str, decontam.contamination(docs, items).collect()))
    monkeypatch.setattr(decontam, "WINDOW_BLOCK", 2)
    assert sorted(map(str, decontam.contamination(docs, items).collect())) == before


def test_media_columns(docs, empty):
    got = {r["doc_id"]: r for r in media.read_back(media.stored_texts(docs)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        p = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[2]["media_sha256"] == got[3]["media_sha256"] and got[7]["feature"] == got[8]["feature"]
    probed = media.media_columns(media.stored_texts(docs).withColumn("content", F.when(F.col("doc_id") > 0, F.col("content")))).collect()
    assert {r["media"]["error"] is None for r in probed if r["doc_id"] != 0} == {True} and next(r for r in probed if r["doc_id"] == 0)["media"]["error"]
    assert media.read_back(media.stored_texts(empty)).count() == 0


def test_media_columns_have_every_track(spark):
    import struct

    def trak(number, handler, codec):
        full, box = media._full, media._box
        return box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, number)), box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000 * number, 2000)), full(b"hdlr", bytes(4), handler), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), full(b"stsz", struct.pack(">II", 0, 0)), full(b"stco", struct.pack(">I", 0)), full(b"stsc", struct.pack(">I", 0))))))

    content = media._box(b"moov", trak(1, b"soun", b"mp4a"), trak(2, b"vide", b"avc1"))
    got = media.media_columns(spark.createDataFrame([(content,), (None,)], "content binary")).select("media.*").collect()
    assert [(t["handler"], t["codec"], t["timescale"]) for t in got[0]["tracks"]] == [("soun", "mp4a", 1000), ("vide", "avc1", 2000)]
    assert got[0]["codec"] == "mp4a" and got[0]["error"] is None and got[1]["error"] and got[1]["tracks"] is None


def test_token_shards(docs, spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    shards = token_shards.write(docs, str(tmp_path / "t"), path)
    rows = token_shards.read(str(tmp_path / "t"), shards).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(rows, TEXTS, strict=True):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    keys = spark.createDataFrame([(5,), (6,), (6,), (999,), (-3,), (None,), (12,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_shards.lookup(str(tmp_path / "t"), shards, keys).collect()}
    assert found == {i: [*model.encode(TEXTS[i], add_special_tokens=False).ids, 2] for i in (5, 6, 12)}
    whole = token_shards.encoder(public.path("word_bpe_49k.json"))
    assert not whole.by_piece and token_shards.round_trip(docs, public.path("word_bpe_49k.json"), path=str(tmp_path / "w")).count() == len(TEXTS)
    odd = spark.createDataFrame([(None, "a"), (3, "b"), (3, "c")], "doc_id long, text string")
    assert token_shards.round_trip(odd, path, path=str(tmp_path / "o")).count() == 3
    assert token_shards.round_trip(odd.filter("false"), path, path=str(tmp_path / "e")).count() == 0


def test_token_shards_with_added_tokens(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = ["one", "a <|endoftext|> b", "two"]
    rows = token_shards.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, path=str(tmp_path / "s")).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pieces(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    out = piece_lattice.encode(docs, path, with_ids=True)
    rows = {r["doc_id"]: r for r in piece_lattice.decode(out, path).collect()}
    assert all(r["lossless"] and r["text"] == (TEXTS[i] or "") for i, r in rows.items())
    assert rows[7]["n_pieces"] > 0 and rows[2]["n_pieces"] == 0
    again = {r["doc_id"]: r["ids"] for r in piece_lattice.encode(docs.repartition(1), path, with_ids=True).collect()}
    assert again == {i: r["ids"] for i, r in rows.items()}
    assert piece_lattice.encode(empty, path).count() == 0


def test_host_reputation(spark):
    rules = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/"))
    urls = ["http://A.example.com/en/1?x", "https://example.com/en/70", "x://foo.net", "nothing", None, "http://bad.org/p", "http://bad.org/q", "http://xcom/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = spark.createDataFrame([(5, True), (5, True), (6, None), (99, True)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in host_reputation.judge(pages, bad, rules).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(5)] == [("a.example.com", "/en/1", "com/en/"), ("example.com", "/en/70", "example.com/en/7"), ("foo.net", "", None), ("", "", None), ("", "", None)]
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == "allow" and got[7]["rule"] is None
    many = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'fine'}.example/p{i}") for i in range(400)], "page_id long, url string")
    marks = spark.createDataFrame([(i, bool(i % 2)) for i in range(400)], "page_id long, bad boolean")
    verdicts = {(r["host"], r["verdict"]) for r in host_reputation.judge(many, marks, ()).collect()}
    assert verdicts == {("spam.example", "block"), ("fine.example", "allow")}
    assert host_reputation.judge(pages.filter("false"), bad.filter("false"), rules).count() == 0


def test_host_reputation_takes_suffixes(spark):
    pages = spark.createDataFrame([(i, f"http://{h}/p{i}") for i, h in enumerate(["spam.co.nz", "fine.co.nz"] * 100 + ["new.spam.co.nz", "new.fine.co.nz"])], "page_id long, url string")
    marks = spark.createDataFrame([(i, i % 2 == 0) for i in range(200)], "page_id long, bad boolean")
    mean = lambda **more: [r["bad_mean"] for r in host_reputation.judge(pages, marks, (), **more).filter("page_id >= 200").orderBy("page_id").collect()]
    pooled, apart = mean(), mean(shared_suffixes=("co.nz",))
    assert pooled[0] == pooled[1] and apart[0] > 0.8 and apart[1] < 0.2


def labelled(spark, n=400):
    rng = np.random.default_rng(4)
    plain = ["house", "river", "garden", "window", "letter", "winter", "summer", "orange", "silver", "travel"]
    rows, marks = [], []
    for i in range(n):
        words = list(rng.choice(plain, 30))
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(30))] = ["blockhead", "scoundrel", "nitwit"][i % 3]
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    rows += [(n, "such a block-head in the garden of the house"), (n + 1, "s c o u n d r e l in the river"), (n + 2, ""), (n + 3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int").withColumn("quality", 1 - F.col("toxic"))


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and all(got[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert got[400]["predicted"] == got[401]["predicted"] == 1 and got[402]["predicted"] == got[403]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in toxicity.classify(docs, labels.filter("false")).collect()} == {0.5}


def test_toxicity_of_spoilt_insults(spark):
    docs, labels = labelled(spark)
    spoilt = []
    for word in ("blockhead", "scoundrel", "nitwit"):
        for put in ".", "*", "x":
            mid = len(word) // 2
            spoilt += [word[:mid] + put + word[mid:], word[:2] + put + word[2:-2] + put + word[-2:], put.join(word)]
    more = spark.createDataFrame([(1000 + i, f"house river garden {w} window letter winter") for i, w in enumerate([*spoilt, "summer"])], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs.unionByName(more), labels).filter("doc_id >= 1000").collect()}
    assert [w for i, w in enumerate(spoilt) if not got[1000 + i]] == [] and got[1000 + len(spoilt)] == 0


def test_quality(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("".join(rng.choice(list("abcdef"), 5)) + ("!!" if i % 3 == 0 else "") for _ in range(40)).upper() if i % 3 == 0 else " ".join("".join(rng.choice(list("abcdef"), 5)) for _ in range(40)) + ".") for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == int(i % 3 != 0) for i in held]) > 0.97
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"]
    assert quality.classify(docs, labels.filter("false")).count() == 302
