"""The whole pipeline against its stages by brute force, on a small table of plain texts."""

import re

import numpy as np
import pytest

import corpus_pipeline
from rosterlens.llm import piece_lattice, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "seven quiet herons stand beside the frozen lake and wait for spring rain to fall"


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8)))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    texts = [prose(rng, int(rng.integers(5, 120))) for _ in range(240)]
    for i in range(0, 240, 4):
        words = texts[i].split()
        for k in rng.integers(0, len(words), 3):
            words[int(k)] = ["blockhead", "scoundrel", "nitwit"][i % 3]
        texts[i] = " ".join(words)
    shared = prose(rng, 30)
    texts += [texts[1], texts[1] + " one more", texts[2] + " tail", f"{shared} {prose(rng, 60)}", f"{prose(rng, 60)} {shared}", f"{prose(rng, 40)} {ITEM.upper()} {prose(rng, 40)}", ITEM, "", None, "x", "x"]
    return list(enumerate(texts))


def near_kept(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [(d, t) for d, t in rows if not sets[d] or root(d) == d]


def cut(rows):
    seen, out = set(), []
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        own = [raw[j : j + 50] for j in range(len(raw) - 49)]
        for j, w in enumerate(own):
            if w in seen:
                gone[j : j + 50] = b"\1" * 50
        seen.update(own)
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode()
        if left or not raw:
            out.append((d, left if t is not None else None))
    return out


def uncontaminated(rows):
    split = lambda t: ITEM_WORD.findall((t or "").lower())
    item = split(ITEM)
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    return [(d, t) for d, t in rows if not any(tuple(w[i : i + 10]) in windows for w in [split(t)] for i in range(len(w) - 9))]


def test_pipeline_by_brute_force(spark, rows, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(d, t, None if t is None else len(t), "x") for d, t in rows], "doc_id long, text string, n_chars int, lang string")
    labels = spark.createDataFrame([(d, int(d % 4 == 0 and d < 240), 1) for d, _ in rows], "doc_id long, toxic int, quality int")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels).collect()}
    wrong = [d for d, _ in rows if judged[d] != int(d % 4 == 0 and d < 240)]
    assert len(wrong) <= 5
    want = uncontaminated(cut(near_kept([(d, t) for d, t in rows if not judged[d]])))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in piece_lattice.decode(out, public.path("piece_bpe_32k.model")).collect()}
    assert {d: t or "" for d, t in want} == {d: r["text"] for d, r in got.items()}
    assert all(r["lossless"] for r in got.values())
    gone = {d for d, _ in rows} - set(got)
    assert {240, 245, 246, 250} <= gone, "copies, near copies and texts with the item go"
