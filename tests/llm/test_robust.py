"""Clashing names, nulls, empty tables, very long texts, ties and repeated rows, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterlens.llm import decontam, host_reputation, jaccard_join, media, ngram_lm, piece_lattice, quality, queries, suffix_dedup, token_shards, toxicity
from rosterlens.llm.shared import named

LONG = "".join(f"word{i % 977} tail{i % 31}, " for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while eleven zebras watch quietly from afar"
TEXTS = [None, "", "   ", LONG, LONG, PASSAGE, PASSAGE, f"{PASSAGE} again and once more", "short", "an utter nitwit in a house", "日本 語 テキスト" * 30, *(f"plain text number {i} of a house by the river" for i in range(30))]
#: Names that operators use for columns of their own.
CLASHES = (
    "score", "predicted", "held_out", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_hash", "text_hash2", "hit_id", "id", "block", "place", "carry", "carry_0", "kept", "kept_0", "own_0", "key_0", "label",
    "row", "w", "items", "n_words", "component_id", "class_id", "root", "n", "lens", "data", "ids", "n_pieces", "content", "shard", "file", "start", "tie", "host", "path", "rule", "verdict", "bad", "a.b", "back`tick",
)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i if i != 8 else None, t) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], rows[1], rows[0], (20, "another text of the same id")]
    docs = spark.createDataFrame([(d, t, None if t is None else len(t)) for d, t in rows], "doc_id long, text string, n_chars int").repartition(4)
    labels = spark.createDataFrame([(i, int(i == 9 or i % 5 == 0), int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None), (9, 1, 0)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([("x", PASSAGE), ("y", PASSAGE), ("z", None), (None, "nothing here"), ("e", "")], "item_id string, text string")
    odd = docs.select("*", *((F.lit(None).cast("string") if i % 2 else F.lit(i)).alias(c) for i, c in enumerate(CLASHES)))
    return docs, odd, labels, bench


def bag(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def folder(tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    tables[2].write.parquet(f"{path}/labels.parquet")
    tables[3].write.parquet(f"{path}/benchmark.parquet")
    return path


STAGES = {name: f for name, f in corpus_pipeline.STAGES}


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, tables, folder, name):
    docs, odd, _, _ = tables
    pytest.importorskip("public_tokenizers")
    stage = STAGES[name]
    plain, full = stage(spark, docs, folder), stage(spark, odd, folder)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert plain.columns == docs.columns and full.columns == odd.columns and [f.dataType for f in full.schema] == [f.dataType for f in odd.schema]
    assert bag(full.select(*(f"`{c}`" for c in plain.columns))) == bag(plain) != []
    assert stage(spark, odd.filter("false"), folder).count() == 0
    kept = {r["doc_id"] for r in plain.select("doc_id").collect()}
    assert {0, 1, 2, None} <= kept, "texts without words stay"
    if name == "n-gram Jaccard join":
        assert 4 not in kept and 6 not in kept and {3, 5} <= kept
    if name == "benchmark decontamination":
        assert not kept & {5, 6, 7} and {3, 4} <= kept
    if name == "suffix-array dedup":
        assert not kept & {4, 6} and {3, 5, 7} <= kept


@pytest.mark.parametrize("name", range(1, 11))
def test_operators(spark, tables, name, tmp_path):
    docs, odd, labels, bench = tables
    public = pytest.importorskip("public_tokenizers")
    more = labels.select("*", F.lit(1).alias("label"), F.lit(2).alias("id"), F.lit(3).alias("text"))
    items = bench.select("*", F.lit(1).alias("item"), F.lit(2).alias("win"), F.lit(3).alias("k"))
    paths = iter(f"{tmp_path}/{i}" for i in range(9))
    pages = lambda df: df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.example/"), "text").alias("url"), *(named(c) for c in df.columns if c not in ("doc_id", "text")))
    marks = labels.select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("bad"))
    run = {
        1: lambda d, o: decontam.contamination(d, items if o else bench),
        2: lambda d, o: media.read_back(media.stored_texts(d)),
        3: lambda d, o: ngram_lm.score(d),
        4: lambda d, o: token_shards.round_trip(d, public.path("byte_bpe_50k.json"), path=next(paths)),
        5: lambda d, o: host_reputation.judge(pages(d), marks.withColumn("n", F.lit(7)) if o else marks, queries.URL_RULES),
        6: lambda d, o: suffix_dedup.dedup(d, with_text=True),
        7: lambda d, o: jaccard_join.classes(d),
        8: lambda d, o: piece_lattice.encode(d, public.path("piece_bpe_32k.model"), with_ids=True),
        9: lambda d, o: toxicity.classify(d, more if o else labels),
        10: lambda d, o: quality.classify(d, more if o else labels),
    }[name]
    plain = bag(run(docs, False))
    assert len(plain) == docs.count(), "a row for each, repeated ones too"
    assert bag(run(odd, True)) == plain
    assert run(odd.filter("false"), True).count() == 0
    if name in (1, 5, 9, 10):
        other = {1: lambda: decontam.contamination(docs, bench.filter("false")), 5: lambda: host_reputation.judge(pages(docs), marks.filter("false"), ()), 9: lambda: toxicity.classify(docs, labels.filter("false")), 10: lambda: quality.classify(docs, labels.filter("false"))}[name]
        assert other().count() == docs.count()
