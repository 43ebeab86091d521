"""What the near-copy join leaves on disk, and what its candidates depend on."""

import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fabgrain.llm import components, ngram_join, repeated
from fabgrain.session import discard, durable, shared_folder


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def stored_tables(spark):
    return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).iterdir() if p.name.startswith("stored-")}


def test_shuffle_files_go_when_a_table_is_stored(spark):
    before = shuffle_files(spark)
    assert len(durable(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()).collect()) == 10
    left = {"at first"}
    for _ in range(50):  # they are removed in the background
        left = {n for n in shuffle_files(spark) - before if n.endswith(".data")}
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_discarded_tables_are_gone(spark):
    stored = durable(spark.range(5))
    name = stored.stored_at.rpartition("/")[2]
    assert name in stored_tables(spark)
    discard(stored)
    assert name not in stored_tables(spark)


def test_components_leave_one_table(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    before = stored_tables(spark)
    assert components.components(edges).count() == 31
    assert len(stored_tables(spark) - before) == 1


def copies(spark):
    words = np.random.default_rng(3).integers(0, 10**9, 30_000).astype(str)
    texts = [" ".join(words[i // 2 * 1000 : i // 2 * 1000 + 999 + i % 2]) for i in range(60)]
    return durable(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def stored_bytes(spark, names):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    return sum(f.stat().st_size for n in names for f in (folder / n).glob("*.parquet"))


def test_near_copies_leave_no_texts_and_no_ngrams(spark):
    docs, before = copies(spark), stored_tables(spark)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(60)}
    assert stored_bytes(spark, stored_tables(spark) - before) < 0.2 * 8 * 60 * 1000


def test_third_stage_leaves_no_texts_and_no_ngrams(spark):
    docs, before = copies(spark), stored_tables(spark)
    kept = corpus_pipeline.no_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))
    assert stored_bytes(spark, stored_tables(spark) - before) < 0.2 * 8 * 60 * 1000


def packed(sets):
    return [np.sort(np.array(s, np.uint64)).tobytes() for s in sets]


def test_counts_of_shared_hashes(spark, monkeypatch):
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 2**63, 400) % 60 * 2**57 + 5) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(packed(sets))), "key long, text binary").repartition(3)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    counts = dict(zip(values.tolist(), counts.tolist(), strict=True))

    def extract(data):
        h = np.frombuffer(data, np.uint64)
        return h, len(h), ""

    for chunk in (100, 1 << 20):
        monkeypatch.setattr(repeated, "CHUNK_HASHES", chunk)
        for row in repeated.shared(durable(docs), extract, listed=True, counted=True).collect():
            marks, often = np.frombuffer(row.marks, np.uint64).tolist(), np.frombuffer(row.often, np.uint16).tolist()
            assert dict(zip(marks, often, strict=True)) == {h: counts[h] for h in sets[row.key].astype(np.uint64).tolist() if counts[h] > 1}


def test_common_ngrams_do_not_link_strangers(spark):
    """Their hashes are the smallest, and all agree in the low bits that a frequency sketch looks at."""
    step = 1 << 21
    sets = [[i * step for i in range(1, 11)] + [(100 + 90 * (k // 2) + i) * step for i in range(90)] for k in range(40)]
    classes = spark.createDataFrame([(k, 100, g) for k, g in enumerate(packed(sets))], "key long, size long, grams binary")
    found = ngram_join._clusters(ngram_join._with_partners(classes, 75), 75)
    assert {r.node: r.root for r in found.collect()} == {k: k // 2 * 2 for k in range(40)}
