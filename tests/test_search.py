"""Questions over indexes, many questions at once, and vectors around pivots: always the rows of a full scan."""

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabgrain.operators import retrieval, text_index, vector_search
from fabgrain.session import new_path


def rows_of(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


@pytest.fixture(scope="module")
def corpus(spark):
    r = np.random.default_rng(11)
    words = [f"word{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    texts = [" ".join(r.choice(words, r.integers(1, 40), p=share / share.sum())) for _ in range(900)]
    texts += texts[:60] + ["", "!!!", "word0"]  # copies tie
    return spark.createDataFrame([(i * 7 % 9973, t) for i, t in enumerate(texts)], "id int, text string").cache()


@pytest.fixture(scope="module")
def index(spark, corpus):
    vectors, weights = retrieval.document_vectors(corpus, "id", "text")
    path = new_path(spark, "index")
    text_index.build_index(vectors, weights, "id", path)
    return vectors, weights, path


QUESTIONS = ["word250 word7", "word1", "word0 word1 word2 word3", "nothing known", "word299 word298 word0 word0", ""]


@pytest.mark.parametrize("question", QUESTIONS)
def test_index_answers_as_a_scan(spark, index, question):
    vectors, weights, path = index
    for n, first_rows in ((5, 1), (40, 4096)):
        want = rows_of(retrieval.nearest_stored(vectors.where("vector is not null"), weights, "id", question, n))
        got = text_index.ask(spark, path, question, n, "id", first_rows=first_rows)
        assert rows_of(got.rows, "id", "similarity", "rank") == want
        assert got.postings_read <= got.postings and got.bands_read <= got.bands


def test_index_reads_the_best_bands_only(spark, index):
    _, _, path = index
    got = text_index.ask(spark, path, "word250 word7", 3, "id", first_rows=1)
    assert got.bands_read < got.bands / 2 and got.postings_read < got.postings / 2


def test_index_reads_the_folders_of_the_question_only(spark, index):
    _, _, path = index
    plan = text_index.read_postings(spark, path, {5: 3, 37: 2, 66: 9})._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shelf#\d+ IN \(2,5\)", plan) and re.search(r"PushedFilters: \[[^\]]*In\(bucket, \[37,5,66\]\)", plan)


def test_candidates_beyond_the_limit_are_read_further(spark, index, monkeypatch):
    vectors, weights, path = index
    monkeypatch.setattr(text_index, "MOST_CANDIDATES", 1)
    want = rows_of(retrieval.nearest_stored(vectors.where("vector is not null"), weights, "id", QUESTIONS[2], 5))
    got = text_index.ask(spark, path, QUESTIONS[2], 5, "id", first_rows=1)
    assert rows_of(got.rows, "id", "similarity", "rank") == want and got.bands_read == got.bands


def test_distances_are_ranked_unrounded(spark):
    close = spark.createDataFrame([(1, [1.0000000000003]), (2, [1.0]), (3, [1.0 + 2**-52])], "id int, v array<double>")
    assert [r.id for r in retrieval.nearest_vectors(close, "id", "v", [0.0], 3).collect()] == [2, 3, 1]
    assert rows_of(vector_search.nearest_join(close.limit(0).unionByName(spark.createDataFrame([(9, [0.0])], "id int, v array<double>")), close, "id", "v", 3), "id") == [(2,), (3,), (1,)]


def test_equal_texts_have_equal_similarities(spark, corpus):
    found = retrieval.nearest_text(corpus, "id", "text", "word3 word5 word8", n=960).collect()
    texts = {r.id: r.text for r in corpus.collect()}
    by_text = {}
    for r in found:
        by_text.setdefault(texts[r.id], set()).add(r.similarity)
    assert all(len(s) == 1 for s in by_text.values())


VECTORS = np.round(np.random.default_rng(3).normal(size=(400, 6)), 2)
VECTORS[200:230] = VECTORS[:30]  # copies tie
VECTORS[17] = 0


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(VECTORS)] + [(900, None), (901, [1.0, None] * 3), (902, [float("nan")] * 6), (None, [0.0] * 6)]
    return spark.createDataFrame(rows, "id int, v array<double>").repartition(5).cache()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("blocks", [(4096, 32768), (7, 30)])
def test_many_questions_equal_a_scan_each(spark, vectors, metric, blocks):
    asked = vectors.where("id % 20 = 0")
    got = vector_search.nearest_join(asked, vectors, "id", "v", 6, metric, *blocks).collect()
    by = {}
    for r in got:
        by.setdefault(r.question, []).append((r.rank, r.id, r.distance))
    present = vectors.where(vector_search.usable("v") & F.col("id").isNotNull())
    assert set(by) == set(range(0, 400, 20))
    for q in (20, 220):
        want = rows_of(retrieval.nearest_vectors(present, "id", "v", VECTORS[q].tolist(), 6, metric), "rank", "id", "distance")
        assert sorted(by[q]) == want


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_memory_of_a_block_does_not_grow_with_the_pairs(metric):
    r = np.random.default_rng(4)
    questions, corpus = r.normal(size=(256, 8)), r.normal(size=(vector_search.CORPUS_ROWS, 8))
    corpus[5000:9000] = questions[7]  # copies that tie, more than a few rows at a time
    keys = r.permutation(len(corpus)).tolist()
    tracemalloc.start()
    found = list(vector_search.best_of_block(questions, corpus, keys, 5, metric))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # all pairs at once are 67 MB a copy
    for q in (0, 7, 255):
        away = vector_search.EXACT[metric](questions[q][None], corpus).tolist()
        want = sorted(zip(away, keys, range(len(corpus)), strict=True))[:5]
        assert [(c, d) for p, c, d in found if p == q] == [(c, d) for d, _, c in want]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_memory_of_a_block_does_not_grow_with_ties(metric):
    r = np.random.default_rng(5)
    corpus = r.normal(size=(vector_search.CORPUS_ROWS, 32)).astype(np.float32)
    questions = np.repeat(corpus[:1], 256, axis=0).astype(np.float64)
    corpus[::4] = corpus[0]  # each question ties with 8192 rows
    keys = r.permutation(len(corpus)).tolist()
    tracemalloc.start()
    found = list(vector_search.best_of_block(questions, corpus, keys, 5, metric))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24_000_000  # all ties are 8 to 17 MB in each of several arrays, the block in double precision 8 a copy
    want = sorted(range(0, len(corpus), 4), key=keys.__getitem__)[:5]
    assert [(q, c) for q, c, _ in found] == [(q, c) for q in range(256) for c in want]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("n", [1, 6, 500])
def test_rows_of_a_block_a_few_at_a_time(metric, n, monkeypatch):
    for name, size in (("AT_ONCE", 3), ("ROWS_AT_ONCE", 7), ("PAIRS_AT_ONCE", 4)):
        monkeypatch.setattr(vector_search, name, size)
    corpus = np.delete(VECTORS, 17, 0).astype(np.float32)
    questions, keys = corpus[195:215], np.random.default_rng(6).permutation(len(corpus)).tolist()
    found = list(vector_search.best_of_block(questions, corpus, keys, n, metric))
    want = []
    for q, v in enumerate(questions.astype(np.float64)):
        away = vector_search.EXACT[metric](v[None], corpus.astype(np.float64)).tolist()
        want += [(q, c, d) for d, _, c in sorted(zip(away, keys, range(len(corpus)), strict=True))[:n]]
    assert found == want


def test_no_questions_or_no_rows(spark, vectors):
    assert vector_search.nearest_join(vectors.limit(0), vectors, "id", "v").count() == 0
    assert vector_search.nearest_join(vectors, vectors.limit(0), "id", "v").count() == 0
    with pytest.raises(Exception, match="lengths"):
        vector_search.nearest_join(spark.createDataFrame([(1, [1.0])], "id int, v array<double>"), vectors, "id", "v").collect()


def test_block_pairs_send_their_best_only(spark, vectors):
    plan = vector_search.nearest_join(vectors.where("id % 20 = 0"), vectors, "id", "v", 6, "l2", 7, 30)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("pivots", [1, 8, 500])
def test_pivots_answer_as_a_scan(spark, vectors, pivots):
    path = new_path(spark, "pivots")
    vector_search.build_pivots(vectors, "id", "v", path, pivots)
    present = vectors.where(vector_search.usable("v") & F.col("id").isNotNull())
    for question, n in ((VECTORS[210], 1), (VECTORS[3], 10), (np.full(6, 9.0), 500)):
        got = vector_search.nearest_around_pivots(spark, path, question.tolist(), n, "id")
        assert rows_of(got.rows) == rows_of(retrieval.nearest_vectors(present, "id", "v", question.tolist(), n))


def test_far_partitions_are_skipped(spark):
    r = np.random.default_rng(8)
    middles = r.normal(size=(20, 6)) * 10
    rows = [(i, (middles[i % 20] + 0.1 * r.normal(size=6)).tolist()) for i in range(2000)]
    path = new_path(spark, "pivots")
    vector_search.build_pivots(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", path, 40)
    got = vector_search.nearest_around_pivots(spark, path, rows[5][1], 10, "id")
    assert got.partitions_read <= got.partitions / 4 and got.rows_read < got.row_count / 4
    assert got.rows.count() == 10


def test_pivots_of_nothing(spark, vectors):
    path = new_path(spark, "pivots")
    vector_search.build_pivots(vectors.limit(0), "id", "v", path)
    assert vector_search.nearest_around_pivots(spark, path, [0.0] * 6, 3, "id").rows.count() == 0
