"""Text vectors and nearest neighbours by exact distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabgrain.functions.skew import keep

# Buckets words are hashed into; also the upper bound of every per-bucket table.
BUCKETS = 4096
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: str) -> Column:
    """Lower-case runs of letters and digits; the outermost ones may be empty text."""
    return F.split(F.lower(text), WORD_BREAK)


def bucket(word: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a word: leading 32 bits of its MD5.

    Never NULL by type, or joins on the bucket would hash every word once more to test for it.
    """
    return F.coalesce(F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(buckets)), F.lit(0).cast("long"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often and in whatever loop it is used."""
    return F.transform(F.array(value), body)[0]


def count_vectors(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """Word count per bucket, ``(key, counts)``: entries ``(bucket, tf)`` in bucket order.

    Buckets are sorted and counted inside the row, so no text and no word is shuffled. A null or empty text has no entries.
    """
    def ends(found: Column) -> Column:
        """Where the runs of equal buckets end."""
        n = F.size(found)
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(found, i) != F.get(found, i - 1)))

    def counted(found: Column, end: Column) -> Column:
        length = lambda e, i: (e - F.coalesce(F.get(end, i - 1), F.lit(0))).cast("long")
        return F.transform(end, lambda e, i: F.struct(F.get(found, e - 1).alias("bucket"), length(e, i).alias("tf")))

    hashed = F.sort_array(F.transform(F.filter(words(text), lambda w: w != ""), lambda w: bucket(w, buckets)))
    counts = let(hashed, lambda found: F.when(F.size(found) > 0, let(ends(found), lambda end: counted(found, end))))
    return docs.select(F.col(key), F.coalesce(counts, F.array().cast("array<struct<bucket:bigint,tf:bigint>>")).alias("counts"))


def bucket_weights(counts: DataFrame) -> DataFrame:
    """Inverse document frequency per bucket of :func:`count_vectors`, ``(bucket, idf)``: at most one row per bucket."""
    total = counts.agg(F.count("*").alias("n")).scalar()
    per_bucket = counts.select(F.explode("counts.bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("docs"))
    return per_bucket.select("bucket", F.ln((total + 1) / (F.col("docs") + 1)).alias("idf"))


def _lookup(weights: DataFrame, buckets: int) -> Column:
    """The weight of every bucket as one constant array; ``weights`` has at most ``buckets`` rows."""
    idf = {r["bucket"]: r["idf"] for r in weights.collect()}
    return F.split(F.lit(",".join(repr(idf.get(b, 0.0)) for b in range(buckets))), ",").cast("array<double>")


def vectors_of(counts: DataFrame, weights: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Unit-length hashed TF-IDF vectors, ``(key, vector)``: entries ``(bucket, weight)`` in bucket order.

    Sums run in that order too, so equal texts get equal vectors to the last digit. Weights of zero, from words every document
    has, are kept; the vector of a document of nothing else, or without words, is NULL.
    """
    idf = _lookup(weights, buckets)
    raw = F.transform("counts", lambda c: F.struct(c["bucket"].alias("bucket"), (c["tf"] * F.get(idf, c["bucket"])).alias("weight")))

    def unit(entries: Column, length: Column) -> Column:
        return F.when(length > 0, F.transform(entries, lambda e: F.struct(e["bucket"].alias("bucket"), (e["weight"] / length).alias("weight"))))

    vector = let(raw, lambda entries: let(
        F.sqrt(F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"])), lambda length: unit(entries, length)))
    return counts.select(F.col(key), vector.alias("vector"))


def hashed_tfidf(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """The entries of :func:`vectors_of` as rows ``(key, bucket, weight)``. Counts are stored, as they are read twice."""
    counts = keep(count_vectors(docs, key, text, buckets))
    return vectors_of(counts, bucket_weights(counts), key, buckets).select(F.col(key), F.inline("vector"))


def document_vectors(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Stored vectors and bucket weights of documents, which answer any number of questions."""
    counts = keep(count_vectors(docs, key, text, buckets))
    weights = keep(bucket_weights(counts))
    return keep(vectors_of(counts, weights, key, buckets)), weights


def question_vector(weights: DataFrame, query: str, buckets: int = BUCKETS) -> list[tuple[int, float]]:
    """The question's buckets and their weights, of length 1 together, in bucket order; without weighted words, none."""
    asked = weights.sparkSession.createDataFrame([(0, query)], "q int, text string")
    counts = count_vectors(asked, "q", "text", buckets).select(F.inline("counts"))
    found = sorted((r["bucket"], r["w"]) for r in counts.join(weights, "bucket").select("bucket", (F.col("tf") * F.col("idf")).alias("w")).collect())
    length = sum(w * w for _, w in found) ** 0.5
    return [(b, w / length) for b, w in found if w > 0] if length > 0 else []


def question_product(entries: Column, question: Sequence[tuple[int, float]]) -> Column:
    """Scalar product of a vector's entries with a question, added up in bucket order."""
    if not question:
        return F.lit(0.0)
    asked = F.map_from_arrays(F.array(*[F.lit(b).cast("long") for b, _ in question]), F.array(*[F.lit(w) for _, w in question]))
    shared = F.filter(entries, lambda e: e["bucket"].isin([b for b, _ in question]))
    return F.coalesce(F.aggregate(shared, F.lit(0.0), lambda s, e: s + e["weight"] * F.try_element_at(asked, e["bucket"])), F.lit(0.0))


def nearest_stored(
    vectors: DataFrame, weights: DataFrame, key: str, query: str, n: int = 3, vector: str = "vector", buckets: int = BUCKETS
) -> DataFrame:
    """The ``n`` documents of highest cosine similarity to a query text, ``(key, similarity, rank)``.

    The question gets the documents' bucket weights; one scan of the vectors and one top-k answer it. Ties go to the smaller
    key. Documents sharing no weighted word, or without any, have similarity 0.
    """
    similarity = question_product(F.col(vector), question_vector(weights, query, buckets))
    best = vectors.select(key, similarity.alias("similarity")).orderBy(F.desc("similarity"), key).limit(n)
    return ranked(best, [F.desc("similarity"), F.col(key)])


def nearest_text(docs: DataFrame, key: str, text: str, query: str, n: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """:func:`nearest_stored` for a single question: counts are stored, vectors are made while they are compared."""
    counts = keep(count_vectors(docs, key, text, buckets))
    weights = keep(bucket_weights(counts))
    return nearest_stored(vectors_of(counts, weights, key, buckets), weights, key, query, n, buckets=buckets)


def ranked(few: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number the rows of a top-k result from 1."""
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def l2(vector: Column, other: Column) -> Column:
    """Euclidean distance of two arrays, in double precision."""
    squares = F.zip_with(vector, other, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def dot(vector: Column, other: Column) -> Column:
    products = F.zip_with(vector, other, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def cosine_distance(vector: Column, other: Column) -> Column:
    """One minus the cosine of two arrays; NULL when either has length zero."""
    lengths = F.sqrt(dot(vector, vector)) * F.sqrt(dot(other, other))
    return F.when(lengths > 0, 1 - dot(vector, other) / lengths)


METRICS = {"l2": l2, "cosine": cosine_distance}


def nearest_vectors(
    corpus: DataFrame, key: str, vector: str, query: Sequence[float], n: int = 3, metric: str = "l2"
) -> DataFrame:
    """The ``n`` rows nearest to a query vector, ``(key, distance, rank)``: one scan and one top-k.

    Distances are compared in full precision; equal ones go to the smaller key.
    """
    target = F.array(*[F.lit(float(v)) for v in query])
    distance = METRICS[metric](F.col(vector), target)
    best = corpus.select(key, distance.alias("distance")).where("distance IS NOT NULL")
    return ranked(best.orderBy("distance", key).limit(n), [F.col("distance"), F.col(key)])


def search(
    docs: DataFrame, query: str, n: int = 5, key: str = "id", text: str = "document",
    vectors: DataFrame | None = None, weights: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` documents nearest to a question, with their text, in order; through stored vectors where given."""
    stored = vectors is not None and weights is not None
    found = keep(nearest_stored(vectors, weights, key, query, n) if stored else nearest_text(docs, key, text, query, n))
    return docs.join(F.broadcast(found), key).select("rank", key, text, "similarity").orderBy("rank")


def embed(docs: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]], column: str = "embedding") -> DataFrame:
    """Add a vector column from any encoder of text batches; the encoder runs in the tasks."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(encoder(batch.tolist()))

    return docs.withColumn(column, encode(F.col(text)))
