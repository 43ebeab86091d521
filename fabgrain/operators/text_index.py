"""Questions over an index of text vectors: posting lists in bands of falling weight, read only as deep as the answer needs.

A bucket's postings are cut into bands by weight, each with its largest weight as an upper bound. A question reads the bands
of its own buckets, those that can add most first. What is unread bounds the similarity of every document from above: once
the ``n`` best seen are better than any unseen one can be, the few that could still be among them are compared exactly.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabgrain.functions.skew import keep
from fabgrain.operators.retrieval import BUCKETS, question_product, question_vector, ranked

#: Bands per halving of the weight, and folders that buckets are spread over.
BANDS_PER_HALF = 4
SHELVES = 32
#: Postings of the first reading; each further one reads four times as many.
FIRST_ROWS = 4096
#: Documents whose vectors are looked up for the exact comparison, at most; with more candidates, more bands are read.
MOST_CANDIDATES = 4096
#: Sums that differ by less may differ by their order only.
SLACK = 1e-9


class Answer(NamedTuple):
    """The nearest documents, and how much of the question's postings was read for them."""

    rows: DataFrame
    bands_read: int
    bands: int
    postings_read: int
    postings: int


def build_index(vectors: DataFrame, weights: DataFrame, key: str, path: str, vector: str = "vector") -> None:
    """Write the index of :func:`fabgrain.operators.retrieval.document_vectors` under ``path``.

    Postings lie in folders by bucket, in files sorted by bucket, band and key; a hot bucket or band spreads over many files.
    ``bands`` holds their bounds, ``vectors`` the documents in key order for look-ups, ``weights`` the bucket weights.
    """
    band = F.floor(-F.log2("weight") * BANDS_PER_HALF).cast("int")
    postings = vectors.select(F.col(key), F.inline(vector)).where("weight > 0").withColumns({"band": band, "shelf": (F.col("bucket") % SHELVES).cast("int")})
    place = ["shelf", "bucket", "band", key]
    postings.repartitionByRange(*place).sortWithinPartitions(*place).write.partitionBy("shelf").parquet(f"{path}/postings")
    vectors.select(F.col(key), F.col(vector).alias("vector")).repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{path}/vectors")
    _postings(vectors.sparkSession, path).groupBy("bucket", "band").agg(F.max("weight").alias("bound"), F.count("*").alias("n")).write.parquet(f"{path}/bands")
    weights.write.parquet(f"{path}/weights")


def _chosen(depth: dict[int, int]) -> Column:
    """Postings down to a band per bucket; folders and files without any are not read."""
    within = F.lit(False)
    for bucket, band in depth.items():
        within = within | ((F.col("bucket") == bucket) & (F.col("band") <= band))
    return F.col("shelf").isin(sorted({b % SHELVES for b in depth})) & F.col("bucket").isin(sorted(depth)) & within


def read_postings(spark: SparkSession, path: str, depth: dict[int, int]) -> DataFrame:
    """Postings of the given buckets, each down to its band."""
    return _postings(spark, path).where(_chosen(depth))


def _postings(spark: SparkSession, path: str) -> DataFrame:
    key, kind = spark.read.parquet(f"{path}/vectors").dtypes[0]
    return spark.read.schema(f"`{key}` {kind}, bucket long, weight double, band int, shelf int").parquet(f"{path}/postings")


def ask(spark: SparkSession, path: str, query: str, n: int = 5, key: str = "id", buckets: int = BUCKETS, first_rows: int = FIRST_ROWS) -> Answer:
    """The rows of :func:`fabgrain.operators.retrieval.nearest_stored` over the indexed vectors, ties included.

    Documents without a vector are not found, others without a word of the question have similarity 0. Only bounds of the
    question's own bands and at most ``MOST_CANDIDATES`` keys come to the driver.
    """
    question = question_vector(spark.read.parquet(f"{path}/weights"), query, buckets)
    weight = dict(question)
    bounds = spark.read.parquet(f"{path}/bands").where(F.col("bucket").isin(sorted(weight))).collect() if weight else []
    bands = sorted(bounds, key=lambda r: (-weight[r["bucket"]] * r["bound"], r["bucket"], r["band"]))
    total = sum(r["n"] for r in bands)
    vectors = spark.read.parquet(f"{path}/vectors").where("vector IS NOT NULL")
    budget, taken, read = first_rows, 0, 0
    while taken < len(bands):
        start = taken
        while taken < len(bands) and (read < budget or taken == start):
            read += bands[taken]["n"]
            taken += 1
        budget *= 4
        depth = {b["bucket"]: b["band"] for b in sorted(bands[:taken], key=lambda r: r["band"])}
        unread = {b: max((r["bound"] for r in bands[taken:] if r["bucket"] == b), default=0.0) * w for b, w in question}
        rest = sum(unread.values())
        entries = F.array_sort(F.collect_list(F.struct("bucket", "weight")))  # at most one per word of the question
        seen = read_postings(spark, path, depth).groupBy(key).agg(entries.alias("entries"))
        least = question_product(F.col("entries"), question)
        known = F.aggregate("entries", F.lit(0.0), lambda s, e: s + F.try_element_at(_constant(unread), e["bucket"]))
        scored = keep(seen.select(key, least.alias("least"), (least + F.lit(rest) - known).alias("most")))
        if taken == len(bands):
            best = scored.select(key, F.col("least").alias("similarity"))
            break
        nth = scored.orderBy(F.desc("least")).limit(n).agg(F.min("least"), F.count("*")).first()
        if nth[1] < n or nth[0] <= rest + SLACK:
            continue  # an unseen document may still be among the best
        close = [r[key] for r in scored.where(F.col("most") >= nth[0] - SLACK).select(key).limit(MOST_CANDIDATES + 1).collect()]
        if len(close) <= MOST_CANDIDATES:
            best = vectors.where(F.col(key).isin(close)).select(key, question_product(F.col("vector"), question).alias("similarity"))
            break
    else:
        best = vectors.select(key, F.lit(0.0).alias("similarity")).limit(0)
    order = [F.desc("similarity"), F.col(key)]
    best = best.orderBy(*order).limit(n)
    if taken == len(bands):  # all sharing documents are known; others come after them
        found = keep(best)
        others = vectors.join(F.broadcast(found), key, "left_anti").select(key, F.lit(0.0).alias("similarity")).orderBy(key).limit(n)
        best = found.unionByName(others).orderBy(*order).limit(n)
    return Answer(ranked(best, order), taken, len(bands), read, total)


def _constant(values: dict[int, float]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(b).cast("long") for b in values]), F.array(*[F.lit(v) for v in values.values()]))
