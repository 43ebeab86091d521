"""Many questions of many vectors, and one question of vectors stored around pivots; both exact.

Distances are computed as :func:`fabgrain.operators.retrieval.l2` and ``cosine_distance`` do, component by component, so that
the same pair of vectors has the same distance to the last digit in each of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fabgrain.operators.retrieval import l2, ranked

#: Rows of a block on each side of a join; questions and rows of a block that are compared at a time, and pairs, exactly.
QUESTION_ROWS, CORPUS_ROWS, AT_ONCE, ROWS_AT_ONCE, PAIRS_AT_ONCE = 4096, 32768, 256, 2048, 4096
PIVOTS = 32
#: Error of a distance by matrix product, or by the triangle inequality, relative to the lengths of the vectors.
SLACK = 1e-9


def usable(vector: str) -> Column:
    """Vectors without missing components; NaN counts as missing."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def _summed(products: np.ndarray) -> np.ndarray:
    """Sums over the last axis, from left to right."""
    total = np.zeros(products.shape[:-1])
    for j in range(products.shape[-1]):
        total += products[..., j]
    return total


def exact_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_summed((a - b) ** 2))


def exact_lengths(a: np.ndarray) -> np.ndarray:
    return np.sqrt(_summed(a * a))


def exact_cosine(a: np.ndarray, b: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """NaN where either length is zero. ``lengths`` is the product of both, where it is known."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - _summed(a * b) / (exact_lengths(a) * exact_lengths(b) if lengths is None else lengths)


EXACT = {"l2": exact_l2, "cosine": exact_cosine}


def _stored(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row per vector, in the type of its components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = set(np.diff(column.offsets.to_numpy()).tolist())
    if len(sizes) > 1:
        raise ValueError("vectors have different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), sizes.pop() if sizes else 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _stored(column).astype(np.float64)


def _first_of_each(asked: np.ndarray, close: np.ndarray, away: np.ndarray, by_key: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of rows ``close`` to questions ``asked``, the ``n`` nearest to each, in order."""
    order = np.lexsort((by_key[close], away, asked))
    asked = asked[order]
    kept = np.arange(len(asked)) - np.searchsorted(asked, asked) < n
    order = order[kept]
    return asked[kept], close[order], away[order]


def best_of_block(questions: np.ndarray, corpus: np.ndarray, keys: list, n: int, metric: str) -> Iterator[tuple[int, int, float]]:
    """For each question its ``n`` nearest rows: place of the question, place of the row, distance.

    Rows are taken a few at a time, and only those in double precision. A matrix product finds all that can be among the
    nearest so far, whatever its rounding; those are compared exactly, and ``n`` per question kept, however many tie.
    """
    if questions.shape[1] != corpus.shape[1]:
        raise ValueError("questions and rows have different lengths")

    def scaled(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.sqrt((m * m).sum(1)), 1e-300)[:, None] if metric == "cosine" else m

    questions = questions.astype(np.float64, copy=False)
    x = scaled(questions)
    x2 = (x * x).sum(1)
    x_length = exact_lengths(questions)
    longest = np.float64(0)  # squared, of the rows so far
    least = np.full((len(x), n), np.inf)  # of the rows so far; their n-th distance only falls
    by_key = np.empty(len(keys), np.int64)  # each row's place among the keys
    by_key[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for _ in range(0, len(x), AT_ONCE)]
    for at in range(0, len(corpus), ROWS_AT_ONCE):
        rows = corpus[at : at + ROWS_AT_ONCE].astype(np.float64, copy=False)
        y = scaled(rows)
        y2 = (y * y).sum(1)
        y_length = exact_lengths(rows)
        longest = np.maximum(longest, y2.max())
        for k, start in enumerate(range(0, len(x), AT_ONCE)):
            part = slice(start, start + AT_ONCE)
            near = x[part] @ y.T
            near *= -2
            near += x2[part, None]
            near += y2
            ahead = np.concatenate([least[part], np.partition(near, n - 1, axis=1)[:, :n] if n < near.shape[1] else near], axis=1)
            least[part] = np.partition(ahead, n - 1, axis=1)[:, :n]
            limit = least[part].max(1) + SLACK * (x2[part] + longest + 1)
            asked, close = np.nonzero(~(near > limit[:, None]))
            for i in range(0, len(asked), PAIRS_AT_ONCE):
                q, c = asked[i : i + PAIRS_AT_ONCE] + start, close[i : i + PAIRS_AT_ONCE]
                away = exact_l2(questions[q], rows[c]) if metric == "l2" else exact_cosine(questions[q], rows[c], x_length[q] * y_length[c])
                known = away == away
                found = q[known], c[known] + at, away[known]
                best[k] = _first_of_each(*map(np.concatenate, zip(best[k], found, strict=True)), by_key, n)
    for part in best:
        yield from zip(*(column.tolist() for column in part), strict=True)


def nearest_join(
    questions: DataFrame, corpus: DataFrame, key: str, vector: str, n: int = 5, metric: str = "l2",
    question_rows: int = QUESTION_ROWS, corpus_rows: int = CORPUS_ROWS,
) -> DataFrame:
    """The ``n`` rows of ``corpus`` nearest to each question: ``(question, key, distance, rank)``.

    Both sides are dealt into blocks, and every block of questions meets every block of rows in a task of its own, which keeps
    ``n`` rows per question; these are merged per question, so no pair that is not among a block's best is shuffled. Ties go to
    the smaller key. Vectors with missing components, and of length zero for the cosine, are left out; all must have one length.
    """
    def dealt(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
        kept = df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
        groups = max(1, -(-kept.count() // rows))
        return kept.withColumn(name, (F.monotonically_increasing_id() % groups).cast("int")), groups

    asked, q_groups = dealt(questions, question_rows, "q")
    rows, c_groups = dealt(corpus, corpus_rows, "c")
    asked = asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_groups - 1))))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))))
    kinds = [df.schema["key"].dataType for df in (asked, rows)]
    schema = pa.schema([("question", to_arrow_type(kinds[0])), ("key", to_arrow_type(kinds[1])), ("distance", pa.float64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        keys, names = right.column("key").to_pylist(), left.column("key").to_pylist()
        found = list(best_of_block(_stored(left.column("v")), _stored(right.column("v")), keys, n, metric))
        columns = [[names[q] for q, _, _ in found], [keys[c] for _, c, _ in found], [d for _, _, d in found]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    best = asked.groupBy("q", "c").cogroup(rows.groupBy("q", "c")).applyInArrow(
        compare, f"question {kinds[0].simpleString()}, key {kinds[1].simpleString()}, distance double")
    rank = F.row_number().over(Window.partitionBy("question").orderBy("distance", "key"))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).select("question", F.col("key").alias(key), "distance", "rank")


class PivotAnswer(NamedTuple):
    """The nearest rows, and how many of the partitions and rows were read for them."""

    rows: DataFrame
    partitions_read: int
    partitions: int
    rows_read: int
    row_count: int


def build_pivots(corpus: DataFrame, key: str, vector: str, path: str, pivots: int = PIVOTS) -> None:
    """Store vectors around the pivots nearest to them, with their distance to it, under ``path``.

    The pivots are a bounded sample: the ``pivots`` rows of smallest hash. Rows lie in a folder per pivot, by distance, a large
    one in many files; ``pivots`` holds the number of rows and the least and largest distance of each.
    """
    kept = corpus.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key), F.col(vector).alias("vector"))
    chosen = [r["vector"] for r in kept.orderBy(F.xxhash64(key, "vector"), key).limit(pivots).collect()]
    spark = corpus.sparkSession
    middles = spark.sparkContext.broadcast(np.array(chosen, np.float64).reshape(len(chosen), len(chosen[0]) if chosen else 0))
    kind = kept.schema[key].dataType
    out = [key, "vector", "pivot", "away"]

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for s in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                x, c = _matrix(s.column(1)), middles.value
                near = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)
                pivot = near.argmin(1)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(pivot, pa.int32()), pa.array(exact_l2(x, c[pivot]))], names=out)

    placed = kept.mapInArrow(place, f"`{key}` {kind.simpleString()}, vector {kept.schema['vector'].dataType.simpleString()}, pivot int, away double")
    placed.repartitionByRange("pivot", "away", key).sortWithinPartitions("pivot", "away").write.partitionBy("pivot").parquet(f"{path}/rows")
    placed.limit(0).write.parquet(f"{path}/columns")  # an empty table has no folder that tells its columns
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    spread = stored.groupBy("pivot").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n"))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(chosen)], "pivot int, middle array<double>")
    table.join(spread, "pivot").write.parquet(f"{path}/pivots")


def nearest_around_pivots(spark: SparkSession, path: str, question: Sequence[float], n: int = 10, key: str = "vec_id") -> PivotAnswer:
    """The rows of :func:`fabgrain.operators.retrieval.nearest_vectors` over the stored vectors, ties included.

    The partitions nearest to the question are read first; the distance of the ``n``-th row found there is a limit. By the
    triangle inequality a partition, or a row of it, whose distance to the pivot differs from the question's by more than the
    limit is farther, and is not read.
    """
    at = np.array([float(x) for x in question])
    pivots = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()  # one row per pivot
    stored = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    away = {p["pivot"]: float(exact_l2(at, np.array(p["middle"]))) for p in pivots}
    slack = SLACK * (1 + max(away.values(), default=0.0) + max((p["high"] for p in pivots), default=0.0))
    ahead = sorted(pivots, key=lambda p: (max(0.0, away[p["pivot"]] - p["high"], p["low"] - away[p["pivot"]]), away[p["pivot"]]))
    first, rows = [], 0
    for p in ahead:
        if rows >= n:
            break
        first.append(p["pivot"])
        rows += p["n"]
    distance = l2(F.col("vector"), F.array(*[F.lit(float(x)) for x in question])).alias("distance")
    order = [F.col("distance"), F.col(key)]
    start = stored.where(F.col("pivot").isin(first)).select(key, distance).where("distance IS NOT NULL").orderBy(*order).limit(n).collect()
    limit = start[-1]["distance"] + slack if len(start) == n else float("inf")
    reached = [p for p in pivots if p["low"] - limit <= away[p["pivot"]] <= p["high"] + limit]
    within = F.lit(False)
    for p in reached:
        d = away[p["pivot"]]
        within = within | ((F.col("pivot") == p["pivot"]) & F.col("away").between(d - limit, d + limit))
    close = stored.where(F.col("pivot").isin([p["pivot"] for p in reached])).where(within)
    best = close.select(key, distance).where("distance IS NOT NULL").orderBy(*order).limit(n)
    return PivotAnswer(ranked(best, order), len(reached), len(pivots), close.count(), sum(p["n"] for p in pivots))
