"""Vector codes by Lloyd rounds over cover trees: whole subtrees are assigned by the triangle inequality.

Every block of rows has one cover tree per part of the vectors, built once and stored. A node's rows follow each other, so
cumulative sums give the total of any subtree. In a round, a node whose radius is too small for another entry to win goes
to the nearest entry as a whole; the rows of the finest nodes that stay ambiguous are compared exactly.
All values are whole numbers, so that sums and distances are exact in any order.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fabgrain.llm.common import free_names
from fabgrain.session import durable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a tree at most, rows per finest node on average, and the ratio of the scales of neighbouring levels.
BLOCK, LEAF, RATIO = 2048, 8, 2 ** 0.5
#: Beyond this, whole numbers are not exact as floats.
EXACT = 1 << 53


class Level(NamedTuple):
    """Nodes of one scale, in the order of their rows."""

    first: np.ndarray  # where a node's rows begin
    centre: np.ndarray  # place of its centre
    radius: np.ndarray  # from there to the farthest of its rows


class Tree(NamedTuple):
    order: np.ndarray  # the block's rows in tree order
    points: np.ndarray
    levels: list[Level]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` and ``b``, which hold whole numbers."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if a.shape[1] * 4 * most * most < EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    if a.shape[1] * 4 * most * most >= 1 << 63:
        raise ValueError(f"components as large as {most} have squared distances beyond 64 bits")
    out = np.empty((len(a), len(b)), np.int64)
    for i, row in enumerate(b.astype(np.int64)):
        out[:, i] = ((a - row) ** 2).sum(1)
    return out


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree of the rows of ``points``, down to nodes of ``leaf`` rows on average.

    Centres are taken farthest first. Those that are more than a scale apart form the level of that scale; all rows lie
    within the scale of a centre, and every centre is one of the next level too.
    """
    x = points.astype(np.float64)
    far = ((x - x[0]) ** 2).sum(1)
    owner = np.zeros(len(x), np.int64)
    centres, nets = [0], []
    scale = far.max() ** 0.5 / RATIO
    nets.append((1, owner.copy()))
    while len(centres) < len(x) // leaf:
        i = int(far.argmax())
        if far[i] == 0:
            break
        if far[i] <= scale * scale:
            if nets[-1][0] < len(centres):
                nets.append((len(centres), owner.copy()))
            scale /= RATIO
            continue
        away = ((x - x[i]) ** 2).sum(1)
        closer = away < far
        far[closer] = away[closer]
        owner[closer] = len(centres)
        centres.append(i)
    if nets[-1][0] < len(centres):
        nets.append((len(centres), owner.copy()))
    # The path of each row from the finest level up: a centre belongs to its nearest centre one level above.
    at = np.array(centres)
    paths = [nets[-1][1]]
    for n, owners in reversed(nets[:-1]):
        parent = np.where(np.arange(len(at)) < n, np.arange(len(at)), owners[at])
        paths.append(parent[paths[-1]])
    paths.reverse()
    order = np.lexsort(paths[::-1])
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    levels = []
    for path in paths:
        node = path[order]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        centre = at[node[first]]
        away = np.sqrt(((x[order] - x[at[node]]) ** 2).sum(1))
        levels.append(Level(first.astype(np.int32), place[centre].astype(np.int32), np.maximum.reduceat(away, first)))
    return Tree(order.astype(np.int32), points[order], levels)


class Assignment(NamedTuple):
    first: np.ndarray  # subtrees that go to one entry as a whole: where their rows begin and end, and the entry
    last: np.ndarray
    entry: np.ndarray
    rows: np.ndarray  # rows compared exactly, and their entries
    row_entry: np.ndarray


def assign(tree: Tree, book: np.ndarray) -> Assignment:
    """The nearest entry of every row, ties to the lower index."""
    n = len(tree.points)
    open_rows = np.ones(n, bool)
    whole: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in tree.levels:
        last = np.r_[level.first[1:], n]
        nodes = np.flatnonzero(open_rows[level.first])
        if not len(nodes):
            break
        away = squared(tree.points[level.centre[nodes]], book).astype(np.float64)
        best = away.argmin(1)
        rows = np.arange(len(nodes))
        nearest = np.sqrt(away[rows, best])
        away[rows, best] = np.inf
        # another entry is farther from every row, by more than rounding could hide
        sure = np.sqrt(away.min(1)) - nearest > 2 * level.radius[nodes] * (1 + 1e-9) + 1e-6 * (1 + nearest)
        for a, b in zip(level.first[nodes[sure]], last[nodes[sure]], strict=True):
            open_rows[a:b] = False
        whole.append((level.first[nodes[sure]], last[nodes[sure]], best[sure]))
    rest = np.flatnonzero(open_rows)
    return Assignment(*(np.concatenate(c) for c in zip(*whole, strict=True)), rest, squared(tree.points[rest], book).argmin(1))


def entries(found: Assignment, n: int) -> np.ndarray:
    """The entry of each row, in tree order."""
    out = np.empty(n, np.int64)
    out[found.rows] = found.row_entry
    for a, b, e in zip(found.first, found.last, found.entry, strict=True):
        out[a:b] = e
    return out


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the rows of each entry; subtrees give theirs from cumulative sums."""
    found = assign(tree, book)
    upto = np.zeros((len(tree.points) + 1, tree.points.shape[1]), np.int64)
    np.cumsum(tree.points, axis=0, dtype=np.int64, out=upto[1:])
    number, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    np.add.at(number, found.entry, (found.last - found.first).astype(np.int64))
    np.add.at(total, found.entry, upto[found.last] - upto[found.first])
    np.add.at(number, found.row_entry, 1)
    np.add.at(total, found.row_entry, tree.points[found.rows].astype(np.int64))
    return number, total


# -- with Spark ----------------------------------------------------------------------------------------------------

def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Neither the vector nor a component is null, and all components are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def parts_of(matrix: np.ndarray) -> list[np.ndarray]:
    width, rest = divmod(matrix.shape[1], PARTS)
    if rest:
        raise ValueError(f"vectors of {matrix.shape[1]} components can't be cut into {PARTS} equal parts")
    return [matrix[:, i * width : (i + 1) * width] for i in range(PARTS)]


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow column of lists of whole numbers, all of one length."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors have different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(sizes[0]))


def trees(vectors: DataFrame, key: str, vector: str, label: str, block: int = BLOCK) -> DataFrame:
    """A row per block: ``keys``, ``labels`` and ``trees`` of its usable rows. Stored, as every round reads it."""
    kept = vectors.where(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(label).alias("label"), whole_numbers(F.col(vector)).alias("v"))
    kinds = [kept.schema[c].dataType for c in ("key", "label")]
    schema = pa.schema([("keys", pa.list_(to_arrow_type(kinds[0]))), ("labels", pa.list_(to_arrow_type(kinds[1]))), ("trees", pa.list_(pa.binary()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for s in (b.slice(i, block) for i in range(0, b.num_rows, block)):
                matrix = _matrix(s.column(2))
                made = [pickle.dumps(tuple(build(_narrow(p)))) for p in parts_of(matrix)]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((s.column(0).to_pylist(), s.column(1).to_pylist(), made), schema.types, strict=True)], schema=schema)

    names = [k.simpleString() for k in kinds]
    return durable(kept.mapInArrow(run, f"keys array<{names[0]}>, labels array<{names[1]}>, trees array<binary>"))


def _narrow(values: np.ndarray) -> np.ndarray:
    small = np.iinfo(np.int16)
    return values.astype(np.int16) if values.size and small.min <= values.min() and values.max() <= small.max else values


def _trees_of(blob: bytes) -> Tree:
    order, points, levels = pickle.loads(blob)
    return Tree(order, points.astype(np.int64), levels)


def first_entries(vectors: DataFrame, key: str, vector: str, n: int = ENTRIES) -> list[np.ndarray]:
    """The codebooks of the ``n`` rows with the smallest keys; rows of one key by their components, null keys last."""
    kept = vectors.where(usable(F.col(vector))).select(F.col(key).alias("key"), whole_numbers(F.col(vector)).alias("v"))
    rows = [r["v"] for r in kept.orderBy(F.col("key").asc_nulls_last(), "v").limit(n).collect()]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors have different lengths")
    return parts_of(np.array(rows, np.int64).reshape(len(rows), len(rows[0]) if rows else 0))


def next_round(stored: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry replaced by the floor of its rows' mean; entries without rows stay.

    Each task adds up its blocks; a number and a sum per component of each entry, at most, come to the driver.
    """
    shared = stored.sparkSession.sparkContext.broadcast(books)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in shared.value]
        for b in parts:
            for blobs in b.column(0):
                for total, blob, book in zip(sums, blobs, shared.value, strict=True):
                    number, values = totals(_trees_of(blob.as_py()), book)
                    total += np.c_[number, values]
        flat = np.concatenate([s.ravel() for s in sums])
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["slot", "value"])

    summed = stored.select("trees").mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found = {r["slot"]: int(r["value"]) for r in summed.collect()}
    out, at = [], 0
    for book in books:
        book = book.copy()
        for entry in range(len(book)):
            if n := found.get(at, 0):
                book[entry] = [found.get(at + 1 + j, 0) // n for j in range(book.shape[1])]
            at += book.shape[1] + 1
        out.append(book)
    return out


def codes(stored: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``key``, ``label``, ``code`` and ``error`` of every row."""
    shared = stored.sparkSession.sparkContext.broadcast(books)
    kinds = [stored.schema[c].dataType.elementType for c in ("keys", "labels")]
    schema = pa.schema([("key", to_arrow_type(kinds[0])), ("label", to_arrow_type(kinds[1])), ("code", pa.string()), ("error", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for keys, labels, blobs in zip(b.column(0), b.column(1), b.column(2), strict=True):
                code = np.empty((len(keys), PARTS), np.uint8)
                error = np.zeros(len(keys), np.int64)
                for i, (blob, book) in enumerate(zip(blobs, shared.value, strict=True)):
                    tree = _trees_of(blob.as_py())
                    entry = entries(assign(tree, book), len(tree.points))
                    code[tree.order, i] = entry
                    error[tree.order] += ((tree.points - book[entry]) ** 2).sum(1)
                text = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays([keys.values, labels.values, pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]), pa.array(error)], schema=schema)

    return stored.mapInArrow(run, f"key {kinds[0].simpleString()}, label {kinds[1].simpleString()}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def train(vectors: DataFrame, stored: DataFrame, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> list[np.ndarray]:
    books = first_entries(vectors, key, vector)
    for _ in range(rounds):
        books = next_round(stored, books)
    return books


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Per usable row: ``key``, ``code``, ``error``, ``label_error`` (summed over equal labels, nulls together) and
    ``codebooks_sha256``.

    Rows with a null vector, or with a null or infinite component or NaN, are dropped. With fewer than 256 rows the
    codebooks are as small; without any, the result is empty. Repeated rows and keys are rows like others; a null key comes
    after all others. Vectors must have one length, a multiple of four, and components whose squared distances fit
    64 bits: others stop the query. Other columns are not looked at.
    """
    stored = trees(vectors, key, vector, label)
    books = train(vectors, stored, key, vector, rounds)
    coded = durable(codes(stored, books))
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    own, code, error, total, sha = free_names(vectors.select(key), "label", "code", "error", "label_error", "codebooks_sha256")
    return coded.join(sums.withColumnRenamed("label", "own"), F.col("label").eqNullSafe(F.col("own")), "left").select(
        F.col("key").alias(key), F.col("code").alias(code), F.col("error").alias(error), F.col("label_error").alias(total), F.lit(digest(books)).alias(sha))
