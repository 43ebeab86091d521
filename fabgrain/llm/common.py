"""Small helpers shared by the text operators."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def strings(column) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return ["" if v is None else v for v in column.to_pylist()]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: splitting bytes knows no other white space."""
    return text.encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any of their bits can choose a bucket."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIER = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    up, down = np.full(size, MULTIPLIER, np.uint64), np.full(size, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of ``k`` consecutive word hashes; empty when there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(10, int(len(hashes)).bit_length()))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mixed((total[k:] - total[:n]) * down[:n])


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Collect row tuples into record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield record(schema, list(zip(*held, strict=True)))
            held = []
    if held:
        yield record(schema, list(zip(*held, strict=True)))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``docs`` has no column of it."""
    taken = {c.lower() for c in docs.columns}
    longest = max(map(len, taken), default=0)
    return [n if n.lower() not in taken else n + "_" * longest for n in names]


#: Rows that a task hands to its Python worker at once; whole texts are long, and both sides hold a batch of them.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's batches have at most ``BATCH_ROWS`` rows, instead of the usual 10,000."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(setting))
    spark.conf.set(setting, str(min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
