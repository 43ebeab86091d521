"""Exact duplicates by composable polynomial fingerprints, confirmed by streaming comparison."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabgrain.llm import pieces as encoders
from fabgrain.llm.common import free_names, record, strings, text_or_empty
from fabgrain.session import durable

CHUNK = 1 << 16
#: Texts with more bytes are cut into pieces of this size that different tasks hash.
PIECE = 1 << 23
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_277_803_951, 938_215_177)
FP = ["n_bytes", "h1", "h2"]


class Fingerprint(NamedTuple):
    n_bytes: int
    h1: int
    h2: int


EMPTY = Fingerprint(0, 0, 0)


@functools.lru_cache(maxsize=2)
def _powers(i: int) -> np.ndarray:
    """Falling powers of the base, for one chunk."""
    out, p = np.empty(CHUNK, np.uint64), 1
    for k in range(CHUNK - 1, -1, -1):
        out[k], p = p, p * BASES[i] % MODULI[i]
    return out


def of_chunk(data: bytes) -> Fingerprint:
    """Polynomial over the bytes plus one, modulo two primes; at most ``CHUNK`` bytes, so that sums stay below 2**56."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(values)
    return Fingerprint(n, *(int(np.dot(values, _powers(i)[CHUNK - n :])) % MODULI[i] for i in (0, 1)))


def combined(a: Fingerprint, b: Fingerprint) -> Fingerprint:
    """Fingerprint of two neighbours: the left one is shifted by the length of the right one."""
    return Fingerprint(a.n_bytes + b.n_bytes, *((x * pow(BASES[i], b.n_bytes, MODULI[i]) + y) % MODULI[i]
                                                for i, (x, y) in enumerate(((a.h1, b.h1), (a.h2, b.h2)))))


def fingerprint(data: bytes) -> Fingerprint:
    return functools.reduce(combined, (of_chunk(data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)), EMPTY)


def fingerprints(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """Columns ``key``, ``text_sha256`` and the fingerprint, for a frame with columns ``key`` and ``text`` (not null).

    Texts of more than ``piece`` bytes are cut; their pieces are dealt to all tasks, hashed there, shifted by the bytes
    that follow, and added up.
    """
    kind = docs.schema["key"].dataType.simpleString()
    docs = docs.withColumn("text_sha256", F.sha2(F.encode("text", "utf-8"), 256))
    size = F.octet_length("text")

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders.forget()
        for b in parts:
            marks = [fingerprint(t.encode("utf-8", "surrogatepass")) for t in strings(b.column("text"))]
            cols = [pa.array(c, pa.int64()) for c in zip(*marks, strict=True)] if marks else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text_sha256"), *cols], names=["key", "text_sha256", *FP])

    def part(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for data, after in zip(b.column("piece").to_pylist(), b.column("after").to_pylist(), strict=True):
                f = fingerprint(data)
                rows.append((f.n_bytes, f.h1 * pow(BASES[0], after, MODULI[0]) % MODULI[0], f.h2 * pow(BASES[1], after, MODULI[1]) % MODULI[1]))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), b.column("text_sha256"), *cols],
                                             names=["row", "key", "text_sha256", *FP])

    small = docs.where(size <= piece).mapInArrow(whole, f"key {kind}, text_sha256 string, n_bytes bigint, h1 bigint, h2 bigint")
    pieces = (
        docs.where(size > piece)
        .select(F.monotonically_increasing_id().alias("row"), "key", "text_sha256", F.encode("text", "utf-8").alias("data"))
        .select("row", "key", "text_sha256", F.explode(F.transform(
            F.sequence(F.lit(0), F.floor((F.length("data") - 1) / piece).cast("int")),
            lambda i: F.struct(F.col("data").substr(i * piece + 1, F.lit(piece)).alias("piece"),
                               F.greatest(F.lit(0), F.length("data") - (i + 1) * piece).cast("long").alias("after")))).alias("p"))
        .select("row", "key", "text_sha256", "p.piece", "p.after")
        .repartition("row", "after")
    )
    shifted = pieces.mapInArrow(part, f"row bigint, key {kind}, text_sha256 string, n_bytes bigint, h1 bigint, h2 bigint")
    huge = shifted.groupBy("row", "key", "text_sha256").agg(
        F.sum("n_bytes").alias("n_bytes"), (F.sum("h1") % MODULI[0]).alias("h1"), (F.sum("h2") % MODULI[1]).alias("h2"))
    return small.unionByName(huge.drop("row"))


def same_text(a: str, b: str, chunk: int = CHUNK) -> bool:
    """Chunk by chunk, stopping at the first difference."""
    return len(a) == len(b) and all(a[i : i + chunk] == b[i : i + chunk] for i in range(0, len(a), chunk))


def _classes(key_columns: list[str], schema: pa.Schema):
    """Number the different texts under each key, over rows sorted by key; a text is passed on at its first row only."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders.forget()
        at, held = None, []
        for b in parts:
            keys = list(zip(*(b.column(c).to_pylist() for c in key_columns), strict=True))
            numbers, firsts = [], []
            for key, text in zip(keys, b.column("text").to_pylist(), strict=True):
                if key != at:
                    at, held = key, []
                number = next((i for i, t in enumerate(held) if same_text(t, text)), len(held))
                firsts.append(text if number == len(held) else None)
                if number == len(held):
                    held.append(text)
                numbers.append(number)
            yield record(schema, [*(b.column(c) for c in schema.names[:-2]), numbers, firsts])

    return run


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """Per row: ``key``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; rows with equal texts form a group.

    The row with the largest key stays; of several rows with that key, one. A null text counts as empty, a null key as
    smaller than any other. Other columns are not looked at; an empty table gives an empty result.

    Texts that share a fingerprint are compared in two rounds, each streaming over sorted rows and holding one copy
    of each different text: first within shares of a group (about the square root of its size), then among the shares.
    """
    keyed = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    kind = keyed.schema["key"].dataType
    marks = durable(fingerprints(keyed, piece))
    repeated = durable(marks.groupBy(*FP).agg(F.count("*").alias("n")).where("n > 1"))

    single = marks.join(repeated, FP, "left_anti").select(
        F.col("key").alias(key), F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    # The marks name the suspects' texts by their hash, so the second look at the texts moves those alone.
    suspects = marks.join(repeated, FP).select("key", "text_sha256", *FP, "n").distinct()
    share = F.pmod(F.xxhash64("key"), F.ceil(F.sqrt("n"))).cast("int")
    hashed = keyed.withColumn("text_sha256", F.sha2(F.encode("text", "utf-8"), 256))
    suspect_rows = (
        hashed.join(suspects.withColumnRenamed("key", "k").withColumnRenamed("text_sha256", "sha"),
                    F.col("key").eqNullSafe(F.col("k")) & (F.col("text_sha256") == F.col("sha")))
        .select("key", "text_sha256", *FP, share.alias("share"), "text")
    )
    schema1 = pa.schema([("key", _arrow(kind)), ("text_sha256", pa.string()), *((c, pa.int64()) for c in FP), ("share", pa.int32()),
                         ("number", pa.int32()), ("text", pa.string())])
    first = durable(
        suspect_rows.repartition(*FP, "share").sortWithinPartitions(*FP, "share")
        .mapInArrow(_classes([*FP, "share"], schema1), f"key {kind.simpleString()}, text_sha256 string, n_bytes bigint, h1 bigint, h2 bigint, share int, number int, text string")
    )
    schema2 = pa.schema([*((c, pa.int64()) for c in FP), ("share", pa.int32()), ("number", pa.int32()), ("group", pa.int32()), ("text", pa.string())])
    second = (
        first.where("text is not null").select(*FP, "share", "number", "text").repartition(*FP).sortWithinPartitions(*FP)
        .mapInArrow(_classes(FP, schema2), "n_bytes bigint, h1 bigint, h2 bigint, share int, number int, group int, text string").drop("text")
    )
    # Both sides of the last join are stored, so that Spark can split it where one text has very many copies.
    members = durable(first.drop("text").join(durable(second), [*FP, "share", "number"]))
    sums = durable(members.groupBy(*FP, "group").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size")))
    joined = members.join(sums, [*FP, "group"])
    keepers = joined.where(F.col("key").eqNullSafe(F.col("keep_id"))).withColumn(
        "kept", F.row_number().over(Window.partitionBy(*FP, "group").orderBy("share")) == 1)
    others = joined.where(~F.col("key").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    several = keepers.unionByName(others).select(F.col("key").alias(key), "keep_id", "group_size", "kept", "text_sha256")
    return single.unionByName(several)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns; a group that loses no row is not looked at again."""
    verdicts = groups(docs, key, text)
    own, k, sha = free_names(docs, "_sha0", "_k", "_sha")
    several = verdicts.where("group_size > 1")
    gone = several.where(~F.col("kept")).select(F.col(key).alias(k), F.col("text_sha256").alias(sha)).distinct()
    tied = several.where("kept").select(F.col(key).alias(k), F.col("text_sha256").alias(sha)).join(gone, [k, sha], "left_semi")
    marked = docs.withColumn(own, F.sha2(F.encode(text_or_empty(text), "utf-8"), 256))
    same = F.col(key).eqNullSafe(F.col(k)) & (F.col(own) == F.col(sha))
    rest = marked.join(gone, same, "left_anti").drop(own)
    once = marked.join(tied, same, "left_semi").dropDuplicates([key, own]).drop(own)
    return rest.unionByName(once)
