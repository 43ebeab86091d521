"""Token ids on disk: raw payload shards and a minimal perfect hash index from document key to place.

A store is a folder with
  shards/   one binary file per shard: header, keys and lengths, raw ids of its documents, one closing byte
  index/    one binary file per bucket of keys: header, displacements, slots (fingerprint, shard, offset, length), closing byte
  directory/ and starts/   tables: each document's place, and the ids in all shards before each shard
A key's hash chooses its bucket file, a displacement and then a slot, so one read of a few bytes each finds any document.
Files are written and read by Spark, on any file system that it reaches.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabgrain.llm import pieces
from fabgrain.llm.common import record, shuffle_partitions, strings
from fabgrain.session import durable

SHARD_IDS = 4 << 20
KEYS_PER_BUCKET = 20_000
#: The last byte of every file. Spark's text writer ends each row with it, which is how binary rows become files.
CLOSING = "\n"

SHARD_HEAD = "<8sQQQQ"  # magic, shard number, documents, ids, bytes per id
SHARD_MAGIC = b"IDSHARD1"
INDEX_HEAD = "<8sQQQ"  # magic, bucket, keys, seed
INDEX_MAGIC = b"IDINDEX1"
SLOT = np.dtype([("mark", "<u4"), ("shard", "<u8"), ("offset", "<u8"), ("length", "<u8")])


# -- minimal perfect hash ------------------------------------------------------------------------------------------

def key_hash(key: bytes, seed: int) -> tuple[int, int]:
    """Two independent 64-bit hashes of a key."""
    h = xxhash.xxh3_128_intdigest(key, seed)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def slot_of(h: tuple[int, int], displacements: np.ndarray, n: int) -> int:
    d = int(displacements[h[0] % len(displacements)])
    return -d - 1 if d < 0 else (h[1] + d // n * (h[0] >> 20) + d % n) % n


def build_slots(keys: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Seed, displacements and the slot of each key: a bijection from distinct ``keys`` onto 0 .. n-1.

    Keys fall into groups of about four. From large groups to small, the first displacement is taken that sends all
    keys of the group to free slots; a group of one names its slot directly, as a negative number.
    """
    n = len(keys)
    for seed in range(1000):
        hashes = [key_hash(k, seed) for k in keys]
        if len(set(hashes)) < n:
            if len(set(keys)) < n:
                raise ValueError("keys must be distinct")
            continue
        groups: list[list[int]] = [[] for _ in range(max(1, n // 4))]
        for i, h in enumerate(hashes):
            groups[h[0] % len(groups)].append(i)
        displacements, slots = np.zeros(len(groups), np.int64), np.full(n, -1, np.int64)
        twice = np.zeros(2 * n, bool)  # taken slots, and the same again, so that a shift is a slice
        for g in sorted((g for g in range(len(groups)) if len(groups[g]) > 1), key=lambda g: -len(groups[g])):
            members = groups[g]
            for turn in range(n):
                at = np.array([(hashes[i][1] + turn * (hashes[i][0] >> 20)) % n for i in members])
                if len(set(at.tolist())) < len(at):
                    continue
                clash = functools.reduce(np.logical_or, (twice[a : a + n] for a in at.tolist()))
                if not clash.all():
                    break
            else:
                break  # this group can't be placed: another seed
            shift = int(np.argmin(clash))  # the first of all n shifts that meets free slots only
            displacements[g] = turn * n + shift
            slots[members] = at = (at + shift) % n
            twice[at] = twice[at + n] = True
        else:
            free = iter(np.flatnonzero(~twice[:n]).tolist())
            for g, members in enumerate(groups):
                if len(members) == 1:
                    slots[members[0]] = at = next(free)
                    displacements[g] = -at - 1
            return seed, displacements, slots
    raise ValueError("no perfect hash found")


def index_bytes(bucket: int, keys: list[bytes], places: list[tuple[int, int, int]]) -> bytes:
    """One index file, without its closing byte."""
    seed, displacements, slots = build_slots(keys)
    out = np.zeros(len(keys), SLOT)
    for key, slot, (shard, offset, length) in zip(keys, slots.tolist(), places, strict=True):
        out[slot] = (xxhash.xxh32_intdigest(key), shard, offset, length)
    return struct.pack(INDEX_HEAD, INDEX_MAGIC, bucket, len(keys), seed) + displacements.astype("<i8").tobytes() + out.tobytes()


class Index:
    """Keyed access to one index file."""

    def __init__(self, data: bytes):
        magic, self.bucket, self.n, self.seed = struct.unpack_from(INDEX_HEAD, data)
        if magic != INDEX_MAGIC:
            raise ValueError("not an index file")
        groups = max(1, self.n // 4)
        self.displacements = np.frombuffer(data, "<i8", groups, struct.calcsize(INDEX_HEAD))
        self.slots = np.frombuffer(data, SLOT, self.n, struct.calcsize(INDEX_HEAD) + 8 * groups)

    def find(self, key: bytes) -> tuple[int, int, int] | None:
        """Shard, offset and length of a key; None when the stored fingerprint is another key's."""
        if not self.n:
            return None
        mark, shard, offset, length = self.slots[slot_of(key_hash(key, self.seed), self.displacements, self.n)].tolist()
        return (shard, offset, length) if mark == xxhash.xxh32_intdigest(key) else None


# -- writing -------------------------------------------------------------------------------------------------------

def _write_files(rows: DataFrame, path: str) -> None:
    """Column ``data`` as binary files, one per row, each followed by the closing byte."""
    rows.select(F.col("data").cast("string").alias("value")).write.option("lineSep", CLOSING).option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def shard_bytes_of(shard: int, keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One shard file, without its closing byte: header, then per document null flag, key and length, then all ids."""
    payload = np.concatenate(ids).astype(f"<u{width}") if ids else np.zeros(0, f"<u{width}")
    head = struct.pack(SHARD_HEAD, SHARD_MAGIC, shard, len(keys), len(payload), width)
    nulls = np.array([k is None for k in keys], np.uint8).tobytes()
    return (head + nulls + np.array([k or 0 for k in keys], "<i8").tobytes()
            + np.array([len(x) for x in ids], "<u8").tobytes() + payload.tobytes())


class Shard:
    """One shard file: its documents' keys and lengths, and its ids by offset."""

    def __init__(self, data: bytes):
        magic, self.number, n, tokens, width = struct.unpack_from(SHARD_HEAD, data)
        if magic != SHARD_MAGIC:
            raise ValueError("not a shard file")
        at = struct.calcsize(SHARD_HEAD)
        nulls, at = data[at : at + n], at + n
        keys, at = np.frombuffer(data, "<i8", n, at).tolist(), at + 8 * n
        self.keys = [None if z else k for z, k in zip(nulls, keys, strict=True)]
        self.lengths, at = np.frombuffer(data, "<u8", n, at).astype(np.int64), at + 8 * n
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.ids = np.frombuffer(data, f"<u{width}", tokens, at)

    def read(self, offset: int, length: int) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.ids[offset : offset + length].astype("<u4").tobytes()


def write(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int, key: str = "doc_id", text: str = "text",
          shard_ids: int = SHARD_IDS, width: int = 2) -> None:
    """Encode every whole text, append ``end_id``, and write shards in ascending key order, then the index.

    ``pattern`` is what the tokenizer splits text by, after folding case and before dropping white space. A null or empty text has just the end id; a null key comes first; rows that repeat a key lie next to each other.
    ``width`` is the bytes per stored id, 2 or 4; an id that does not fit is an error.
    """
    spark = docs.sparkSession
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn(
        "part", F.spark_partition_id())
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("data", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.load(tokenizer_path, pattern, folds=True)
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = number = part = 0

        def full() -> pa.RecordBatch:
            return record(schema, [[shard_bytes_of(part << 32 | number, keys, held, width)]])

        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            for s in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                for k, packed in zip(s.column(0).to_pylist(), encoder.packed(strings(s.column(1))), strict=True):
                    ids = np.frombuffer(packed + end, "<u4")
                    if width == 2:
                        if ids.max() > 0xFFFF:
                            raise ValueError("an id does not fit in 2 bytes")
                        ids = ids.astype("<u2")
                    if held and size + len(ids) > shard_ids:
                        yield full()
                        keys, held, size, number = [], [], 0, number + 1
                    keys.append(k)
                    held.append(ids)
                    size += len(ids)
        if held:
            yield full()

    _write_files(ordered.mapInArrow(encode, "data binary"), f"{path}/shards")
    _write_index(spark, path)


def payload(spark: SparkSession, path: str, sums: bool = True) -> DataFrame:
    """Per document, as the shards have it: ``key``, ``shard``, ``offset``, ``length`` and, with ``sums``, the checksum of its ids."""
    kinds = [("key", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())] + [("ids_crc32", pa.int64())] * sums
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                s = Shard(data.as_py())
                columns = [s.keys, [s.number] * len(s.keys), s.offsets, s.lengths]
                if sums:
                    columns.append([zlib.crc32(s.read(o, n)) for o, n in zip(s.offsets.tolist(), s.lengths.tolist(), strict=True)])
                yield record(schema, columns)

    return _files(spark, f"{path}/shards").mapInArrow(run, ", ".join(f"{n} bigint" for n in schema.names))


def _named(rows: DataFrame, buckets: int) -> DataFrame:
    """With ``name``, a row's key in the index (its id, and which of the rows with that id it is), and ``bucket``."""
    name = F.concat_ws("/", F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("ordinal").cast("string"))
    return rows.withColumn("name", name).withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int"))


def _write_index(spark: SparkSession, path: str) -> None:
    """Read the shards back, note what they hold, and index it."""
    payload(spark, path, sums=False).write.parquet(f"{path}/directory")
    rows = spark.read.parquet(f"{path}/directory")
    # Shards are numbered within the range of keys they were written from, so their starts add up within a range, and ranges
    # among each other: one row per range.
    shards = durable(rows.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("length").alias("tokens")).withColumn("part", F.shiftright("shard", 32)))
    upto = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", upto(Window.orderBy("part")).alias("before"))
    inside = shards.withColumn("inside", upto(Window.partitionBy("part").orderBy("shard")))
    inside.join(parts, "part").select("shard", "documents", "tokens", (F.col("before") + F.col("inside")).alias("start")).write.parquet(f"{path}/starts")

    # Only keys that occur again need numbering; their rows are spread by key.
    again = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"))
    same = F.col("key").eqNullSafe(F.col("k"))
    numbered = rows.join(again, same, "left_anti").withColumn("ordinal", F.lit(0).cast("long")).unionByName(
        rows.join(again, same, "left_semi").withColumn(
            "ordinal", (F.row_number().over(Window.partitionBy("key").orderBy("shard", "offset")) - 1).cast("long")))
    buckets = max(1, -(-rows.count() // KEYS_PER_BUCKET))

    def build(group: pa.Table) -> pa.Table:
        g = group.to_pydict()
        data = index_bytes(g["bucket"][0], [x.encode() for x in g["name"]], list(zip(g["shard"], g["offset"], g["length"], strict=True)))
        return pa.table({"data": pa.array([data], pa.binary())})

    _write_files(_named(numbered, buckets).groupBy("bucket").applyInArrow(build, "data binary"), f"{path}/index")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/buckets")


# -- reading -------------------------------------------------------------------------------------------------------

def lookup(spark: SparkSession, path: str, keys: DataFrame, all_there: bool = False) -> DataFrame:
    """``keys`` (columns ``key``, ``ordinal``) with ``shard``, ``offset`` and ``length``, found through the index.

    A key that is not in the store gives no row, but for one in 2**32 whose fingerprint agrees by chance; with
    ``all_there`` it stops the query.
    """
    rows = spark.read.parquet(f"{path}/buckets").head()
    if rows is None:
        raise ValueError(f"no store at {path}")
    schema = pa.schema([(c, pa.int64()) for c in ("key", "ordinal", "shard", "offset", "length")])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([struct.unpack_from(INDEX_HEAD, d.as_buffer())[1] for d in b.column(0)], pa.int32()), b.column(0)], names=["bucket", "content"])

    def find(wanted: pa.Table, index: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if all_there and wanted.num_rows and not index.num_rows:
            raise ValueError(f"no index file for bucket {wanted.column('bucket')[0]}")
        if index.num_rows and wanted.num_rows:
            found = Index(index.column("content")[0].as_py())
            for k, o, name in zip(*(wanted.column(c).to_pylist() for c in ("key", "ordinal", "name")), strict=True):
                if place := found.find(name.encode()):
                    out.append((k, o, *place))
                elif all_there:
                    raise ValueError(f"the index does not know document {name}")
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], schema=schema)

    files = _files(spark, f"{path}/index").mapInArrow(heads, "bucket int, content binary")
    wanted = _named(keys.select(F.col("key").cast("long").alias("key"), F.col("ordinal").cast("long").alias("ordinal")), rows["buckets"])
    return wanted.groupBy("bucket").cogroup(files.groupBy("bucket")).applyInArrow(
        find, "key bigint, ordinal bigint, shard bigint, offset bigint, length bigint")


def fetch(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The raw ``ids`` at ``places`` (as from ``lookup``), as 32-bit integers; one shard and its places per group."""
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([struct.unpack_from(SHARD_HEAD, d.as_buffer())[1] for d in b.column(0)], pa.int64()), b.column(0)], names=["shard", "content"])

    def cut(wanted: pa.Table, shard: pa.Table) -> pa.Table:
        ids = []
        if shard.num_rows and wanted.num_rows:
            s = Shard(shard.column("content")[0].as_py())
            ids = [s.read(o, n) for o, n in zip(wanted.column("offset").to_pylist(), wanted.column("length").to_pylist(), strict=True)]
        names = ["key", "ordinal", "shard", "offset", "length"]
        kept = wanted.select(names) if len(ids) == wanted.num_rows else wanted.select(names).slice(0, 0)
        return kept.append_column("ids", pa.array(ids, pa.binary()))

    files = _files(spark, f"{path}/shards").mapInArrow(heads, "shard bigint, content binary")
    return places.groupBy("shard").cogroup(files.groupBy("shard")).applyInArrow(
        cut, "key bigint, ordinal bigint, shard bigint, offset bigint, length bigint, ids binary")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document: ``key``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``.

    Each document that the shards' headers name goes through the index, and the ids at the place found there are read and
    summed. A document that the index misses, or a place that does not hold it, stops the query.
    """
    named = spark.read.parquet(f"{path}/directory")  # as the shards' headers told when the index was made
    places = named.groupBy("key").agg(F.count("*").alias("n")).select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal"))
    found = lookup(spark, path, places, all_there=True)
    held = payload(spark, path).withColumnRenamed("key", "held")
    starts = spark.read.parquet(f"{path}/starts").select("shard", F.col("start").alias("shard_start"))
    right = F.col("ids_crc32").isNotNull() & F.col("held").eqNullSafe(F.col("key"))
    wrong = F.raise_error(F.concat(F.lit("the index gives a wrong place for document "), F.coalesce(F.col("key").cast("string"), F.lit("null"))))
    return (
        found.join(held, ["shard", "offset", "length"], "left").join(starts, "shard", "left")
        .select("key", (F.col("shard_start") + F.col("offset")).alias("start"), F.col("length").alias("n_tokens"),
                F.when(right, F.col("ids_crc32")).otherwise(wrong.cast("long")).alias("ids_crc32"))
    )
