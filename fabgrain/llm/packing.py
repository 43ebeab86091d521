"""Documents cut and packed into sequences of fixed length, with a certified bound on the number of sequences."""

from __future__ import annotations

import functools
import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabgrain.llm import pieces
from fabgrain.llm.common import strings
from fabgrain.session import durable

#: Pieces that one partition packs; large enough that the rounding of each partition's bound hardly counts.
PER_PARTITION = 50_000

log = logging.getLogger(__name__)


def cut(docs: DataFrame, tokenizer_path: str, pattern: str, room: int, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``room`` tokens: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, and ``ids`` as 32-bit integers.

    ``pattern`` is what the tokenizer splits text by. The ids are followed by ``end_id``. Only longer documents are cut;
    the first piece takes the remainder. Without ``with_ids`` only the checksum of the ids leaves the task.
    """
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    names = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * with_ids]
    end = np.array([end_id], "<u4").tobytes()

    def pieces_of(texts: list[str]) -> Iterator[tuple]:
        for k, ids in enumerate(pieces.load(tokenizer_path, pattern).packed(texts)):
            data = memoryview(ids + end)
            n = len(data) // 4
            borders = [0, *range(n % room or room, n + 1, room)]
            for i, (a, z) in enumerate(zip(borders, borders[1:], strict=False)):
                part = data[4 * a : 4 * z]
                yield (k, i, a, z - a, zlib.crc32(part), *[bytes(part)] * with_ids)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for part in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                source, *columns = zip(*pieces_of(strings(part.column(1))), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(source, pa.int64())), *map(pa.array, columns, types)], names=["key", *names])

    return keyed.mapInArrow(run, f"key {kind}, piece int, start bigint, length int, ids_crc32 bigint" + ", ids binary" * with_ids)


def lower_bound(lengths: np.ndarray, room: int) -> int:
    """Fewest bins that any packing needs, by dual feasible functions.

    For a threshold t, items over ``room - t`` count as a whole bin, items under t as nothing, the rest by length; and
    for k, an item counts as floor((k+1) x) / k unless (k+1) x is whole. Each function maps any full bin to at most 1.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=room + 1).astype(np.int64)
    sizes = np.arange(room + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(total[-1]) // room)
    t = np.arange(1, room // 2 + 1)
    large = number[-1] - number[room - t]
    middle = total[room - t] - total[t - 1]
    best = max(best, int((large + -(-middle // room)).max()) if len(t) else 0)
    for k in range(1, 100):
        scaled = (k + 1) * sizes
        weight = np.where(scaled % room == 0, k * sizes, scaled // room * room)  # times k * room
        best = max(best, -(-int((counts * weight).sum()) // (k * room)))
    return best


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: per item its bin and its place there, and per bin the room left."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    free = 0  # bit r is set when some bin has room r left
    left: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = free >> n
        if fitting:
            r = n + ((fitting & -fitting).bit_length() - 1)
            b = by_room[r].pop()
            if not by_room[r]:
                free &= ~(1 << r)
        else:
            r, b = room, len(left)
            left.append(room)
        bins[i], places[i] = b, room - r
        r -= n
        left[b] = r
        if r:
            by_room[r].append(b)
            free |= 1 << r
    return bins, places, np.array(left, np.int64)


def pack(items: DataFrame, room: int, per_partition: int = PER_PARTITION) -> tuple[DataFrame, DataFrame]:
    """``items`` with ``sequence_id`` and ``offset``; its column ``length`` holds 1 to ``room``. Read several times: store it.

    Each partition packs its items best-fit decreasing and computes a lower bound for them. Where the packing meets the
    bound, it is certified optimal and final. The other partitions keep their full bins, exchange the items of the
    rest, and pack again, in as many partitions as those need, until all are certified or a round leaves as many items
    in no fewer bins; then the packing before it stays. Items of full length are sequences of their own.

    The second table has the bounds of all other sequences, as ``partition`` (``sequence_id`` without its low 32 bits),
    ``certified``, ``sequences`` and ``lower_bound``; full bins that a partition kept are a certified row of their own.
    """
    first_id = 1 << 62
    done = [items.where(F.col("length") == room).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(first_id))
            .withColumn("offset", F.lit(0).cast("long"))]
    rest = items.where(F.col("length") < room)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    number, fewest, base = rest.count(), None, 0
    bounds = [items.sparkSession.createDataFrame([], "partition bigint, certified boolean, sequences bigint, lower_bound bigint")]
    held = None

    def bounds_of(packed: DataFrame) -> DataFrame:
        return packed.groupBy(F.shiftright("sequence_id", 32).alias("partition"), (~F.col("_open")).alias("certified")).agg(
            F.count_if(F.col("offset") == 0).alias("sequences"), F.max("_bound").alias("lower_bound"))

    while number:
        shares = max(1, -(-number // per_partition))

        def run(group: pa.Table) -> pa.Table:
            lengths = group.column("length").to_numpy().astype(np.int64)
            order = np.lexsort((group.column("_tie").to_numpy(), lengths))
            group, lengths = group.take(pa.array(order)), lengths[order]
            bins, places, left = best_fit(lengths, room)
            bound = lower_bound(lengths, room)
            open_bins = np.zeros(len(left), bool) if len(left) == bound else left > 0
            is_open = open_bins[bins]
            bound_of = np.where(is_open, lower_bound(lengths[is_open], room), (~open_bins).sum())
            share = base + int(group.column("_share")[0].as_py())
            return (group.append_column("sequence_id", pa.array(bins + (share << 32))).append_column("offset", pa.array(places))
                    .append_column("_open", pa.array(is_open)).append_column("_bound", pa.array(bound_of)))

        dealt = rest.withColumn("_tie", F.xxhash64(*items.columns)).withColumn(
            "_share", F.pmod(F.xxhash64("_tie", F.lit(base)), F.lit(shares)).cast("int"))
        packed = durable(dealt.groupBy("_share").applyInArrow(
            run, fields + ", _tie bigint, _share int, sequence_id bigint, offset bigint, _open boolean, _bound bigint").drop("_tie", "_share"))
        left_over, bins = packed.where("_open").agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if held is not None and left_over == number and bins >= fewest:
            break
        done.append(packed.where("not _open").drop("_open", "_bound"))
        bounds.append(bounds_of(packed.where("not _open")))
        held = packed.where("_open")
        rest = held.drop("_open", "_bound", "sequence_id", "offset")
        number, fewest, base = left_over, bins, base + shares
    if number:
        open_bounds = bounds_of(held)
        n, found, least = open_bounds.agg(F.count("*"), F.sum("sequences"), F.sum("lower_bound")).first()
        log.warning("%d partitions are not certified: %d sequences, lower bound %d", n, found, least)
        done.append(held.drop("_open", "_bound"))
        bounds.append(open_bounds)
    return functools.reduce(DataFrame.unionByName, done), functools.reduce(DataFrame.unionByName, bounds)


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, room: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    A null or empty text is a document of its end id alone. Null keys and repeated rows are packed like any others; an
    empty table gives no rows. Other columns are not looked at.
    """
    items = durable(cut(docs, tokenizer_path, pattern, room, end_id, key, text, with_ids=False))
    return pack(items, room)[0].select(F.col("key").alias(key), "piece", "start", F.col("length").cast("long").alias("length"),
                                    "ids_crc32", "sequence_id", "offset")
