"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, or a piece of one that is cut where its last bytes hash to a chosen value, so that an edit moves the
cuts near it only. Its digest is added to three cells of a sketch. Two sketches of one size are subtracted cell by cell;
what both texts have goes away, and peeling cells that hold a single digest recovers the others. Where the cells do not
suffice, both sketches are made again, four times as large, until the difference is recovered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fabgrain.llm.common import batches, hashed, mixed, shuffle_partitions, strings, text_or_empty, windows
from fabgrain.session import durable

HASHES = 3
#: Cells per hash of a fingerprint, and how many times as many there are after each failure.
CELLS, GROWTH = 4, 4
#: A long line is cut after about every 32 bytes, by the hash of the last 8.
CUT_BYTES, CUT_SHIFT = 8, 59
SEGMENT = 1 << 20
#: Pairs of texts are worked off together until they have so many digests, or are so many.
MOST_DIGESTS, MOST_PAIRS = 1 << 18, 512


def paragraphs(data: bytes) -> list[bytes]:
    """Lines with their ends, and the pieces of long ones; together they are the text."""
    cuts = [np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1]
    for at in range(0, len(data), SEGMENT):  # whether there is a cut depends on the last bytes alone
        begin = max(0, at - CUT_BYTES + 1)
        marks = windows(np.frombuffer(data[begin : at + SEGMENT], np.uint8).astype(np.uint64), CUT_BYTES)
        cuts.append(np.flatnonzero(marks >> np.uint64(CUT_SHIFT) == 0) + begin + CUT_BYTES)
    ends = np.union1d(np.concatenate(cuts), [len(data)]).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False) if b > a]


def digests(text: str) -> np.ndarray:
    """A 64-bit digest per paragraph; a paragraph that occurs again has another one each time, so all differ."""
    keys = hashed(paragraphs(text.encode("utf-8", "surrogatepass")))
    order = np.argsort(keys, kind="stable")
    runs = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, np.int64)
    number = np.arange(len(keys)) - np.repeat(runs, np.diff(np.r_[runs, len(keys)]))
    return mixed(keys[order] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Sketches(NamedTuple):
    """Cells of several sketches of one size, one sketch per row."""

    number: np.ndarray  # digests in a cell
    digest: np.ndarray  # their sum modulo 2**64
    check: np.ndarray  # the sum of their check values modulo 2**32

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(*(a - b for a, b in zip(self, other, strict=True)))


def check_of(keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ np.uint64(0xD6E8FEB86659FD93)).astype(np.uint32)


def cells_of(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """The cell of each digest per hash; another size has other hashes."""
    return [(mixed(keys + np.uint64((size * HASHES + j) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(16)) % np.uint64(size) + np.uint64(j * size)
            for j in range(HASHES)]


def _add(flat: Sketches, owner: np.ndarray, keys: np.ndarray, signs: np.ndarray, size: int) -> None:
    for cell in cells_of(keys, size):
        at = owner * (HASHES * size) + cell.astype(np.int64)
        np.add.at(flat.number, at, signs)
        np.add.at(flat.digest, at, keys * signs.astype(np.uint64))
        np.add.at(flat.check, at, check_of(keys) * signs.astype(np.uint32))


def sketch(sets: Sequence[np.ndarray], size: int) -> Sketches:
    """One sketch per set of digests, of ``HASHES`` times ``size`` cells."""
    n = len(sets) * HASHES * size
    flat = Sketches(np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint32))
    keys = np.concatenate([np.zeros(0, np.uint64), *sets])
    _add(flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), keys, np.ones(len(keys), np.int64), size)
    return Sketches(*(c.reshape(len(sets), HASHES * size) for c in flat))


class Difference(NamedTuple):
    done: np.ndarray  # per pair of sketches: whether all was recovered
    owner: np.ndarray  # per recovered digest: its pair, itself, and 1 if the first text has it, -1 if the second
    digest: np.ndarray
    sign: np.ndarray


def peel(difference: Sketches) -> Difference:
    """Recover the digests of subtracted sketches, all pairs at once. A cell that holds one digest gives it away, it is
    taken out of its other cells, and so on; a pair is done when nothing is left.
    """
    rows, width = difference.number.shape
    size = width // HASHES
    flat = Sketches(*(c.ravel().copy() for c in difference))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(np.abs(flat.number) == 1)
    for _ in range(rows * width):
        sign = flat.number[look]
        key = flat.digest[look] * sign.astype(np.uint64)
        pure = (np.abs(sign) == 1) & (flat.check[look] == check_of(key) * sign.astype(np.uint32))
        owner, key, sign = look[pure] // width, key[pure], sign[pure]
        if not len(key):
            break
        order = np.lexsort((key, owner))
        owner, key, sign = owner[order], key[order], sign[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        owner, key, sign = owner[once], key[once], sign[once]
        found.append((owner, key, sign))
        _add(flat, owner, key, -sign, size)
        touched = np.concatenate([owner * width + c.astype(np.int64) for c in cells_of(key, size)])
        look = np.unique(touched[np.abs(flat.number[touched]) == 1])
    left = (flat.number != 0) | (flat.digest != 0) | (flat.check != 0)
    done = ~left.reshape(rows, width).any(axis=1)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    owner, key, sign = (np.concatenate(c) for c in zip(none, *found, strict=True))
    return Difference(done, owner, key, sign)


def differing(pairs: Sequence[tuple[np.ndarray, np.ndarray]], size: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pair of sets, the digests of the first alone and of the second alone."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 2] * len(pairs)
    todo = list(range(len(pairs)))
    while todo:
        got = peel(sketch([pairs[i][0] for i in todo], size).minus(sketch([pairs[i][1] for i in todo], size)))
        order = np.argsort(got.owner, kind="stable")
        ends = np.searchsorted(got.owner[order], np.arange(len(todo) + 1))
        for k in np.flatnonzero(got.done):
            own = order[ends[k] : ends[k + 1]]
            out[todo[k]] = got.digest[own[got.sign[own] > 0]], got.digest[own[got.sign[own] < 0]]
        todo = [i for i, done in zip(todo, got.done, strict=True) if not done]
        size *= GROWTH
    return out


def likeness(n: int, m: int, first_alone: int, second_alone: int) -> float:
    """Shared paragraphs among all of two texts with ``n`` and ``m``; 1 for two empty ones."""
    return 1.0 if n + m == 0 else (n - first_alone) / (n + second_alone)


def encoded(s: Sketches, n: np.ndarray) -> list[bytes]:
    """Sketches as bytes: paragraphs of the text, then the numbers, digests and check values of all cells."""
    columns = [np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(len(n), -1) for c, t in ((n.reshape(-1, 1), "<u4"), (s.number, "<u4"), (s.digest, "<u8"), (s.check, "<u4"))]
    return [row.tobytes() for row in np.concatenate(columns, axis=1)]


def decoded(fingerprint: str) -> tuple[int, Sketches]:
    """Number of paragraphs and the sketch of a fingerprint as :func:`fingerprints` writes it."""
    data = base64.b64decode(fingerprint)
    cells = (len(data) - 4) // 16
    n, numbers, keys, checks = (np.frombuffer(data[a:b], t) for a, b, t in ((0, 4, "<u4"), (4, 4 + 4 * cells, "<u4"), (4 + 4 * cells, 4 + 12 * cells, "<u8"), (4 + 12 * cells, len(data), "<u4")))
    return int(n[0]), Sketches(numbers.astype(np.int64)[None], keys.astype(np.uint64)[None], checks.astype(np.uint32)[None])


def likeness_of(a: str, b: str) -> float | None:
    """Likeness of two stored fingerprints; None where their cells do not suffice, and the texts are needed."""
    (n, x), (m, y) = decoded(a), decoded(b)
    got = peel(x.minus(y))
    return likeness(n, m, int((got.sign > 0).sum()), int((got.sign < 0).sum())) if got.done[0] else None


# -- with Spark ----------------------------------------------------------------------------------------------------

class Version(NamedTuple):
    key: object
    text: str
    keys: np.ndarray


def version(key, text: str) -> Version:
    return Version(key, text, digests(text))


def edited(text: str, after: str) -> str:
    """The last half of the text replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


RESULT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
          ("near_edited", pa.float64()), ("near_next", pa.float64())]


def compared(pairs: list[tuple[Version, Version]]) -> list[tuple]:
    """Per text and its next one: the columns of ``RESULT``."""
    texts = [edited(a.text, b.text) for a, b in pairs]
    sets = [digests(t) for t in texts]
    own = encoded(sketch([a.keys for a, _ in pairs], CELLS), np.array([len(a.keys) for a, _ in pairs]))
    other = encoded(sketch(sets, CELLS), np.array([len(s) for s in sets]))
    apart = differing([(a.keys, s) for (a, _), s in zip(pairs, sets, strict=True)] + [(a.keys, b.keys) for a, b in pairs])
    near = [likeness(len(x), len(y), len(p), len(q)) for (x, y), (p, q) in
            zip([(a.keys, s) for (a, _), s in zip(pairs, sets, strict=True)] + [(a.keys, b.keys) for a, b in pairs], apart, strict=True)]
    return [(len(a.text), hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), f, g, u, v) for (a, _), t, f, g, u, v in
            zip(pairs, texts, own, other, near[: len(pairs)], near[len(pairs) :], strict=True)]


def _worked_off(pairs: Iterator[tuple[Version, Version]]) -> Iterator[tuple]:
    """Key and result of each pair, many pairs at a time."""
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0].keys) * 2 + len(pair[1].keys)
        if size >= MOST_DIGESTS or len(held) >= MOST_PAIRS:
            yield from ((p[0].key, *r) for p, r in zip(held, compared(held), strict=True))
            held, size = [], 0
    if held:
        yield from ((p[0].key, *r) for p, r in zip(held, compared(held), strict=True))


def _next_part(spark: SparkSession, ends: DataFrame) -> DataFrame:
    """Which range follows which, empty ones left out; after the last comes the first. A number per range is collected."""
    parts = sorted(r["part"] for r in ends.where("place = 'first'").select("part").collect())
    return spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``.

    The edited text has its last half replaced by the start of the next document, by descending key; after the last comes the
    first. A likeness is the share of paragraphs that both texts have, from the digests recovered by peeling. A null text counts
    as empty, a null key as the smallest; rows with one key are ordered by a hash of their texts. A single document is its
    own next. Other columns are not looked at, and an empty table gives an empty result.

    Texts move once, into ranges of keys. Each range is read in order, holding two texts; its first and last rows are
    stored, and the last one of each meets the first one of the next range by a join.
    """
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumns({"tie": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    order = [F.col("key").desc_nulls_last(), F.col("tie"), F.col("spread")]
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "key", "text")
    kind = rows.schema["key"].dataType
    result = [("key", to_arrow_type(kind)), *RESULT]
    names = f"key {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    schema = pa.schema([("part", pa.int32()), ("place", pa.string()), *result, ("text", pa.string())])

    def in_order(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None,) * len(RESULT)
        ends: list[tuple] = []

        def pairs() -> Iterator[tuple[Version, Version]]:
            last, part = None, None
            for b in parts:
                for part, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strings(b.column(2)), strict=True):
                    now = version(k, t)
                    if last is None:
                        ends.append((part, "first", k, *none, t))
                    else:
                        yield last, now
                    last = now
            if last is not None:
                ends.append((part, "last", last.key, *none, last.text))

        yield from batches(schema, ((None, "pair", *r, None) for r in _worked_off(pairs())))
        yield from batches(schema, iter(ends))

    def across(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[Version, Version]]:
            for b in parts:
                for k, t, after in zip(b.column(0).to_pylist(), strings(b.column(1)), strings(b.column(2)), strict=True):
                    yield version(k, t), version(None, after)

        yield from batches(pa.schema(result), _worked_off(pairs()))

    stored = durable(ranged.mapInArrow(in_order, f"part int, place string, {names}, text string"))
    ends = stored.where("place <> 'pair'").select("part", "place", "key", "text")
    heads = ends.where("place = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next"))
    met = ends.where("place = 'last'").join(_next_part(docs.sparkSession, ends), "part").join(heads, "after").select("key", "text", "next")
    both = stored.where("place = 'pair'").select("key", *[c for c, _ in RESULT]).unionByName(met.mapInArrow(across, names))
    return both.select(F.col("key").alias(key), "n_chars", "edited_sha256", F.base64("fingerprint").alias("fingerprint"),
                       F.base64("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
