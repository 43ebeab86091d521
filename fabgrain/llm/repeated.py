"""Which 64-bit hashes of a document occur in other documents too, over all documents.

Hashes travel packed: each task sorts those of a bounded chunk of documents and sends every distinct one once, so a
hash that a third of all documents share costs one entry per chunk. Buckets are ranges of the hash; the low half of a
hash tells those of a bucket apart. Two different hashes may therefore be taken for one (about one in 2**32 per bucket
size): "shared" is never missed, and callers decide exactly later on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabgrain.llm.common import record, shuffle_partitions, strings

CHUNK_HASHES = 1 << 20
CHUNK_DOCS = 60_000
#: Hashes that a bucket gathers, about.
BUCKET_BYTES = 1 << 26

Extract = Callable[[str], tuple[np.ndarray, int, str]]

_ROWS = [("bucket", pa.int32(), "int"), ("chunk", pa.int64(), "bigint"), ("marks", pa.binary(), "binary"), ("owners", pa.binary(), "binary"),
         ("several", pa.binary(), "binary"), ("keys", pa.list_(pa.int64()), "array<bigint>"), ("sizes", pa.list_(pa.int64()), "array<bigint>"),
         ("notes", pa.list_(pa.string()), "array<string>"), ("often", pa.binary(), "binary")]
_ANSWER = ["chunk", "marks", "owners", "keys", "sizes", "notes", "often"]


def _slices(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers present among sorted hashes, and where each begins (with an end)."""
    of = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    numbers, begin = np.unique(of, return_index=True)
    return numbers.astype(np.int64), np.append(begin, len(hashes))


def _send(chunk: int, hashes: list[np.ndarray], table: list[tuple], buckets: int, schema: pa.Schema, listed: bool, counted: bool) -> pa.RecordBatch:
    """Rows of one chunk: a slice per bucket, and one row with its documents and what is shared within the chunk."""
    all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(hashes), dtype=np.uint16), [len(h) for h in hashes])
    order = np.argsort(all_hashes, kind="stable")
    all_hashes, owner = all_hashes[order], owner[order]
    first = np.ones(len(all_hashes), bool)
    first[1:] = all_hashes[1:] != all_hashes[:-1]
    alone = first & np.append(first[1:], True)
    width = np.uint64 if listed else np.uint32
    single, single_owner, several = all_hashes[alone], owner[alone], all_hashes[first & ~alone]
    times = _packed(np.diff(np.flatnonzero(np.append(first, True)))[~alone[first]])
    rows: list[tuple] = []
    parts: dict[int, list[bytes]] = {}
    for numbers, begin, values, place in ((*_slices(single, buckets), single, 0), (*_slices(several, buckets), several, 2)):
        for i, n in enumerate(numbers.tolist()):
            cut = slice(begin[i], begin[i + 1])
            slot = parts.setdefault(n, [b"", b"", b"", b""])
            slot[place] = values[cut].astype(width).tobytes()
            if place == 0:
                slot[1] = single_owner[cut].tobytes()
            elif counted:
                slot[3] = times[cut].tobytes()
    rows += [(n, chunk, *data[:3], None, None, None, data[3]) for n, data in parts.items()]
    keys, sizes, notes = zip(*table, strict=True)
    rows.append((chunk % buckets, chunk, all_hashes[~alone].astype(width).tobytes() if listed else b"", owner[~alone].tobytes(), b"", keys, sizes, notes, None))
    return record(schema, list(zip(*rows, strict=True)))


def _in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values if len(sorted_set) else np.zeros(len(values), bool)


def _packed(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits, higher ones as the highest."""
    return np.minimum(counts, np.iinfo(np.uint16).max).astype(np.uint16)


def shared(docs: DataFrame, extract: Extract, listed: bool = False, counted: bool = False) -> DataFrame:
    """Per row of ``docs`` (columns ``key`` bigint and ``text``): ``key``, ``size``, ``note``, ``shared``, ``marks`` and ``often``.

    ``extract`` gives a text's distinct hashes, a number and a note. ``shared`` counts the hashes that occur in other
    rows too; ``marks`` holds them as packed 64-bit integers if ``listed``, else it is null; ``often``, of those listed, in how
    many rows each occurs, as packed 16-bit integers, if ``counted``. The rows must come in the same order whenever they
    are read, as they do from files.
    """
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * shuffle_partitions(docs.sparkSession), -(-n_bytes // (BUCKET_BYTES // 4)))  # of two bytes of text, one hash of 8 at most
    width = np.uint64 if listed else np.uint32
    schema = pa.schema([(n, t) for n, t, _ in _ROWS])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        hashes: list[np.ndarray] = []
        table: list[tuple] = []
        held = 0
        for b in batches:
            for s in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                for key, text in zip(s.column("key").to_pylist(), strings(s.column("text")), strict=True):
                    h, size, note = extract(text)
                    hashes.append(h)
                    table.append((key, size, note))
                    held += len(h)
                    if held >= CHUNK_HASHES or len(table) >= CHUNK_DOCS:
                        yield _send(chunk, hashes, table, buckets, schema, listed, counted)
                        hashes, table, held, chunk = [], [], 0, chunk + 1
        if table:
            yield _send(chunk, hashes, table, buckets, schema, listed, counted)

    def match(group: pa.Table) -> pa.Table:
        slices = group.filter(pa.compute.is_null(group.column("keys")))
        marks = [np.frombuffer(m, width) for m in slices.column("marks").to_pylist()]
        several = [np.frombuffer(m, width) for m in slices.column("several").to_pylist()]
        values, counts = np.unique(np.concatenate([*marks, *several, *several, np.zeros(0, width)]), return_counts=True)
        values, counts = values[counts > 1], counts[counts > 1]
        if counted:  # a chunk's own count instead of two
            for s, n in zip(several, slices.column("often").to_pylist(), strict=True):
                counts[np.searchsorted(values, s)] += np.frombuffer(n, np.uint16).astype(np.int64) - 2
        rows = []
        for chunk, m, o, s in zip(slices.column("chunk").to_pylist(), marks, slices.column("owners").to_pylist(), several, strict=True):
            hit = _in(m, values)
            if hit.any():
                rows.append((chunk, m[hit].tobytes() if listed else b"", np.frombuffer(o, np.uint16)[hit].tobytes(), None, None, None,
                             _packed(counts[np.searchsorted(values, m[hit])]).tobytes() if counted else None))
            if counted and len(s):  # without owners: the chunk knows them, but not how often other chunks have them
                rows.append((chunk, s.tobytes(), None, None, None, None, _packed(counts[np.searchsorted(values, s)]).tobytes()))
        types = [schema.field(n).type for n in _ANSWER]
        found = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=_ANSWER)
        return pa.concat_tables([found, group.filter(pa.compute.is_valid(group.column("keys"))).select(_ANSWER)])

    def answer(group: pa.Table) -> pa.Table:
        docs_row = group.filter(pa.compute.is_valid(group.column("keys")))
        keys, sizes, notes = (docs_row.column(n)[0].as_py() for n in ("keys", "sizes", "notes"))
        told = group.filter(pa.compute.is_null(group.column("owners")))
        owned = group.filter(pa.compute.and_(pa.compute.is_null(group.column("keys")), pa.compute.is_valid(group.column("owners"))))
        group = pa.concat_tables([owned, docs_row])
        owner = np.concatenate([np.frombuffer(o, np.uint16) for o in group.column("owners").to_pylist()])
        counts = np.bincount(owner, minlength=len(keys))
        marks: list[bytes | None] = [None] * len(keys)
        often: list[bytes | None] = [None] * len(keys)
        if listed:
            own = [np.frombuffer(m, np.uint64) for m in group.column("marks").to_pylist()]
            by_owner, ends = np.argsort(owner, kind="stable"), np.cumsum(counts)
            per_row = lambda x: [x[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            marks = per_row(np.concatenate(own)[by_owner])
        if counted:
            joined = lambda column, kind: np.concatenate([*(np.frombuffer(x, kind) for x in column.to_pylist()), np.zeros(0, kind)])
            several, times = joined(told.column("marks"), np.uint64), joined(told.column("often"), np.uint16)
            order = np.argsort(several)
            within = times[order][np.searchsorted(several[order], own[-1])]
            often = per_row(np.concatenate([joined(owned.column("often"), np.uint16), within])[by_owner])
        return pa.table({"key": pa.array(keys, pa.int64()), "size": pa.array(sizes, pa.int64()), "note": pa.array(notes, pa.string()),
                         "shared": pa.array(counts, pa.int64()), "marks": pa.array(marks, pa.binary()), "often": pa.array(often, pa.binary())})

    fields = {n: d for n, _, d in _ROWS}
    sent = docs.select("key", "text").mapInArrow(send, ", ".join(f"{n} {d}" for n, d in fields.items()))
    found = sent.groupBy("bucket").applyInArrow(match, ", ".join(f"{n} {fields[n]}" for n in _ANSWER))
    return found.groupBy("chunk").applyInArrow(answer, "key bigint, size bigint, note string, shared bigint, marks binary, often binary")


def keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
