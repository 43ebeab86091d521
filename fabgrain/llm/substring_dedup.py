"""Long passages that repeat across documents, found on a compacted de Bruijn graph of word windows.

An edge of the graph is a window of consecutive words, from its first words to its last. Edges that follow each other in
a document and share the same anchor (the least hash of the shorter word runs in the window) form a path, which is stored
as one row: its anchor, its edges, its document and its place there. Only paths whose anchor occurs in several documents
are stored. Equal paths collapse to the smallest source coordinate; paths of one anchor that are not equal branch, and
only those are taken apart into edges, by joins on (anchor, edge).

Hashes only propose what repeats. Every span names its source coordinates, and its words must equal the words there, by a
digest, before they go. Documents with a span that does not hold are resolved again by digests of their windows' words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabgrain.llm import repeated
from fabgrain.llm.common import hashed, record, windows, words_of
from fabgrain.session import durable

WINDOW = 50
#: Claims on one source that are checked together, about.
CLAIMS = 1000
#: Hash of no words.
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def joined_sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` values, by doubling."""
    out, done = values, 1
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Per window of words, the least hash of the runs of half its length in it: equal windows have equal anchors."""
    part = max(1, window // 2)
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    return sliding_least(windows(hashes, part), window - part + 1)


def edges_of(hashes: np.ndarray, window: int, bits: int = 64) -> np.ndarray:
    """The low ``bits`` of each window's hash."""
    return windows(hashes, window) & np.uint64((1 << bits) - 1)


def paths_of(hashes: np.ndarray, shared: np.ndarray, window: int, bits: int = 64) -> list[tuple[int, int, bytes]]:
    """Anchor, first place and packed edges of each maximal run of windows with one anchor out of ``shared``."""
    anchor = anchors(hashes, window)
    if not len(anchor):
        return []
    edges = edges_of(hashes, window, bits)
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    end = np.append(begin[1:], len(anchor))
    wanted = np.isin(anchor[begin], shared)
    signed = anchor.view(np.int64)
    return [(int(signed[a]), a, edges[a:z].tobytes()) for a, z in zip(begin[wanted].tolist(), end[wanted].tolist(), strict=True)]


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """The words outside of all spans."""
    cover = np.zeros(len(words) + 1, np.int64)
    for a, z in spans:
        cover[a] += 1
        cover[z] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def merged(spans: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Spans as (source, source_id, shift, start, end), those that meet in one source at one shift joined to long ones."""
    out: list[tuple[int, int, int, int, int]] = []
    for s in sorted(spans):
        if out and out[-1][:3] == s[:3] and s[3] <= out[-1][4]:
            out[-1] = (*out[-1][:4], max(out[-1][4], s[4]))
        else:
            out.append(s)
    return out


def _stored_paths(found: DataFrame, window: int, bits: int) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("path", pa.binary()), ("key", pa.int64()), ("text_id", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                rows = [(anchor, path, key, text_id, place)
                        for key, text_id, text, marks in zip(*(s.column(c).to_pylist() for c in range(4)), strict=True)
                        for anchor, place, path in paths_of(hashed(words_of(text)), np.frombuffer(marks, np.uint64), window, bits)]
                if rows:
                    yield record(schema, list(zip(*rows, strict=True)))

    rows = found.select("key", "text_id", "text", "marks").mapInArrow(run, "anchor bigint, path binary, key bigint, text_id bigint, place bigint")
    return rows.withColumn("path_id", F.xxhash64("path"))


def _edges(paths: DataFrame) -> DataFrame:
    """One row per edge of each path: its number ``at`` in the path, and its hash; before them the path's other columns."""
    paths = paths.select(*[c for c in paths.columns if c != "path"], "path")
    kept = paths.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                edges = [np.frombuffer(p, np.int64) for p in s.column(len(kept)).to_pylist()]
                n = [len(e) for e in edges]
                row = pa.array(np.repeat(np.arange(len(edges)), n))
                yield pa.RecordBatch.from_arrays([*(s.column(c).take(row) for c in range(len(kept))), pa.array(np.concatenate([np.arange(k) for k in n]), pa.int32()),
                                                  pa.array(np.concatenate(edges))], names=[*kept, "at", "edge"])

    return paths.mapInArrow(run, "".join(f"{c} bigint, " for c in kept) + "at int, edge bigint")


def _runs(sourced: DataFrame) -> DataFrame:
    """Per path with the sources of its edges: its runs of ``n`` edges from ``at`` on that follow each other in one source too."""
    names = ["anchor", "path_id", "at", "n", "source", "source_id", "source_place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = [x.to_numpy() for x in lists.flatten().flatten()]  # at, source, source_id, source_place
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at, source, source_id, place = flat
            fresh = np.ones(len(at) + 1, bool)
            fresh[1:-1] = ((row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (source_id[1:] != source_id[:-1])
                           | (place[1:] - place[:-1] != 1) | (at[1:] - at[:-1] != 1))
            begin = np.flatnonzero(fresh)
            n, begin = np.diff(begin), begin[:-1]
            of = pa.array(row[begin])
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *(pa.array(x, pa.int64()) for x in (
                at[begin], n, source[begin], source_id[begin], place[begin]))], names=names)

    return sourced.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _cut(found: DataFrame) -> DataFrame:
    """Per text with spans: how many words go, the hash of what is left, and what its words claim of their sources."""
    claim = pa.struct([("source", pa.int64()), ("source_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
    schema = pa.schema([("key", pa.int64()), ("text_id", pa.int64()), ("note", pa.string()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                        ("claims", pa.list_(claim))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text_id, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                long = merged([tuple(s.values()) for s in spans])
                left = without(words, [s[3:] for s in long])
                claims = [dict(zip(claim.names, (source, source_id, start + shift, end - start, digest(words[start:end])), strict=True))
                          for source, source_id, shift, start, end in long if source is not None]
                rows.append((key, text_id, joined_sha(words), len(words) - len(left), joined_sha(left), claims))
            if rows:
                yield record(schema, list(zip(*rows, strict=True)))

    return found.select("key", "text_id", "text", "spans").mapInArrow(
        run, "key bigint, text_id bigint, note string, n_removed bigint, kept_sha256 string, "
             "claims array<struct<source: bigint, source_id: bigint, start: bigint, n: bigint, digest: binary>>")


def _with_spans(found: DataFrame, spans: DataFrame) -> DataFrame:
    span = F.struct("source", "source_id", (F.col("source_place") - F.col("start")).alias("shift"), "start", "end")
    listed = spans.groupBy("key", "text_id").agg(F.collect_set(span).alias("spans"))
    return found.join(listed.hint("merge"), ["key", "text_id"])


def _false_claims(found: DataFrame, cut: DataFrame) -> DataFrame:
    """Claims whose words are not those at the source coordinates they name."""
    claim = F.struct("start", "n", "digest")
    told = durable(cut.select(F.explode("claims").alias("c")).select("c.*").distinct())
    # A source that very many texts claim is read once per CLAIMS of them.
    number = durable(told.groupBy("source", "source_id").agg(F.ceil(F.count("*") / CLAIMS).cast("int").alias("groups")))
    group = F.pmod(F.xxhash64("start", "n", "digest"), F.col("groups"))
    asked = durable(told.join(number, ["source", "source_id"]).groupBy("source", "source_id", group.alias("group")).agg(F.collect_list(claim).alias("claims")))
    schema = pa.schema([("source", pa.int64()), ("source_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text_id, text, claims in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                rows += [(key, text_id, *c.values()) for c in claims if digest(words[c["start"] : c["start"] + c["n"]]) != c["digest"]]
            if rows:
                yield record(schema, list(zip(*rows, strict=True)))

    sources = found.select(F.col("key").alias("source"), F.col("text_id").alias("source_id"), "text")
    return sources.join(asked.hint("merge"), ["source", "source_id"]).select("source", "source_id", "text", "claims").mapInArrow(
        run, "source bigint, source_id bigint, start bigint, n bigint, digest binary")


def _exact_spans(found: DataFrame, stored: DataFrame, doubted: DataFrame, window: int) -> DataFrame:
    """Word ranges of the doubted texts' windows whose words start in a smaller document, by digests of the words."""
    schema = pa.schema([("key", pa.int64()), ("text_id", pa.int64()), ("start", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text_id, text, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                rows += [(key, text_id, at, digest(words[at : at + window])) for at in starts]
            if rows:
                yield record(schema, list(zip(*rows, strict=True)))

    at = (F.col("place") + F.col("at")).alias("start")
    own = _edges(stored.join(doubted, ["key", "text_id"], "left_semi").select("anchor", "path")).select("anchor", "edge").distinct()
    alike = _edges(stored.join(own.select("anchor").distinct().hint("merge"), "anchor", "left_semi").select("anchor", "key", "text_id", "place", "path"))
    asked = alike.join(own.hint("merge"), ["anchor", "edge"], "left_semi").groupBy("key", "text_id").agg(F.collect_set(at).alias("starts"))
    told = durable(found.join(asked.hint("merge"), ["key", "text_id"]).select("key", "text_id", "text", "starts").mapInArrow(
        run, "key bigint, text_id bigint, start bigint, words binary"))
    firsts = durable(told.groupBy("words").agg(F.min("key").alias("first")))
    none = F.lit(None).cast("long")
    return (told.join(doubted, ["key", "text_id"], "left_semi").join(firsts.hint("merge"), "words").where("first < key")
            .select("key", "text_id", "start", (F.col("start") + window).alias("end"), none.alias("source"), none.alias("source_id"), F.lit(0).cast("long").alias("source_place")))


def repeated_spans(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """What repeats, as two tables.

    The first has every row: ``key``, ``size`` in words, ``note`` (SHA-256 of its words, joined by blanks), and ``copy``: its
    words as a whole are those of a smaller key, so that all of them go. Such a path adds nothing to the graph. The
    second has the other texts that lose words, as ``key``, ``note``, ``n_removed`` and ``kept_sha256``: the windows go
    whose words also start in a document with a smaller key. Edges are ``bits`` of a window's hash; the result is the
    same for any number, as words are compared by digests of 128 bits before they go.
    """
    rows = repeated.keyed_texts(docs, key, text)

    def extract(t: str) -> tuple[np.ndarray, int, str]:
        words = words_of(t)
        return np.unique(anchors(hashed(words), window)), len(words), joined_sha(words)

    seen = durable(repeated.shared(rows, extract, listed=True))
    least = durable(seen.where(f"size >= {window}").groupBy("note").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most"))
    seen = durable(seen.join(least, "note", "left").withColumn("copy", F.coalesce(F.col("key") > F.col("least"), F.lit(False)))
                   .select("key", "size", "note", "copy", "shared", "marks"))

    # Rows that repeat a key share their anchors here; each keeps its own text.
    hopeful = seen.where("shared > 0 and not copy and key is not null").groupBy("key").agg(
        F.aggregate(F.collect_list("marks"), F.lit(b""), lambda a, m: F.concat(a, m)).alias("marks"))
    found = durable(rows.join(hopeful.hint("merge"), "key").withColumn("text_id", F.xxhash64("text")))  # their number follows the corpus
    stored = durable(_stored_paths(found, window, bits))

    paths = durable(stored.groupBy("anchor", "path_id", "path").agg(F.min(F.struct("key", "text_id", "place")).alias("first"), F.max("key").alias("last"))
                    .select("anchor", "path_id", "path", F.col("first.key").alias("source"), F.col("first.text_id").alias("source_id"),
                            F.col("first.place").alias("source_place"), "last"))
    # An anchor with one path does not branch: all edges of the path start in the same documents.
    branching = durable(paths.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    source = ["source", "source_id", "source_place"]
    straight = paths.where("source < last").join(branching, "anchor", "left_anti").select(
        "anchor", "path_id", F.lit(0).cast("long").alias("at"), (F.length("path") / 8).cast("long").alias("n"), *source)
    edges = durable(_edges(paths.drop("last").join(branching, "anchor", "left_semi")))
    # Stored, so that the join below shuffles both of its sides and Spark can split an edge that many paths have.
    firsts = durable(edges.groupBy("anchor", "edge").agg(
        F.min(F.struct("source", "source_id", (F.col("source_place") + F.col("at")).alias("source_place"))).alias("s")).select("anchor", "edge", "s.*"))
    sourced = edges.select("anchor", "edge", "path_id", "at").join(firsts.hint("merge"), ["anchor", "edge"]).groupBy("anchor", "path_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), *source))).alias("sources"))
    resolved = straight.unionByName(_runs(sourced))
    start = F.col("place") + F.col("at")
    spans = stored.drop("path").join(resolved, ["anchor", "path_id"]).where("source < key").select(
        "key", "text_id", start.alias("start"), (start + F.col("n") + (window - 1)).alias("end"), *source)
    cut = durable(_cut(_with_spans(found, spans)))
    false = durable(_false_claims(found, cut))
    if not false.isEmpty():
        claims = cut.select("key", "text_id", F.explode("claims").alias("c")).select("key", "text_id", "c.*")
        doubted = durable(claims.join(false, false.columns, "left_semi").select("key", "text_id").distinct())
        again = _cut(_with_spans(found, _exact_spans(found, stored, doubted, window)))
        cut = cut.join(doubted, ["key", "text_id"], "left_anti").unionByName(again)
    return seen, cut.select("key", "note", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``n_removed`` and ``kept_sha256`` of the words that stay, joined by blanks.

    A null or empty text has no words. A null key is smaller than none and larger than none: its row loses nothing. Rows
    that repeat a key are judged by their own text, and never against each other. Other columns are not looked at.
    """
    seen, cut = repeated_spans(docs, window, key, text, bits)
    changed = cut.distinct()
    return seen.join(changed, ["key", "note"], "left").select(
        F.col("key").alias(key), F.col("size").alias("n_words"),
        F.when(F.col("copy"), F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "note")).alias("kept_sha256"))
