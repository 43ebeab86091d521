"""Near-duplicate join on n-gram sets: globally ordered sets in tries, joined with bounds on what can still overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabgrain.llm import repeated
from fabgrain.llm.common import free_names, hashed, mixed, record, strings, windows
from fabgrain.llm.components import components
from fabgrain.session import discard, durable

WORDS = 5
PERCENT = 75
#: Bits of the filter of keys, in pieces of ``FILTER_PIECE``: of fixed size, too. With more keys than bits it lets most rows
#: through, and the join behind it decides alone.
FILTER_BITS, FILTER_PIECE = 1 << 26, 1 << 16
#: N-grams that one task puts into tries at once; larger clusters are worked off in blocks.
BLOCK_GRAMS = 500_000


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A-Z in lower case; a shorter text is one run."""
    h = hashed(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(h):
        return h
    if len(h) < words:
        return mixed(windows(h, len(h)) + np.uint64(len(h)))
    return np.unique(windows(h, words))


def least_overlap(a, b, percent: int = PERCENT):
    """Fewest common elements of sets with ``a`` and ``b`` elements whose Jaccard similarity reaches ``percent``."""
    return -(-percent * (a + b) // (100 + percent))


class Trie:
    """Sets as sorted paths, common beginnings stored once, chains without branches as one node; nodes by level."""

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        parent, depth, source = [-1], [0], [-1]
        self.node_of = np.zeros(len(paths), np.int64)
        stack, last = [0], np.zeros(0, np.uint32)
        for i in order:
            path = paths[i]
            n = min(len(path), len(last))
            differ = np.flatnonzero(path[:n] != last[:n])
            common = int(differ[0]) if len(differ) else n
            below = -1
            while depth[stack[-1]] > common:
                below = stack.pop()
            if depth[stack[-1]] < common:  # a chain forks in its middle
                parent.append(stack[-1])
                depth.append(common)
                source.append(source[below])
                parent[below] = len(parent) - 1
                stack.append(len(parent) - 1)
            if len(path) > common:
                parent.append(stack[-1])
                depth.append(len(path))
                source.append(i)
                stack.append(len(parent) - 1)
            self.node_of[i] = stack[-1]
            last = path
        up, deep = np.array(parent), np.array(depth)
        level = np.zeros(len(up), np.int64)
        kids: list[list[int]] = [[] for _ in parent]
        for k, p in enumerate(parent[1:], 1):
            kids[p].append(k)
        todo, by_level = [0], []
        while todo:
            level[todo] = len(by_level)
            by_level.append(todo)
            todo = [c for k in todo for c in kids[k]]
        # Per node the smallest set and the longest rest of a path below it.
        least, most = np.full(len(up), np.iinfo(np.int64).max), deep.copy()
        np.minimum.at(least, self.node_of, sizes)
        for nodes in by_level[:0:-1]:
            np.minimum.at(least, up[nodes], least[nodes])
            np.maximum.at(most, up[nodes], most[nodes])
        new = np.empty(len(up), np.int64)
        ordered = np.concatenate([np.array(nodes) for nodes in by_level])
        new[ordered] = np.arange(len(up))
        self.node_of = new[self.node_of]
        self.parent = np.where(up[ordered] >= 0, new[up[ordered]], -1)
        self.least, self.rest = least[ordered], (most - deep)[ordered]
        self.levels = np.cumsum([0, *map(len, by_level)])
        labels = [paths[source[k]][depth[parent[k]] : depth[k]] if k else np.zeros(0, np.uint32) for k in ordered.tolist()]
        self.begin = np.cumsum([0, *map(len, labels)])
        self.labels = np.concatenate(labels)
        self.end_label = np.array([x[-1] if len(x) else 0 for x in labels], np.uint32)

    def overlaps(self, path: np.ndarray, size: int, member: np.ndarray, percent: int) -> np.ndarray:
        """Common elements of one set and each node's path, -1 below subtrees that can't reach the similarity.

        ``member`` tells per element whether it is in the set. Overlaps of shared beginnings are computed once; a
        subtree is left out when the overlap so far, plus the shorter of the rests, stays under the least that the
        smallest set in it would need.
        """
        out = np.full(len(self.parent), -1, np.int64)
        out[0] = 0
        for a, z in zip(self.levels[1:], self.levels[2:], strict=False):
            nodes = np.flatnonzero(out[self.parent[a:z]] >= 0) + a
            if not len(nodes):
                break
            begin, length = self.begin[nodes], self.begin[nodes + 1] - self.begin[nodes]
            at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            got = out[self.parent[nodes]] + np.add.reduceat(member[self.labels[at]], np.cumsum(length) - length, dtype=np.int64)
            left = len(path) - np.searchsorted(path, self.end_label[nodes], side="right")
            possible = got + np.minimum(left, self.rest[nodes])
            out[nodes] = np.where(possible >= least_overlap(size, self.least[nodes], percent), got, -1)
        return out


def linked(sizes: list[int], sets: list[np.ndarray], queries: list[int] | None = None, percent: int = PERCENT) -> np.ndarray:
    """Per set a label; two sets have the same one if links of at least ``percent`` join them.

    ``queries`` are the sets compared with all; by default every set is. Elements in one set only are no part of the
    tries, but of the sizes. Once all sets have one label, no further comparison can change anything.
    """
    n = np.array(sizes, np.int64)
    labels = np.arange(len(sets))
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.uint32)
    rank[np.lexsort((values, -counts))] = np.arange(len(values), dtype=np.uint32)
    ends = np.cumsum([0, *map(len, sets)])
    keep = counts > 1
    paths = []
    for a, z in zip(ends, ends[1:], strict=False):
        own = inverse[a:z]
        paths.append(np.sort(rank[own[keep[own]]]))
    trie = Trie(paths, n)
    member = np.zeros(len(values), bool)
    for q in range(len(sets)) if queries is None else queries:
        member[paths[q]] = True
        got = trie.overlaps(paths[q], int(n[q]), member, percent)[trie.node_of]
        member[paths[q]] = False
        near = np.unique(labels[got >= least_overlap(n[q], n, percent)])
        if len(near) > 1 or len(near) and near[0] != labels[q]:
            near = np.union1d(near, labels[q])
            labels[np.isin(labels, near)] = near[0]
        if (labels == labels[0]).all():
            break
    return labels


def fingerprint(grams: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(grams.tobytes())


def _slot() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).alias("slot")


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for the hash of each key."""
    schema = pa.schema([("piece", pa.int64()), ("bits", pa.binary())])

    def gather(group: pa.Table) -> pa.Table:
        bits = np.zeros(FILTER_PIECE, bool)
        slots = group.column("slot").to_numpy()
        bits[slots % FILTER_PIECE] = True
        return pa.table([pa.array([slots[0] // FILTER_PIECE]), pa.array([np.packbits(bits).tobytes()], pa.binary())], schema=schema)

    pieces = keys.select(_slot()).distinct().groupBy(F.floor(F.col("slot") / FILTER_PIECE)).applyInArrow(gather, "piece bigint, bits binary")
    out = np.zeros((FILTER_BITS // FILTER_PIECE, FILTER_PIECE // 8), np.uint8)
    for r in pieces.collect():
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _texts_of(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """``key`` and ``text`` of the rows whose key is in ``reps``, with its ``fp`` there.

    A filter leaves out most other rows before the join, so that their texts are not shuffled.
    """
    bits = rows.sparkSession.sparkContext.broadcast(_filter(reps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = b.column("slot").to_numpy()
            kept = b.filter(pa.array((bits.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool))).select(["key", "text"])
            if kept.num_rows:
                yield kept

    likely = rows.where("key is not null").select("key", "text", _slot()).mapInArrow(run, "key bigint, text string")
    return likely.join(reps.hint("merge"), "key")  # their number follows the corpus


def _sets(rows: DataFrame) -> DataFrame:
    """``key``, ``size``, ``fp`` and ``grams`` of the rows whose set has the fingerprint ``fp``."""
    schema = pa.schema([("key", pa.int64()), ("size", pa.int64()), ("fp", pa.string()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                grams = [shingles(t) for t in strings(s.column(1))]
                found = [(key, len(g), fp, g.tobytes()) for key, fp, g in zip(s.column(0).to_pylist(), s.column(2).to_pylist(), grams, strict=True) if fingerprint(g) == fp]
                if found:
                    yield record(schema, list(zip(*found, strict=True)))

    return rows.select("key", "text", "fp").mapInArrow(run, "key bigint, size bigint, fp string, grams binary")


def _with_partners(classes: DataFrame, percent: int) -> DataFrame:
    """The sets of which enough n-grams occur in other sets too, as ``key``, ``size`` (of the whole set), those ``grams`` and how ``often``."""
    def extract(grams: bytes) -> tuple[np.ndarray, int, str]:
        g = np.frombuffer(grams, np.uint64)
        return g, len(g), ""

    sets = durable(classes)
    marks = repeated.shared(sets.select("key", F.col("grams").alias("text")), extract, listed=True, counted=True)
    out = durable(marks.where(f"100 * shared >= {percent} * size").select("key", "size", F.col("marks").alias("grams"), "often"))
    discard(sets)
    return out


def _clusters(classes: DataFrame, percent: int) -> DataFrame:
    """Candidate clusters: two sets that reach the similarity share one of their rarest n-grams, and so a cluster.

    A set of n elements needs ceil(percent n / 100) common ones, so only its n - that + 1 rarest are looked at. Any order of
    all n-grams gives the same result, but a rough one links strangers by n-grams that are common, up to one cluster of most
    of a corpus; so n-grams are counted, all of them.
    """
    schema = pa.schema([("gram", pa.int64()), ("rep", pa.int64())])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, n, data, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                g, often = np.frombuffer(data.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint16)
                # N-grams of this set alone are the rarest of all; they take up places but have no partner.
                first = np.lexsort((g, often))[: max(0, n + percent * -n // 100 + 1 - (n - len(g)))]
                yield record(schema, [g[first].astype(np.int64), np.full(len(first), rep)])

    postings = durable(classes.select("key", "size", "grams", "often").mapInArrow(rare, "gram bigint, rep bigint"))
    centres = durable(postings.groupBy("gram").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b < most").drop("most"))
    found = components(postings.join(centres, "gram").select(F.col("rep").alias("a"), "b").where("a <> b").distinct())
    discard(postings, centres)
    return found


def _links(percent: int, cross: bool):
    def run(group: pa.Table) -> pa.Table:
        if cross:
            group = pa.concat_tables([group.filter(group.column("asked")), group.filter(pa.compute.invert(group.column("asked")))])
        keys = np.array(group.column("key").to_pylist(), np.int64)
        sets = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        asked = int(np.sum(group.column("asked").to_numpy())) if cross else len(sets)
        labels = linked(group.column("size").to_pylist(), sets, list(range(asked)), percent) if len(sets) > 1 else np.arange(len(sets))
        least = {}
        for label, key in zip(labels.tolist(), keys.tolist(), strict=True):
            least[label] = min(key, least.get(label, key))
        roots = np.array([least[x] for x in labels.tolist()], np.int64)
        other = roots != keys
        return pa.table({"a": keys[other], "b": roots[other]})

    return run


def _task(*parts: str) -> Column:
    """One key for a cluster's part, so that the parts of a cluster go to different tasks."""
    return F.xxhash64("cluster", *parts).alias("task")


def _cluster_links(classes: DataFrame, clusters: DataFrame, percent: int, block_grams: int) -> DataFrame:
    """Links that join the sets of each cluster, as (a, b); a cluster of more than a block's n-grams is cut.

    First every block is joined in itself and with the cluster's first set. Then only sets outside of the largest
    component found so far can add a link; they are compared with all blocks.
    """
    members = durable(classes.select("key", "size", "grams").join(clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster")), "key"))
    large = durable(members.groupBy("cluster").agg(F.ceil(F.sum("size") / block_grams).cast("int").alias("blocks")).where("blocks > 1"))
    placed = members.join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    everywhere = F.when(F.col("key") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = durable(placed.withColumn("block", F.explode(everywhere)).groupBy(_task("block")).applyInArrow(_links(percent, False), "a bigint, b bigint"))
    if not large.head(1):
        discard(members, large)
        return first

    found = components(first)
    several = durable(placed.where("blocks > 1").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    discard(members, large)
    parts = several.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = durable(parts.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main")))
    rest = several.join(main, "cluster").where("root <> main")
    amount = rest.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / block_grams)).cast("int").alias("asks"))
    asked = rest.join(amount, "cluster").select(
        "cluster", "key", "size", "grams", F.pmod(F.xxhash64("key", F.lit(1)), F.col("asks")).cast("int").alias("ask"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asked"))
    against = several.join(amount, "cluster").select(
        "cluster", "key", "size", "grams", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), "block", F.lit(False).alias("asked"))
    second = asked.unionByName(against).groupBy(_task("block", "ask")).applyInArrow(_links(percent, True), "a bigint, b bigint")
    return first.unionByName(durable(second))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Per row: ``key``, ``n_shingles`` and ``component_id``, the smallest key reachable by links of ``percent`` or more.

    A null or empty text has no n-grams and is linked with nothing; a row with a null key has no component; rows that
    repeat a key are one node. Other columns are not looked at. N-grams are compared by 64-bit hashes.

    Only documents of whose n-grams at least ``percent`` occur elsewhere can have a partner. Of these, equal sets become
    one class, and classes without enough n-grams in other classes go; candidate clusters share rare n-grams; each
    cluster is joined in a trie.
    """
    rows = repeated.keyed_texts(docs, key, text)

    def extract(t: str) -> tuple[np.ndarray, int, str]:
        g = shingles(t)
        return g, len(g), fingerprint(g)

    marks = durable(repeated.shared(rows, extract).select("key", "size", F.col("note").alias("fp"), "shared"))
    hopeful = marks.where(f"key is not null and size > 0 and 100 * shared >= {percent} * size").select("key").distinct()
    members = durable(marks.join(hopeful.hint("merge"), "key", "left_semi").select("key", "fp").distinct())  # their number follows the corpus
    reps = durable(members.groupBy("fp").agg(F.min("key").alias("key")))  # as one set may have very many copies, see below
    classes = _with_partners(_sets(_texts_of(rows, reps)), percent)
    links = _cluster_links(classes, _clusters(classes, percent), percent, block_grams)
    discard(classes)

    members = members.join(reps.withColumnRenamed("key", "rep"), "fp").select("key", "rep")
    twice = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")  # one key with several texts
    joined = components(links.unionByName(members.join(twice, "key", "left_semi").select(F.col("key").alias("a"), F.col("rep").alias("b"))))
    roots = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").groupBy("key").agg(
        F.min(F.coalesce("root", "rep")).alias("root"))
    return marks.join(roots, "key", "left").select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"), F.coalesce("root", "key").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` without those whose group has a smaller key, with all their columns."""
    (name,) = free_names(docs, "_gone")
    gone = near_duplicates(docs, key, text, percent).where(F.col("component_id") < F.col(key)).select(F.col(key).alias(name)).distinct()
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")
