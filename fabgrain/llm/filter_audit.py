"""How five filters interact: what each removes, at every place of every order, with copies found by radix text tries.

Each block of rows is put into a local trie first, so that a text leaves its block once, however often it is repeated there.
These texts are range-partitioned by prefixes that are lengthened until none stands for too many bytes, and inserted whole
into compressed tries whose terminals hold the smallest id. A traversal tells each block which of its texts have a smaller
id elsewhere. All that follows works on counts per part and mask of failed filters.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabgrain.llm.common import batches, shuffle_partitions, strings, text_or_empty
from fabgrain.session import durable

#: The filters, by letter; filter number i has the bit 2**i in a mask.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"

#: A local trie is closed at so many bytes of text, or rows.
BLOCK_BYTES, BLOCK_ROWS = 1 << 24, 20_000
#: Bytes of text in a range at most, where texts differ.
RANGE_BYTES = 1 << 26
#: Lengths of the prefixes that are tried: this many code points, then four times as many each time.
SHORTEST = 8
#: A trie is closed between two prefixes once it holds so many bytes.
TRIE_BYTES = 1 << 22


def base_mask(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        1 * (len(words) < LEAST_WORDS)
        | 2 * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
        | 4 * (100 * capitals > MOST_CAPITALS * len(text))
        | 8 * (len(data.translate(None, MARKS)) < len(data))
    )


def smaller(a: int | None, b: int | None) -> int | None:
    """The smaller id; null is larger than any."""
    return b if a is None else a if b is None else min(a, b)


class Node:
    __slots__ = ("label", "children", "terminal")

    def __init__(self, label: str, children: dict | None = None) -> None:
        self.label, self.children, self.terminal = label, children, -1


class Trie:
    """A compressed trie of whole texts: an edge carries a run of characters, a terminal the smallest id of its text."""

    def __init__(self) -> None:
        self.root = Node("")
        self.least: list[int | None] = []
        self.size = 0

    @staticmethod
    def _shared(label: str, text: str, at: int) -> int:
        """Leading characters of ``label`` that ``text`` has from ``at`` on."""
        if text.startswith(label, at):
            return len(label)
        low, high = 0, min(len(label), len(text) - at)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if text.startswith(label[low:middle], at + low) else (low, middle - 1)
        return low

    def insert(self, text: str, key: int | None) -> int:
        """The number of the text's terminal, whose smallest id now covers ``key``."""
        node, at = self.root, 0
        while at < len(text):
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = child = Node(text[at:])
                self.size += len(text) - at
                shared = len(text) - at
            elif (shared := self._shared(child.label, text, at)) < len(child.label):
                upper = Node(child.label[:shared], {child.label[shared]: child})
                child.label = child.label[shared:]
                node.children[text[at]] = child = upper
            node, at = child, at + shared
        if node.terminal < 0:
            node.terminal = len(self.least)
            self.least.append(key)
        else:
            self.least[node.terminal] = smaller(self.least[node.terminal], key)
        return node.terminal

    def terminals(self) -> Iterator[tuple[int, int | None]]:
        """Number and smallest id of every terminal, from the root down."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.terminal >= 0:
                yield node.terminal, self.least[node.terminal]
            if node.children:
                stack.extend(node.children.values())


def prefix_marks(text: str) -> list[int]:
    """A hash of each prefix of ``SHORTEST``, four times as many, ... code points that is shorter than the text."""
    out, size = [], SHORTEST
    while size < len(text):
        out.append(xxhash.xxh3_64_intdigest(text[:size].encode("utf-8", "surrogatepass"), size) - (1 << 63))
        size *= 4
    return out


ROWS = pa.schema([("block", pa.int64()), ("terminal", pa.int32()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()),
                  ("least", pa.int64()), ("text", pa.string()), ("n_bytes", pa.int64()), ("marks", pa.list_(pa.int64()))])


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows with their block's terminal and its smallest id; the first row of a terminal carries the text."""
    task = TaskContext.get().partitionId() << 32
    number, trie, rows, texts = 0, Trie(), [], []

    def closed() -> Iterator[pa.RecordBatch]:
        told: set[int] = set()

        def listed() -> Iterator[tuple]:
            for terminal, key, part, mask in rows:
                text = None if terminal in told else texts[terminal]
                told.add(terminal)
                yield (task + number, terminal, key, part, mask, trie.least[terminal], text,
                       None if text is None else len(text.encode("utf-8", "surrogatepass")), None if text is None else prefix_marks(text))

        yield from batches(ROWS, listed())

    masks: list[int] = []
    held = 0
    for b in parts:
        for key, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strings(b.column(2)), strict=True):
            terminal = trie.insert(text, key)
            if terminal == len(texts):
                texts.append(text)
                masks.append(base_mask(text))
                held += len(text)
            rows.append((terminal, key, part, masks[terminal]))
            if held >= BLOCK_BYTES or len(rows) >= BLOCK_ROWS:
                yield from closed()
                number, trie, rows, texts, masks, held = number + 1, Trie(), [], [], [], 0
    if rows:
        yield from closed()


def _smaller_elsewhere(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts sorted by prefix: the blocks' terminals whose text has a smaller id in another block."""
    schema = pa.schema([("block", pa.int64()), ("terminal", pa.int32()), ("first", pa.int64())])
    trie, holders, at = Trie(), [], None

    def told() -> Iterator[tuple]:
        for number, least in trie.terminals():
            for block, terminal, own in holders[number]:
                if least is not None and (own is None or least < own):
                    yield block, terminal, least

    for b in parts:
        for prefix, block, terminal, least, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if prefix != at and trie.size >= TRIE_BYTES:  # equal texts have equal prefixes, so none goes on
                yield from batches(schema, told())
                trie, holders = Trie(), []
            at = prefix
            number = trie.insert(text, least)
            if number == len(holders):
                holders.append([])
            holders[number].append((block, terminal, least))
    yield from batches(schema, told())


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row: ``id``, ``part`` and ``mask``, the bits of the filters that the row fails.

    A null text counts as empty and a null part as the empty string. Ids are whole numbers; a null id is larger than any
    other, and rows that repeat the smallest id of a text are all first. Other columns are not looked at.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty(text).alias("text"))
    stored = durable(rows.mapInArrow(_blocks, "block long, terminal int, id long, part string, mask int, least long, text string, n_bytes long, marks array<long>"))
    texts = stored.where("text IS NOT NULL")
    total = texts.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(shuffle_partitions(docs.sparkSession), -(-total // range_bytes))
    # Prefixes with more than a quarter of a range's bytes: at most four times as many of each length as there are ranges.
    weights = texts.select(F.explode("marks").alias("mark"), "n_bytes").groupBy("mark").agg(F.sum("n_bytes").alias("n"))
    heavy = docs.sparkSession.sparkContext.broadcast({r["mark"] for r in weights.where(F.col("n") > total / ranges / 4).select("mark").collect()})

    def prefixed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            whole = strings(b.column(3))
            prefixes = [t[: SHORTEST * 4 ** next((i for i, m in enumerate(ms) if m not in heavy.value), 64)]
                        for t, ms in zip(whole, b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), *b.columns[:4]], names=["prefix", "block", "terminal", "least", "text"])

    found = (
        texts.select("block", "terminal", "least", "text", "marks")
        .mapInArrow(prefixed, "prefix string, block long, terminal int, least long, text string")
        .repartitionByRange(ranges, "prefix").sortWithinPartitions("prefix")
        .mapInArrow(_smaller_elsewhere, "block long, terminal int, first long")
    )
    first = F.coalesce("first", "least")
    copy = first.isNotNull() & (F.col("id").isNull() | (F.col("id") > first))
    flagged = stored.select("block", "terminal", "id", "part", "mask", "least").join(found, ["block", "terminal"], "left")
    return flagged.select("id", "part", (F.col("mask") + F.when(copy, COPY).otherwise(0)).alias("mask"))


def reduced(masked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts ``n``, ``good`` and ``toxic`` per ``part`` and ``mask``: all that the audit needs of the documents.

    A document is good or toxic if any of its label rows says so; null labels say nothing.
    """
    marked = durable(labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")))
    return masked.join(marked, "id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from :func:`reduced`; without documents, none."""
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32 entries
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    steps = per_part.select("part", "masks", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])).alias("step"))

    def bit(step: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substring("filter_order", step, F.lit(1))) - 1)

    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda s, i: s + F.when(i > 0, bit(i)).otherwise(0))
    steps = steps.withColumns({"own": bit(F.col("step")), "before": before})

    def total(which, value=lambda m: m["n"]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(which(m["mask"]), value(m)).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    there = lambda m: m.bitwiseAND(before) == 0
    n_orders = F.lit(len(list(itertools.permutations(FILTERS))))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: there(m) & ~fails(m)).alias("kept"),
        total(lambda m: there(m) & fails(m)).alias("removed"),
        total(lambda m: ~there(m) & fails(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(lambda m: there(m) & fails(m), lambda m: m["good"]).alias("good_lost"),
        total(lambda m: there(m) & fails(m), lambda m: m["toxic"]).alias("toxic_lost"),
        # of all orders, each of the filters that a document fails comes first equally often
        total(fails, lambda m: m["n"] * (n_orders / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of ``docs`` under the five filters, see :func:`masks`, :func:`reduced` and :func:`audit`."""
    return audit(reduced(masks(docs, key, text, part), labels, key))
