"""A byte-level convolutional network for text quality, in numpy: trained on a bounded sample, applied to whole texts.

A text is cut into overlapping chunks that cover all of its bytes. In a chunk, every byte gives a learned vector and
one fixed feature: whether the eight bytes from here on occur elsewhere in the chunk. Learned filters slide over them;
their responses are max-pooled over each chunk. The pooled responses of all chunks are combined by their mean and their
maximum into one probability.
"""

from __future__ import annotations

import functools
import logging
import pickle
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabgrain.llm import pieces
from fabgrain.llm.common import strings, text_or_empty
from fabgrain.session import durable

CHUNK, STEP = 512, 448
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 7, 8, 2, 32, 16
DIM = EMBED + 1
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
GRAM = 8

#: Bounds of the sample that one task learns from: documents of each label, and bytes of text for both labels together.
SAMPLE_PER_LABEL = 1200
SAMPLE_BYTES = 1 << 25
EPOCHS = 14
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


class Model(NamedTuple):
    embed: np.ndarray  # 257 x EMBED; row 256 is padding
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    w1: np.ndarray  # 2 * FILTERS x HIDDEN
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray


def initial(seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    def normal(*shape, scale): return (r.standard_normal(shape) * scale).astype(np.float32)  # noqa: E704
    embed = normal(257, EMBED, scale=0.5)
    embed[256] = 0
    return Model(embed, normal(WIDTH * DIM, FILTERS, scale=(2 / (WIDTH * DIM)) ** 0.5), np.zeros(FILTERS, np.float32),
                 normal(2 * FILTERS, HIDDEN, scale=(1 / FILTERS) ** 0.5), np.zeros(HIDDEN, np.float32),
                 normal(HIDDEN, scale=(1 / HIDDEN) ** 0.5), np.zeros(1, np.float32))


def chunks(data: bytes) -> np.ndarray:
    """Rows of ``CHUNK`` byte values; the last is filled up with 256. An empty text is one row of padding."""
    n = max(1, -(-max(0, len(data) - CHUNK) // STEP) + 1)
    padded = np.full((n - 1) * STEP + CHUNK, 256, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP].copy()


def repeats(rows: np.ndarray) -> np.ndarray:
    """1 where the eight bytes from a place on occur at another place of the row, else 0."""
    n, places = len(rows), CHUNK - GRAM + 1
    gram = np.zeros((n, places), np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(0x100000001B3) ^ rows[:, k : k + places].astype(np.uint64)
    gram = (gram * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(1023) | np.arange(places, dtype=np.uint64)
    gram.sort(axis=1)
    value, place = gram >> np.uint64(10), (gram & np.uint64(1023)).astype(np.int64)
    same = value[:, 1:] == value[:, :-1]
    hit = np.zeros((n, places), bool)
    hit[:, 1:] |= same
    hit[:, :-1] |= same
    out = np.zeros((n, CHUNK), np.float32)
    np.put_along_axis(out, place, hit.astype(np.float32), axis=1)
    return out * (rows < 256)


def windows_of(model: Model, rows: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """All filter inputs: rows x positions x (WIDTH * DIM)."""
    x = np.empty((len(rows), CHUNK, DIM), np.float32)
    x[:, :, :EMBED] = model.embed[rows]
    x[:, :, EMBED] = repeat
    w = np.lib.stride_tricks.sliding_window_view(x.reshape(len(rows), CHUNK * DIM), WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]
    return np.ascontiguousarray(w).reshape(len(rows) * POSITIONS, WIDTH * DIM)


def pooled(model: Model, rows: np.ndarray, repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk and filter the largest response, not under zero, and where it is."""
    out = (windows_of(model, rows, repeat) @ model.filters).reshape(len(rows), POSITIONS, FILTERS)
    place = out.argmax(axis=1)
    return np.maximum(np.take_along_axis(out, place[:, None], axis=1)[:, 0] + model.bias, 0), place


def combine(model: Model, mean: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document features, hidden values and probability."""
    f = np.concatenate([mean, most], axis=1)
    hidden = np.maximum(f @ model.w1 + model.b1, 0)
    z = np.clip(hidden @ model.w2 + model.b2, -30, 30)
    return f, hidden, 1 / (1 + np.exp(-z))


def n_chunks(n_bytes: int) -> int:
    return max(1, -(-max(0, n_bytes - CHUNK) // STEP) + 1)


def chunk_blocks(data: Sequence[bytes], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All chunks of all texts in order, at most ``at_once`` at a time: the number of each one's text, and their rows."""
    held: list[np.ndarray] = []
    owners: list[int] = []
    for i, d in enumerate(data):
        number, done = n_chunks(len(d)), 0
        while done < number:
            n = min(at_once - len(owners), number - done)
            held.append(chunks(d[done * STEP : (done + n - 1) * STEP + CHUNK]))
            owners += [i] * n
            done += n
            if len(owners) == at_once:
                yield np.array(owners), np.concatenate(held)
                held, owners = [], []
    if held:
        yield np.array(owners), np.concatenate(held)


def scores(model: Model | None, texts: list[str], at_once: int = 64) -> np.ndarray:
    """Probability of label 1 per text, 0.5 without a model. Memory does not follow the texts: their chunks come in blocks."""
    if model is None:
        return np.full(len(texts), 0.5, np.float32)
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    total = np.zeros((len(texts), FILTERS), np.float64)
    most = np.zeros((len(texts), FILTERS), np.float32)
    for owner, rows in chunk_blocks(data, at_once):
        got, _ = pooled(model, rows, repeats(rows))
        np.add.at(total, owner, got)
        np.maximum.at(most, owner, got)
    number = np.array([n_chunks(len(d)) for d in data]).reshape(-1, 1)
    return combine(model, (total / number).astype(np.float32), most)[2]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7, at_once: int = 32, block: int = 64) -> Model | None:
    """Adam on the cross entropy, each label weighted to half; the largest response alone passes its gradient on.

    Every text is learned from as a whole. The chunks of a step come in blocks, once forward and once backward; between them
    only the pooled responses of each chunk are held. Without texts of both labels there is no model.
    """
    if len(set(labels)) < 2:
        return None
    model = initial(seed)
    y = np.array(labels, np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model]
    r = np.random.default_rng(seed)
    step = 0
    total = epochs * -(-len(texts) // at_once)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for chosen in (order[i : i + at_once] for i in range(0, len(order), at_once)):
            taken = [data[i] for i in chosen]
            sizes = np.array([n_chunks(len(d)) for d in taken])
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(chosen)), sizes)
            flags = []
            p, place = np.empty((len(owner), FILTERS), np.float32), np.empty((len(owner), FILTERS), np.int16)
            at = 0
            for _, rows in chunk_blocks(taken, block):
                flags.append(np.packbits(repeats(rows) > 0, axis=1))
                part = slice(at, at := at + len(rows))
                p[part], place[part] = pooled(model, rows, _unpacked(flags[-1]))
            mean, most = np.add.reduceat(p, starts) / sizes[:, None].astype(np.float32), np.maximum.reduceat(p, starts)
            f, hidden, prob = combine(model, mean, most)
            dz = ((prob - y[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            dh = np.outer(dz, model.w2) * (hidden > 0)
            df = dh @ model.w1.T
            # one chunk per document and filter holds the maximum: the first that reaches it
            first = np.full((len(chosen), FILTERS), len(owner))
            np.minimum.at(first, owner, np.where(p == most[owner], np.arange(len(owner))[:, None], len(owner)))
            dp = df[owner, :FILTERS] / sizes[owner, None]
            np.add.at(dp, (first.ravel(), np.tile(np.arange(FILTERS), len(chosen))), df[:, FILTERS:].ravel())
            dp *= p > 0
            dfilters, dembed = np.zeros_like(model.filters), np.zeros_like(model.embed)
            at = 0
            for (_, rows), flag in zip(chunk_blocks(taken, block), flags, strict=True):
                part = slice(at, at := at + len(rows))
                where = place[part, :, None].astype(np.int64) * STRIDE + np.arange(WIDTH)
                row = np.arange(len(rows))[:, None, None]
                seen = np.empty((*where.shape, DIM), np.float32)  # what the filters saw where they responded most
                seen[..., :EMBED] = model.embed[rows[row, where]]
                seen[..., EMBED] = _unpacked(flag)[row, where]
                dfilters += np.einsum("rfi,rf->if", seen.reshape(len(rows), FILTERS, WIDTH * DIM), dp[part])
                dx = (dp[part, :, None] * model.filters.T[None]).reshape(len(rows), FILTERS, WIDTH, DIM)[..., :EMBED]
                byte = rows[row, where].ravel()
                dembed += np.stack([np.bincount(byte, dx[..., e].ravel(), 257) for e in range(EMBED)], axis=1).astype(np.float32)
            dembed[256] = 0
            step += 1
            rate = 0.004 * min(1, step / 50) * (1 - step / (total + 1)) + 1e-5
            grads = (dembed, dfilters, dp.sum(0), f.T @ dh, dh.sum(0), hidden.T @ dz, dz.sum(keepdims=True))
            for param, grad, (m, v) in zip(model, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.002 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)
    return model


def _unpacked(flags: np.ndarray) -> np.ndarray:
    return np.unpackbits(flags, axis=1, count=CHUNK).astype(np.float32)


def held_out(key: str = "doc_id"):
    return (F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT)


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, most_bytes: int = SAMPLE_BYTES,
           key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Columns ``k``, ``t`` and ``y`` of the labelled documents that are learned from, none held out.

    Of each label these are the documents with the smallest hash of their key: at most ``per_label``, and only so many that
    their texts have ``most_bytes`` / 2 bytes, the last of them whole and at least one. No length is left out. Documents with
    both labels, or a null or other label, are not learned from; of rows that repeat a key, the smallest text is.
    """
    told = labels.where(~held_out(key) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(
        F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other")).where("y = other").drop("other")
    ids = docs.select(F.col(key).alias("k"))
    present = told.join(ids, "k", "left_semi").withColumn("h", F.xxhash64("k"))
    few = durable(functools.reduce(DataFrame.unionByName, [present.where(F.col("y") == y).orderBy("h", "k").limit(per_label) for y in (0, 1)]))
    texts = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    sizes = texts.join(F.broadcast(few), "k").groupBy("k", "y", "h").agg(F.max(F.octet_length("t")).alias("n")).collect()  # a row per document of the sample
    taken = []
    for y in (0, 1):
        held = 0
        for r in sorted((r for r in sizes if r["y"] == y), key=lambda r: (r["h"], r["k"])):
            if held >= most_bytes / 2:
                break
            held += r["n"]
            taken.append((r["k"], y))
    chosen = docs.sparkSession.createDataFrame(taken, few.select("k", "y").schema)
    return texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t"))


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model | None:
    """Trained in one task, on the bounded sample; only the weights come to the driver.

    Without usable documents of both labels there is nothing to tell apart: the result is None, which is logged, and every
    text scores 0.5, so that none is rejected.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        rows = sorted((k, y, t) for b in parts for k, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strings(b.column(2)), strict=True))
        trained = train([t for _, _, t in rows], [y for _, y, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([None if trained is None else pickle.dumps(tuple(trained))], pa.binary())], names=["model"])

    trained = [r["model"] for r in sample(docs, labels, **options).repartition(1).mapInArrow(run, "model binary").collect() if r["model"]]
    if not trained:
        logging.getLogger(__name__).warning("no labelled documents of both kinds to learn from: every text scores 0.5")
        return None
    return Model(*pickle.loads(trained[0]))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``key``, ``held_out``, ``score`` and ``predicted``, from its whole text alone.

    A null text counts as empty; empty texts are scored like others. A null key counts as not held out. Repeated rows
    stay; other columns are not looked at. Without a model every score is 0.5.
    """
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"))
    kind = keyed.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for s in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                p = scores(shared.value, strings(s.column(1))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                                 names=[key, "held_out", "score", "predicted"])

    return keyed.mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``threshold``, with all their columns; without a model, all.

    A null text counts as empty, and empty texts are scored like others; repeated rows share their fate; an empty table stays
    empty.
    """
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.forget()
        for b in parts:
            for s in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                yield s.filter(pa.array(scores(shared.value, strings(s.column(place))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
