"""Quality rules: word and line counts, and bands for how well whole texts and fixed chunks compress."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabgrain.llm.common import strings, words_of

SYMBOLS = "#*$%&|<>"
LEVEL = 3


class Band(NamedTuple):
    """Highest ratio plain / compressed of texts of at least ``least`` bytes."""

    least: int
    high: float


#: Longer texts compress better, so each length class has limits of its own; texts under 200 bytes carry the compressor's
#: fixed cost and are not judged.
WHOLE = (Band(200, 3.2), Band(1000, 3.6), Band(4000, 4.2), Band(16_000, 5.0), Band(64_000, 6.0))
CHUNK = Band(2048, 5.0)
#: Chunks of texts shorter than one of those.
SHORT = Band(512, 3.2)
#: Lowest ratios by length, read between the lengths on a log scale. For ASCII, they lie over what random base64 and random
#: printable text reach (1.06, 1.11, 1.20, 1.24, 1.27, 1.29, 1.31, 1.33, 1.34). Prose in scripts of several bytes a letter
#: compresses no better than that when short (Chinese 0.96, 0.97, 1.11, 1.18, 1.28, -, 1.51, -, 2.31), and has its own.
LOW_SIZES = (200, 300, 500, 700, 1000, 1500, 2048, 4000, 16_000)
LOW_ASCII = (1.085, 1.13, 1.215, 1.26, 1.295, 1.315, 1.42, 1.45, 1.6)
LOW_WIDE = (0.95, 0.95, 1.05, 1.1, 1.2, 1.3, 1.42, 1.45, 1.6)
#: A text is rejected when more than this share of its chunks lies outside the band.
BAD_CHUNKS = 0.25

LEAST_WORDS = 50


def _repeated(ids: np.ndarray, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    grams = ids[:n].astype(np.int64)
    for k in range(1, size):  # renumbered after each word, so that no product overflows
        grams = np.unique(grams, return_inverse=True)[1].astype(np.int64) * (int(ids.max()) + 1) + ids[k : n + k]
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines equal to an earlier one, words in repeated 3-word windows."""
    words = words_of(text)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    white = sum(map(text.count, "\x20\x09\x0a\x0b\x0c\x0d"))
    return len(words), len(text) - white, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(ids)


def beyond_ascii(data: bytes) -> float:
    """Share of the bytes that are not ASCII."""
    return float(np.count_nonzero(np.frombuffer(data, np.uint8) > 127)) / len(data) if data else 0.0


def lowest(size: int, beyond: float) -> float:
    """Least ratio of ``size`` bytes: the limit of ASCII, or that of other scripts from a share ``beyond`` of a half on."""
    ascii_low, wide = (float(np.interp(np.log(size), np.log(LOW_SIZES), low)) for low in (LOW_ASCII, LOW_WIDE))
    return ascii_low + (wide - ascii_low) * min(1.0, 2 * beyond)


def ratios(data: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text, and the share of its chunks whose ratio is outside the band.

    The last chunk ends with the text and may overlap the one before, so that all bytes lie in a chunk. Texts of under
    512 bytes have none.
    """
    if not data:
        return 1.0, 0.0
    whole = len(data) / len(squeeze.compress(data))
    size, high = CHUNK if len(data) >= CHUNK.least else SHORT
    begins = [*range(0, len(data) - size, size), len(data) - size] if len(data) >= size else []
    bad = 0
    for at in begins:
        part = data[at : at + size]
        bad += not lowest(size, beyond_ascii(part)) <= size / len(squeeze.compress(part)) <= high
    return whole, bad / len(begins) if begins else 0.0


def verdict(size: int, whole: float, bad_chunks: float, beyond: float = 0.0) -> bool:
    """True if the compression bands accept a text of ``size`` bytes, a share ``beyond`` of them not ASCII."""
    band = next((b for b in reversed(WHOLE) if size >= b.least), None)
    return band is None or lowest(size, beyond) <= whole <= band.high and bad_chunks <= BAD_CHUNKS


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its counts, its ratios and whether it is kept.

    A null or empty text has no words, fails the base rule and is not kept. Null keys and repeated rows stay as they
    are; other columns are not looked at. A text is compressed as a whole and in chunks of 2048 bytes (512 in
    shorter texts), of which the last one ends with the text.
    """
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for b in parts:
            rows = []
            for t in strings(b.column(1)):
                data = t.encode("utf-8", "surrogatepass")
                counts = base_counts(t)
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > 50 * counts[0]
                whole, bad = ratios(data, squeeze)
                rows.append((*counts, failed, not failed and verdict(len(data), whole, bad, beyond_ascii(data)), whole, bad))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                                             names=[key, *names, "base_failed", "kept", "ratio", "bad_chunks"])

    return keyed.mapInArrow(count, f"`{key}` {kind}, " + ", ".join(f"{n} bigint" for n in names)
                            + ", base_failed boolean, kept boolean, ratio double, bad_chunks double")
