"""Exact byte-level BPE in linear time: longest matches, undone where neighbours could not have come out of the merges."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabgrain.llm.common import strings

#: Pieces whose ids a worker remembers; when full, it starts anew.
REMEMBERED = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BytePairs:
    """Encoder and decoder for one table of ranks.

    A list of tokens is what the merges give if and only if each two neighbours are compatible: undoing the merges on
    both sides of their border, latest first, never meets a pair that would have been merged earlier. Compatibility
    is remembered per pair. Encoding takes the longest token at each place and goes back to a shorter one, or to the
    token before, when a pair does not fit; a place that led nowhere is never tried again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.id_of = ranks
        self.matcher = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.matcher.add_word(token.decode("latin-1"), (len(token), i))
        self.matcher.make_automaton()
        self.halves = self._halves()
        self.joined = {pair: i for i, pair in enumerate(self.halves) if pair is not None}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def _halves(self) -> list[tuple[int, int] | None]:
        """The two tokens whose merge makes each token; none for single bytes."""
        halves: list[tuple[int, int] | None] = [None] * len(self.bytes_of)
        for i, token in enumerate(self.bytes_of):
            if len(token) > 1:
                parts = [token[k : k + 1] for k in range(len(token))]
                while len(parts) > 2:
                    best = min(range(len(parts) - 1), key=lambda k: self.id_of.get(parts[k] + parts[k + 1], len(halves)))
                    if self.id_of.get(parts[best] + parts[best + 1], i) >= i:
                        break
                    parts[best : best + 2] = [parts[best] + parts[best + 1]]
                if len(parts) == 2 and all(p in self.id_of for p in parts):
                    halves[i] = (self.id_of[parts[0]], self.id_of[parts[1]])
        return halves

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges can leave these two tokens side by side."""
        pair = (left, right)
        if (known := self.fits.get(pair)) is not None:
            return known
        a, b, limit, fits = left, right, len(self.halves), True
        while True:
            if self.joined.get((a, b), limit) < limit:
                fits = False
                break
            # Undo the later of the two merges; what was merged before it must not be joined across the border.
            if a > b:
                if self.halves[a] is not None:
                    limit, a = a, self.halves[a][1]
                elif self.halves[b] is not None:
                    limit, b = b + 1, self.halves[b][0]
                else:
                    break
            elif self.halves[b] is not None:
                limit, b = b + 1, self.halves[b][0]
            elif self.halves[a] is not None:
                limit, a = a, self.halves[a][1]
            else:
                break
        if len(self.fits) >= REMEMBERED * 2:
            self.fits.clear()
        self.fits[pair] = fits
        return fits

    def ids(self, piece: str) -> list[int]:
        """Ids of one piece of text, as its bytes in Latin-1."""
        if (whole := self.id_of.get(piece.encode("latin-1"))) is not None:
            return [whole]
        ways: list[list[tuple[int, int]]] = [[] for _ in piece]  # at each place, from short to long
        for end, (size, i) in self.matcher.iter(piece):
            ways[end - size + 1].append((size, i))
        out: list[int] = []
        at, left, dead = 0, [len(ways[0])], set()
        begun = [0]
        n = len(piece)
        while at < n:
            options = ways[at]
            k = left[-1] - 1
            while k >= 0 and (at + options[k][0] in dead or out and not self.compatible(out[-1], options[k][1])):
                k -= 1
            if k >= 0:
                left[-1] = k  # on return only shorter ones are tried
                at += options[k][0]
                out.append(options[k][1])
                if at < n:
                    begun.append(at)
                    left.append(len(ways[at]))
            elif len(begun) == 1:
                raise ValueError("the ranks do not cover every byte")
            else:
                dead.add(at)
                begun.pop()
                left.pop()
                out.pop()
                at = begun[-1]
        return out

    def packed(self, text: str, pieces: regex.Pattern) -> bytes:
        """Ids of a text as little-endian 32-bit integers, each match of ``pieces`` encoded on its own."""
        known = self.known
        out = []
        for piece in pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.ids(piece.encode("utf-8", "surrogatepass").decode("latin-1")), "<u4").tobytes()
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def unpacked(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    """Built once per Python worker."""
    return BytePairs(read_ranks(path))


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key`` and ``ids``, the whole text's ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Null keys and repeated rows stay as they are; other columns are not looked at.
    ``ranks_path`` is read by every Python worker, so it must be in the same place on all machines.
    """
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, pieces = load(ranks_path), regex.compile(pattern)
        for b in parts:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                ids = [pairs.packed(t, pieces) for t in strings(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=[key, "ids"])

    return keyed.mapInArrow(run, f"`{key}` {kind}, ids binary")


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """``coded`` with a further column ``decoded``, the bytes of the text; null ids give null."""
    place = coded.columns.index(ids)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(ranks_path)
        for b in parts:
            data = [None if i is None else pairs.unpacked(i) for i in b.column(place).to_pylist()]
            yield b.append_column("decoded", pa.array(data, pa.binary()))

    return coded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema) + ", decoded binary")


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    return coded.select(key, (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and the hashes of both."""
    return digests(decode(encode(docs, ranks_path, pattern, key, text), ranks_path), key)
