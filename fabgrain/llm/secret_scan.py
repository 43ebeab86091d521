"""Secrets in texts: a keyword automaton finds the places, anchored patterns and checksums decide."""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabgrain.llm.common import strings

#: Kinds in the order used for spans that start at the same place. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "jwt", "pem")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Access tokens of a code host: 30 random characters, then their CRC-32 in six characters of base 62.
GITHUB = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Keyword (ASCII letters in lower case) to kind; every match of a kind's pattern starts with one of its keywords.
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "github"),
    "eyj": "jwt",
    "-----begin ": "pem",
}
LOWER = {c: c + 32 for c in range(65, 91)}
#: Letters of hexadecimal numbers become x, all else a blank: a long number is then one keyword of 24 times x.
HEX_CLASS = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
HEX_LEAST = 24


def _crc_fits(m: re.Match) -> bool:
    value = zlib.crc32(m[1].encode())
    digits = ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits == m[2]


def _header_reads(m: re.Match) -> bool:
    try:
        return all(isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict) for part in m.groups())
    except (ValueError, binascii.Error, RecursionError):
        return False


def _key_decodes(m: re.Match) -> bool:
    """The body is base64 of a DER sequence whose length field fits."""
    try:
        der = base64.b64decode("".join(m[2].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return der[1] == len(der) - 2
    n = der[1] & 0x7F
    return 0 < n <= 4 and int.from_bytes(der[2 : 2 + n], "big") == len(der) - 2 - n


RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, _crc_fits),
    "jwt": (JWT, _header_reads),
    "pem": (PEM, _key_decodes),
}


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """A-Z in lower case, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(LOWER)


def _hex_spans(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of hexadecimal digits, looked at only where 24 of them follow each other."""
    ascii_text = text if text.isascii() else "".join(c if c < "\x80" else " " for c in text)
    classes = ascii_text.encode("ascii").translate(HEX_CLASS)
    keyword = b"x" * HEX_LEAST
    at = classes.find(keyword)
    while at >= 0:
        end = HEX.match(text, at).end()
        yield at, end
        at = classes.find(keyword, end)


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in code points, by start and then kind as in ``KINDS``.

    Per kind the leftmost non-overlapping matches of its pattern are taken, as a search over the whole text would; of
    these, only those that pass the kind's rule (least length, checksum, decodable content) are returned. Time is linear in
    the text.
    """
    found = [(a, b, "hex") for a, b in _hex_spans(text)]
    hits: dict[str, set[int]] = {}
    for end, (size, kind) in _automaton().iter(lowered(text)):
        hits.setdefault(kind, set()).add(end - size + 1)
    for kind, starts in hits.items():
        pattern, holds = RULES[kind]
        free = 0
        for at in sorted(starts):
            if at < free:
                continue
            if m := pattern.match(text, at):
                free = m.end()
                if holds(m):
                    found.append((at, free, kind))
            elif kind == "jwt" and text.startswith("eyJ", at):  # what follows its run decides, and is the same for every later start in the run
                free = JWT_RUN.match(text, at).end()
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key`` and ``spans``, an array of (start, end, kind) in code points.

    Documents without secrets, with a null or with an empty text get an empty array. A null key is returned as it is,
    repeated rows give repeated rows, and other columns are not looked at. Every whole text is scanned in one pass.
    """
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in spans_of(t)] for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, spans)], names=[key, "spans"])

    return keyed.mapInArrow(scan, f"`{key}` {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every secret replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the secrets in ``text`` masked; a null text stays null."""
    place = docs.columns.index(text)

    def mask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            clean = [None if t is None else masked(t, s) if (s := spans_of(t)) else t for t in b.column(place).to_pylist()]
            yield b.set_column(place, b.schema.field(place), pa.array(clean, b.schema.field(place).type))

    return docs.mapInArrow(mask, docs.schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as one text."""
    def listed(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(key, count("assign"), count("access"), count("hex"),
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
