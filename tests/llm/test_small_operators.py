"""Operators on one document at a time: plain functions against brute force, and odd tables through Spark."""

import base64
import hashlib
import io
import itertools
import random
import re
import string
import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from tokenizers import Tokenizer

from fabgrain.llm import byte_bpe, compression_rules, exact_dedup, packing, pieces, quality_cnn, secret_scan, token_store, warc

STRANGE = ["", " ", "a", "  a  b ", "x\n\n y\t \r\nz", "don't IT'S we'll 'x", "日本語 çéß İstanbul ΟΔΟΣ", "1234 5.6,7 ...!? --", "a   b\x1c \x1dc",
           "é café ̀", "<|endoftext|> <|startoftext|>", "\U0001f600\U0001f600 ok", "a" * 3000, "ab" * 700 + " " * 50 + "\n" * 9, "The The THE."]


def random_texts(n=150, seed=3):
    r = random.Random(seed)
    alphabet = ["a", "b", "e", "t", "th", "ing", " ", " ", "  ", "\n", ".", ",", "'", "s", "é", "ß", "日", "0", "7", "_", "-", "A", "Z", "\t", " "]
    return ["".join(r.choices(alphabet, k=r.randrange(80))) for _ in range(n)]


def test_byte_pairs_equal_tiktoken():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    pairs, library = byte_bpe.load(P.path("byte_bpe_50k.tiktoken")), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cut = byte_bpe.regex.compile(P.PATTERN)
    for text in [*STRANGE, *random_texts()]:
        ids = pairs.packed(text, cut)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert pairs.unpacked(ids).decode() == text


@pytest.mark.parametrize("name,pattern,folds", [
    ("byte_bpe_50k.json", P.PATTERN, False),
    ("word_bpe_49k.json", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", True)])
def test_pieces_equal_whole_texts(name, pattern, folds):
    library = Tokenizer.from_file(P.path(name))
    library.encode_special_tokens = True
    texts = [*STRANGE, *random_texts()]
    for text, ids in zip(texts, pieces.load(P.path(name), pattern, folds).packed(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name,pattern,folds", [
    ("byte_bpe_50k.json", P.PATTERN, False),
    ("word_bpe_49k.json", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", True)])
def test_only_what_touches_other_characters_takes_the_slow_way(name, pattern, folds):
    library, encoder = Tokenizer.from_file(P.path(name)), pieces.Encoder(P.path(name), pattern, folds)
    library.encode_special_tokens = True
    slow, within = [], encoder.within
    encoder.within = lambda piece: slow.append(piece) or within(piece)
    r = random.Random(9)
    parts = ["ab", "'s", "'", "7", "é", "日本", "²", "_", "!", " ", " ", "  ", "\n", "\u3000", "\xa0", "\u0301", "ß's", "\x85", "İ", "Ab"]
    texts = ["".join(r.choices(parts, k=r.randrange(20))) for _ in range(2000)] + ["the quick 'brown' fox's 12 é jumps\n over\u3000it", "é" * 500]
    for text, ids in zip(texts, encoder.packed(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert slow and not any(p.isascii() for p in slow) and all(len(p) <= pieces.LONGEST for p in encoder)


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    encoder = pieces.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    texts = ["a b c d e é f g a b é h", "h g f", "", "a b c"]
    assert list(encoder.packed(texts)) == list(pieces.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN).packed(texts))
    assert len(encoder) <= 3 and len(encoder.old) <= 3


def test_the_next_operator_frees_the_encoders():
    pieces.load(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert not list(exact_dedup._classes(["key"], None)(iter([]))) and pieces.load.cache_info().currsize == 0


def brute_base(text):
    found = []
    for kind, pattern, holds in (
            ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        found += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if holds(m)]
    return sorted(found, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_secrets_equal_a_plain_search():
    r = random.Random(1)
    parts = ["password", "PassWord", "secret", "token", "api_key", "APIKEY", "=", ":", " = ", '"', "'", "abc", "abcdef0123456789", "AKIA", "ABCD1234EFGH5678IJKL", " ", "é", "İ", "ſecret", "toKen", "\n", "x/y+z=", "zz"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randrange(1, 14)))
        assert [s for s in secret_scan.spans_of(text) if s[2] in secret_scan.KINDS[:3]] == brute_base(text), text


def test_checksums_decide():
    import zlib
    body = "abcdefghijABCDEFGHIJ0123456789"
    value, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        check = secret_scan.BASE62[d] + check
    assert ("github" in {s[2] for s in secret_scan.spans_of(f"x ghp_{body}{check} y")}) and not secret_scan.spans_of(f"x ghp_{body}{'A' * 6} y")
    assert secret_scan.masked("my token=abcdef123 here", secret_scan.spans_of("my token=abcdef123 here")) == "my [assign] here"


def test_rules_count_as_stated():
    def brute(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)

    for text in [*STRANGE, *random_texts(), "a b c a b c x\na b c\na b c", "#$ %|", " \n "]:
        assert compression_rules.base_counts(text) == brute(text), repr(text)
    squeeze = zstandard.ZstdCompressor(level=3)
    noise = random.Random(1).randbytes(20_000)
    for data, kept in ((b"spam " * 4000, False), (noise, False)):
        assert compression_rules.verdict(len(data), *compression_rules.ratios(data, squeeze)) is kept


PROSE = ("The lot was held at the second lithography step because three wafers showed a ring of low yield near the edge. The engineer on duty "
         "compared the maps with those of last week, found the same ring on two older lots, and asked for the chuck to be cleaned before the "
         "next run. Nobody had touched the recipe since March, so a drift of the heater seemed more likely than a mistake in the settings. ")


def accepted(data):
    squeeze = zstandard.ZstdCompressor(level=compression_rules.LEVEL)
    return compression_rules.verdict(len(data), *compression_rules.ratios(data, squeeze), compression_rules.beyond_ascii(data))


def noise_of(kind, size, r):
    if kind == "ascii":
        return "".join(r.choices(string.printable[:95], k=size)).encode()
    data = base64.b64encode(r.randbytes(size))
    step = {"base64": size, "lines": 76, "words": 12}[kind]
    return b"\n".join(data[i : i + step] for i in range(0, len(data), step))[:size]


@pytest.mark.parametrize("size", [200, 290, 310, 480, 520, 690, 720, 990, 1010, 1500, 2040, 3000, 4000, 8000, 15_000, 17_000, 70_000])
def test_noise_is_rejected_in_every_length_class(size):
    r = random.Random(size)
    for kind in ("base64", "lines", "words", "ascii"):
        assert not any(accepted(noise_of(kind, size, r)) for _ in range(5)), kind


def fresh_prose(size, r):
    """Sentences over a vocabulary with word frequencies like those of prose."""
    syllables = ["".join(p) for p in itertools.product("bdfgklmnprst", "aeiou")]
    vocabulary = ["".join(r.choices(syllables, k=r.choice((1, 2, 2, 3)))) for _ in range(3000)]
    words = r.choices(vocabulary, weights=[1 / (i + 3) for i in range(3000)], k=size)
    return " ".join(words).encode()[:size]


@pytest.mark.parametrize("size", [200, 310, 520, 990, 2040, 3000, 8000, 34_000])
def test_prose_is_kept_in_every_length_class(size):
    r = random.Random(size)
    assert all(accepted(fresh_prose(size, r)) for _ in range(5))
    assert size > len(PROSE) or accepted(PROSE[:size].encode())


def test_text_that_is_mostly_noise_is_rejected():
    r = random.Random(3)
    mixed = b"\n".join([fresh_prose(8500, r), noise_of("lines", 25_500, r)])
    assert not accepted(mixed)
    assert compression_rules.ratios(mixed, zstandard.ZstdCompressor(level=3))[1] > 0.6


@pytest.mark.parametrize("good, bad", [(2060, 2000), (2100, 1500), (1000, 600), (500, 500), (4096, 2047)])
def test_noise_or_repetition_in_the_tail_is_rejected(good, bad):
    r = random.Random(good)
    prose = fresh_prose(good + bad, r)
    assert accepted(prose)
    for tail in (noise_of("base64", bad, r), noise_of("words", bad, r), (b"spam " * bad)[:bad]):
        assert not accepted(prose[:good] + tail)


def test_short_text_of_another_script_is_kept():
    text = ("如果您选择此选项，浏览器会在您离开页面之前询问是否保存更改。管理员可以为所有用户停用该功能，届时设置页面会显示相应的提示。"
            "请确认网络连接正常，然后重新加载网页；如果问题仍然存在，请联系贵组织的技术支持人员，并提供错误代码和发生时间。"
            "为保护隐私，系统不会记录密码、地址或付款信息。").encode()
    assert 300 < len(text) and accepted(text) and accepted(text[:300])


def test_bins_and_bound():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 400):
        lengths = r.integers(1, 100, n)
        bins, places, left = packing.best_fit(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(left)
        for b in range(len(left)):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(places[own])]
            assert places[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist() and lengths[own].sum() + left[b] == 100
    assert packing.lower_bound(np.array([60] * 7), 100) == 7 == len(packing.best_fit(np.array([60] * 7), 100)[2])


def test_perfect_hash_is_a_bijection():
    for n in (1, 2, 3, 50, 3000):
        keys = [f"{i}/0".encode() for i in range(n)]
        index = token_store.Index(token_store.index_bytes(0, keys, [(i, 2 * i, 3) for i in range(n)]))
        assert [index.find(k) for k in keys] == [(i, 2 * i, 3) for i in range(n)]
        assert index.find(b"absent") is None


def test_archive_round_trip_and_damage():
    records = [(1, "http://a", b"x" * 5000, None, False), (2, "http://b\nX: y", b"", None, False), (3, None, "é".encode() * 70_000, 1, True)]
    data = b"".join(warc.member(warc.record_bytes(*r, "2020-01-01T00:00:00Z")) + b"\0" for r in records)
    back = list(warc.read_archive(io.BytesIO(data)))
    assert [r.headers["Page-Id"] for r in back] == ["1", "2", "3"] and warc.payload_of(back[0].block) == b"x" * 5000
    assert warc.hex_digest(back[2].headers["WARC-Payload-Digest"]) == hashlib.sha1(records[2][2]).hexdigest()
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_archive(io.BytesIO(data[: len(data) // 2])))
    broken = warc.record_bytes(*records[0], "x").replace(b"xxx", b"yyy", 1)
    with pytest.raises(warc.DamagedArchive):
        warc.read_record(iter([broken]))


def test_a_header_beyond_the_limit_is_refused(monkeypatch):
    long = warc.record_bytes(1, "u" * (2 << 20), b"x", None, False, "x")
    assert warc.read_record(iter([long[i : i + 9999] for i in range(0, len(long), 9999)])).headers["WARC-Target-URI"] == "u" * (2 << 20)
    monkeypatch.setattr(warc, "MOST_HEADER", 1000)
    with pytest.raises(ValueError, match="page 1"):
        warc.record_bytes(1, "u" * 1000, b"x", None, False, "x")


@pytest.mark.parametrize("unit", ["eyJ", "EyJ", "eyJa.", "eyJa.eyJ", "password ", "password=", "secret: ", "token='", "AKIA", "akia", "ghp_", "npm_0", "0123456789abcdef" * 2, "-----BEGIN ", "-----BEGIN A PRIVATE KEY-----A"])
def test_secrets_take_linear_time(unit):
    def seconds(n):
        text = unit * (n // len(unit))
        start = time.perf_counter()
        secret_scan.spans_of(text)
        return time.perf_counter() - start

    assert seconds(2_000_000) < 4


def test_tokens_within_runs_equal_a_plain_search():
    part = base64.urlsafe_b64encode(b'{"a":1}').decode().rstrip("=")
    assert part.startswith("eyJ")
    for text in (f"eyJ{part}.{part}.x", f"EyJ{part}.{part}.x", f"eyJ eyJ.{part}.{part}.{part}", f"EYJeyJ_{part}.{part}.y eyJ", f"{part}.{part}", f"{part}.{part}.", f"{part}.eyJ.{part}.{part}."):
        want = [(m.start(), m.end(), "jwt") for m in secret_scan.JWT.finditer(text) if secret_scan.RULES["jwt"][1](m)]
        assert [s for s in secret_scan.spans_of(text) if s[2] == "jwt"] == want, text


def slow_score(model, data):
    """The network byte by byte and filter by filter."""
    size = quality_cnn.CHUNK
    n = quality_cnn.n_chunks(len(data))
    pooled = []
    for c in range(n):
        part = [*data[c * quality_cnn.STEP : c * quality_cnn.STEP + size]]
        part += [256] * (size - len(part))
        grams = Counter(tuple(part[i : i + 8]) for i in range(size - 7))
        inputs = [[*model.embed[b], float(i + 8 <= size and grams[tuple(part[i : i + 8])] > 1 and b < 256)] for i, b in enumerate(part)]
        responses = []
        for f in range(quality_cnn.FILTERS):
            best = max(sum(float(x) * float(w) for x, w in zip(sum(inputs[p : p + quality_cnn.WIDTH], []), model.filters[:, f], strict=True))
                       for p in range(0, size - quality_cnn.WIDTH + 1, quality_cnn.STRIDE))
            responses.append(max(0.0, best + float(model.bias[f])))
        pooled.append(responses)
    features = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    hidden = np.maximum(features @ model.w1 + model.b1, 0)
    return 1 / (1 + np.exp(-(hidden @ model.w2 + model.b2[0])))


@pytest.mark.parametrize("text", ["", "a short text, a short text", "words and words " * 50])
def test_network_equals_a_plain_convolution(text):
    model = quality_cnn.initial(3)
    assert quality_cnn.scores(model, [text])[0] == pytest.approx(slow_score(model, text.encode()), abs=1e-4)


def test_training_follows_the_gradient():
    """One small step changes the loss as the difference quotient says it should."""
    r = random.Random(4)
    texts = ["".join(r.choices("abc xyz", k=n)) for n in (0, 30, 700, 5000)]
    labels = [1, 0, 1, 0]
    one, other = (quality_cnn.train(texts, labels, epochs=1, at_once=4, block=b) for b in (3, 1000))
    for a, b in zip(one, other, strict=True):
        assert np.allclose(a, b, atol=1e-5)
    def loss(m): p = quality_cnn.scores(m, texts); return -sum(np.log(p[i] if y else 1 - p[i]) for i, y in enumerate(labels))  # noqa: E702, E704
    assert loss(quality_cnn.train(texts, labels, epochs=40, at_once=4)) < loss(quality_cnn.initial())
    assert quality_cnn.train(texts, [1] * 4) is None and quality_cnn.train([], []) is None


def test_chunks_come_in_blocks():
    r = np.random.default_rng(1)
    data = [r.bytes(n) for n in (0, 5, 512, 513, 5000, 100)]
    whole = [quality_cnn.chunks(d) for d in data]
    for at_once in (1, 4, 1000):
        got = list(quality_cnn.chunk_blocks(data, at_once))
        assert np.concatenate([o for o, _ in got]).tolist() == [i for i, c in enumerate(whole) for _ in c]
        assert (np.concatenate([c for _, c in got]) == np.concatenate(whole)).all() and all(len(c) <= at_once for _, c in got)


def test_network_learns_and_covers_whole_texts():
    r = random.Random(2)
    words = ["the", "and", "thing", "of", "other", "ren", "sto"]
    good = [" ".join(r.choices(words, k=80)) for _ in range(60)]
    bad = [" ".join(w + "***" for w in r.choices(words, k=80)) for _ in range(60)]
    model = quality_cnn.train(good[:50] + bad[:50], [1] * 50 + [0] * 50, epochs=10)
    p = quality_cnn.scores(model, good[50:] + bad[50:] + [""])
    assert (p[:10] > 0.5).all() and (p[10:20] < 0.5).all() and 0 <= p[20] <= 1
    long = " ".join(good)
    assert quality_cnn.scores(model, [long + " " + bad[0]])[0] < quality_cnn.scores(model, [long])[0]
    assert np.concatenate([c[: quality_cnn.STEP] for c in quality_cnn.chunks(long.encode())])[: len(long)].astype(np.uint8).tobytes() == long.encode()[:len(quality_cnn.chunks(long.encode())) * quality_cnn.STEP]
