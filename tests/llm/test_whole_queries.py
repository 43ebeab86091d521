"""The registered text queries and the pipeline over whole small tables, against plain Python."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from fabgrain.llm import byte_bpe, compression_rules, packing, quality_cnn, secret_scan
from fabgrain.llm.common import table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MIDDLE = os.path.join(os.path.dirname(FOLDER.rstrip("/")), "sf0.01")  # in the smallest one, no document is rejected
LARGER = os.path.join(os.path.dirname(FOLDER.rstrip("/")), "sf0.1")  # the smaller ones have too few bad documents to judge by
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not found")

ROOM = 2048


@pytest.fixture(scope="module")
def texts():
    return texts_of(FOLDER)


def texts_of(folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    return {int(k): t if isinstance(t, str) else "" for k, t in zip(docs.doc_id, docs.text, strict=True)}


def rows(spark, name, folder=FOLDER):
    return entry.queries()[name](spark, folder).collect()


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_token_store(spark, texts):
    encode, want, start = library("word_bpe_49k.json"), {}, 0
    for k in sorted(texts):
        ids = [*encode(texts[k]), 1]
        want[k] = (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op2_token_store")} == want


def test_byte_pairs(spark, texts):
    known = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op6_byte_bpe")}
    for k, text in texts.items():
        ids = known.encode_ordinary(text)
        assert got.pop(k) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), k
    assert not got


def between(x, points):
    """Straight lines through ``points``, flat beyond both ends."""
    if x <= points[0][0]:
        return points[0][1]
    for (a, p), (b, q) in zip(points, points[1:], strict=False):
        if x <= b:
            return p + (q - p) * (x - a) / (b - a)
    return points[-1][1]


def accepted(data):
    """The compression bands as the README states them: low limits by length and script, high limits by length, chunks that cover
    the text, and a quarter of bad chunks at most."""
    def ratio(x):
        return len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))

    def low(x):
        sizes = [200, 300, 500, 700, 1000, 1500, 2048, 4000, 16000]
        plain, wide = [1.085, 1.13, 1.215, 1.26, 1.295, 1.315, 1.42, 1.45, 1.6], [0.95, 0.95, 1.05, 1.1, 1.2, 1.3, 1.42, 1.45, 1.6]
        p, w = (between(math.log(len(x)), [(math.log(s), v) for s, v in zip(sizes, limits, strict=True)]) for limits in (plain, wide))
        beyond = sum(b > 127 for b in x) / len(x)
        return p + (w - p) * min(1, 2 * beyond)

    if len(data) < 200:
        bad_whole = False
    else:
        high = 3.2 if len(data) < 1000 else 3.6 if len(data) < 4000 else 4.2 if len(data) < 16000 else 5.0 if len(data) < 64000 else 6.0
        bad_whole = not low(data) <= ratio(data) <= high
    size, high = (2048, 5.0) if len(data) >= 2048 else (512, 3.2)
    parts = []
    if len(data) >= size:
        at = 0
        while at + size < len(data):
            parts.append(data[at : at + size])
            at += size
        parts.append(data[-size:])
    bad = sum(not low(x) <= ratio(x) <= high for x in parts)
    return not bad_whole and 4 * bad <= len(parts)


def test_compression_rules(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op5_compression_rules")}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        words, data = words_of(text), text.encode()
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(grams)
        repeated = len({i + d for i, g in enumerate(grams) if often[g] > 1 for d in range(3)})
        lines = [x for x in text.split("\n") if words_of(x)]
        failed = len(words) < 50 or 100 * repeated > 50 * len(words)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, failed, not failed and accepted(data))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == want, k


def test_compression_rules_on_hard_texts(spark):
    """Texts at the limits, where a change of a chunk or a limit changes the verdict."""
    r = np.random.default_rng(12)
    words = ["".join(r.choice(list("abcdefghijklmnop"), r.integers(2, 9))) for _ in range(4000)]
    texts = []
    for n in (60, 120, 300, 700, 3000):
        for share in (0.0, 0.1, 0.3, 0.5, 0.7, 0.9):
            own = [str(w) for w in r.choice(words, n)]
            cut = int(n * share)
            texts += [" ".join(own[:cut] + [base64.b64encode(r.bytes(9)).decode() for _ in range(n - cut)]),
                      " ".join(own[:cut] + [f"{own[0]}{i % 97}" for i in range(n - cut)]), " ".join(own[:cut] + ["é" + chr(0x4E00 + int(x)) for x in r.integers(0, 3000, n - cut)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.base_failed, x.kept) for x in compression_rules.judge(docs).collect()}
    wrong = [k for k, t in enumerate(texts) if got[k][1] != (not got[k][0] and accepted(t.encode()))]
    kept = sum(x[1] for x in got.values())
    assert not wrong and 10 < kept < len(texts) - 10


def all_spans(text):
    """Every kind's pattern over the whole text, without keywords."""
    rules = {**secret_scan.RULES, "hex": (secret_scan.HEX, lambda m: len(m[0]) >= 24)}
    found = [(m.start(), m.end(), kind) for kind, (pattern, holds) in rules.items() for m in pattern.finditer(text) if holds(m)]
    return sorted(found, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_secret_scan(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op9_secret_scan")}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        spans = all_spans(text)
        base = ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans if kind in ("assign", "access", "hex"))
        counts = Counter(kind for _, _, kind in spans)
        r = got[k]
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"]), k
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


def pieces(texts):
    """(document, piece) to start, length and checksum."""
    encode, found = library("byte_bpe_50k.json"), {}
    for k, text in texts.items():
        ids = [*encode(text), 0]
        first = len(ids) % ROOM or ROOM
        borders = [0, *range(first, len(ids) + 1, ROOM)]
        for i, (a, z) in enumerate(zip(borders, borders[1:], strict=False)):
            found[k, i] = (a, z - a, zlib.crc32(packed(ids[a:z])))
    return found


def check_packing(got, want):
    assert len(got) == len(want)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for sequence in places.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= ROOM
    bound = packing.lower_bound(np.array([r.length for r in got]), ROOM)
    assert bound <= len(places) <= 11 * bound / 9 + 1


def test_packing(spark, texts):
    check_packing(rows(spark, "op8_certified_packing"), pieces(texts))


def labelled(spark, texts, labels):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_long_documents_are_learned_from_whole(spark):
    good = ["the and of thing other ren sto " * 1800 for _ in range(14)]
    bad = ["*** $$$ 000 ### qqq " * 2800 for _ in range(14)]
    docs, labels = labelled(spark, good + bad, [(i, int(i < 14), 0) for i in range(28)])
    drawn = quality_cnn.sample(docs, labels).collect()
    usable = [i for i in range(28) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r.k for r in drawn) == usable and min(len(r.t) for r in drawn) > 50_000
    model = quality_cnn.fit(docs, labels)
    p = quality_cnn.scores(model, [good[0], bad[0]])
    assert p[0] > p[1] + 0.02  # learned in fourteen steps
    few = quality_cnn.sample(docs, labels, most_bytes=200_000).collect()  # the bound draws fewer of them, not shorter ones
    assert {r.y for r in few} == {0, 1} and len(few) < len(drawn) and {r.k for r in few} < {r.k for r in drawn}
    assert len(quality_cnn.sample(docs, labels, most_bytes=1).collect()) == 2


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 0, 0), (2, 0, 0)], [(1, 1, 0), (1, 0, 0), (2, None, 0), (2, 7, 0)], [(900, 1, 0), (901, 0, 0)]])
def test_without_both_labels_nothing_is_rejected(spark, caplog, labels):
    docs, table_ = labelled(spark, ["one", "two", "three", None], labels)
    model = quality_cnn.fit(docs, table_)
    assert model is None and "every text scores 0.5" in caplog.text
    assert {(r.score, r.predicted) for r in quality_cnn.score(docs, model).collect()} == {(0.5, 1)}
    assert quality_cnn.keep_good(docs, model).count() == 4


def test_conflicting_and_repeated_rows_are_not_learned_twice(spark):
    docs, labels = labelled(spark, [f"text {i}" for i in range(9)], [(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 1), (3, None, 0), (4, 0, 0), (None, 0, 0), (8, 0, 1)])
    docs = docs.unionByName(spark.createDataFrame([(4, "another"), (None, "none")], "doc_id long, text string"))
    usable = {k: t for k, t in {2: ("text 2", 1), 4: ("another", 0), 8: ("text 8", 0)}.items() if zlib.crc32(str(k).encode()) % 5}
    assert {r.k: (r.t, r.y) for r in quality_cnn.sample(docs, labels).collect()} == usable


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="driver tables not found")
def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    scored = entry.queries()["op4_quality_cnn"](spark, LARGER).cache()
    assert scored.count() == docs.count() == scored.where("score between 0 and 1 and predicted = int(score >= 0.3)").count()
    keys = [r.doc_id for r in scored.where("held_out").select("doc_id").collect()]
    assert keys and all(zlib.crc32(str(k).encode()) % 5 == 0 for k in keys)
    judged = scored.where("held_out").join(labels, "doc_id")
    good, bad = (judged.where(F.col("quality") == y).agg(F.avg("predicted")).head()[0] for y in (1, 0))
    scored.unpersist()
    assert good > 0.95 and bad < 0.15


def near_classes(texts):
    """Document to the smallest document that links reach."""
    def grams(t):
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    keys = sorted(texts)
    sets, root = {k: grams(texts[k]) for k in keys}, {k: k for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n, m = len(sets[a]), len(sets[b])
            if min(n, m) * 100 < max(n, m) * 75 or not n:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (n + m - common) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    return root


def without_secrets(text):
    out, at = "", 0
    for start, end, kind in all_spans(text):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


@pytest.mark.skipif(not os.path.isdir(MIDDLE), reason="driver tables not found")
def test_pipeline(spark):
    texts = texts_of(MIDDLE)
    model = quality_cnn.fit(table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels"))
    keys = sorted(texts)
    good = {k: texts[k] for k, p in zip(keys, quality_cnn.scores(model, [texts[k] for k in keys]), strict=True) if p >= 0.3}
    assert 0 < len(good) < len(texts)
    last = {t: k for k, t in sorted(good.items())}
    single = {k: t for t, k in last.items()}
    classes = near_classes(single)
    apart = {k: t for k, t in single.items() if classes[k] == k}
    assert len(apart) < len(single) < len(good)
    check_packing(rows(spark, "pipeline", MIDDLE), pieces({k: without_secrets(t) for k, t in apart.items()}))


def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    odd = odd_docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    for docs in (odd, odd.limit(0), no_docs.withColumn("n_chars", F.lit(0))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, FOLDER).columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= docs.count()
