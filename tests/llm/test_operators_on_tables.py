"""Operators on whole tables against brute force, with odd rows and empty tables."""

import pathlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fabgrain.llm import byte_bpe, components, compression_rules, exact_dedup, ngram_join, packing, quality_cnn, secret_scan, substring_dedup, token_store, warc
from fabgrain.llm.common import hashed, windows
from fabgrain.session import durable, new_path

BYTE = (P.path("byte_bpe_50k.json"), P.PATTERN)
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def store(spark, docs):
    path = new_path(spark, "tokens")
    token_store.write(docs, path, P.path("word_bpe_49k.json"), WORD, end_id=1, shard_ids=20_000)
    return token_store.documents(spark, path)


OPERATORS = {
    "store": lambda spark, d: store(spark, d),
    "ngram": lambda spark, d: ngram_join.near_duplicates(d),
    "rules": lambda spark, d: compression_rules.judge(d),
    "bpe": lambda spark, d: byte_bpe.round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "substring": lambda spark, d: substring_dedup.remove_repeats(d),
    "secrets": lambda spark, d: secret_scan.digest(secret_scan.find_secrets(d)),
    "exact": lambda spark, d: exact_dedup.groups(d),
    "cnn": lambda spark, d: quality_cnn.score(d, quality_cnn.initial()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, odd_docs, no_docs, name):
    assert OPERATORS[name](spark, odd_docs).count() == odd_docs.count()
    assert OPERATORS[name](spark, no_docs).count() == 0


def test_exact_groups(spark, odd_docs):
    rows = [tuple(r) for r in exact_dedup.groups(odd_docs, piece=50_000).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted((r for r in rows if r[1] == 7), key=str) == [(1, 7, 4, False), (1, 7, 4, False), (7, 7, 4, True), (None, 7, 4, False)]
    assert sum(r[3] for r in rows) == 5
    assert (2, 3, 2, False) in rows and (3, 3, 2, True) in rows
    assert exact_dedup.drop_copies(odd_docs).count() == 5
    assert exact_dedup.drop_copies(odd_docs).columns == odd_docs.columns


def test_fingerprints_compose():
    data = np.random.default_rng(1).bytes(300_000)
    whole = exact_dedup.fingerprint(data)
    for cut in (0, 1, 65_536, 299_999):
        assert exact_dedup.combined(exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:])) == whole
    assert not exact_dedup.same_text("a" * 70_000 + "b", "a" * 70_000 + "c")


def test_packing_is_gapless(spark, odd_docs):
    rows = packing.pack_documents(odd_docs, *BYTE).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len({(r.doc_id, r.piece) for r in rows if r.doc_id == 4}) == max(r.piece for r in rows if r.doc_id == 4) + 1


def near_copies(n=40, seed=5):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [list(r.choice(vocabulary, 60)) for _ in range(4)]
    texts = []
    for i in range(n):
        words = list(bases[i % 4])
        for _ in range(r.integers(0, 4)):
            words[r.integers(0, 60)] = str(r.choice(vocabulary))
        texts.append(" ".join(words))
    return [*texts, "a b", "A  b", "b a", "", None]


def brute_components(texts):
    def grams(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, parent = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    return {i: (len(sets[i]), parent[i]) for i in range(len(texts))}


@pytest.mark.parametrize("block", [2_000_000, 200])
def test_ngram_join_equals_all_pairs(spark, block):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, block_grams=block).collect()}
    assert got == brute_components(texts)


def test_trie_equals_all_pairs():
    r = np.random.default_rng(8)
    for _ in range(60):
        sets = [np.unique(r.integers(0, 30, r.integers(1, 25))).astype(np.uint64) for _ in range(r.integers(2, 12))]
        labels = np.arange(len(sets))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
                    labels[labels == labels[i]] = labels[j]
        got = ngram_join.linked([len(s) for s in sets], sets)
        assert all((got[i] == got[j]) == (labels[i] == labels[j]) for i in range(len(sets)) for j in range(i))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 120), 100)}


def test_substrings_equal_brute_force(spark):
    r = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(70)]
    texts = []
    for i in range(30):
        words = [f"w{x}" for x in r.integers(0, 5000, r.integers(0, 120))]
        if i % 3 == 0:
            at = int(r.integers(0, len(words) + 1))
            words[at:at] = passage[: int(r.integers(45, 71))]
        texts.append(" ".join(words) if i else " ".join(["same"] * 130))
    texts += [texts[3], " ".join(["same"] * 90), "Same " + texts[6]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words, first = [t.split() for t in texts], {}
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for row in substring_dedup.remove_repeats(docs).collect():
        w, gone = words[row.doc_id], set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < row.doc_id:
                gone.update(range(k, k + 50))
        kept = [x.encode() for j, x in enumerate(w) if j not in gone]
        assert (row.n_words, row.n_removed, row.kept_sha256) == (len(w), len(gone), substring_dedup.joined_sha(kept)), row.doc_id


def test_store_lookup_and_fetch(spark):
    docs = spark.createDataFrame([(i, f"word number {i}") for i in range(200)], "doc_id long, text string")
    path = new_path(spark, "tokens")
    token_store.write(docs, path, P.path("word_bpe_49k.json"), WORD, end_id=1, shard_ids=50)
    found = token_store.lookup(spark, path, spark.createDataFrame([(7, 0), (150, 0), (999, 0)], "key long, ordinal long"))
    ids = {r.key: np.frombuffer(r.ids, "<u4")[-1] for r in token_store.fetch(spark, path, found).collect()}
    assert ids == {7: 1, 150: 1}
    assert {(r.key, r.n_tokens) for r in token_store.documents(spark, path).collect()} == {(i, r.length) for i, r in enumerate(token_store.payload(spark, path).orderBy("key").collect())}


@pytest.mark.parametrize("damage", ["missing", "other"])
def test_a_damaged_index_stops_the_store(spark, damage):
    docs = spark.createDataFrame([(i, f"word number {i} " * (i % 5 + 1)) for i in range(60)], "doc_id long, text string")
    path, other = new_path(spark, "tokens"), new_path(spark, "tokens")
    token_store.write(docs, path, P.path("word_bpe_49k.json"), WORD, end_id=1, shard_ids=50)
    token_store.write(docs.withColumn("doc_id", 59 - F.col("doc_id")), other, P.path("word_bpe_49k.json"), WORD, end_id=1, shard_ids=50)
    files = {p: [f for f in sorted(pathlib.Path(p, "index").iterdir()) if f.name.startswith("part-") and f.stat().st_size > 2] for p in (path, other)}
    for mine, theirs in zip(files[path], files[other], strict=True):
        mine.with_name("." + mine.name + ".crc").unlink(missing_ok=True)
        mine.write_bytes(b"") if damage == "missing" else mine.write_bytes(theirs.read_bytes())
    with pytest.raises(Exception, match="index|struct|buffer|unpack"):
        token_store.documents(spark, path).collect()


def test_archives(spark):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (2, "u", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big)], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_archives(pages, path)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.payload_table(spark, path).collect())
    assert got == [("1", 1500, "revisit", 2), ("2", 1500, "response", None), ("2", 1500, "response", None), ("3", 5, "response", None),
                   ("4", 5, "response", None), ("5", 0, "response", None), ("None", 1500, "revisit", 2)]
    assert warc.read_archives(spark, path).where("payload_digest IS NULL").count() == 0
    empty = new_path(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.payload_table(spark, empty).count() == 0


@pytest.mark.parametrize("texts", [("A" * 1500, "B" * 1600, "A" * 1500), ("B" * 1600, "A" * 1500, "A" * 1500)])
def test_pages_that_repeat_an_id_with_other_payloads(spark, texts):
    pages = spark.createDataFrame([(5, "u", texts[0]), (5, "u", texts[1]), (3, "u", texts[2])], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_archives(pages.coalesce(1), path)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.payload_table(spark, path).collect())
    assert got == [(3, 1500, "revisit", 5), (5, 1500, "response", None), (5, 1600, "response", None)]


def test_archives_are_cut_by_bytes(spark):
    r = np.random.default_rng(0)
    pages = spark.createDataFrame([(i, "u" * (3 << 20) if i == 7 else None, r.bytes(20_000).hex()) for i in range(60)], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_archives(pages.coalesce(2), path, archive_bytes=200_000)
    sizes = [f.stat().st_size for f in pathlib.Path(path).iterdir() if f.name.startswith("part-")]
    assert len(sizes) >= 5 and max(sizes) <= 200_001
    back = {x.key: (x.url, bytes(x.payload).decode()) for x in warc.read_archives(spark, path).collect()}
    assert back == {p.page_id: (p.url or "", p.html) for p in pages.collect()}


def test_filters_keep_columns_whose_names_the_operators_use_too(spark, odd_docs):
    taken = ["_gone", "_k", "_sha", "_SHA0", "key", "note", "size", "kept", "component_id", "length", "spans"]
    wide = odd_docs
    for i, name in enumerate(c for c in taken if c.lower() not in {x.lower() for x in odd_docs.columns}):
        wide = wide.withColumn(name, F.lit(i))
    for keep in (exact_dedup.drop_copies, ngram_join.one_of_each, secret_scan.mask_secrets, lambda d: quality_cnn.keep_good(d, quality_cnn.initial(), threshold=0.0)):
        got, plain = keep(wide), keep(odd_docs)
        assert got.columns == wide.columns
        assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, (r.doc_id for r in plain.collect())))
    assert packing.pack_documents(wide, *BYTE).count() == packing.pack_documents(odd_docs, *BYTE).count()


def test_substrings_of_a_passage_in_many_contexts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.range(0, 300, numPartitions=5).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("a"), "id"), F.lit(passage), F.concat(F.lit("z"), "id")).alias("text"))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {i: (62, 60 if i else 0) for i in range(300)}


def window_brute_force(texts):
    """Per text: words, words that go, and the hash of what is left; windows are compared by their words."""
    words, first, out = [t.split() for t in texts], {}, {}
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        out[i] = (len(w), len(gone), substring_dedup.joined_sha([x.encode() for j, x in enumerate(w) if j not in gone]))
    return out


def test_windows_whose_hashes_agree_in_32_bits_are_told_apart(spark):
    passage, seen, pair = [f"p{i}" for i in range(30)], {}, None
    for i in range(40_000):
        words = [*(f"a{i}_{j}" for j in range(25)), *passage, *(f"z{i}_{j}" for j in range(25))]
        hashes = hashed([w.encode() for w in words])
        for anchor, edge in zip(substring_dedup.anchors(hashes, 50).tolist(), (windows(hashes, 50) & np.uint64(0xFFFFFFFF)).tolist(), strict=True):
            if seen.setdefault((anchor, edge), (i, words))[0] != i:
                pair = seen[anchor, edge][1], words
        if pair:
            break
    texts = [" ".join(w) for w in pair]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs).collect()} == window_brute_force(texts)


@pytest.mark.parametrize("bits", [0, 3, 9])
def test_source_words_decide_where_window_hashes_agree(spark, bits):
    r = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([*(f"w{x}" for x in r.integers(0, 9, r.integers(0, 30))), *passage, *(f"w{x}" for x in r.integers(0, 9, r.integers(0, 30)))]) for _ in range(60)]
    texts += [t + " tail" for t in texts[10:20]] + [texts[3] + " " + texts[7]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs, bits=bits).collect()} == window_brute_force(texts)


def test_packing_goes_on_while_open_pieces_fall_and_gives_its_bounds(spark):
    r = np.random.default_rng(2)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(r.integers(20, 101, 2000))], "id long, length int").repartition(4)
    items = durable(items)
    packed, bounds = packing.pack(items, 100, per_partition=40)
    rows, bounds = packed.collect(), bounds.collect()
    assert sorted(x.id for x in rows) == list(range(2000))
    bins = defaultdict(list)
    for x in rows:
        bins[x.sequence_id].append((x.offset, x.length))
    for parts in bins.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 100
    short = {k for k, parts in bins.items() if parts[0][1] < 100}
    counted = defaultdict(int)
    for k in short:
        counted[k >> 32] += 1
    given = defaultdict(int)
    for b in bounds:
        given[b.partition] += b.sequences
        assert b.lower_bound <= b.sequences and (not b.certified or b.lower_bound == b.sequences)
    assert given == counted
    assert len({b.partition for b in bounds}) > -(-sum(x.length < 100 for x in rows) // 40)
