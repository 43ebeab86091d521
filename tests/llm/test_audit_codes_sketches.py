"""Filter audit, vector codes and document sketches against brute force, with odd rows and empty tables."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest

from fabgrain.llm import filter_audit, text_sketches, vector_codes

# -- filter audit --------------------------------------------------------------------------------------------------

LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [(1, LONG, "a"), (2, LONG, "b"), (2, LONG, "a"), (3, LONG + " #", "a"), (4, None, None), (5, "", "a"), (6, "AAA " * 60, "b"), (None, LONG, "b"),
         (7, "x " * 100_000, "b"), (8, LONG[:8] + "other", "a"), (9, LONG + " end", "b"), (10, LONG + " #", "a"), (None, "only", "a")]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (6, None, 1), (10, 1, 0), (None, 1, 1), (77, 1, 1)]


def audit_by_hand(rows, labels):
    failing = []
    for key, text, part in rows:
        text = text or ""
        words = text.encode().split()
        own = {f for f, bad in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)), ("D", any(c in "#$%&*|" for c in text)),
            ("E", any((t or "") == text and k is not None and (key is None or k < key) for k, t, _ in rows))) if bad}
        good = any(k == key and q == 1 for k, q, _ in labels if k is not None)
        toxic = any(k == key and t == 1 for k, _, t in labels if k is not None)
        failing.append((part or "", own, good, toxic))
    out = set()
    parts = {p for p, *_ in failing}
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    taken = Counter()
    for part, own, _, _ in failing:
        for o in orders:
            if first := next((f for f in o if f in own), None):
                taken[part, first] += 1
    for part in parts:
        for o in orders:
            left = [(own, g, t) for p, own, g, t in failing if p == part]
            everyone = list(left)
            for step, f in enumerate(o, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                out.add((part, o, step, len(left), len(gone), sum(f in x[0] for x in everyone) - len(gone), sum(x[0] == {f} for x in everyone),
                         sum(g for _, g, _ in gone), sum(t for _, _, t in gone), taken[part, f]))
    return out


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, s, 1, "x") for k, t, s in rows], "doc_id long, text string, source string, block int, mask string").repartition(parts)


@pytest.mark.parametrize("block_rows", [2, 20_000])
def test_audit_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(filter_audit, "BLOCK_ROWS", block_rows)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(docs_of(spark, TEXTS), labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in got.collect()} == audit_by_hand(TEXTS, LABELS)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(docs_of(spark, []), labels).count() == 0
    assert filter_audit.interactions(docs_of(spark, TEXTS), labels.limit(0)).where("good_lost > 0").count() == 0


def test_trie_holds_whole_texts_with_least_ids():
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("ab"), r.integers(0, 12))) for _ in range(400)]
    trie, numbers = filter_audit.Trie(), {}
    for i, t in enumerate(texts):
        key = None if i % 5 == 0 else 1000 - i
        assert numbers.setdefault(t, trie.insert(t, key)) == trie.insert(t, key)
    want = {numbers[t]: min((1000 - i for i, u in enumerate(texts) if u == t and i % 5), default=None) for t in numbers}
    assert dict(trie.terminals()) == want


def test_heavy_prefixes_are_lengthened_and_tries_closed(spark, monkeypatch):
    """Texts that share a long start, many small ranges, tries of a few bytes."""
    monkeypatch.setattr(filter_audit, "BLOCK_ROWS", 7)
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 50)
    rows = [(i, "common start " * 30 + str(i % 40), "a") for i in range(300)] + [(i + 300, "same", "b") for i in range(100)]
    got = filter_audit.masks(docs_of(spark, rows, 8), range_bytes=2000).collect()
    assert {r["id"] for r in got if not r["mask"] & filter_audit.COPY} == set(range(40)) | {300}


# -- vector codes --------------------------------------------------------------------------------------------------

def codes_by_hand(rows, rounds=4):
    kept = [(k, lab, tuple(int(np.floor(1024 * float(x))) for x in v)) for k, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:256]
    width = len(kept[0][2]) // 4
    books = [[list(r[2][p * width : (p + 1) * width]) for r in start] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for r in kept:
                part = r[2][p * width : (p + 1) * width]
                members[nearest(part, book)[1]].append(part)
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(members, book, strict=True)]
    out = []
    for k, lab, v in kept:
        found = [nearest(v[p * width : (p + 1) * width], book) for p, book in enumerate(books)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), lab))
    sums = Counter()
    for _, _, e, lab in out:
        sums[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((k, c, e, sums[lab], sha) for k, c, e, lab in out)


def vectors(n, spread, seed=1):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(6, 8))
    return [(i, [float(np.float32(x)) for x in middles[i % 6] + spread * r.normal(size=8)], i % 3 or None) for i in range(n)]


ODD = [(900, None, 1), (901, [1.0, None] + [0.0] * 6, 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("inf")] + [0.0] * 7, 1),
       (5, [0.25] * 8, 2), (5, [0.25] * 8, 2), (5, [-0.25] * 8, None), (None, [0.5] * 8, 2), (950, [-1e-9] * 8, 2)]


@pytest.mark.parametrize("n,spread", [(20, 0.5), (700, 0.0), (700, 0.01), (700, 1.0)])
def test_codes_equal_brute_force(spark, n, spread):
    rows = vectors(n, spread) + ODD
    frame = spark.createDataFrame([(k, v, lab, "x", 1) for k, v, lab in rows], "vec_id long, embedding array<float>, label int, code string, trees int")
    got = vector_codes.compress(frame.repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == codes_by_hand(rows)


def test_codes_of_nothing_and_of_other_shapes(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame(ODD[:4], schema)).count() == 0
    assert [tuple(r)[:4] for r in vector_codes.compress(spark.createDataFrame([(1, [], 1)], schema)).collect()] == [(1, "00000000", 0, 0)]
    with pytest.raises(Exception, match="equal parts|different lengths"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], schema)).collect()
    with pytest.raises(Exception, match="different lengths"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], schema)).collect()


@pytest.mark.parametrize("spread", [1, 30, 1000])
def test_cover_tree_keeps_its_rules(spread):
    r = np.random.default_rng(2)
    points = (r.integers(-3000, 3000, (12, 5)).repeat(60, axis=0) + r.integers(-spread, spread + 1, (720, 5))).astype(np.int64)
    tree = vector_codes.build(points)
    assert sorted(tree.order.tolist()) == list(range(720)) and (tree.points == points[tree.order]).all()
    before = set()
    for level in tree.levels:
        last = np.r_[level.first[1:], 720]
        centres = {tuple(tree.points[c]) for c in level.centre}
        assert before <= centres  # nested
        before = centres
        for a, b, c, radius in zip(level.first, last, level.centre, level.radius, strict=True):
            assert a <= c < b and np.sqrt(((tree.points[a:b] - tree.points[c]) ** 2).sum(1).max()) <= radius * (1 + 1e-12)


def test_subtrees_go_as_a_whole_and_exactly():
    r = np.random.default_rng(4)
    points = (r.integers(-3000, 3000, (12, 5)).repeat(60, axis=0) + r.integers(-5, 6, (720, 5))).astype(np.int64)
    book = points[::60].copy()
    tree = vector_codes.build(points)
    found = vector_codes.assign(tree, book)
    want = ((tree.points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (vector_codes.entries(found, 720) == want).all()
    assert len(found.rows) < 100 and (found.last - found.first).max() > 20
    number, total = vector_codes.totals(tree, book)
    assert number.tolist() == np.bincount(want, minlength=12).tolist()
    assert all((total[e] == tree.points[want == e].sum(0)).all() for e in range(12))


def test_large_components_are_exact_or_refused():
    a, b = np.array([[2**28, 1]]), np.array([[-(2**28), 0], [0, 0]])
    assert vector_codes.squared(a, b).tolist() == [[2**58 + 1, 2**56 + 1]]
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.squared(np.array([[2**40]]), np.array([[1]]))


# -- document sketches ---------------------------------------------------------------------------------------------

def pieces(text):
    """Paragraphs with the number of their occurrence."""
    seen = Counter()
    out = set()
    for p in text_sketches.paragraphs(text.encode()):
        seen[p] += 1
        out.add((p, seen[p]))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_brute_force(spark, odd_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    got = text_sketches.fingerprints(odd_docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[1]) == 2 and len({r["fingerprint"] for r in by[1] + by[7] + by[None]}) == 1
    ordered = [(7, "a b c d e f g"), (6, rows[7][1]), (5, rows[6][1]), (4, rows[5][1]), (3, ""), (2, ""), (1, "a b c d e f g")]
    for (key, text), (_, after) in itertools.pairwise(ordered):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = by[key][0]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r["near_edited"] == jaccard(pieces(text), pieces(new)) and r["near_next"] == jaccard(pieces(text), pieces(after))
    # of the two rows with id 1, one is followed by the other and one by the null id; after that comes the first row again
    assert [r["near_next"] for r in by[1] + by[None]] == [1.0] * 3


def test_one_document_follows_itself(spark):
    only = spark.createDataFrame([(4, "ab\ncd")], "doc_id long, text string")
    r = text_sketches.fingerprints(only).first()
    assert (r["near_next"], r["n_chars"], r["edited_sha256"]) == (1.0, 5, hashlib.sha256(b"ab\nab").hexdigest())
    assert text_sketches.fingerprints(only.limit(0)).count() == 0


def test_every_document_meets_its_next(spark):
    rows = [(i * 3, f"line {i}\n" * 3 + f"next {i}\n" + "end " * i) for i in range(150)]
    got = text_sketches.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    texts = dict(rows)
    for r in got:
        after = texts[r["doc_id"] - 3 if r["doc_id"] else 149 * 3]
        text = texts[r["doc_id"]]
        assert r["edited_sha256"] == hashlib.sha256(text_sketches.edited(text, after).encode()).hexdigest()
        assert r["near_next"] == jaccard(pieces(text), pieces(after))


def test_peeling_recovers_the_difference():
    r = np.random.default_rng(5)
    def keys(n): return r.integers(0, 1 << 63, n).astype(np.uint64)  # noqa: E704
    shared, sizes = keys(5000), [(0, 0), (1, 0), (0, 3), (40, 2), (700, 900)]
    sets = [(keys(a), keys(b)) for a, b in sizes]
    got = text_sketches.differing([(np.r_[shared, a], np.r_[b, shared]) for a, b in sets])
    for (a, b), (x, y) in zip(sets, got, strict=True):
        assert sorted(a.tolist()) == sorted(x.tolist()) and sorted(b.tolist()) == sorted(y.tolist())


def test_a_small_sketch_fails_openly():
    r = np.random.default_rng(6)
    a, b = (r.integers(0, 1 << 63, 100).astype(np.uint64) for _ in range(2))
    assert not text_sketches.peel(text_sketches.sketch([a], 4).minus(text_sketches.sketch([b], 4))).done[0]


def test_stored_fingerprints_can_be_compared(spark):
    lines = [f"a line of some length, number {i}\n" for i in range(300)]
    rows = [(1, "".join(lines)), (2, "".join(lines[:100] + ["short\n"] + lines[101:])), (3, "other\n" * 500)]
    prints = {r["doc_id"]: r["fingerprint"] for r in text_sketches.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert text_sketches.likeness_of(prints[1], prints[1]) == 1.0
    assert text_sketches.likeness_of(prints[1], prints[2]) in (None, jaccard(pieces(texts[1]), pieces(texts[2])))
    assert text_sketches.likeness_of(prints[1], prints[3]) is None


def test_paragraphs_cover_the_text_and_follow_edits():
    text = ("word " * 40_000 + "\n") + "".join(chr(97 + i * i % 26) for i in range(100_000)) + "\n\n"
    data = text.encode()
    cut = text_sketches.paragraphs(data)
    assert b"".join(cut) == data and b"\n" in cut
    moved = text_sketches.paragraphs(b"inserted" + data)
    assert len(set(cut) - set(moved)) <= 1
