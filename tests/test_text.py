"""Status documents, text search, conversations and licenses."""

import hashlib
import json
import math
import re
from base64 import b64encode
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabgrain.operators import chat, licenses, retrieval
from fabgrain.operators import status_docs as docs
from fabgrain.operators.summary import status_summary


def rows_of(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_status_documents(measured):
    found = {r.id: r for r in docs.status_documents(status_summary(measured)).collect()}
    doc = found["Lot1_W01_Thickness"]
    assert doc.document == "Wafer W01 in Lot Lot1 status for Thickness: Average is 3.7500, Std Dev is 3.0957, Yield is 97.00%."
    assert (doc.metadata.lot_id, doc.metadata["yield"]) == ("Lot1", 97.0)
    lone = found["Lot1_W02_Thickness"]
    assert "Std Dev is nan" in lone.document and lone.metadata.std is None


def test_low_yields(measured, spark):
    summary = status_summary(measured)
    assert rows_of(docs.low_yield_wafers(summary, "Lot1"), "wafer_id", "parameter", "yield") == [("W01", "Resistance", 95.0)]
    verdicts = {r.lot_id: (r.low_entries, r.verdict, r.worst_parameter) for r in docs.lot_verdicts(summary).collect()}
    assert verdicts == {"Lot1": (1, "low", "Resistance"), "Lot10": (1, "low", "Thickness"), "Lot2": (0, "good", None)}
    missing = summary.withColumn("yield", F.lit(None).cast("double"))
    assert docs.low_yield_wafers(missing).count() == 0
    assert docs.wafer_status(summary, "W01", "Lot2").count() == 1 and docs.wafer_status(summary, "W01").count() == 4


TEXTS = [(0, "The wafer in Lot1 is fine."), (1, "Low yield: wafer W02, lot LOT7!"), (2, "yield yield yield"), (3, "é à — ñ"), (4, ""), (5, "!!!"), (6, "the the wafer")]


def brute_force(query, buckets):
    def counts(text):
        tokens = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
        return Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets for w in tokens)

    tf = {i: counts(t) for i, t in TEXTS}
    df = Counter(b for c in tf.values() for b in c)
    idf = {b: math.log((len(TEXTS) + 1) / (n + 1)) for b, n in df.items()}
    vec = lambda c: {b: n * idf.get(b, 0) for b, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = vec(counts(query))
    scores = []
    for i, c in tf.items():
        v = vec(c)
        if c:
            both = norm(v) * norm(q)
            scores.append((i, round(sum(x * q.get(b, 0) for b, x in v.items()) / both, 6) if both else 0.0))
    vectors = {(i, b): x / norm(vec(c)) for i, c in tf.items() for b, x in vec(c).items()}
    return sorted(scores, key=lambda s: (-s[1], s[0])), vectors


@pytest.mark.parametrize("query, buckets", [("low yield wafer", 4096), ("the wafer", 4096), ("yield", 5), ("nothing known", 4096)])
def test_text_search_matches_brute_force(spark, query, buckets):
    corpus = spark.createDataFrame(TEXTS, "id int, text string")
    scores, vectors = brute_force(query, buckets)
    got = retrieval.nearest_text(corpus, "id", "text", query, n=4, buckets=buckets)
    assert rows_of(got, "id", "similarity", "rank") == [(i, pytest.approx(s, abs=2e-6), r + 1) for r, (i, s) in enumerate(scores[:4])]
    mine = {(r.id, r.bucket): r.weight for r in retrieval.hashed_tfidf(corpus, "id", "text", buckets).collect()}
    assert mine == pytest.approx(vectors)


def test_search_returns_documents_in_order(spark):
    corpus = spark.createDataFrame(TEXTS, "id int, document string")
    scores, _ = brute_force("low yield", 4096)
    assert [r.id for r in retrieval.search(corpus, "low yield", n=2).collect()] == [i for i, _ in scores[:2]]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_vectors_match_numpy(spark, metric):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8)).astype("float32")
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, v array<float>")
    query = vectors[7].astype(float)
    far = np.linalg.norm(vectors - query, axis=1) if metric == "l2" else 1 - vectors @ query / np.linalg.norm(vectors, axis=1) / np.linalg.norm(query)
    best = np.argsort(far, kind="stable")[:5]
    got = retrieval.nearest_vectors(corpus, "id", "v", query.tolist(), 5, metric)
    assert [r.id for r in got.collect()] == best.tolist()
    assert [r.distance for r in got.collect()] == pytest.approx(far[best], abs=1e-5)


def test_any_encoder_can_be_plugged_in(spark):
    corpus = spark.createDataFrame(TEXTS, "id int, text string")
    got = retrieval.embed(corpus, "text", lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert {r.id: r.embedding for r in got.collect()} == {i: [float(len(t)), 1.0] for i, t in TEXTS}


def test_context_keeps_the_last_messages(spark):
    roles = ["system", "user", "assistant"]
    turns = [(1, t, roles[t % 3], f"m{t}") for t in range(12)] + [(2, 0, "user", "x")]
    got = chat.context_window(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "turn")
    assert [r.turn for r in got.where("conv_id = 1").collect()] == list(range(2, 12))
    assert {(r.turn % 3, r.role) for r in got.where("conv_id = 1").collect()} == {(0, "model"), (1, "user"), (2, "model")}
    assert got.where("conv_id = 2").count() == 1
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_suggestions(spark):
    answers = [("hello", "x"), ("The WAFER is ok", "called get_wafer_status"), ("that Lot", "x"), ("hello", "get_wafer_status")]
    got = spark.createDataFrame(answers, "answer string, response string").select(chat.suggestions(F.col("answer"), F.col("response")))
    assert [r[0] for r in got.collect()] == [chat.OFF_TOPIC, chat.AFTER_STATUS, chat.ON_TOPIC, chat.OFF_TOPIC]


def key(expiry="2026-05-18T23:59:59", signature="vault:v1:YWJj", **payload):
    body = {"customer": "c", "machine_id": "m", "features": ["core"], "issued_at": "2026-01-01T00:00:00", **payload}
    if expiry is not None:
        body["expiry"] = expiry
    return b64encode(json.dumps({"payload": body, "signature": signature}).encode()).decode()


@pytest.mark.parametrize("license_key, as_of, status, days, login", [
    (key(), "2026-05-12T00:00:00", "expiring", 6, True),
    (key(), "2026-05-10T23:59:59", "valid", 8, True),
    (key(), "2026-05-11T23:59:59", "expiring", 7, True),
    (key(), "2026-05-18T23:59:59", "expiring", 0, True),
    (key(), "2026-05-19T00:00:00", "expired", 0, False),
    (key(), "2026-05-20T12:00:00", "expired", -1, False),
    (key("2026-05-18T23:59"), "2026-05-18T23:59:00", "expiring", 0, True),
    (key(None), "2030-01-01T00:00:00", "valid", 999, True),
    (key("2026-05-18"), "2026-05-12T00:00:00", "invalid", 0, False),
    (key("2026-13-18T00:00:00"), "2026-05-12T00:00:00", "invalid", 0, False),
    (key(signature="vault:v1"), "2026-05-12T00:00:00", "invalid", 0, False),
    (key(signature="vault:v1:!!"), "2026-05-12T00:00:00", "invalid", 0, False),
    ("!!", "2026-05-12T00:00:00", "invalid", 0, False),
    (b64encode(b"{}").decode(), "2026-05-12T00:00:00", "invalid", 0, False),
    (b64encode(b"no json").decode(), "2026-05-12T00:00:00", "invalid", 0, False),
    (None, "2026-05-12T00:00:00", "invalid", 0, False),
])
def test_license_status(spark, license_key, as_of, status, days, login):
    keys = spark.createDataFrame([(license_key,)], "license_key string")
    row = licenses.license_status(licenses.decode_key(keys), as_of).first()
    assert (row.status, row.days_remaining, row.login_allowed) == (status, days, login)


def test_wrong_signature_is_invalid_but_never_expired(spark):
    keys = spark.createDataFrame([(key(),)], "license_key string")
    row = licenses.license_status(licenses.decode_key(keys), "2027-01-01T00:00:00", signature_ok=F.lit(False)).first()
    assert (row.status, row.days_remaining) == ("invalid", 0)


def test_expiry_assignment_and_round_trip(spark):
    asked = spark.createDataFrame(
        [("a", "2026-01-01 10:00:00", "2026-02-03", 5), ("b", "2026-01-01 10:00:00", None, 5), ("c", "2026-01-01 10:00:00", None, None)],
        "customer string, issued string, expiry_date string, expiry_days int",
    ).withColumn("due", licenses.expiry_time("issued", "expiry_date", "expiry_days"))
    assert [str(r.due) for r in asked.collect()] == ["2026-02-03 23:59:59", "2026-01-06 10:00:00", "2027-01-01 10:00:00"]
    full = asked.select(
        "customer", F.lit("m" * 200).alias("machine_id"), licenses.local_time(F.col("due")).alias("expiry"),
        F.array(F.lit("core")).alias("features"), F.lit("2026-01-01T10:00:00").alias("issued_at"),
    )
    decoded = licenses.decode_key(licenses.encode_key(full, F.lit("vault:v1:YWJj")))
    assert rows_of(decoded, "well_formed", "payload.expiry", "payload.customer") == [
        (True, "2026-02-03T23:59:59", "a"), (True, "2026-01-06T10:00:00", "b"), (True, "2027-01-01T10:00:00", "c")
    ]
    assert not any("\n" in r.license_key for r in decoded.collect())
