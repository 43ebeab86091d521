"""Queries over status documents, texts, vectors, conversations and licenses."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabgrain.functions.skew import keep
from fabgrain.operators import chat, licenses, retrieval, text_index, vector_search
from fabgrain.operators import status_docs as docs
from fabgrain.operators.summary import moments, status_from_moments, status_summary
from fabgrain.plans import driver_tables as drv
from fabgrain.plans.driver_tables import LICENSES, MEASURED, measurements, table
from fabgrain.plans.registry import query
from fabgrain.session import new_path


def _summary(spark, sf):
    rows = measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value", "yield")
    return status_summary(rows, constant_yield=False)


STATUS = MEASURED + """,
s AS (SELECT lot_id, wafer_id, parameter, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
      avg(yield) AS yield FROM m GROUP BY lot_id, wafer_id, parameter)"""
DOCUMENTS = STATUS + """,
docs AS (
  SELECT lot_id || '_' || wafer_id || '_' || parameter AS id,
         'Wafer ' || wafer_id || ' in Lot ' || lot_id || ' status for ' || parameter || ': Average is ' || printf('%.4f', round(mean, 4))
         || ', Std Dev is ' || coalesce(printf('%.4f', round(std, 4)), 'nan') || ', Yield is ' || printf('%.2f', round(yield, 2)) || '%.' AS document,
         s.*
  FROM s
)"""


EXACT_SPREAD = """CASE WHEN count(value) > 1 THEN sqrt((count(value) * sum(value::HUGEINT * value::HUGEINT) - sum(value::HUGEINT) * sum(value::HUGEINT))::DOUBLE
      / (count(value) * (count(value) - 1))) END"""


@query("r1_sentences", f"""
WITH {DOCUMENTS.replace("stddev_samp(value)", EXACT_SPREAD)} SELECT id, document FROM docs""")
def _(spark, sf):
    # from exact sums on both sides, as the spread's last digits depend on the order of addition else
    rows = measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value", "yield")
    return docs.status_documents(status_from_moments(moments(rows))).select("id", "document")


@query("r2_metadata", f"""
WITH {DOCUMENTS} SELECT id, lot_id, wafer_id, parameter, mean, round(std, 2) AS std, yield FROM docs""")
def _(spark, sf):
    rows = docs.status_documents(_summary(spark, sf)).select("id", "metadata.*")
    return rows.withColumn("std", F.round("std", 2))


def words_sql(table: str, key: str, text: str) -> str:
    return f"""
words AS (
  SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS word FROM {table}
),
counts AS (
  SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % 4096 AS bucket, count(*) AS tf FROM words GROUP BY ALL
),
weights AS (
  SELECT bucket, ln(((SELECT count(*) FROM {table}) + 1) / (count(*) + 1)) AS idf FROM counts GROUP BY bucket
)"""


WORDS = words_sql("documents", "doc_id", "text")


def _documents(spark, sf):
    """The driver's documents are one file of few row groups, so they are dealt to all cores first."""
    return table(spark, sf, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)


def similar_sql(key: str, question: str, n: int) -> str:
    return f"""
q AS (SELECT bucket, coalesce(count(w), 0) * any_value(idf) AS q_weight FROM weights LEFT JOIN (
        SELECT unnest(string_split('{question}', ' ')) AS w) ON ('0x' || substr(md5(w), 1, 8))::BIGINT % 4096 = bucket GROUP BY bucket),
d AS (SELECT {key}, sqrt(sum((tf * idf) ** 2)) AS norm, sum(tf * idf * q_weight) AS dot
      FROM counts JOIN weights USING (bucket) JOIN q USING (bucket) GROUP BY {key}),
f AS (SELECT {key}, CASE WHEN norm > 0 THEN round(dot / (norm * (SELECT sqrt(sum(q_weight ** 2)) FROM q)), 12) ELSE 0 END AS exact FROM d),
best AS (SELECT {key}, round(exact, 6) AS similarity, row_number() OVER (ORDER BY exact DESC, {key})::INTEGER AS rank FROM f ORDER BY rank LIMIT {n})"""


@query("r3_text_vectors", f"""
WITH {WORDS}, n AS (SELECT doc_id, sqrt(sum((tf * idf) ** 2)) AS norm FROM counts JOIN weights USING (bucket) GROUP BY doc_id)
SELECT doc_id, bucket, round(tf * idf / norm, 6) AS weight
FROM counts JOIN weights USING (bucket) JOIN n USING (doc_id) WHERE norm > 0""")
def _(spark, sf):
    vectors = retrieval.hashed_tfidf(_documents(spark, sf), "doc_id", "text")
    return vectors.withColumn("weight", F.round("weight", 6))


QUESTION = "of the one that is on the with and by"


@query("r4_nearest_text", f"WITH {WORDS}, {similar_sql('doc_id', QUESTION, 3)} SELECT * FROM best")
def _(spark, sf):
    return retrieval.nearest_text(_documents(spark, sf), "doc_id", "text", QUESTION).withColumn("similarity", F.round("similarity", 6))


@query("r4_nearest_stored", f"WITH {WORDS}, {similar_sql('doc_id', QUESTION, 3)} SELECT * FROM best")
def _(spark, sf):
    vectors, weights = retrieval.document_vectors(_documents(spark, sf), "doc_id", "text")
    return retrieval.nearest_stored(vectors, weights, "doc_id", QUESTION).withColumn("similarity", F.round("similarity", 6))


def _first_vector(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _nearest_sql(distance: str) -> str:
    return f"""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, round({distance}, 12) AS exact FROM embeddings, q)
SELECT vec_id, abs(round(exact, 6)) AS distance, row_number() OVER (ORDER BY exact, vec_id)::INTEGER AS rank FROM d ORDER BY rank LIMIT 10"""


@query("r4_nearest_l2", _nearest_sql("list_distance(embedding::DOUBLE[], q::DOUBLE[])"))
def _(spark, sf):
    return retrieval.nearest_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf), 10).withColumn("distance", F.round("distance", 6))


@query("r4_nearest_cosine", _nearest_sql("1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])"))
def _(spark, sf):
    rows = retrieval.nearest_vectors(
        table(spark, sf, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf), 10, metric="cosine"
    )
    return rows.withColumn("distance", F.abs(F.round("distance", 6)))


@query("r4_nearest_pivots", _nearest_sql("list_distance(embedding::DOUBLE[], q::DOUBLE[])"))
def _(spark, sf):
    path = new_path(spark, "pivots")
    vector_search.build_pivots(table(spark, sf, "embeddings"), "vec_id", "embedding", path)
    return vector_search.nearest_around_pivots(spark, path, _first_vector(spark, sf)).rows.withColumn("distance", F.round("distance", 6))


def _many_sql(distance: str) -> str:
    return f"""
WITH d AS (
  SELECT q.vec_id AS question, c.vec_id, round({distance}, 12) AS exact
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) c)
SELECT question, vec_id, abs(round(exact, 6)) AS distance, row_number() OVER (PARTITION BY question ORDER BY exact, vec_id)::INTEGER AS rank
FROM d QUALIFY rank <= 5"""


def _many(spark, sf, metric):
    vectors = table(spark, sf, "embeddings")
    found = vector_search.nearest_join(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 5, metric)
    return found.withColumn("distance", F.abs(F.round("distance", 6)))


@query("r4_many_l2", _many_sql("list_distance(c.v, q.v)"))
def _(spark, sf):
    return _many(spark, sf, "l2")


@query("r4_many_cosine", _many_sql("1 - list_cosine_similarity(c.v, q.v)"))
def _(spark, sf):
    return _many(spark, sf, "cosine")


@query("r5_wafer_status", f"""
WITH {STATUS} SELECT lot_id, wafer_id, parameter, mean, round(std, 2) AS std, min, max, yield FROM s WHERE wafer_id = 'W03'""")
def _(spark, sf):
    return docs.wafer_status(_summary(spark, sf), "W03").withColumn("std", F.round("std", 2))


ISSUE = "wafers with low yield in Lot Lot17 for parameter R"


@query("r6_search", f"""
WITH {DOCUMENTS}, {words_sql('docs', 'id', 'document')}, {similar_sql('id', ISSUE.lower(), 5)}
SELECT rank, id, document, similarity FROM best JOIN docs USING (id)""")
def _(spark, sf):
    texts = keep(docs.status_documents(_summary(spark, sf)).select("id", "document"))
    return retrieval.search(texts, ISSUE).withColumn("similarity", F.round("similarity", 6))


@query("r6_indexed", f"""
WITH {DOCUMENTS}, {words_sql('docs', 'id', 'document')}, {similar_sql('id', ISSUE.lower(), 5)}
SELECT rank, id, document, similarity FROM best JOIN docs USING (id)""")
def _(spark, sf):
    texts = keep(docs.status_documents(_summary(spark, sf)).select("id", "document"))
    vectors, weights = retrieval.document_vectors(texts, "id", "document")
    path = new_path(spark, "index")
    text_index.build_index(vectors, weights, "id", path)
    found = text_index.ask(spark, path, ISSUE).rows
    return texts.join(F.broadcast(found), "id").select("rank", "id", "document", F.round("similarity", 6).alias("similarity")).orderBy("rank")


@query("r7_low_yield", f"""
WITH {STATUS} SELECT lot_id, wafer_id, parameter, yield, round(std, 2) AS std FROM s WHERE coalesce(yield, 100) < 96.5""")
def _(spark, sf):
    return docs.low_yield_wafers(_summary(spark, sf)).withColumn("std", F.round("std", 2))


@query("r7_lot_verdicts", f"""
WITH {STATUS}, p AS (SELECT lot_id, parameter, count(*) FILTER (coalesce(yield, 100) < 96.5) AS n FROM s GROUP BY ALL)
SELECT lot_id, sum(n)::BIGINT AS low_entries, CASE WHEN sum(n) > 0 THEN first(parameter ORDER BY n DESC, parameter) END AS worst_parameter,
       CASE WHEN sum(n) > 0 THEN 'low' ELSE 'good' END AS verdict
FROM p GROUP BY lot_id""")
def _(spark, sf):
    return docs.lot_verdicts(_summary(spark, sf))


def _context_sql(n: int) -> str:
    return f"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {n}"""


@query("r8_context", _context_sql(10))
def _(spark, sf):
    return chat.context_window(table(spark, sf, "conversations"))


@query("r8_context_of_4", _context_sql(4))
def _(spark, sf):
    return chat.context_window(table(spark, sf, "conversations"), keep_last=4)


@query("r9_suggestions", """
SELECT conv_id, turn, CASE WHEN NOT contains(lower(text), 'wafer') AND NOT contains(lower(text), 'the') THEN '搜尋異常晶圓|查詢特定 Wafer 狀態|有哪些可用工具？'
  WHEN contains(role || text, 'assistant') THEN '再查另一個晶圓|搜尋相似異常' ELSE '搜尋 Lot1 異常|查詢 Wafer_001 狀態|幫助我分析數據' END AS suggestions
FROM conversations""")
def _(spark, sf):
    # these texts hardly mention lots or tools, so other topic words and another marker are asked for
    chosen = chat.suggestions(F.col("text"), F.concat("role", "text"), topics=("wafer", "the"), tool="assistant")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(chosen, "|").alias("suggestions"))


# --- licenses

ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


@query("k1_decode", f"""
WITH {LICENSES}
SELECT license_id, o_orderstatus <> 'P' AS well_formed, CASE WHEN o_orderstatus <> 'P' THEN customer END AS customer,
       CASE WHEN o_orderstatus <> 'P' THEN machine_id END AS machine_id,
       CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '4-NOT SPECIFIED' THEN {ISO.format('due')} END AS expiry,
       CASE WHEN o_orderstatus <> 'P' THEN 'core,' || lower(o_orderstatus) END AS features,
       CASE WHEN o_orderstatus <> 'P' THEN {ISO.format('issued')} END AS issued_at
FROM licenses""")
def _(spark, sf):
    decoded = licenses.decode_key(drv.license_keys(spark, sf))
    return decoded.select(
        "license_id", "well_formed", "payload.customer", "payload.machine_id", "payload.expiry",
        F.array_join("payload.features", ",").alias("features"), "payload.issued_at",
    )


AS_OF = "1998-06-15T12:00:00"


@query("k2_status", f"""
WITH {LICENSES},
d AS (SELECT license_id, o_orderstatus = 'P' AS bad, o_orderpriority = '4-NOT SPECIFIED' AS endless, due, '{AS_OF}'::TIMESTAMP AS now FROM licenses),
e AS (SELECT license_id, bad, NOT endless AND now > due AS late,
             CASE WHEN bad THEN 0 WHEN endless THEN 999 ELSE date_sub('day', now, due) END::BIGINT AS days_remaining FROM d),
f AS (SELECT *, CASE WHEN bad THEN 'invalid' WHEN late THEN 'expired' WHEN days_remaining <= 7 THEN 'expiring' ELSE 'valid' END AS status FROM e)
SELECT license_id, days_remaining, status, status IN ('expiring', 'valid') AS login_allowed FROM f""")
def _(spark, sf):
    status = licenses.license_status(licenses.decode_key(drv.license_keys(spark, sf)), AS_OF)
    return status.select("license_id", "days_remaining", "status", "login_allowed")


@query("k3_expiry", f"WITH {LICENSES} SELECT license_id, due FROM licenses")
def _(spark, sf):
    return drv.licenses(spark, sf).select("license_id", "due")
