"""The registered queries of the text operators, with their production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabgrain.llm import (
    byte_bpe,
    compression_rules,
    exact_dedup,
    filter_audit,
    ngram_join,
    packing,
    quality_cnn,
    secret_scan,
    substring_dedup,
    text_sketches,
    token_store,
    vector_codes,
    warc,
)
from fabgrain.llm.common import table
from fabgrain.plans.registry import query
from fabgrain.session import new_path

#: Place of a tokenizer file.
tokenizer = public_tokenizers.path
#: How word_bpe_49k.json splits folded text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@query("op1_warc", """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN later IS NULL THEN 'response' ELSE 'revisit' END AS record_type, later AS refers_to
FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
             CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000
                  THEN nullif(max(page_id) OVER (PARTITION BY html), page_id) END AS later
      FROM pages)
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.payload_table(spark, path)


@query("op2_token_store")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write(table(spark, folder, "documents"), path, tokenizer("word_bpe_49k.json"), WORD_PATTERN, end_id=1)
    return token_store.documents(spark, path).withColumnRenamed("key", "doc_id")


@query("op3_ngram_join", r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS grams FROM texts),
classes AS (SELECT min(doc_id) AS rep, grams, len(grams) AS n FROM sets WHERE len(grams) > 0 GROUP BY grams),
postings AS (SELECT rep, n, unnest(grams) AS gram FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM postings a JOIN postings b ON a.gram = b.gram AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reached AS (SELECT rep AS node, rep AS other FROM classes UNION SELECT node, b FROM reached JOIN links ON other = a),
roots AS (SELECT node, min(other) AS root FROM reached GROUP BY node)
SELECT doc_id, len(s.grams) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON s.grams = c.grams LEFT JOIN roots ON node = rep
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


@query("op4_quality_cnn")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_cnn.score(docs, quality_cnn.fit(docs, table(spark, folder, "labels")))


@query("op5_compression_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return compression_rules.judge(table(spark, folder, "documents"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op7_substring_dedup", r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lists AS (
  SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS h FROM texts WHERE len(w) >= 50),
windows AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS place FROM lists),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
repeats AS (SELECT doc_id, place FROM windows JOIN firsts USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM texts),
marked AS (
  SELECT a.doc_id, word, a.place,
         count(r.place) OVER (PARTITION BY a.doc_id ORDER BY a.place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words a LEFT JOIN repeats r ON a.doc_id = r.doc_id AND a.place = r.place),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept k USING (doc_id)
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


@query("op8_certified_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN, room=2048, end_id=0)


@query("op9_secret_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, folder, "documents")))


@query("op10_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(table(spark, folder, "documents"))


@query("op11_filter_audit", r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, (len(w) < 50)::INT + 2 * (100 * list_unique(w) < 65 * len(w))::INT
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (first IS NOT NULL AND (doc_id IS NULL OR doc_id > first))::INT AS mask,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM texts LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, s::INT AS s, 1 << (instr('ABCDE', o[s]) - 1) AS own,
                 coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (instr('ABCDE', o[i]) - 1))), 0)::BIGINT AS before
          FROM orders, (SELECT unnest(range(1, 6)) AS s))
SELECT part, o AS filter_order, s AS step,
       coalesce(sum(n) FILTER (mask & before = 0 AND mask & own = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // nullif(bit_count(mask), 0)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY part, o, s
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd rounds as a chain of common table expressions, with whole numbers throughout."""
    chain = ""
    for k in range(rounds + 1):
        chain += f""",
near{k} AS (
  SELECT r, p, x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 256 + e) AS best
  FROM pieces JOIN book{k} USING (p) GROUP BY r, p, x)"""
        if k < rounds:
            chain += f""",
sums{k} AS (
  SELECT p, best % 256 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM pieces))) AS i)
  GROUP BY ALL),
means{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM sums{k} GROUP BY p, e),
book{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e))"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id, v) AS r
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
pieces AS (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
book0 AS (SELECT p, r - 1 AS e, x AS c FROM pieces WHERE r <= 256){chain},
coded AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, c, unnest(range(1, len(c) + 1)) AS i FROM book{rounds})) AS codebooks_sha256
FROM coded JOIN kept USING (r)"""


@query("op12_cover_tree_codes", _codes_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


@query("op13_paragraph_sketch")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return text_sketches.fingerprints(table(spark, folder, "documents"))
