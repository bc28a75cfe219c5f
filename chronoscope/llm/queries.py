"""Registered queries of the training-data operators: thin calls over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, fixity, language, mixing, near_duplicates, passages, quality, secrets, sharding, spelling, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_simhash_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_subword_quality(spark, sf_dir):
    return quality.quality_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_family_svm_language(spark, sf_dir):
    return language.languages_of_documents(table(spark, sf_dir, "documents"))


@query
def op1_minimax_sharding(spark, sf_dir):
    return sharding.shard_manifest(table(spark, sf_dir, "documents"))


@query
def op10_pivotal_mixing(spark, sf_dir):
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


@query
def op7_blob_ledger_secrets(spark, sf_dir):
    return secrets.secrets_by_deliveries(table(spark, sf_dir, "documents"))


@query
def op3_merkle_fixity(spark, sf_dir):
    """The archive of all pages against a replica with planted damage; files of 50 pages."""
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(fixity.archive(pages, file_pages=50), fixity.damaged(pages, file_pages=50))


ORACLE["op3_merkle_fixity"] = """
WITH recs AS (
  SELECT page_id, page_id // 50 AS file, damaged,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
         || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html'
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body
         || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM (SELECT page_id, url, html AS body, false AS damaged FROM pages
        UNION ALL
        SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN '~' || substr(html, 2) ELSE html END, true FROM pages)
), placed AS (
  SELECT damaged, file, page_id, sha256(record) AS sha256,
         row_number() OVER (PARTITION BY damaged, file ORDER BY page_id) - 1 AS nth,
         count(*) OVER (PARTITION BY damaged, file) AS n,
         CAST(sum(strlen(record)) OVER (PARTITION BY damaged, file ORDER BY page_id) AS BIGINT) AS "end", strlen(record) AS length
  FROM recs
), a AS (SELECT * FROM placed WHERE NOT damaged),
b AS (SELECT * FROM placed WHERE damaged AND NOT (file % 7 = 3 AND nth = n - 1))
SELECT a.file, a.nth, a.page_id, a."end" - a.length AS start, a."end", a.sha256, b.sha256 AS replica_sha256,
       CASE WHEN b.sha256 IS NULL THEN 'missing' ELSE 'changed' END AS status
FROM a LEFT JOIN b USING (file, nth)
WHERE a.sha256 IS DISTINCT FROM b.sha256
"""


@query
def op4_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op4_benchmark_decontamination"] = r"""
WITH item AS (
  SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark
), doc AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), irun AS (
  SELECT item_id, len(w) AS n, i AS at, array_to_string(w[i:i + 4], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item WHERE len(w) >= 5)
), iw AS (SELECT run, 1.0 / count(DISTINCT item_id) AS weight FROM irun GROUP BY run),
drun AS (
  SELECT doc_id, i AS pos, array_to_string(w[i:i + 4], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)
), proposed AS (
  SELECT DISTINCT d.doc_id, i.item_id, greatest(0, least(d.pos - i.at, len(doc.w) - i.n)) AS first_word, i.n
  FROM drun d JOIN irun i USING (run) JOIN doc ON doc.doc_id = d.doc_id
), win AS (
  SELECT p.doc_id, p.item_id, p.first_word, array_to_string(w[i:i + 4], ' ') AS run
  FROM (SELECT p.*, doc.w, unnest(range(first_word + 1, least(first_word + n, len(doc.w)) - 3)) AS i FROM proposed p JOIN doc USING (doc_id)) p
), wc AS (SELECT doc_id, item_id, first_word, run, count(*) AS c FROM win GROUP BY ALL),
ic AS (SELECT item_id, run, count(*) AS c FROM irun GROUP BY ALL),
theirs AS (
  SELECT wc.doc_id, wc.item_id, wc.first_word, sum(wc.c * CASE WHEN ic.run IS NULL THEN 1.0 ELSE iw.weight END) AS s,
         sum(CASE WHEN ic.run IS NULL THEN 0.0 ELSE least(wc.c, ic.c) * iw.weight END) AS common
  FROM wc LEFT JOIN ic ON ic.item_id = wc.item_id AND ic.run = wc.run LEFT JOIN iw ON iw.run = ic.run
  GROUP BY ALL
), own AS (SELECT item_id, sum(c * weight) AS s FROM ic JOIN iw USING (run) GROUP BY item_id),
sim AS (SELECT doc_id, item_id, first_word, common / (own.s + theirs.s - common) AS similarity FROM theirs JOIN own USING (item_id))
SELECT doc_id, item_id, round(max(similarity), 9) AS similarity, CAST(min(first_word) FILTER (round(similarity, 9) = round(best, 9)) AS BIGINT) AS first_word
FROM (SELECT *, max(similarity) OVER (PARTITION BY doc_id, item_id) AS best FROM sim WHERE similarity >= 0.8 - 1e-9)
GROUP BY doc_id, item_id
"""


@query
def op6_order_minhash(spark, sf_dir):
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query
def op8_suffix_automata_passages(spark, sf_dir):
    return passages.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def _secret_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a,
         length(m[i]) AS n, {rank} AS rank, '{kind}' AS kind
  FROM (SELECT doc_id, m, c, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS c, string_split_regex(t, '{p}') AS g FROM d))
  WHERE length(c[i]) >= {least}"""


ORACLE["op7_blob_ledger_secrets"] = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(
    _secret_spans(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(secrets.RULES)) + """
), f AS (
  SELECT doc_id, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, rank) AS spans,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
  FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""

ORACLE["op8_suffix_automata_passages"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
lost AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS text
  FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op11_url_range_join(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA))


ORACLE["op11_url_range_join"] = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES """ + ", ".join(map(str, URL_RULES)) + r"""),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t, row_number() OVER () AS nth FROM pages
), parts AS (
  SELECT nth, page_id, translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), fits AS (
  SELECT nth, arg_max(rhost || rpath, (length(rhost) + length(rpath)) * 1000 + length(rhost)) AS rule,
         arg_max(rverdict, (length(rhost) + length(rpath)) * 1000 + length(rhost)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY nth
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (nth)
"""


@query
def op12_charpoly_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_spelling_tiles(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


ORACLE["op13_spelling_tiles"] = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t
  FROM (SELECT unnest(range(256)) AS k)
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n,
         CASE WHEN b.most >= 10 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.n = b.most) END AS form
  FROM words w LEFT JOIN best b USING (word)
), path AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
FROM forms f JOIN path p USING (word) JOIN forms l ON l.word = p.root AND l.form IS NULL
"""
