"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.llm import ctw, decontaminate, license_scan, mixing, sharding, simhash, syncmers, toxicity, url_filter, warc
from lumicat.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.warc_roundtrip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.drop("spans")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    ops = (
        op1_warc, op2_license_scan, op3_syncmers, op4_url_filter, op5_decontaminate,
        op6_mixing, op7_toxicity, op8_ctw, op9_simhash, op10_sharding, pipeline,
    )
    return {f.__name__: f for f in ops}


_OP1 = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS owner FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM o
"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op2_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    templates = ", ".join(
        f"({_sql_text(label)}, [{', '.join(map(_sql_text, t))}], {license_scan.needed(len(t), license_scan.THRESHOLD)})"
        for label, text in license_scan.TEMPLATES for t in [license_scan.template_tokens(text)]
    )
    phrases = ", ".join(f"({_sql_text(p)}, {len(p.split())}, {_sql_text(label)})" for p, label in license_scan.PHRASES)
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH templates(label, tokens, need) AS (VALUES {templates}),
phrases(phrase, width, label) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, '{word}') AS words FROM d),
places AS (
  SELECT r, label, i FROM (SELECT r, words, unnest(range(len(words))) AS i FROM w WHERE {" OR ".join(f"contains(low, {_sql_text(max(p.split(), key=len))})" for p, _ in license_scan.PHRASES)}), phrases
  WHERE array_to_string(words[i + 1 : i + width], ' ') = phrase
),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
lines AS (SELECT r, list_transform(string_split(low, chr(10)), lambda b: list_intersect(list_distinct(regexp_extract_all(b, '{word}')), [{', '.join(map(_sql_text, sorted({x for _, text in license_scan.TEMPLATES for x in license_scan.template_tokens(text)})))}])) AS kept FROM d),
blocks AS (
  SELECT r, list_distinct(flatten(kept[i + 1 : i + {license_scan.LINES}])) AS tokens
  FROM (SELECT r, kept, unnest(range(len(kept))) AS i FROM lines)
),
more AS (
  SELECT r, list(DISTINCT label) AS labels, max(len(list_intersect(t.tokens, b.tokens))::DOUBLE / len(t.tokens)) AS score
  FROM blocks b, templates t WHERE len(list_intersect(t.tokens, b.tokens)) >= t.need GROUP BY r
)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(base.n_base, 0) AS n_base, base.first_word, base.last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       coalesce(more.score, 0.0) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


def _op4_sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = low.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    rules = ", ".join(f"({_sql_text(h)}, {_sql_text(p)}, {_sql_text(v)})" for h, p, v in url_filter.RULES)
    prefixes, sites, domains, folders, endings = (", ".join(map(_sql_text, x)) for x in (url_filter.PREFIXES, url_filter.LISTED_SITES, url_filter.DOMAINS, url_filter.FOLDERS, url_filter.ENDINGS))
    return f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {rules}),
p AS (
  SELECT row_number() OVER () AS r, page_id, url, {host} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), ''), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^{url_filter.TRACKING}(=|$)'))) AS params
  FROM pages
),
c AS (
  SELECT *, host || regexp_replace(path, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM p
),
listed AS (
  SELECT concat(a, s, d, f, n, e) AS canonical
  FROM unnest([{prefixes}]) p(a), unnest([{sites}]) t(s), unnest([{domains}]) q(d), unnest([{folders}]) u(f), range({url_filter.LISTED_PAGES}) v(n), unnest([{endings}]) w(e)
),
best AS (
  SELECT r, arg_max(r_host || r_path, length(r_host) + length(r_path)) AS rule, arg_max(r_verdict, length(r_host) + length(r_path)) AS verdict
  FROM c, rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY r
)
SELECT c.page_id, c.host, c.path, best.rule,
       coalesce(best.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       best.rule IS NULL AND l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN best USING (r) LEFT JOIN listed l ON c.canonical = l.canonical
"""


_OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1 : i + 10], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, i, size, array_to_string(w[i + 1 : i + size], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)
), hit AS (SELECT r, i, size, item_id FROM dw JOIN bw USING (size, win)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, sha256(array_to_string(list_sort(list(id)), ',')) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       coalesce(items.items_sha256, sha256('')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _OP1, "op2_license_scan": _op2_sql(), "op4_url_filter": _op4_sql(), "op5_decontaminate": _OP5}
