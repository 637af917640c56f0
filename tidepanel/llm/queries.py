"""The queries op1_ to op10_: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import blob_ledger, mixing
from tidepanel.llm.bpe_dp import encode
from tidepanel.llm.common import materialize, ready, table
from tidepanel.llm.interp_lm import score_texts
from tidepanel.llm.langid_ecoc import identify
from tidepanel.llm.quality_llr import quality
from tidepanel.llm.range_join import range_join
from tidepanel.llm.superminhash import near_duplicates
from tidepanel.llm.template_ec import main_text
from tidepanel.llm.warc_index import archive_index


def op1_template_ec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = materialize(blob_ledger.scan(versions, blob_ledger.empty_ledger(spark)))
    return blob_ledger.digest(blob_ledger.findings(versions, ledger).select("doc_id", "spans"))


def op3_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_langid_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_interp_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "stamp")


def op9_bpe_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_template_ec,
    op2_blob_ledger,
    op3_range_join,
    op4_superminhash,
    op5_quality_llr,
    op6_langid_ecoc,
    op7_interp_lm,
    op8_warc_index,
    op9_bpe_dp,
    op10_mixing,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: lambda spark, sf_dir, q=q: q(ready(spark), sf_dir) for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS k, '{kind}' AS kind, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n
  FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, b, g FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, string_split_regex(t, '{pattern}') AS b, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d))
  WHERE length(g[i]) >= {least}"""


#: The base rules in the contract's own words; what the method adds is taken as it is.
_BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
]
_SPANS = " UNION ALL ".join(_spans_sql(r[0], k, *r[1:]) for k, r in enumerate(_BASE + [(r.kind, r.pattern, r.group, r.least) for r in blob_ledger.RULES[len(_BASE) :]]))
_SPELLED = "string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k)"

ORACLES: dict[str, str] = {
    "op2_blob_ledger": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_SPANS}), g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    {_SPELLED} FILTER (k < 3) AS base, {_SPELLED} AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
""",
    "op8_warc_index": """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www[0-9]*\\.', ''), '.')), ',')
    || ')' || coalesce(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)), ''), '/') AS urlkey,
  strftime(TIMESTAMP '2020-01-01' + INTERVAL 1 SECOND * page_id, '%Y%m%d%H%M%S') AS stamp
FROM p LEFT JOIN f ON f.digest = p.digest
""",
    "op3_range_join": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS id, vec_id AS seen FROM v
  UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a
), c AS (
  SELECT id, min(seen) AS component_id FROM r GROUP BY id
)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.id = v.vec_id
""",
    "op4_superminhash": """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d
), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s
), e AS (SELECT doc_id, unnest(g) AS x FROM s
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * o.both >= 75 * (p.n + q.n - o.both)
), r AS (
  SELECT doc_id AS id, doc_id AS seen FROM n
  UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a
), c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.id = n.doc_id
""",
}
