"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .lines import line_runs
from .mixing import domain_labels, mixing_rates
from .packing import pack_documents
from .pivots import embedding_components
from .positive import quality_scores
from .quality import quality_rules
from .revisits import header_lines, page_captures, resolve_revisits
from .secrets import secret_spans
from .sequenced import applied_changes
from .simhash import simhash_components
from .sortmeans import cluster_digest
from .sortmeans import oracle as sortmeans_oracle
from .substring import substring_dedup
from .toxicity import toxicity_scores


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Target weights of the domains' tokens.
MIX = {"good": 0.9, "poor": 0.05, "toxic": 0.05}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")), MIX)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", header_lines(found["headers"]))


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages
), urls AS (
  SELECT page_id, html,
    lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]+)', 1)) AS host,
    regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?[^/?:]+:([0-9]+)', 1) AS port,
    regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+([^?]*)', 1) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='))), '&') AS query
  FROM parts
), canon AS (
  SELECT page_id, html, CASE WHEN host <> '' THEN regexp_replace(host, '^www[0-9]*\.', '')
    || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END
    || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical_url
  FROM urls
), first AS (
  SELECT 2 * page_id AS record_id, canonical_url, 10 * page_id AS ts, md5(html) AS tag, length(html) AS size FROM canon
), again AS (
  SELECT 2 * page_id + 1 AS record_id, canonical_url, 10 * page_id + 5005 AS ts, md5(html) AS tag, page_id % 97 AS day FROM canon
), joined AS (
  SELECT a.*, f.record_id AS rid, f.ts AS rts, f.tag AS rtag, f.size AS size
  FROM again a ASOF LEFT JOIN first f ON a.canonical_url = f.canonical_url AND a.ts > f.ts
)
SELECT record_id, canonical_url, ts,
  CASE WHEN rid IS NULL THEN 'unmatched' WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN tag = rtag THEN rid END AS response_id, CASE WHEN tag = rtag THEN rts END AS response_ts,
  CAST(CASE WHEN tag = rtag THEN 200 END AS INTEGER) AS status,
  CASE WHEN tag = rtag THEN 'content-length: ' || size || ',content-type: text/html,date: now,etag: "' || tag || '",last-modified: day ' || day END AS headers
FROM joined
"""


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=20)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), window=2048)


def op7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs(table(spark, sf_dir, "documents"), min_lines=2)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), distance=4, shingle=4)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 19))) AS s FROM d)
), first AS (
  SELECT k, min((doc_id, s)) AS f FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, s + o AS p FROM (SELECT win.doc_id, win.s, unnest(range(0, 20)) AS o FROM win JOIN first USING (k) WHERE (win.doc_id, win.s) <> f)
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d
), marked AS (
  SELECT each.doc_id, word, each.p, gone.p IS NOT NULL AS removed FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p
), per_doc AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT removed) AS kept FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN per_doc USING (doc_id)
"""

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS place FROM documents WHERE text <> ''
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS p FROM l WHERE regexp_matches(line, '[^ \t\n\v\f\r]')
), win AS (
  SELECT a.doc_id, a.p, a.line AS l1, b.line AS l2 FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.p = a.p + 1
), first AS (
  SELECT l1, l2, min((doc_id, p)) AS f FROM win GROUP BY 1, 2
), gone AS (
  SELECT DISTINCT doc_id, p + o AS p FROM (SELECT win.doc_id, win.p, unnest([0, 1]) AS o FROM win JOIN first USING (l1, l2) WHERE (win.doc_id, win.p) <> f)
), islands AS (
  SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gone
), runs AS (
  SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run, sum(n)::BIGINT AS n_removed FROM (SELECT doc_id, g, count(*) AS n FROM islands GROUP BY 1, 2) GROUP BY 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS t FROM l LEFT JOIN w ON w.doc_id = l.doc_id AND w.place = l.place LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p WHERE gone.p IS NULL GROUP BY 1
), counts AS (
  SELECT doc_id, count(*) AS n_lines FROM w GROUP BY 1
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op11_sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied_changes(table(spark, sf_dir, "client_changes"))


def op12_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sortmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_digest(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_secrets": op2_secrets, "op3_revisits": op3_revisits, "op4_substring": op4_substring, "op5_quality": op5_quality, "op6_packing": op6_packing, "op7_pivots": op7_pivots, "op8_lines": op8_lines, "op9_simhash": op9_simhash, "op10_toxicity": op10_toxicity, "op11_sequenced": op11_sequenced, "op12_positive": op12_positive, "op13_sortmeans": op13_sortmeans}


def oracle_sql() -> dict[str, str]:
    return {"op3_revisits": OP3_SQL, "op4_substring": OP4_SQL, "op8_lines": OP8_SQL, "op13_sortmeans": sortmeans_oracle()}
