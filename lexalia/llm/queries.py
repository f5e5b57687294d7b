"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexalia.llm import (
    decontaminate, line_dedup, lm_backoff, packing, quality_classifier, quality_crf, simhash,
    substring_dedup, token_alignment, toxicity, url_filter, warc_archive, whitening)
from lexalia.llm.rows import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed values of the query: (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
TOKENIZER = "word_bpe_49k.json"


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def url_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(URL_RULES, "host string, path string, verdict string")


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every url of ``pages``."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_rules(spark)).drop("url")


SQL["op1_url_filter"] = """
WITH rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
         FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT n, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS verdict
    FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)
"""


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and retention of every document."""
    return quality_crf.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_RE2_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL["op3_decontaminate"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_RE2_ALNUM}') AS w FROM documents),
b AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_RE2_ALNUM}') AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes,
       unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
hits AS MATERIALIZED (SELECT k, i, dw.n, item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
cover AS (SELECT k, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT k, i, n FROM hits), unnest(generate_series(0, n - 1)) AS t(j) GROUP BY k),
names AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hits WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (k) LEFT JOIN names USING (k)
"""


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that stand anywhere else."""
    found = substring_dedup.substring_dedup(read(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op4_substring_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 34)) AS t(i)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT k, i + j AS p FROM win JOIN rep USING (h), unnest(generate_series(0, 34)) AS t(j)),
words AS (SELECT k, p, w[p] AS x FROM d, unnest(generate_series(1, len(w))) AS t(p)),
kept AS (SELECT k, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (k, p) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (k)
"""


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without later places of three-line windows."""
    found = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed",
                        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


_BLANK = r"[\x20\x09-\x0D]"
SQL["op6_line_dedup"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
parts AS (SELECT k, doc_id, unnest(string_split(text, chr(10))) AS x,
        generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d),
lines AS MATERIALIZED (SELECT *, regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t,
        CASE WHEN regexp_matches(x, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END AS holds FROM parts),
numbered AS MATERIALIZED (SELECT *, sum(holds) OVER (PARTITION BY k ORDER BY p) AS w FROM lines),
three AS (SELECT k, doc_id, w, t || chr(10) || lead(t) OVER o || chr(10) || lead(t, 2) OVER o AS s
        FROM numbered WHERE holds = 1 WINDOW o AS (PARTITION BY k ORDER BY p)),
later AS (SELECT k, w FROM three WHERE s IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, k, w) > 1),
gone AS MATERIALIZED (SELECT DISTINCT k, w + j AS w FROM later, unnest([0, 1, 2]) AS u(j)),
marked AS (SELECT n.*, a.w IS NOT NULL AS here, b.w IS NOT NULL AS after FROM numbered n
        LEFT JOIN gone a ON a.k = n.k AND a.w = n.w LEFT JOIN gone b ON b.k = n.k AND b.w = n.w + 1),
kept AS (SELECT k, sum(holds) AS n_lines, count(*) FILTER (holds = 1 AND here) AS n_removed,
        string_agg(x, chr(10) ORDER BY p) FILTER (NOT CASE WHEN holds = 1 THEN here ELSE here AND after END) AS s,
        max_by(x, p) = '' AND max_by(here AND holds = 1, p) FILTER (p < last) AS cut
        FROM (SELECT *, max(p) OVER (PARTITION BY k) AS last FROM marked) GROUP BY k)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN cut AND ends_with(s, chr(10)) THEN left(s, -1) ELSE s END, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""


@_query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and backoff log-probability of every document."""
    return lm_backoff.score_texts(read(spark, sf_dir, "documents"))


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four principal components of every embedding, whitened."""
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    rows = found.select("*", F.posexplode("whitened").alias("place", "value"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation",
                       F.col("value").alias("whitened"), F.col("explained")[F.col("place")].alias("explained"),
                       "identity_error")


@_query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back through their index."""
    pages = read(spark, sf_dir, "pages")
    archive = warc_archive.write(pages)
    return warc_archive.fetch(archive, warc_archive.look_up(archive, pages.select("url")), with_payload=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and pair scores of every document under two tokenizers."""
    found, _ = token_alignment.align_tokenizers(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))
    return found
