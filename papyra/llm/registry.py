"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import new_path
from papyra.llm.decontaminate import find_leaks
from papyra.llm.hmm import score
from papyra.llm.jaccard_join import jaccard_classes
from papyra.llm.language_id import identify_languages
from papyra.llm.license_scan import scan_licenses
from papyra.llm.line_dedup import dedup_lines
from papyra.llm.pieces import encode_pieces
from papyra.llm.secret_scan import scan_secrets
from papyra.llm.token_counts import count_tokens
from papyra.llm.va_search import top_k

#: Where the vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINES_SQL = r"""
WITH p AS (
  SELECT doc_id, i, parts[i] AS piece FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(1)), '([.!?]\s)', '\1' || chr(1), 'g'), '(\s)(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS parts
    FROM documents WHERE regexp_matches(text, '\S')))
), s AS (SELECT doc_id, j, string_agg(piece, '' ORDER BY i) AS span FROM (SELECT *, greatest(1, count(*) FILTER (regexp_matches(piece, '\S')) OVER (PARTITION BY doc_id ORDER BY i)) AS j FROM p) GROUP BY ALL),
l AS (SELECT *, len(list_filter(string_split_regex(span, '\s+'), lambda x: x <> '')) AS w FROM s),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY j) AS cum FROM l),
d AS (SELECT doc_id, list(regexp_replace(span, '^\s+|\s+$', '', 'g') ORDER BY j) AS lines FROM s GROUP BY doc_id),
r AS (
  SELECT 'start' AS kind, a.doc_id, a.j AS a, b.j AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.cum - a.cum + a.w >= 50 AND b.cum - b.w - a.cum + a.w < 50
  UNION ALL SELECT 'end', a.doc_id, a.j, b.j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.cum - a.cum + a.w >= 50 AND b.cum - a.cum < 50
), k AS (SELECT kind, doc_id, a, b, row_number() OVER (PARTITION BY kind, array_to_string(lines[a:b], chr(1)) ORDER BY doc_id, a) AS n FROM r JOIN d USING (doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS j FROM k WHERE n > 1),
t AS (SELECT s.doc_id, regexp_replace(coalesce(string_agg(span, '' ORDER BY s.j) FILTER (g.j IS NULL), ''), '\s+$', '') AS text, count(g.j) AS gone FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.j = s.j GROUP BY s.doc_id)
SELECT documents.* REPLACE (CASE WHEN gone > 0 THEN t.text ELSE documents.text END AS text) FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id WHERE coalesce(gone, 0) = 0 OR t.text <> ''
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, text, CASE WHEN len(ws) < 3 THEN list_aggregate(ws, 'string_agg', ' ')
    ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS gram
  FROM (SELECT doc_id, text, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), s AS (SELECT doc_id, text, count(*) AS n FROM g GROUP BY ALL),
p AS (
  SELECT a.doc_id AS da, a.text AS ta, b.doc_id AS db, b.text AS tb, count(*) AS o
  FROM g a JOIN g b ON a.gram = b.gram AND (a.doc_id, a.text) < (b.doc_id, b.text) GROUP BY ALL
), h AS (
  SELECT {'d': da, 't': ta} AS a, {'d': db, 't': tb} AS b
  FROM p JOIN s x ON x.doc_id = da AND x.text = ta JOIN s y ON y.doc_id = db AND y.text = tb
  WHERE o >= ceil(0.6 / 1.6 * (x.n + y.n) - 1e-9)
), e AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b.d) AS l FROM r GROUP BY a),
n AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, coalesce(l, doc_id) AS class_id, coalesce(links, 0) AS n_links
FROM documents LEFT JOIN n ON n.a = {'d': doc_id, 't': text} LEFT JOIN c ON c.a = {'d': doc_id, 't': text}
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", F.round("similarity", 6).alias("similarity"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), model_file)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat and walk spans of any length."""
    return scan_secrets(_table(spark, sf_dir, "documents"), longest=None)


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Each call starts a cache of its own, so that it counts the whole table."""
    return count_tokens(_table(spark, sf_dir, "documents"), new_path(spark, "token-cache"), vocabulary)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


_TOP_K_SQL = """
WITH d AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= 10
"""


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    found = top_k(_table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 20 == 0)
    return found.withColumn("distance", F.round("distance", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_token_counts, op3_sentencepiece, op4_jaccard_join, op5_line_dedup, op6_lm_scoring, op7_decontaminate, op8_license_scan, op9_exact_top_k, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": _JACCARD_SQL, "op5_line_dedup": _LINES_SQL, "op9_exact_top_k": _TOP_K_SQL}
