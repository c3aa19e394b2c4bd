"""Queries ``opN_<name>`` over the driver's tables, their oracles, and ``pipeline``.

Each query applies its operator with production parameters to the whole table and
derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (hnsw, language_id, line_runs, merkle, mixing_lm, mixture, packing, resampling, simhash, token_count, toxicity,
               url_ratio, voronoi)
from .common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return register


@query("op1_context_mixing")
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    scores = mixing_lm.score_documents(docs, ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_url_ratio")
def op2_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_ratio.judge_urls(table(spark, sf_dir, "pages"))


@query("op3_voronoi_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def op3_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op4_token_count")
def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    found = language_id.identify(docs, tokenizer_path("piece_bpe_32k.model"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query("op7_line_dedup", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op8_source_mix")
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed_words(table(spark, sf_dir, "documents"), weights=(1, 2, 3), repeat_limit=3)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, radius=2)
    return found.select("doc_id", "fingerprint", "component_id")


@query("op10_near_vectors")
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op11_importance_resampling", """
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
         lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
texts AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
rows AS (SELECT *, row_number() OVER () AS r FROM texts),
occ AS (
  SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM rows),
per AS (SELECT side, r, w, count(*) AS n FROM occ GROUP BY ALL),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM per)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, tab),
counts AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t
  FROM range(10000) AS b(bucket) LEFT JOIN (SELECT bucket, side, n FROM per JOIN hashed USING (w)) o ON o.bucket = b.bucket GROUP BY b.bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM counts),
weights AS (
  SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM per JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM rows LEFT JOIN weights USING (r) WHERE side = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, min_words=20,
                               percent=10, seed=2024)


@query("op12_nearest_toxicity")
def op12_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, threshold=0.3)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op13_merkle_manifest", """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
         lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
marked AS (
  SELECT d.*, hex(encode(CAST(doc_id AS VARCHAR))) AS h, t FROM documents d, tab),
tampers AS (
  SELECT * EXCLUDE (h, t), coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2),
         lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 7 = 0, false) AS tamper
  FROM marked),
fields AS (
  SELECT doc_id, lang, tamper,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS size,
         coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS size1,
         coalesce(strlen(text) || ':' || text, '-') AS body FROM tampers),
hashed AS (
  SELECT doc_id, lang, sha256(head || size || body) AS leaf, CASE WHEN tamper THEN sha256(head || size1 || body) END AS changed FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2),
subroots AS (
  SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2),
root AS (SELECT h AS root, level AS height FROM tops WHERE n = 1),
steps AS (
  SELECT l.lang, l.i, s.level, CASE WHEN o.h IS NULL THEN '0' WHEN o.i < (l.i >> s.level) THEN 'L' || o.h ELSE 'R' || o.h END AS step
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang, unnest(range(r.height)) AS s(level)
  LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = s.level AND o.i = xor(l.i >> s.level, 1)),
inner_paths AS (SELECT lang, i, list(step ORDER BY level) AS path FROM steps GROUP BY lang, i),
top_steps AS (
  SELECT r.lang, s.level, CASE WHEN o.h IS NULL THEN '0' WHEN o.i < (r.i >> s.level) THEN 'L' || o.h ELSE 'R' || o.h END AS step
  FROM subroots r, root, unnest(range(root.height)) AS s(level) LEFT JOIN tops o ON o.level = s.level AND o.i = xor(r.i >> s.level, 1)),
top_paths AS (SELECT lang, list(step ORDER BY level) AS path FROM top_steps GROUP BY lang),
paths AS (
  SELECT l.doc_id, l.leaf, l.changed, r.subroot, root.root, list_concat(coalesce(p.path, []), coalesce(t.path, [])) AS path
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang, root
  LEFT JOIN inner_paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i LEFT JOIN top_paths t ON t.lang IS NOT DISTINCT FROM l.lang),
folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), path), lambda a, s: CASE substr(s, 1, 1)
         WHEN 'L' THEN sha256(substr(s, 2) || a) WHEN 'R' THEN sha256(a || substr(s, 2)) ELSE sha256(a) END) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda s: substr(s, 2)), 'string_agg', ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM folded
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.manifest(table(spark, sf_dir, "documents"), tamper=merkle.crc_tampers("doc_id", 7),
                             tampered={"n_chars": F.try_add(F.col("n_chars"), F.lit(1))})
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
