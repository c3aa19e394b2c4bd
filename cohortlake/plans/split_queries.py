"""Queries for the stratified split, set sizes, batches, split filter and bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agg, joins as J, split as S
from . import testdata as td
from .catalog import query, with_cte

SEED = 23

# Oracle of the stratified split: quotas by largest remainder on the train side,
# test = the first quota subjects of each class in md5(subject|seed) order.
SPLIT_SQL = """
SELECT subject, target, CASE WHEN rk < test_quota THEN 'test' ELSE 'train' END AS split FROM (
  SELECT u.subject, u.target, q.test_quota,
         row_number() OVER (PARTITION BY u.target ORDER BY md5(CAST(u.subject AS VARCHAR) || '|23'), u.subject) - 1 AS rk
  FROM (SELECT DISTINCT subject, target FROM t) u JOIN (
    SELECT target, cnt - (fl + CASE WHEN rr <= n_train - sum(fl) OVER () THEN 1 ELSE 0 END) AS test_quota FROM (
      SELECT target, cnt, fl, n_train,
             row_number() OVER (ORDER BY rem DESC, target) AS rr FROM (
        SELECT target, cnt, n_train, (n_train * cnt) // n AS fl, (n_train * cnt) % n AS rem FROM (
          SELECT target, cnt, sum(cnt) OVER () AS n,
                 sum(cnt) OVER () - CAST(ceil(0.25 * sum(cnt) OVER ()) AS BIGINT) AS n_train
          FROM (SELECT target, count(*) AS cnt FROM (SELECT DISTINCT subject, target FROM t) GROUP BY target)))))
  q ON u.target = q.target)
"""

T = with_cte(t=td.TRAINING_SQL)


def split_assignment(spark, sf_dir):
    return S.stratified_split(td.training(spark, sf_dir), "subject", "target", 0.25, SEED)


@query("stratified_split", T + SPLIT_SQL)
def q_stratified_split(spark, sf_dir):
    return split_assignment(spark, sf_dir)


@query("set_sizes", with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL) + """
SELECT split, count(*) AS n_rows FROM t JOIN s ON t.subject = s.subject GROUP BY split""")
def q_set_sizes(spark, sf_dir):
    t = td.training(spark, sf_dir)
    a = split_assignment(spark, sf_dir).select("subject", "split")
    return agg.set_sizes(t.join(a, "subject"), "split")


@query("split_filter", with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL) + """
SELECT subject, target, n_chars FROM t WHERE subject IN (SELECT subject FROM s WHERE split = 'test')""")
def q_split_filter(spark, sf_dir):
    t = td.training(spark, sf_dir)
    return J.split_filter(t, split_assignment(spark, sf_dir), "test").select("subject", "target", "n_chars")


_BATCH_SQL = with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL) + """
SELECT subject, split, position, batch_id FROM (
  SELECT subject, split, position, position // 12 AS batch_id, count(*) OVER (PARTITION BY split) AS n FROM (
    SELECT subject, split,
           row_number() OVER (PARTITION BY split ORDER BY
             CASE WHEN split = 'train' THEN md5(CAST(subject AS VARCHAR) || '|0|23') ELSE '' END, subject) - 1 AS position
    FROM s))
WHERE batch_id < n // 12
"""


@query("mini_batches", _BATCH_SQL)
def q_mini_batches(spark, sf_dir):
    a = split_assignment(spark, sf_dir)
    return S.mini_batches(a, "subject", "split", 12, epoch=0, seed=SEED).select(
        "subject", "split", "position", "batch_id")


_BOOT_SQL = with_cte(v=td.VISITS_SQL) + """
, subj AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS idx FROM (SELECT DISTINCT subject FROM v))
, n AS (SELECT count(*) AS n FROM subj)
, draws AS (SELECT idx AS draw, ('0x' || substr(md5('7|' || CAST(idx AS VARCHAR)), 1, 15))::BIGINT % (SELECT n FROM n) AS pick FROM subj)
SELECT d.draw, s.subject, v.visit, v.score
FROM draws d JOIN subj s ON s.idx = d.pick JOIN v ON v.subject = s.subject
"""


@query("cluster_bootstrap", _BOOT_SQL)
def q_cluster_bootstrap(spark, sf_dir):
    v = td.visits(spark, sf_dir).select("subject", "visit", "score")
    return S.cluster_bootstrap(v, "subject", seed=7).select("draw", "subject", "visit", "score")


_ORDERS_SPLIT = with_cte(t="""SELECT o_custkey AS subject, min(CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 END) AS target FROM orders GROUP BY o_custkey""") + SPLIT_SQL


@query("stratified_split_orders", _ORDERS_SPLIT)
def q_stratified_split_orders(spark, sf_dir):
    """Subjects with several labels: one row each."""
    o = td.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 17 == 0, 0).otherwise(1).alias("target"))
    return S.stratified_split(o, "subject", "target", 0.25, SEED)


@query("mini_batches_payload", """
SELECT o_orderkey AS subject, split, o_totalprice, position, position // 12 AS batch_id FROM (
  SELECT o_orderkey, split, o_totalprice,
         row_number() OVER (PARTITION BY split ORDER BY
           CASE WHEN split = 'train' THEN md5(CAST(o_orderkey AS VARCHAR) || '|0|23') ELSE '' END, o_orderkey) - 1 AS position
  FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM orders))""")
def q_mini_batches_payload(spark, sf_dir):
    """All rows, incomplete last batches too, with a payload column."""
    o = td.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("subject"), "o_totalprice",
        F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("split"))
    return S.mini_batches(o, "subject", "split", 12, epoch=0, seed=SEED, drop_last=False)


# the same rounds as a recursion over them; keys by md5
_PERMUTED_SQL = "WITH RECURSIVE " + with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL)[5:] + """
, e AS (SELECT unnest([0, 1, 2]) AS epoch)
, ranked AS (SELECT subject, split, row_number() OVER (PARTITION BY split ORDER BY subject) - 1 AS rk, count(*) OVER (PARTITION BY split) AS n FROM s)
, rounds(subject, split, epoch, rk, n, x, r) AS (
    SELECT subject, split, epoch, rk, n, rk, 0 FROM ranked, e
  UNION ALL
    SELECT subject, split, epoch, rk, n, CASE WHEN ((c * c + 1) % 2147483647) % 2 = 1 THEN mate ELSE x END, r + 1
    FROM (SELECT *, (c0 * c0 + 1) % 2147483647 AS c
          FROM (SELECT *, (greatest(x, mate) + k) % 2147483647 AS c0
                FROM (SELECT *, (k % n - x + n) % n AS mate
                      FROM (SELECT *, ('0x' || substr(md5('23|' || epoch || '|' || r), 1, 15))::BIGINT AS k FROM rounds WHERE r < 24)))))
, placed AS (SELECT subject, split, epoch, n, CASE WHEN split = 'train' THEN x ELSE rk END AS position FROM rounds WHERE r = 24)
SELECT subject, split, epoch, position, position // 12 AS batch_id FROM placed WHERE position // 12 < n // 12"""


@query("mini_batches_permuted", _PERMUTED_SQL)
def q_mini_batches_permuted(spark, sf_dir):
    """Three epochs of batches from one ranking, each by a keyed permutation of the row index."""
    a = split_assignment(spark, sf_dir)
    return S.mini_batches_permuted(a, "subject", [0, 1, 2], "split", 12, SEED).select(
        "subject", "split", "epoch", "position", "batch_id")
