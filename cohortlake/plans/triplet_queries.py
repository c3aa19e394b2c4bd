"""Triplet queries on customers as subjects (age in whole months, label BUILDING).

Oracles are brute force: every anchor against every candidate, which is only
affordable at the check's scale; the Spark plans never build those pairs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import triplets as TR
from . import testdata as td
from .catalog import query, with_cte

SEED = 5
M0, STEP = 12.0, 6.0


def ages(spark, sf_dir):
    return td.subjects(spark, sf_dir).select("subject", "label", F.col("age_months").alias("age"))


def _h(expr_key: str, tag: str) -> str:
    return f"('0x' || substr(md5(CAST({expr_key} AS VARCHAR) || '|{SEED}|{tag}'), 1, 15))::BIGINT"


_BASE = with_cte(
    s=td.SUBJECTS_SQL,
    a="SELECT subject, label, age_months AS age FROM s",
    cls="SELECT DISTINCT label FROM a",
    negc="SELECT c1.label, min(c2.label) AS neg_label FROM cls c1 LEFT JOIN cls c2 ON c2.label <> c1.label GROUP BY c1.label",
)


def _band_sql(kind: str, base: str = _BASE, same_split: bool = False) -> str:
    if kind == "pos":
        cand_cond = "c.label = a.label AND c.subject <> a.subject"
        cols = "a.subject, a.label, a.age, m.margin AS pos_margin, b.size AS pos_band_size, b.cand AS positive"
    else:
        cand_cond = "c.label = n.neg_label"
        cols = ("a.subject, a.label, a.age, n.neg_label, m.margin AS neg_margin, "
                "coalesce(b.size, 0) AS neg_band_size, b.cand AS negative")
    if same_split:
        cand_cond += " AND c.split = a.split"
        cols += ", a.split"
    return base + f"""
, near AS (SELECT a.subject, min(abs(c.age - a.age)) AS d
           FROM a JOIN negc n ON n.label = a.label JOIN a c ON {cand_cond} GROUP BY a.subject)
, m AS (SELECT a.subject, CASE WHEN nr.d IS NULL THEN NULL WHEN nr.d < {M0} THEN {M0}::DOUBLE
                    ELSE {M0}::DOUBLE + {STEP}::DOUBLE * (floor((nr.d - {M0}) / {STEP}) + 1) END AS margin
        FROM a LEFT JOIN near nr ON nr.subject = a.subject)
, band AS (SELECT a.subject, c.subject AS cand,
                  row_number() OVER (PARTITION BY a.subject ORDER BY c.age, c.subject) - 1 AS k,
                  count(*) OVER (PARTITION BY a.subject) AS size
           FROM a JOIN negc n ON n.label = a.label JOIN m ON m.subject = a.subject
           JOIN a c ON {cand_cond} AND c.age > a.age - m.margin AND c.age < a.age + m.margin)
SELECT {cols}
FROM a JOIN negc n ON n.label = a.label JOIN m ON m.subject = a.subject
LEFT JOIN band b ON b.subject = a.subject AND b.k = {_h('a.subject', kind)} % b.size
"""


@query("age_band_positive", _band_sql("pos"))
def q_age_band_positive(spark, sf_dir):
    t = TR.age_band_triplets(ages(spark, sf_dir), "subject", "label", "age", M0, STEP, SEED)
    return t.select("subject", "label", "age", "pos_margin", "pos_band_size", "positive")


@query("age_band_negative", _band_sql("neg"))
def q_age_band_negative(spark, sf_dir):
    t = TR.age_band_triplets(ages(spark, sf_dir), "subject", "label", "age", M0, STEP, SEED)
    return t.select("subject", "label", "age", "neg_label", "neg_margin", "neg_band_size", "negative")


_CAND_SQL = _BASE + """
SELECT a.subject, a.label, a.age,
       (SELECT count(*) FROM a c WHERE c.label = a.label AND c.subject <> a.subject
          AND c.age > a.age - 12.0 AND c.age < a.age + 12.0) AS n_positive,
       (SELECT count(*) FROM a c WHERE c.label = n.neg_label
          AND c.age > a.age - 12.0 AND c.age < a.age + 12.0) AS n_negative
FROM a JOIN negc n ON n.label = a.label
"""


@query("candidates_in_band", _CAND_SQL)
def q_candidates_in_band(spark, sf_dir):
    return TR.candidates_in_band(ages(spark, sf_dir), 12.0, "subject", "label", "age")


_RANDOM_SQL = _BASE + f"""
, r AS (SELECT subject, label, row_number() OVER (PARTITION BY label ORDER BY subject) - 1 AS rk,
               count(*) OVER (PARTITION BY label) AS n FROM a)
SELECT a.subject, a.label, n.neg_label, p.subject AS positive, q.subject AS negative
FROM r a JOIN negc n ON n.label = a.label
LEFT JOIN r p ON p.label = a.label AND p.rk = {_h('a.subject', 'rpos')} % a.n
LEFT JOIN (SELECT label, max(n) AS n FROM r GROUP BY label) nn ON nn.label = n.neg_label
LEFT JOIN r q ON q.label = n.neg_label AND q.rk = {_h('a.subject', 'rneg')} % nn.n
"""


@query("random_triplet", _RANDOM_SQL)
def q_random_triplet(spark, sf_dir):
    return TR.random_triplets(ages(spark, sf_dir), "subject", "label", SEED)


def _triplet_table_sql() -> str:
    pos = _band_sql("pos")
    neg = _band_sql("neg")
    return with_cte(pt=pos.replace("WITH ", "SELECT * FROM (WITH ", 1) + ")",
                    nt=neg.replace("WITH ", "SELECT * FROM (WITH ", 1) + ")",
                    s2=td.SUBJECTS_SQL) + """
SELECT pt.subject AS anchor_id, pt.positive AS positive_id, nt.negative AS negative_id,
       sa.label AS anchor_label, sa.acctbal AS anchor_acctbal,
       sp.label AS positive_label, sp.acctbal AS positive_acctbal,
       sn.label AS negative_label, sn.acctbal AS negative_acctbal
FROM pt JOIN nt ON pt.subject = nt.subject
LEFT JOIN s2 sa ON sa.subject = pt.subject
LEFT JOIN s2 sp ON sp.subject = pt.positive
LEFT JOIN s2 sn ON sn.subject = nt.negative
"""


@query("triplet_table", _triplet_table_sql())
def q_triplet_table(spark, sf_dir):
    t = TR.age_band_triplets(ages(spark, sf_dir), "subject", "label", "age", M0, STEP, SEED)
    feats = td.subjects(spark, sf_dir).select("subject", "label", "acctbal")
    out = TR.triplet_table(t, feats)
    return out.select("anchor_id", "positive_id", "negative_id", "anchor_label", "anchor_acctbal",
                      "positive_label", "positive_acctbal", "negative_label", "negative_acctbal")


def split_triplet_table_sql(split_sql: str) -> str:
    """Brute-force oracle of ``prepare_triplets``: triplets inside each split."""
    base = with_cte(
        s=td.SUBJECTS_SQL,
        t="SELECT subject, label AS target FROM s",
        sp=split_sql,
        a="SELECT s.subject, s.label, s.age_months AS age, sp.split FROM s JOIN sp ON s.subject = sp.subject",
        cls="SELECT DISTINCT label FROM a",
        negc="SELECT c1.label, min(c2.label) AS neg_label FROM cls c1 LEFT JOIN cls c2 "
             "ON c2.label <> c1.label GROUP BY c1.label",
    )
    pos = _band_sql("pos", base, True)
    neg = _band_sql("neg", base, True)
    return with_cte(pt=pos.replace("WITH ", "SELECT * FROM (WITH ", 1) + ")",
                    nt=neg.replace("WITH ", "SELECT * FROM (WITH ", 1) + ")",
                    s2=td.SUBJECTS_SQL) + """
SELECT pt.subject AS anchor_id, pt.positive AS positive_id, nt.negative AS negative_id,
       sa.label AS anchor_label, sa.acctbal AS anchor_acctbal,
       sp.label AS positive_label, sp.acctbal AS positive_acctbal,
       sn.label AS negative_label, sn.acctbal AS negative_acctbal, pt.split
FROM pt JOIN nt ON pt.subject = nt.subject
LEFT JOIN s2 sa ON sa.subject = pt.subject
LEFT JOIN s2 sp ON sp.subject = pt.positive
LEFT JOIN s2 sn ON sn.subject = nt.negative
"""
