"""Queries for panel joins, semi joins, first-row lookup and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators.arrays import volume_table
from ..session import write_shared
from . import testdata as td
from .catalog import query, r6, with_cte


# Panels keyed (subject, visit): visit = calendar year.
def panel_orders(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_custkey").alias("subject"), F.year("o_orderdate").alias("visit"))
            .agg(F.avg("o_totalprice").alias("fa_score"), F.count(F.lit(1)).alias("fa_n")))


def _lineitem_by_customer(spark, sf_dir):
    li = td.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice",
                                                      "l_discount")
    o = td.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def panel_lineitem(spark, sf_dir):
    x = _lineitem_by_customer(spark, sf_dir)
    return (x.groupBy(F.col("o_custkey").alias("subject"), F.year("l_shipdate").alias("visit"))
            .agg(F.avg("l_extendedprice").alias("t1_score")))


def panel_discount(spark, sf_dir):
    x = _lineitem_by_customer(spark, sf_dir)
    return (x.groupBy(F.col("o_custkey").alias("subject"), F.year("l_shipdate").alias("visit"))
            .agg(F.max("l_discount").alias("rsf_score")))


PANELS_SQL = dict(
    fa="""SELECT o_custkey AS subject, CAST(year(o_orderdate) AS INTEGER) AS visit, avg(o_totalprice) AS fa_score,
                 count(*) AS fa_n FROM orders GROUP BY ALL""",
    t1="""SELECT o.o_custkey AS subject, CAST(year(l.l_shipdate) AS INTEGER) AS visit, avg(l.l_extendedprice) AS t1_score
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY ALL""",
    rsf="""SELECT o.o_custkey AS subject, CAST(year(l.l_shipdate) AS INTEGER) AS visit, max(l.l_discount) AS rsf_score
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY ALL""",
)
P = with_cte(**PANELS_SQL)


@query("join_two_keys", P + """
SELECT fa.subject, fa.visit, round(fa_score, 6) AS fa_score, fa_n, round(t1_score, 6) AS t1_score
FROM fa JOIN t1 ON fa.subject = t1.subject AND fa.visit = t1.visit""")
def q_join_two_keys(spark, sf_dir):
    out = J.join_keys(panel_orders(spark, sf_dir), panel_lineitem(spark, sf_dir))
    return out.select("subject", "visit", r6("fa_score"), "fa_n", r6("t1_score"))


@query("join_three_way", P + """
SELECT fa.subject, fa.visit, round(fa_score, 6) AS fa_score, round(t1_score, 6) AS t1_score,
       rsf_score
FROM fa JOIN t1 ON fa.subject = t1.subject AND fa.visit = t1.visit
        JOIN rsf ON fa.subject = rsf.subject AND fa.visit = rsf.visit""")
def q_join_three_way(spark, sf_dir):
    # both panels of the line items come from one join and one aggregate
    x = _lineitem_by_customer(spark, sf_dir)
    both = write_shared(x.groupBy(F.col("o_custkey").alias("subject"), F.year("l_shipdate").alias("visit"))
                        .agg(F.avg("l_extendedprice").alias("t1_score"), F.max("l_discount").alias("rsf_score")), "panels")
    out = J.join_panels(panel_orders(spark, sf_dir), both.select("subject", "visit", "t1_score"),
                        both.select("subject", "visit", "rsf_score"))
    return out.select("subject", "visit", r6("fa_score"), r6("t1_score"), "rsf_score")


def visit_year_panel(spark, sf_dir):
    """Tabular side: visits (orders) per subject-year with the label of the year."""
    v = td.visits(spark, sf_dir)
    return (v.groupBy("subject", F.year("visit_date").alias("visit"))
            .agg(F.max("label").alias("label"), F.avg("visit_age").alias("visit_age")))


_TAB_SQL = """SELECT subject, CAST(year(visit_date) AS INTEGER) AS visit, max(label) AS label, avg(visit_age) AS visit_age
              FROM v GROUP BY ALL"""


@query("common_subjects", with_cte(v=td.VISITS_SQL, tab=_TAB_SQL, **PANELS_SQL) + """
SELECT tab.subject, tab.visit, tab.label, round(tab.visit_age, 6) AS visit_age,
       round(t1.t1_score, 6) AS t1_score
FROM tab JOIN t1 ON tab.subject = t1.subject AND tab.visit = t1.visit""")
def q_common_subjects(spark, sf_dir):
    out = J.common_subjects(visit_year_panel(spark, sf_dir), panel_lineitem(spark, sf_dir))
    return out.select("subject", "visit", "label", r6("visit_age"), r6("t1_score"))


@query("semi_join_subjects", with_cte(v=td.VISITS_SQL, **PANELS_SQL) + """
SELECT subject, visit, round(t1_score, 6) AS t1_score FROM t1
WHERE subject IN (SELECT subject FROM v WHERE visit_age < 18)""")
def q_semi_join_subjects(spark, sf_dir):
    """Imaging rows of subjects that have a tabular visit under 18 (the reference
    semi-filters imaging on the subjects of the age-filtered tabular table)."""
    tab = td.visits(spark, sf_dir).where(F.col("visit_age") < 18)
    out = J.semi_join_subjects(panel_lineitem(spark, sf_dir), tab)
    return out.select("subject", "visit", r6("t1_score"))


_VOL_SQL = """SELECT vec_id AS subject, embedding AS voxels FROM embeddings"""


@query("join_image_rows", with_cte(t=td.TRAINING_SQL, vol=_VOL_SQL) + """
SELECT t.subject, t.target, CAST(len(vol.voxels) AS INTEGER) AS n_voxels,
       round(list_sum(list_transform(vol.voxels, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS voxel_sum
FROM t JOIN vol ON t.subject = vol.subject""")
def q_join_image_rows(spark, sf_dir):
    vols = volume_table(td.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (4, 4, 4))
    out = J.join_image_rows(td.training(spark, sf_dir), vols.withColumnRenamed("vec_id", "subject"))
    total = F.aggregate(F.col("voxels"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("subject", "target", F.size("voxels").alias("n_voxels"), r6(total, "voxel_sum"))


@query("missing_volumes", with_cte(t=td.TRAINING_SQL, vol=_VOL_SQL) + """
SELECT t.subject, t.target FROM t WHERE t.subject NOT IN (SELECT subject FROM vol)""")
def q_missing_volumes(spark, sf_dir):
    vols = td.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject"))
    out = J.join_image_rows(td.training(spark, sf_dir), vols, how="left_anti")
    return out.select("subject", "target")


@query("lookup_first_row", with_cte(v=td.VISITS_SQL, s=td.SUBJECTS_SQL) + """
SELECT s.subject, f.visit, f.score, f.priority FROM s JOIN (
  SELECT subject, visit, score, priority FROM v
  QUALIFY row_number() OVER (PARTITION BY subject ORDER BY visit_date, visit) = 1) f ON s.subject = f.subject""")
def q_lookup_first_row(spark, sf_dir):
    v = td.visits(spark, sf_dir).select("subject", "visit_date", "visit", "score", "priority")
    ids = td.subjects(spark, sf_dir)
    return J.lookup_first_row(v, ids, "subject", ["visit_date", "visit"]).select(
        "subject", "visit", "score", "priority")


@query("intersect_subjects", with_cte(v=td.VISITS_SQL, **PANELS_SQL) + """
SELECT subject FROM v WHERE visit_age < 18 INTERSECT SELECT subject FROM rsf""")
def q_intersect_subjects(spark, sf_dir):
    """Subjects in both the age-filtered tabular table and an imaging panel."""
    tab = td.visits(spark, sf_dir).where(F.col("visit_age") < 18)
    img = panel_discount(spark, sf_dir)
    return J.intersect_subjects(tab, img)


@query("other_classes", """
SELECT e.vec_id, e.label, c.label AS other_label
FROM embeddings e JOIN (SELECT DISTINCT label FROM embeddings) c ON c.label <> e.label""")
def q_other_classes(spark, sf_dir):
    e = td.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return J.other_classes(e, "label")
