"""Queries for fills and per-subject aggregates (visits = orders)."""

from __future__ import annotations

from ..operators import agg, fill
from . import testdata as td
from .catalog import query, r6, with_cte

ORDER = ["visit_date", "visit"]
FILL_COLS = ["score", "band", "priority"]
V = with_cte(v=td.VISITS_SQL)

_WIN = """
WINDOW wa AS (PARTITION BY subject ORDER BY visit_date, visit
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
       wb AS (PARTITION BY subject ORDER BY visit_date, visit
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def _fill_sql(kind: str) -> str:
    def one(c):
        nxt = f"first({c} IGNORE NULLS) OVER wa"
        prv = f"last({c} IGNORE NULLS) OVER wb"
        return {"both": f"coalesce({nxt}, {prv})", "backward": nxt, "forward": prv}[kind] + f" AS {c}"
    return V + f"SELECT subject, visit, {', '.join(one(c) for c in FILL_COLS)} FROM v " + _WIN


def _filled(spark, sf_dir, direction):
    v = td.visits(spark, sf_dir)
    out = fill.fill_nearest_visit(v, "subject", ORDER, FILL_COLS, direction=direction)
    return out.select("subject", "visit", *FILL_COLS)


@query("fill_nearest_visit", _fill_sql("both"))
def q_fill_nearest_visit(spark, sf_dir):
    return _filled(spark, sf_dir, "both")


@query("backfill", _fill_sql("backward"))
def q_backfill(spark, sf_dir):
    return _filled(spark, sf_dir, "backward")


@query("forward_fill", _fill_sql("forward"))
def q_forward_fill(spark, sf_dir):
    return _filled(spark, sf_dir, "forward")


_MODE_SQL = V + """
, mp AS (SELECT priority AS m FROM v WHERE priority IS NOT NULL
         GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)
, mb AS (SELECT band AS m FROM v WHERE band IS NOT NULL
         GROUP BY band ORDER BY count(*) DESC, band LIMIT 1)
SELECT subject, visit,
       coalesce(priority, (SELECT m FROM mp)) AS priority,
       coalesce(band, (SELECT m FROM mb)) AS band
FROM v
"""


@query("global_mode_fill", _MODE_SQL)
def q_global_mode_fill(spark, sf_dir):
    v = td.visits(spark, sf_dir)
    return fill.global_mode_fill(v, ["priority", "band"]).select("subject", "visit", "priority", "band")


_MEAN_SQL = V + """
SELECT subject, visit,
       coalesce(score, (SELECT round_even(avg(score), 0) FROM v)) AS score,
       CAST(coalesce(band, (SELECT round_even(avg(band), 0) FROM v)) AS DOUBLE) AS band
FROM v
"""


@query("global_mean_fill", _MEAN_SQL)
def q_global_mean_fill(spark, sf_dir):
    v = td.visits(spark, sf_dir).select("subject", "visit", "score", "band")
    return fill.global_mean_fill(v, ["score", "band"]).select("subject", "visit", "score", "band")


_NULL_SQL = V + """
SELECT subject, bool_or(score IS NULL) AS score_has_null,
       bool_or(priority IS NULL) AS priority_has_null
FROM v GROUP BY subject
"""


@query("null_check", _NULL_SQL)
def q_null_check(spark, sf_dir):
    return fill.null_check(td.visits(spark, sf_dir), "subject", ["score", "priority"])


_MEAN_COLS = ["visit_age", "score", "band", "label"]

_SUBJ_MEAN_SQL = V + """
SELECT subject, round(avg(visit_age), 6) AS visit_age, round(avg(score), 6) AS score,
       round(avg(band), 6) AS band, round(avg(label), 6) AS label
FROM v GROUP BY subject
"""


@query("subject_mean", _SUBJ_MEAN_SQL)
def q_subject_mean(spark, sf_dir):
    v = td.visits(spark, sf_dir)
    out = agg.subject_mean(v, "subject", _MEAN_COLS)
    return out.select("subject", *[r6(c) for c in _MEAN_COLS])


_SUBJ_MEAN_LABEL_SQL = V + """
SELECT subject, round(avg(visit_age), 6) AS visit_age, round(avg(score), 6) AS score,
       round(avg(band), 6) AS band, CAST(ceil(avg(label)) AS DOUBLE) AS label
FROM v GROUP BY subject
"""


@query("subject_mean_labels", _SUBJ_MEAN_LABEL_SQL)
def q_subject_mean_labels(spark, sf_dir):
    v = td.visits(spark, sf_dir)
    out = agg.subject_mean_labels(v, "subject", ["label"], _MEAN_COLS)
    return out.select("subject", *[r6(c) for c in ["visit_age", "score", "band"]], "label")


@query("distinct_subjects", V + "SELECT DISTINCT subject FROM v")
def q_distinct_subjects(spark, sf_dir):
    return agg.distinct_subjects(td.visits(spark, sf_dir), "subject")


_DUP_SQL = V + """
SELECT subject, count(*) AS n FROM v GROUP BY subject HAVING count(*) > 1
"""


@query("assert_unique", _DUP_SQL)
def q_assert_unique(spark, sf_dir):
    """Key check: subjects that repeat in the visit table (not unique as a subject key)."""
    return agg.duplicate_keys(td.visits(spark, sf_dir), ["subject"])


_LABEL_GROUPS_SQL = V + """
SELECT label, count(*) AS n FROM (
  SELECT subject, arg_min(label, (visit_date, visit)) AS label FROM v GROUP BY subject
) GROUP BY label
"""


@query("label_groups", _LABEL_GROUPS_SQL)
def q_label_groups(spark, sf_dir):
    v = td.visits(spark, sf_dir).select("subject", "visit_date", "visit", "label")
    return agg.label_group_sizes(v, "subject", "label", ORDER)


@query("label_group_rows", V + """
SELECT subject, arg_min(label, (visit_date, visit)) AS label FROM v GROUP BY subject""")
def q_label_group_rows(spark, sf_dir):
    """The groups themselves: each subject with the label of its first visit."""
    v = td.visits(spark, sf_dir).select("subject", "visit_date", "visit", "label")
    return agg.label_groups(v, "subject", "label", ORDER)
