"""Queries for projections, drops, renames, codes, one-hot, hours, sums, text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import sentence
from ..operators import columns as C
from ..operators.index import row_index
from . import testdata as td
from .catalog import query, r6, with_cte

V = with_cte(v=td.VISITS_SQL)
T = with_cte(t=td.TRAINING_SQL)


@query("project_target", V + "SELECT subject, label FROM v")
def q_project_target(spark, sf_dir):
    return C.project_target(td.visits(spark, sf_dir), "label")


@query("project_features", V + "SELECT visit_age, score, priority FROM v")
def q_project_features(spark, sf_dir):
    return C.project_features(td.visits(spark, sf_dir), ["visit_age", "score", "priority"])


@query("split_xy", T + "SELECT subject, sex, age, round(log_chars, 6) AS log_chars, n_chars, other_label FROM t")
def q_split_xy(spark, sf_dir):
    x, _ = C.split_xy(td.training(spark, sf_dir), "target")
    return x.select("subject", "sex", "age", r6("log_chars"), "n_chars", "other_label")


@query("drop_columns", V + "SELECT subject, visit, visit_date, score, band, priority, label FROM v")
def q_drop_columns(spark, sf_dir):
    # confounder-style strict drop, with the age column (age=True)
    return C.drop_confounders(td.visits(spark, sf_dir), age=True, confounders=["status"])


@query("rename_columns", V + """
SELECT subject, visit, visit_date, visit_age, score AS negative_valence_score, band,
       priority AS arousal_priority, status, label FROM v""")
def q_rename_columns(spark, sf_dir):
    return C.rename_columns(td.visits(spark, sf_dir),
                            {"score": "negative_valence_score", "priority": "arousal_priority",
                             "not_there": "ignored"})


@query("filter_lt", V + "SELECT subject, visit, visit_age FROM v WHERE visit_age < 18")
def q_filter_lt(spark, sf_dir):
    return C.filter_lt(td.visits(spark, sf_dir), "visit_age", 18).select("subject", "visit", "visit_age")


@query("attach_columns", T + "SELECT subject, target, sex, age, n_chars FROM t")
def q_attach_columns(spark, sf_dir):
    return C.attach_columns(td.training(spark, sf_dir), ["subject", "target"], ["sex", "age", "n_chars"])


@query("drop_by_position", T + "SELECT subject, target, round(log_chars, 6) AS log_chars, n_chars, other_label FROM t")
def q_drop_by_position(spark, sf_dir):
    t = td.training(spark, sf_dir)
    return C.drop_by_name(t, ["age", "sex"]).select("subject", "target", r6("log_chars"),
                                                     "n_chars", "other_label")


@query("drop_positions", T + "SELECT subject, target, age, sex, other_label FROM t")
def q_drop_positions(spark, sf_dir):
    """Features 2 and 3 go by position."""
    t = td.training(spark, sf_dir).select("subject", "target", "age", "sex", "log_chars", "n_chars", "other_label")
    return C.drop_positions(t, ["age", "sex", "log_chars", "n_chars", "other_label"], (2, 3))


_CODES_SQL = V + """
, pc AS (SELECT priority AS pv, CAST(row_number() OVER (ORDER BY priority) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT priority FROM v WHERE priority IS NOT NULL))
, sc AS (SELECT status AS sv, CAST(row_number() OVER (ORDER BY status) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT status FROM v WHERE status IS NOT NULL))
SELECT v.subject, v.visit, coalesce(pc.code, -1) AS priority, coalesce(sc.code, -1) AS status
FROM v LEFT JOIN pc ON v.priority = pc.pv LEFT JOIN sc ON v.status = sc.sv
"""


@query("category_codes", _CODES_SQL)
def q_category_codes(spark, sf_dir):
    v = td.visits(spark, sf_dir).select("subject", "visit", "priority", "status")
    return C.category_codes(v, ["priority", "status"])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STATUSES = ["F", "O", "P"]
_ONE_HOT_SQL = V + "SELECT subject, visit, " + ", ".join(
    [f"CAST(coalesce(status = '{s}', false) AS INTEGER) AS \"status_{s}\"" for s in _STATUSES]
    + [f"CAST(coalesce(priority = '{p}', false) AS INTEGER) AS \"priority_{p}\"" for p in _PRIORITIES]
) + " FROM v"


@query("one_hot", _ONE_HOT_SQL)
def q_one_hot(spark, sf_dir):
    v = td.visits(spark, sf_dir).select("subject", "visit", "status", "priority")
    return C.one_hot(v, ["status", "priority"])


def _hours(spark, sf_dir):
    e = td.table(spark, sf_dir, "events")
    hhmm = (F.hour("ts") * 100 + F.when(F.minute("ts") >= 30, 30).otherwise(0)).cast("int")
    return e.select("event_id", hhmm.alias("youthreport2_shq1"),
                    (F.col("user_id") * 10).cast("int").alias("youthreport2_shq2"))


_HOURS_SQL = """
WITH e AS (SELECT event_id,
                  CAST(hour(ts) * 100 + CASE WHEN minute(ts) >= 30 THEN 30 ELSE 0 END AS INTEGER) AS h1,
                  CAST(user_id * 10 AS INTEGER) AS h2 FROM events)
SELECT event_id,
  CASE WHEN h1 BETWEEN 0 AND 2400 AND h1 % 100 IN (0, 30) THEN
       CASE WHEN h1 >= 1500 THEN (h1 // 100 - 15) * 2 + CAST(h1 % 100 = 30 AS INTEGER)
            ELSE 19 + (h1 // 100) * 2 + CAST(h1 % 100 = 30 AS INTEGER) END
       ELSE h1 END AS youthreport2_shq1,
  CASE WHEN h2 BETWEEN 0 AND 2400 AND h2 % 100 IN (0, 30) THEN
       CASE WHEN h2 >= 1500 THEN (h2 // 100 - 15) * 2 + CAST(h2 % 100 = 30 AS INTEGER)
            ELSE 19 + (h2 // 100) * 2 + CAST(h2 % 100 = 30 AS INTEGER) END
       ELSE h2 END AS youthreport2_shq2
FROM e
"""


@query("hours_to_codes", _HOURS_SQL)
def q_hours_to_codes(spark, sf_dir):
    return C.hours_to_codes(_hours(spark, sf_dir), ["youthreport2_shq1", "youthreport2_shq2"])


_WEIGHTS = {"l_quantity": 1, "l_extendedprice": 1, "l_discount": 2, "l_tax": 1, "l_linenumber": 3}

_WSUM_SQL = """
SELECT l_orderkey, l_linenumber,
       round(l_quantity + (CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_extendedprice END)
             + 2 * l_discount + l_tax + 3 * l_linenumber, 6) AS error_sum
FROM lineitem
"""


@query("weighted_column_sum", _WSUM_SQL)
def q_weighted_column_sum(spark, sf_dir):
    li = td.table(spark, sf_dir, "lineitem")
    li = li.withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 4 == 0, F.lit(None))
                       .otherwise(F.col("l_extendedprice")))
    out = C.weighted_column_sum(li, "error_sum", _WEIGHTS)
    return out.select("l_orderkey", "l_linenumber", r6("error_sum"))


@query("sentence_template", T + """
SELECT subject, 'This subject is ' || CASE WHEN sex = 0 THEN 'female' ELSE 'male' END
       || ' and ' || CAST(round_even(age, 2) AS VARCHAR) || ' years old' AS sentence FROM t""")
def q_sentence_template(spark, sf_dir):
    t = td.training(spark, sf_dir)
    return t.select("subject", sentence(F.col("sex"), F.col("age")).alias("sentence"))


@query("cast_types", T + """
SELECT subject, CAST(sex AS FLOAT) AS sex, CAST(age AS FLOAT) AS age,
       CAST(target AS FLOAT) AS target FROM t""")
def q_cast_types(spark, sf_dir):
    t = td.training(spark, sf_dir).select("subject", "sex", "age", "target")
    return C.cast_types(t, ["sex", "age", "target"], "float")


@query("path_columns", V + """
SELECT DISTINCT subject, '/data/volumes/' || CAST(subject AS VARCHAR) || '.nii.gz' AS volume_path,
       '/data/volumes/' || CAST(subject AS VARCHAR) || '/image.nii.gz' AS image_path FROM v""")
def q_path_columns(spark, sf_dir):
    s = td.visits(spark, sf_dir).select("subject").distinct()
    return C.path_columns(s, "/data/volumes", "subject")


def _category_file(spark, sf_dir):
    """Ragged category file: one column per region, cells = its nation names."""
    n = td.table(spark, sf_dir, "nation")
    r = td.table(spark, sf_dir, "region")
    nr = n.join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name")
    # position of each nation inside its region (region has at most a few dozen)
    nr = nr.withColumn("i", F.row_number().over(Window.partitionBy("r_name").orderBy("n_name")))
    return nr.groupBy("i").pivot("r_name").agg(F.first("n_name")).drop("i")


def _nation_panel(spark, sf_dir):
    """Data table whose columns are nation names: customers per segment x nation."""
    c = td.table(spark, sf_dir, "customer")
    n = td.table(spark, sf_dir, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .groupBy("c_mktsegment").pivot("n_name").agg(F.count(F.lit(1))))


_FG_SQL = """
WITH present AS (SELECT DISTINCT n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
pos AS (SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS position FROM present)
SELECT r.r_name AS category, n.n_name AS feature, pos.position AS position
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN pos ON pos.n_name = n.n_name
"""


@query("feature_groups", _FG_SQL)
def q_feature_groups(spark, sf_dir):
    cats = _category_file(spark, sf_dir)
    data = _nation_panel(spark, sf_dir)
    return C.feature_groups(cats, data.columns, cats.columns)


_ROW_INDEX_SQL = T + """
SELECT subject, row_number() OVER (ORDER BY md5(CAST(subject AS VARCHAR) || '|23'), subject) - 1 AS row_index
FROM t
"""


@query("row_index", _ROW_INDEX_SQL)
def q_row_index(spark, sf_dir):
    from ..functions.exprs import hash_key
    t = td.training(spark, sf_dir).select("subject")
    return row_index(t, [hash_key("subject", F.lit(23)), F.col("subject")]).select("subject", "row_index")


@query("row_index_payload", """
SELECT l_orderkey, l_linenumber, l_extendedprice, flag, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_returnflag) - 1 AS row_index
FROM (SELECT *, l_returnflag AS flag FROM lineitem)""")
def q_row_index_payload(spark, sf_dir):
    """Positions in date order, with columns beside the key."""
    li = td.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate",
                                                    F.col("l_returnflag").alias("flag"))
    return row_index(li, ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "flag"]).drop("l_shipdate")
