"""Queries for the composed flows and the flagship entry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import TRIPLET_MIX
from ..operators import scale as SC
from ..session import shared_path, write_shared
from . import composed as CP
from . import metric_queries as MQ
from . import testdata as td
from .catalog import query, r6, with_cte
from .join_queries import PANELS_SQL, panel_discount, panel_lineitem, panel_orders
from .metric_queries import SCORED_SQL, TRAIN_SQL, W_SQL, _bce_sql, scored, train_rows
from .split_queries import SEED, SPLIT_SQL, split_assignment
from .triplet_queries import ages as subject_ages, split_triplet_table_sql

ORDER = ["visit_date", "visit"]
PREP = dict(key="subject", order_by=ORDER, confounders=["status"],
            sums={"error_sum": {"score": 1, "band": 2}}, redundant=["band"],
            renames={"score": "negative_valence_score"}, mode_columns=["priority"],
            code_columns=["priority"], age_column="visit_age", age_bound=18.0)
OUT_COLS = ["subject", "visit", "visit_age", "negative_valence_score", "priority", "label", "error_sum"]


def prepared(spark, sf_dir):
    return CP.tabular_preparation(td.visits(spark, sf_dir), **PREP)


def _present(df):
    return df.select("subject", "visit", r6("visit_age"), r6("negative_valence_score"), "priority",
                     r6("label"), r6("error_sum"))


def flagship(spark, sf_dir):
    return _present(prepared(spark, sf_dir))


_FCOLS = ["visit_age", "negative_valence_score", "priority", "label", "error_sum"]
_NUM = ["visit_age", "negative_valence_score", "label", "error_sum"]


def _fill(c):
    return f"coalesce(first({c} IGNORE NULLS) OVER wa, last({c} IGNORE NULLS) OVER wb) AS {c}"


PREP_SQL = with_cte(
    v=td.VISITS_SQL,
    a="""SELECT subject, visit, visit_date, visit_age, score AS negative_valence_score, priority, label,
                score + 2 * band AS error_sum FROM v""",
    f=f"""SELECT subject, visit, {', '.join(_fill(c) for c in _FCOLS)} FROM a
          WINDOW wa AS (PARTITION BY subject ORDER BY visit_date, visit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                 wb AS (PARTITION BY subject ORDER BY visit_date, visit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    mp="""SELECT priority AS m FROM f WHERE priority IS NOT NULL GROUP BY priority
          ORDER BY count(*) DESC, priority LIMIT 1""",
    g="SELECT subject, visit, coalesce(priority, (SELECT m FROM mp)) AS priority, "
      + ", ".join(f"coalesce({c}, (SELECT round_even(avg({c}), 0) FROM f)) AS {c}" for c in _NUM)
      + " FROM f",
    codes="""SELECT priority AS pv, CAST(row_number() OVER (ORDER BY priority) - 1 AS INTEGER) AS code
             FROM (SELECT DISTINCT priority FROM g WHERE priority IS NOT NULL)""",
) + """
SELECT g.subject, g.visit, round(g.visit_age, 6) AS visit_age,
       round(g.negative_valence_score, 6) AS negative_valence_score,
       coalesce(codes.code, -1) AS priority, round(g.label, 6) AS label, round(g.error_sum, 6) AS error_sum
FROM g LEFT JOIN codes ON g.priority = codes.pv
WHERE g.visit_age < 18
"""


@query("tabular_preparation", PREP_SQL)
def q_tabular_preparation(spark, sf_dir):
    """SURVEY op 71 (the reference's tabular processing flow)."""
    return flagship(spark, sf_dir)


_CSV_SCHEMA = ("subject bigint, visit bigint, visit_date timestamp, visit_age double, score double, "
               "band bigint, priority string, status string, label int")


def _visits_csv(spark, sf_dir):
    """The visit table written as text, as the reference receives it (NA for missing)."""
    path = shared_path(spark, "visits_csv", unique=True)
    v = td.visits(spark, sf_dir).withColumn("visit_date", F.col("visit_date").cast("timestamp"))
    v.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)
    return path


@query("load_tabular", PREP_SQL)
def q_load_tabular(spark, sf_dir):
    """SURVEY op 72: CSV scan -> preparation -> write -> read back."""
    src = _visits_csv(spark, sf_dir)
    out = CP.load_tabular(spark, src, shared_path(spark, "load_tabular", unique=True), quick=True,
                          schema=_CSV_SCHEMA, **PREP)
    return _present(out)


_LWI_SQL = PREP_SQL.replace("""
SELECT g.subject, g.visit, round(g.visit_age, 6) AS visit_age,""", """
, prep AS (SELECT g.subject, g.visit, g.visit_age,""").replace(
    "WHERE g.visit_age < 18\n", "WHERE g.visit_age < 18)\n")


def _lwi_sql() -> str:
    body = _LWI_SQL.replace("WITH ", "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in PANELS_SQL.items()) + ",\n", 1)
    return body.replace("round(g.negative_valence_score, 6) AS negative_valence_score,",
                        "g.negative_valence_score,").replace(
        "round(g.label, 6) AS label, round(g.error_sum, 6) AS error_sum", "g.label, g.error_sum") + """
, vy AS (SELECT o_orderkey AS visit_id, CAST(year(o_orderdate) AS INTEGER) AS visit FROM orders)
SELECT p.subject, p.visit_id, p.visit, round(p.visit_age, 6) AS visit_age, round(fa.fa_score, 6) AS fa_score,
       round(t1.t1_score, 6) AS t1_score, rsf.rsf_score
FROM (SELECT prep.subject, prep.visit AS visit_id, vy.visit, prep.visit_age FROM prep JOIN vy ON prep.visit = vy.visit_id) p
JOIN fa ON fa.subject = p.subject AND fa.visit = p.visit
JOIN t1 ON t1.subject = p.subject AND t1.visit = p.visit
JOIN rsf ON rsf.subject = p.subject AND rsf.visit = p.visit
"""


@query("load_with_imaging", _lwi_sql())
def q_load_with_imaging(spark, sf_dir):
    """SURVEY op 73: imaging panels joined, prepared tabular visits keyed by (subject, year)."""
    prep = prepared(spark, sf_dir)
    years = td.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit_id"),
                                                       F.year("o_orderdate").alias("visit"))
    tab = (prep.select("subject", F.col("visit").alias("visit_id"), "visit_age")
           .join(years, "visit_id", "inner"))
    out = CP.load_with_imaging(spark, tab, panel_orders(spark, sf_dir).drop("fa_n"),
                               panel_lineitem(spark, sf_dir), panel_discount(spark, sf_dir))
    return out.select("subject", "visit_id", "visit", r6("visit_age"), r6("fa_score"), r6("t1_score"),
                      "rsf_score")


_PTS_SQL = with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL, tr=TRAIN_SQL) + "SELECT t.subject, t.target, s.split, " + ", ".join(
    "round(({f} * (2.0 / (CASE WHEN (SELECT max({f}) FROM tr) - (SELECT min({f}) FROM tr) = 0 THEN 1.0 "
    "ELSE (SELECT max({f}) FROM tr) - (SELECT min({f}) FROM tr) END)) + (-1.0 - (SELECT min({f}) FROM tr) * "
    "(2.0 / (CASE WHEN (SELECT max({f}) FROM tr) - (SELECT min({f}) FROM tr) = 0 THEN 1.0 "
    "ELSE (SELECT max({f}) FROM tr) - (SELECT min({f}) FROM tr) END)))), 6) + 0.0 AS {f}".format(f=f)
    for f in td.TRAINING_FEATURES) + " FROM t JOIN s ON t.subject = s.subject"


@query("prepare_training_set", _PTS_SQL)
def q_prepare_training_set(spark, sf_dir):
    """SURVEY op 74: split, fit on train, scale both sets, key and target in front."""
    scaled, _, _, _ = CP.prepare_training_set(td.training(spark, sf_dir), "subject", "target",
                                              td.TRAINING_FEATURES, 0.25, SEED)
    return scaled.select("subject", "target", "split", *[r6(f) for f in td.TRAINING_FEATURES])


@query("prepare_triplets", split_triplet_table_sql(SPLIT_SQL))
def q_prepare_triplets(spark, sf_dir):
    """SURVEY op 75: split subjects, mine triplets inside each split, attach features."""
    feats = td.subjects(spark, sf_dir).select("subject", "label", "acctbal")
    out = CP.prepare_triplets(subject_ages(spark, sf_dir), feats, "subject", "label", "age", 12.0, 6.0,
                               0.25, SEED, 5)
    return out.select("anchor_id", "positive_id", "negative_id", "anchor_label", "anchor_acctbal",
                      "positive_label", "positive_acctbal", "negative_label", "negative_acctbal", "split")


_EVAL_SQL = with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL, p=SCORED_SQL, tr=TRAIN_SQL, wt=W_SQL) + f"""
, acc AS (SELECT run, split, epoch, avg(CAST(label = CAST(logit > 0 AS INTEGER) AS DOUBLE)) AS accuracy
          FROM p GROUP BY ALL)
, mac AS (SELECT run, split, epoch, avg(r) AS macro_accuracy FROM (
            SELECT run, split, epoch, label, avg(CAST(label = CAST(logit > 0 AS INTEGER) AS DOUBLE)) AS r
            FROM p GROUP BY ALL) GROUP BY ALL)
, bce AS (SELECT run, split, epoch, avg({_bce_sql('logit', 'CAST(label AS DOUBLE)', '(SELECT w FROM wt)')}) AS bce_loss
          FROM p GROUP BY ALL)
SELECT run, split, epoch, 'accuracy' AS metric, round(accuracy, 6) AS value FROM acc
UNION ALL SELECT run, split, epoch, 'macro_accuracy', round(macro_accuracy, 6) FROM mac
UNION ALL SELECT run, split, epoch, 'bce_loss', round(bce_loss, 6) FROM bce
"""


def evaluation(spark, sf_dir):
    a = split_assignment(spark, sf_dir)
    w = SC.class_weight_value(train_rows(spark, sf_dir, a), "target")
    return CP.evaluate_run(scored(spark, sf_dir, a), w)


@query("evaluate_run", _EVAL_SQL)
def q_evaluate_run(spark, sf_dir):
    """SURVEY op 76: predictions -> accuracy, macro accuracy, BCE -> metric log rows."""
    return evaluation(spark, sf_dir).select("run", "split", "epoch", "metric", r6("value"))


_STEPS_SQL = with_cte(e=MQ.EMB_SQL, ew=MQ._EW_SQL, c=MQ._CENTERS_SQL, d=MQ._DIST_SQL, r=MQ._R_SQL, rt=MQ._RT_SQL,
                      th=f"""SELECT rt.subject, greatest({MQ._dist('ea.embedding', 'ep.embedding')} - {MQ._dist('ea.embedding', 'en.embedding')}
                             + 1.0, 0.0) AS hinge FROM rt JOIN embeddings ea ON ea.vec_id = rt.subject
                             JOIN embeddings ep ON ep.vec_id = rt.positive JOIN embeddings en ON en.vec_id = rt.negative""") + f"""
, rs AS (SELECT 'a' AS run, CASE WHEN e.vec_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, e.vec_id % 3 AS epoch, e.batch_id AS step, y,
                CAST(y = CAST(logit > 0 AS INTEGER) AS INTEGER) AS hit, {_bce_sql('logit', 'CAST(y AS DOUBLE)', '(SELECT w FROM ew)')} AS bce,
                least(greatest(dist, 1e-12), 1e12) AS cd, hinge
         FROM e JOIN d ON d.vec_id = e.vec_id LEFT JOIN th ON th.subject = e.vec_id)
, lab AS (SELECT run, split, epoch, step, y, grouping(step) AS g, count(*) AS n, sum(hit) AS h, sum(bce) AS b, sum(cd) AS c, sum(hinge) AS t, count(hinge) AS tn
          FROM rs GROUP BY GROUPING SETS ((run, split, epoch, step, y), (run, split, epoch, y)))
, w AS (SELECT run, split, epoch, step, g, sum(h) / sum(n) AS accuracy, avg(h / n) AS macro_accuracy, sum(b) / sum(n) AS bce_loss,
               sum(c) / sum(n) + ((SELECT count(DISTINCT label) FROM embeddings) - 1) * 1e-12 AS center_loss, sum(t) / sum(tn) AS triplet_loss
        FROM lab GROUP BY ALL)
, mix AS (SELECT *, {TRIPLET_MIX['bce']} * bce_loss + {TRIPLET_MIX['center']} * center_loss + {TRIPLET_MIX['triplet']} * triplet_loss AS combined_loss FROM w)
""" + " UNION ALL ".join(f"SELECT run, split, epoch, step, '{m}' AS metric, round({m}, 6) AS value FROM mix"
                        for m in ("accuracy", "macro_accuracy", "bce_loss", "center_loss", "triplet_loss", "combined_loss"))


@query("evaluate_steps", _STEPS_SQL)
def q_evaluate_steps(spark, sf_dir):
    """SURVEY op 76 with 7, 8, 62, 64, 65: all losses of the triplet model for every step and epoch; predictions
    and log written, the log read back."""
    e = MQ.emb(spark, sf_dir)
    trip = MQ.emb_triplets(spark, sf_dir).select(F.col("subject").alias("vec_id"), "positive_vec", "negative_vec")
    rows = e.join(trip, "vec_id", "left").withColumns({
        "run": F.lit("a"), "split": F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train"), "epoch": F.col("vec_id") % 3})
    log = CP.evaluate_steps(rows, SC.class_weight_value(e, "y"), MQ.M.class_centers(e), label="y", center_label="label", vec="embedding",
                            positive="positive_vec", negative="negative_vec", log_path=shared_path(spark, "step_log", unique=True),
                            predictions_path=shared_path(spark, "step_predictions", unique=True))
    return log.select("run", "split", "epoch", "step", "metric", r6("value"))


def _scaled_sql(c: str) -> str:
    return f"round(({c} - lo) * 2.0 / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END - 1.0, 6) + 0.0 AS {c}"


@query("prepare_triplets_scaled", f"""
WITH b AS ({split_triplet_table_sql(SPLIT_SQL)}),
r AS (SELECT min(anchor_acctbal) AS lo, max(anchor_acctbal) AS hi FROM b WHERE split = 'train')
SELECT anchor_id, positive_id, negative_id, split, {', '.join(_scaled_sql(f'{x}_acctbal') for x in ('anchor', 'positive', 'negative'))} FROM b, r""")
def q_prepare_triplets_scaled(spark, sf_dir):
    """SURVEY op 75 with features scaled on the training subjects before they are attached."""
    feats = td.subjects(spark, sf_dir).select("subject", "label", "acctbal")
    out = CP.prepare_triplets(subject_ages(spark, sf_dir), feats, "subject", "label", "age", 12.0, 6.0, 0.25, SEED, 5, scale=["acctbal"])
    return out.select("anchor_id", "positive_id", "negative_id", "split", *[r6(f"{x}_acctbal") for x in ("anchor", "positive", "negative")])


@query("weighted_classifier", no_sql_reason="model coefficients are fitted iteratively")
def q_weighted_classifier(spark, sf_dir):
    """SURVEY op 77: class-weighted logistic regression on the scaled training set."""
    scaled, _, weight, _ = CP.prepare_training_set(td.training(spark, sf_dir), "subject", "target",
                                                   td.TRAINING_FEATURES, 0.25, SEED)
    w = weight.select("class_weight").first()[0]
    if w is None:
        raise ValueError("no positive training row")
    return CP.weighted_classifier(scaled, "target", td.TRAINING_FEATURES, w)



_FITTED_SQL = with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL) + """
SELECT s.split, t.target, count(*) AS n, true AS better_than_constant
FROM t JOIN s ON t.subject = s.subject GROUP BY ALL"""


@query("weighted_classifier_fit", _FITTED_SQL)
def q_weighted_classifier_fit(spark, sf_dir):
    """Rows scored by split and label, and whether the fitted weighted loss on the
    training rows is at most that of the best constant."""
    scaled, _, weight, _ = CP.prepare_training_set(td.training(spark, sf_dir), "subject", "target",
                                                   td.TRAINING_FEATURES, 0.25, SEED)
    w = weight.select("class_weight").first()[0]
    everything = (scaled.where(F.col("split") == "train").withColumn("part", F.lit("train"))
                  .unionByName(scaled.withColumn("part", F.lit("test"))))  # fitted on the former, all scored
    scores = CP.weighted_classifier(everything, "target", td.TRAINING_FEATURES, w, split_col="part")
    p, y = F.col("probability"), F.col("y")
    rw = F.when(y == 1, F.lit(float(w))).otherwise(1.0)
    loss = -(y * F.log(F.greatest(p, F.lit(1e-12))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(1e-12)))) * rw
    base = F.sum(F.when(y == 1, rw)) / F.sum(rw)  # weighted share of positives
    train = scores.where(F.col("split") == "train").agg(F.sum(loss).alias("loss"), F.sum(rw).alias("w"), base.alias("b"))
    entropy = -(F.col("b") * F.log("b") + (1 - F.col("b")) * F.log(1 - F.col("b"))) * F.col("w")
    better = train.select((F.col("loss") <= entropy + 1e-6).alias("ok")).first()["ok"]
    return scores.groupBy("split", F.col("y").cast("int").alias("target")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("better_than_constant", F.lit(better))


def _moment_sql(term: str, x: str) -> str:
    m = f"round(sum(w * target * {x}) / sum(w), 4) + 0.0"
    return f"SELECT '{term}' AS term, {m} AS model_moment, {m} AS data_moment FROM m"


_MOMENTS_SQL = with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL) + f"""
, tr AS (SELECT t.* FROM t JOIN s ON t.subject = s.subject WHERE s.split = 'train')
, cw AS (SELECT CAST(count_if(target = 0) AS DOUBLE) / count_if(target = 1) AS cw FROM tr)
, lim AS (SELECT {', '.join(f'min({f}) AS {f}_lo, max({f}) AS {f}_hi' for f in td.TRAINING_FEATURES)} FROM tr)
, m AS (SELECT target, CASE WHEN target = 1 THEN cw ELSE 1.0 END AS w,
        {', '.join(f'({f} - {f}_lo) * 2.0 / CASE WHEN {f}_hi = {f}_lo THEN 1.0 ELSE {f}_hi - {f}_lo END - 1.0 AS {f}' for f in td.TRAINING_FEATURES)}
        FROM tr, cw, lim)
""" + " UNION ALL ".join(_moment_sql(t, x) for t, x in [("intercept", "1.0"), *zip(td.TRAINING_FEATURES, td.TRAINING_FEATURES)])


@query("weighted_classifier_moments", _MOMENTS_SQL)
def q_weighted_classifier_moments(spark, sf_dir):
    """SURVEY op 77, checked: at the optimum of the weighted loss the model's weighted moments of every
    feature equal those of the labels, which SQL computes without a fit; a wrong fit differs."""
    scaled, _, weight, _ = CP.prepare_training_set(td.training(spark, sf_dir), "subject", "target",
                                                   td.TRAINING_FEATURES, 0.25, SEED)
    w = weight.select("class_weight").first()[0]
    train = scaled.where(F.col("split") == "train")
    both = train.withColumn("part", F.lit("train")).unionByName(train.withColumn("part", F.lit("test")))  # fitted and scored
    # written once: the steps of the fit run over a plain scan, not over the plan of the split and the scaling
    both = write_shared(both.withColumns({f"x_{f}": F.col(f) for f in td.TRAINING_FEATURES}), "fit-rows")
    scores = CP.weighted_classifier(both, "target", td.TRAINING_FEATURES, w, split_col="part", max_iter=500, tol=1e-12)
    scores = scores.withColumnsRenamed({f"x_{f}": f for f in td.TRAINING_FEATURES})
    out = CP.fit_moments(scores, "target", td.TRAINING_FEATURES, w)
    return out.select("term", *[(F.round(c, 4) + 0.0).alias(c) for c in ("model_moment", "data_moment")])
