"""Queries for predictions, accuracies, losses, scaling, weights and array volumes.

Two scored tables stand in for the network's output:

* documents: labelled documents, split and batched as in training, two epochs,
  logit = a fixed function of the row;
* embeddings: 64-float vectors with 10 labels; binary target ``label >= 5``,
  logit ``20 * embedding[0]``, batches of 12 by ``vec_id``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CENTER_MIX, TRIPLET_MIX
from ..operators import arrays as A, joins as J, metrics as M, scale as SC, split as S
from ..operators.triplets import random_triplets
from . import testdata as td
from .catalog import query, r6, with_cte
from .split_queries import SEED, SPLIT_SQL, split_assignment

EPOCHS = (0, 1)
FEATS = td.TRAINING_FEATURES


def batches(spark, sf_dir, assignment=None):
    a = assignment or split_assignment(spark, sf_dir)
    return S.mini_batches_epochs(a, "subject", EPOCHS, "split", 12, seed=SEED)


def scored(spark, sf_dir, assignment=None):
    """run, split, epoch, batch_id, subject, label, sex, age, logit (documents)."""
    t = td.training(spark, sf_dir)
    b = batches(spark, sf_dir, assignment).select("subject", "split", "epoch", "batch_id")
    j = b.join(t, "subject", "inner")
    return j.select(F.lit("r0").alias("run"), "split", "epoch", "batch_id", "subject",
                    F.col("target").alias("label"), "sex", "age",
                    (td.logit_expr("subject") + F.col("epoch") * 0.25).alias("logit"))


def _batch_sql(epoch: int) -> str:
    return f"""
SELECT subject, split, {epoch} AS epoch, batch_id FROM (
  SELECT subject, split, position // 12 AS batch_id, count(*) OVER (PARTITION BY split) AS n FROM (
    SELECT subject, split,
           row_number() OVER (PARTITION BY split ORDER BY
             CASE WHEN split = 'train' THEN md5(CAST(subject AS VARCHAR) || '|{epoch}|23') ELSE '' END,
             subject) - 1 AS position
    FROM s))
WHERE batch_id < n // 12"""


SCORED_SQL = f"""
SELECT 'r0' AS run, b.split, b.epoch, b.batch_id, t.subject, t.target AS label, t.sex, t.age,
       {td.LOGIT_SQL.replace('subject', 't.subject').replace('log_chars', 't.log_chars')} + b.epoch * 0.25 AS logit
FROM ({' UNION ALL '.join(_batch_sql(e) for e in EPOCHS)}) b JOIN t ON b.subject = t.subject
"""
P = with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL, p=SCORED_SQL)
PRED = "CAST(logit > 0 AS INTEGER)"


@query("predict_tag", P + f"""
SELECT subject, split, epoch, round(logit, 6) + 0.0 AS logit,
       round(1.0 / (1.0 + exp(-logit)), 6) AS probability, {PRED} AS prediction FROM p""")
def q_predict_tag(spark, sf_dir):
    p = M.with_prediction(scored(spark, sf_dir))
    return p.select("subject", "split", "epoch", r6("logit"), r6("probability"), "prediction")


@query("prediction_table", P + f"""
SELECT run, split, epoch, batch_id, subject, label, {PRED} AS prediction, age, sex FROM p""")
def q_prediction_table(spark, sf_dir):
    return M.prediction_table(scored(spark, sf_dir))


@query("union_results", P + f"""
SELECT run, split, epoch, batch_id, subject, label, {PRED} AS prediction, age, sex FROM p WHERE epoch = 0
UNION ALL
SELECT run, split, epoch, batch_id, subject, label, {PRED} AS prediction, age, sex FROM p WHERE epoch = 1""")
def q_union_results(spark, sf_dir):
    p = M.prediction_table(scored(spark, sf_dir))
    return J.union_results(p.where(F.col("epoch") == 0), p.where(F.col("epoch") == 1))


@query("accuracy_micro", P + f"""
SELECT run, split, epoch, round(avg(CAST(label = {PRED} AS DOUBLE)), 6) AS accuracy
FROM p GROUP BY run, split, epoch""")
def q_accuracy_micro(spark, sf_dir):
    out = M.accuracy_micro(M.prediction_table(scored(spark, sf_dir)))
    return out.select("run", "split", "epoch", r6("accuracy"))


@query("accuracy_macro", P + f"""
SELECT run, split, epoch, round(avg(r), 6) AS macro_accuracy FROM (
  SELECT run, split, epoch, label, avg(CAST(label = {PRED} AS DOUBLE)) AS r
  FROM p GROUP BY run, split, epoch, label) GROUP BY run, split, epoch""")
def q_accuracy_macro(spark, sf_dir):
    out = M.accuracy_macro(M.prediction_table(scored(spark, sf_dir)))
    return out.select("run", "split", "epoch", r6("macro_accuracy"))


@query("running_metrics", P + f"""
SELECT run, split, epoch, batch_id, round(nc / nr, 6) AS batch_accuracy,
       round(sum(nc) OVER w / sum(nr) OVER w, 6) AS running_accuracy
FROM (SELECT run, split, epoch, batch_id, sum(CAST(label = {PRED} AS BIGINT)) AS nc, count(*) AS nr
      FROM p GROUP BY ALL)
WINDOW w AS (PARTITION BY run, split, epoch ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_metrics(spark, sf_dir):
    out = M.running_metrics(M.prediction_table(scored(spark, sf_dir)))
    return out.select("run", "split", "epoch", "batch_id", r6("batch_accuracy"), r6("running_accuracy"))


def train_rows(spark, sf_dir, assignment=None):
    t = td.training(spark, sf_dir)
    return J.split_filter(t, assignment or split_assignment(spark, sf_dir), "train")


TRAIN_SQL = "SELECT * FROM t WHERE subject IN (SELECT subject FROM s WHERE split = 'train')"
W_SQL = "SELECT CAST(count_if(target = 0) AS DOUBLE) / nullif(count_if(target = 1), 0) AS w FROM tr"


@query("class_weight", with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL, tr=TRAIN_SQL) + """
SELECT CAST(count_if(target = 0) AS BIGINT) AS n_negative, CAST(count_if(target = 1) AS BIGINT) AS n_positive,
       round(CAST(count_if(target = 0) AS DOUBLE) / nullif(count_if(target = 1), 0), 6) AS class_weight
FROM tr""")
def q_class_weight(spark, sf_dir):
    out = SC.class_weight(train_rows(spark, sf_dir), "target")
    return out.select("n_negative", "n_positive", r6("class_weight"))


def _bce_sql(x: str, y: str, w: str) -> str:
    return (f"(1 - {y}) * {x} + (1 + ({w} - 1) * {y}) * "
            f"(ln(1 + exp(-abs({x}))) + greatest(-{x}, 0))")


@query("bce_with_logits", with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL, p=SCORED_SQL, tr=TRAIN_SQL,
                                   wt=W_SQL) + f"""
SELECT run, split, epoch, round(avg({_bce_sql('logit', 'CAST(label AS DOUBLE)', '(SELECT w FROM wt)')}), 6) AS bce_loss
FROM p GROUP BY run, split, epoch""")
def q_bce_with_logits(spark, sf_dir):
    w = SC.class_weight_value(train_rows(spark, sf_dir), "target")
    out = M.bce_loss(scored(spark, sf_dir), w)
    return out.select("run", "split", "epoch", r6("bce_loss"))


_FIT_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, min({f}) AS min, max({f}) AS max FROM tr" for f in FEATS)


@query("minmax_fit", with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL, tr=TRAIN_SQL) + f"""
SELECT feature, round(min, 6) AS min, round(max, 6) AS max FROM ({_FIT_SQL})""")
def q_minmax_fit(spark, sf_dir):
    out = SC.minmax_fit_long(train_rows(spark, sf_dir), FEATS)
    return out.select("feature", r6("min"), r6("max"))


def _scaled_sql(inverse: bool) -> str:
    cols = []
    for f in FEATS:
        lo, hi = f"(SELECT min({f}) FROM tr)", f"(SELECT max({f}) FROM tr)"
        rng = f"(CASE WHEN {hi} - {lo} = 0 THEN 1.0 ELSE {hi} - {lo} END)"
        s = f"(2.0 / {rng})"
        z = f"({f} * {s} + (-1.0 - {lo} * {s}))"
        expr = f"(({z}) - (-1.0 - {lo} * {s})) / {s}" if inverse else z
        cols.append(f"round({expr}, 6) + 0.0 AS {f}")
    return with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL, tr=TRAIN_SQL) + \
        f"SELECT t.subject, s.split, {', '.join(cols)} FROM t JOIN s ON t.subject = s.subject"


def _scaled(spark, sf_dir):
    t = td.training(spark, sf_dir)
    a = split_assignment(spark, sf_dir)
    fit = SC.minmax_fit(train_rows(spark, sf_dir, a), FEATS)
    return t.join(a.select("subject", "split"), "subject"), fit


@query("minmax_transform", _scaled_sql(False))
def q_minmax_transform(spark, sf_dir):
    rows, fit = _scaled(spark, sf_dir)
    out = SC.minmax_transform(rows, fit, FEATS)
    return out.select("subject", "split", *[r6(f) for f in FEATS])


@query("minmax_inverse", _scaled_sql(True))
def q_minmax_inverse(spark, sf_dir):
    rows, fit = _scaled(spark, sf_dir)
    out = SC.minmax_inverse(SC.minmax_transform(rows, fit, FEATS), fit, FEATS)
    return out.select("subject", "split", *[r6(f) for f in FEATS])


# --- embeddings -------------------------------------------------------------

def emb(spark, sf_dir):
    e = td.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", "embedding",
                    F.floor(F.col("vec_id") / 12).alias("batch_id"),
                    (F.col("label") >= 5).cast("int").alias("y"),
                    (F.element_at("embedding", 1).cast("double") * 20.0).alias("logit"))


EMB_SQL = """SELECT vec_id, label, embedding, vec_id // 12 AS batch_id, CAST(label >= 5 AS INTEGER) AS y,
                    CAST(embedding[1] AS DOUBLE) * 20.0 AS logit FROM embeddings"""
_CENTERS_SQL = """SELECT label, CAST(pos - 1 AS INTEGER) AS pos, avg(CAST(v AS DOUBLE)) AS cv FROM
  (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos"""
_DIST_SQL = """SELECT e.vec_id, e.batch_id, sum(pow(CAST(e.v AS DOUBLE) - c.cv, 2)) AS dist FROM
  (SELECT vec_id, label, vec_id // 12 AS batch_id, unnest(embedding) AS v,
          generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) e
  JOIN c ON c.label = e.label AND c.pos = e.pos GROUP BY e.vec_id, e.batch_id"""
_CL_SQL = """SELECT batch_id, sum(least(greatest(dist, 1e-12), 1e12)) / count(*)
                    + ((SELECT count(DISTINCT label) FROM embeddings) - 1) * 1e-12 AS center_loss
             FROM d GROUP BY batch_id"""


@query("class_centers", with_cte(c=_CENTERS_SQL) + "SELECT label, pos, round(cv, 6) + 0.0 AS center_value FROM c")
def q_class_centers(spark, sf_dir):
    centers = M.class_centers(emb(spark, sf_dir))
    long = centers.select("label", F.posexplode("center").alias("pos", "center_value"))
    return long.select("label", "pos", r6("center_value"))


RATE = 0.3


@query("learned_centers", with_cte(
    e=EMB_SQL,
    b="SELECT label, batch_id, count(*) AS n FROM e GROUP BY ALL",
    s="SELECT batch_id, sum(n) AS size FROM b GROUP BY ALL",
    f=f"""SELECT label, batch_id, size, ln(1 - {RATE}::DOUBLE * n / size) AS own, coalesce(sum(ln(1 - {RATE}::DOUBLE * n / size)) OVER (
          PARTITION BY label ORDER BY batch_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later
          FROM b JOIN s USING (batch_id)""",
    k="SELECT label, exp(sum(own)) AS keep FROM f GROUP BY label",
    x="SELECT label, batch_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM e",
    m=f"SELECT label, pos, sum(exp(later) * {RATE}::DOUBLE / size * v) AS moved FROM x JOIN f USING (label, batch_id) GROUP BY ALL")
    + "SELECT label, CAST(pos AS INTEGER) AS pos, round(keep + moved, 6) + 0.0 AS center_value FROM m JOIN k USING (label)")
def q_learned_centers(spark, sf_dir):
    """SURVEY op 63 as the reference has it: centres learned by gradient steps (one epoch, from ones)."""
    e = emb(spark, sf_dir)
    start = e.groupBy("label").agg(F.transform(F.first("embedding"), lambda x: F.lit(1.0)).alias("center"))
    centers = M.learned_centers(e, start, RATE)
    return centers.select("label", F.posexplode("center").alias("pos", "center_value")).select("label", "pos", r6("center_value"))


@query("center_distance", with_cte(c=_CENTERS_SQL, d=_DIST_SQL, cl=_CL_SQL)
       + "SELECT batch_id, round(center_loss, 6) AS center_loss FROM cl")
def q_center_distance(spark, sf_dir):
    e = emb(spark, sf_dir)
    out = M.center_loss(e, M.class_centers(e), ["batch_id"])
    return out.select("batch_id", r6("center_loss"))


def emb_triplets(spark, sf_dir):
    e = emb(spark, sf_dir)
    t = random_triplets(e.select(F.col("vec_id").alias("subject"), F.col("y").alias("label")), "subject", "label", 5)
    vec = e.select(F.col("vec_id").alias("_id"), "embedding")
    return (t.join(vec.withColumnRenamed("embedding", "anchor_vec"), t.subject == F.col("_id")).drop("_id")
            .join(vec.withColumnRenamed("embedding", "positive_vec"), F.col("positive") == F.col("_id")).drop("_id")
            .join(vec.withColumnRenamed("embedding", "negative_vec"), F.col("negative") == F.col("_id")).drop("_id")
            .withColumn("batch_id", F.floor(F.col("subject") / 12)))


def _hsql(tag: str) -> str:
    return f"('0x' || substr(md5(CAST(a.subject AS VARCHAR) || '|5|{tag}'), 1, 15))::BIGINT"


_RT_SQL = f"""
SELECT a.subject, p.subject AS positive, q.subject AS negative FROM r a
JOIN (SELECT c1.label, min(c2.label) AS neg_label FROM (SELECT DISTINCT label FROM r) c1
      JOIN (SELECT DISTINCT label FROM r) c2 ON c2.label <> c1.label GROUP BY c1.label) n ON n.label = a.label
JOIN r p ON p.label = a.label AND p.rk = {_hsql('rpos')} % a.n
JOIN (SELECT label, max(n) AS n FROM r GROUP BY label) nn ON nn.label = n.neg_label
JOIN r q ON q.label = n.neg_label AND q.rk = {_hsql('rneg')} % nn.n"""
_R_SQL = """SELECT vec_id AS subject, y AS label, row_number() OVER (PARTITION BY y ORDER BY vec_id) - 1 AS rk,
                   count(*) OVER (PARTITION BY y) AS n FROM (SELECT vec_id, CAST(label >= 5 AS INTEGER) AS y FROM embeddings)"""


def _dist(a: str, b: str) -> str:
    return (f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: pow(CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE) + 1e-6, 2))))")


_TL_SQL = f"""SELECT rt.subject // 12 AS batch_id,
  avg(greatest({_dist('ea.embedding', 'ep.embedding')} - {_dist('ea.embedding', 'en.embedding')} + 1.0, 0.0)) AS triplet_loss
FROM rt JOIN embeddings ea ON ea.vec_id = rt.subject JOIN embeddings ep ON ep.vec_id = rt.positive
JOIN embeddings en ON en.vec_id = rt.negative GROUP BY 1"""


@query("triplet_margin", with_cte(r=_R_SQL, rt=_RT_SQL, tl=_TL_SQL)
       + "SELECT batch_id, round(triplet_loss, 6) AS triplet_loss FROM tl")
def q_triplet_margin(spark, sf_dir):
    out = M.triplet_margin_loss(emb_triplets(spark, sf_dir), ["batch_id"])
    return out.select("batch_id", r6("triplet_loss"))


_EW_SQL = "SELECT CAST(count_if(y = 0) AS DOUBLE) / nullif(count_if(y = 1), 0) AS w FROM e"
_EBCE_SQL = f"""SELECT batch_id, avg({_bce_sql('logit', 'CAST(y AS DOUBLE)', '(SELECT w FROM ew)')}) AS bce_loss
                FROM e GROUP BY batch_id"""


@query("combined_loss", with_cte(e=EMB_SQL, ew=_EW_SQL, eb=_EBCE_SQL, c=_CENTERS_SQL, d=_DIST_SQL,
                                 cl=_CL_SQL, r=_R_SQL, rt=_RT_SQL, tl=_TL_SQL) + f"""
SELECT eb.batch_id, round({CENTER_MIX['bce']} * bce_loss + {CENTER_MIX['center']} * center_loss, 6) AS center_model_loss,
       round({TRIPLET_MIX['bce']} * bce_loss + {TRIPLET_MIX['center']} * center_loss
             + {TRIPLET_MIX['triplet']} * triplet_loss, 6) AS triplet_model_loss
FROM eb JOIN cl ON eb.batch_id = cl.batch_id JOIN tl ON eb.batch_id = tl.batch_id""")
def q_combined_loss(spark, sf_dir):
    e = emb(spark, sf_dir)
    w = SC.class_weight_value(e, "y")
    bce = M.bce_loss(e, w, ["batch_id"], "logit", "y")
    cen = M.center_loss(e, M.class_centers(e), ["batch_id"])
    tri = M.triplet_margin_loss(emb_triplets(spark, sf_dir), ["batch_id"])
    parts = bce.join(cen, "batch_id").join(tri, "batch_id")
    return parts.select("batch_id", r6(M.combined_loss(parts, CENTER_MIX), "center_model_loss"),
                        r6(M.combined_loss(parts, TRIPLET_MIX), "triplet_model_loss"))


def volumes(spark, sf_dir):
    return A.volume_table(td.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (4, 4, 4))


@query("volume_max_scale", """
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CAST(v AS DOUBLE) / max(CAST(v AS DOUBLE)) OVER (PARTITION BY vec_id), 6) + 0.0 AS value
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""")
def q_volume_max_scale(spark, sf_dir):
    v = A.volume_max_scale(volumes(spark, sf_dir))
    return v.select("vec_id", F.posexplode("voxels").alias("pos", "value")).select(
        "vec_id", "pos", r6("value"))


NEW_SIZE = (6, 6, 6)


def _resample_sql() -> str:
    n0, n1, n2 = NEW_SIZE
    d = 4
    axes = []
    for name, expr, n in (("a", f"o // {n1 * n2}", n0), ("b", f"(o // {n2}) % {n1}", n1),
                          ("c", f"o % {n2}", n2)):
        p = f"(CAST({expr} AS DOUBLE) * {d - 1} / {n - 1})"
        i0 = f"CAST(least(floor({p}), {d - 2}) AS INTEGER)"
        axes.append((f"{name}0", i0, f"least({i0} + 1, {d - 1})", f"({p} - {i0})"))
    terms = []
    for corner in range(8):
        idx, w = [], []
        for i, (_, i0, i1, t) in enumerate(axes):
            hi = (corner >> (2 - i)) & 1
            idx.append(f"({i1 if hi else i0}) * {[16, 4, 1][i]}")
            w.append(t if hi else f"(1 - {t})")
        terms.append(f"CAST(embedding[{' + '.join(idx)} + 1] AS DOUBLE) * {' * '.join(w)}")
    value = " + ".join(terms)
    return f"""SELECT vec_id, CAST(o AS INTEGER) AS pos, round({value}, 6) + 0.0 AS value
FROM (SELECT vec_id, embedding, unnest(range({n0 * n1 * n2})) AS o FROM embeddings)"""


@query("volume_resample", _resample_sql())
def q_volume_resample(spark, sf_dir):
    v = A.volume_resample(volumes(spark, sf_dir), NEW_SIZE)
    return v.select("vec_id", F.posexplode("voxels").alias("pos", "value")).select(
        "vec_id", "pos", r6("value"))


@query("volume_resample_tiles", _resample_sql())
def q_volume_resample_tiles(spark, sf_dir):
    """SURVEY op 67 tile by tile: two planes and a halo each, array functions only."""
    tiles = A.tiles_resample(A.volume_tiles(volumes(spark, sf_dir), 2), NEW_SIZE, 2)
    place = F.col("origin") * (NEW_SIZE[1] * NEW_SIZE[2]) + F.col("at")
    return (tiles.select("vec_id", "origin", F.posexplode("voxels").alias("at", "value"))
            .select("vec_id", place.cast("int").alias("pos"), r6("value")))


@query("volume_max_scale_tiles", """
SELECT vec_id, CAST(pos // 16 AS INTEGER) AS plane, round(sum(value), 6) + 0.0 AS plane_sum FROM (
  SELECT vec_id, pos, CAST(v AS DOUBLE) / max(CAST(v AS DOUBLE)) OVER (PARTITION BY vec_id) AS value
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)) GROUP BY ALL""")
def q_volume_max_scale_tiles(spark, sf_dir):
    """SURVEY op 66 tile by tile: sums of the scaled planes (a tile's own, without its halo)."""
    tiles = A.tiles_max_scale(A.volume_tiles(volumes(spark, sf_dir), 1), "vec_id")
    planes = F.inline(F.transform(F.sequence(F.lit(0), F.when(F.col("origin") + 2 == F.get("dims", F.lit(0)), 1).otherwise(0)),
                                  lambda k: F.struct((F.col("origin") + k).alias("plane"), F.slice("voxels", k * 16 + 1, F.lit(16)).alias("v"))))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return tiles.select("vec_id", planes).select("vec_id", "plane", r6(total, "plane_sum"))


@query("fuse_features", with_cte(t=td.TRAINING_SQL) + """
SELECT e.vec_id AS subject, CAST(len(e.embedding) + 3 AS INTEGER) AS n_features,
       round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))) + t.sex + t.age + t.n_chars, 6) AS fused_sum,
       round(t.age, 6) AS fused_age
FROM embeddings e JOIN t ON t.subject = e.vec_id""")
def q_fuse_features(spark, sf_dir):
    e = td.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject"), "embedding")
    t = td.training(spark, sf_dir).select("subject", F.array("sex", "age", "n_chars").alias("tab"))
    f = A.fuse_features(e, t, "subject", "embedding", "tab")
    total = F.aggregate("fused", F.lit(0.0), lambda acc, x: acc + x)
    return f.select("subject", F.size("fused").alias("n_features"), r6(total, "fused_sum"),
                    r6(F.element_at("fused", 66), "fused_age"))
