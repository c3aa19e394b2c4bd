"""The reference's end-to-end flows, composed from the operators.

Column lists default to the reference's own (``constants``); every flow takes
them as arguments so the same code runs on the stand-in tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import bce_with_logits
from ..operators import columns as C, fill, joins as J, metrics as M, scale as SC, split as S
from ..operators import triplets as TR
from ..session import write_shared
from ..sources import io


def tabular_preparation(df: DataFrame, key: str = "subject",
                        order_by: Sequence[str] = ("visit",),
                        confounders: Sequence[str] = K.CONFOUNDERS,
                        sums: Mapping[str, Mapping[str, float]] | None = None,
                        redundant: Sequence[str] = K.REDUNDANT_COLUMNS,
                        renames: Mapping[str, str] = K.CONSTRUCT_RENAMES,
                        mode_columns: Sequence[str] = K.MODE_FILL_COLUMNS,
                        code_columns: Sequence[str] = K.CODE_COLUMNS,
                        age_column: str = K.AGE_COLUMN, age_bound: float = 18.0,
                        checkpoint: bool = True) -> DataFrame:
    """Drop confounders -> sums -> drop redundant -> rename -> per-subject fill ->
    global mode fill -> global mean fill -> codes -> ``age < bound``.

    The filled table is written once to the shared folder: the mode and mean
    statistics, the code tables and the final projection all read the columns they
    need from it, and the lineage above it is cut.
    """
    if sums is None:
        sums = {"stroop_error_sum": K.STROOP_ERROR_WEIGHTS, "stroop_miss_sum": K.STROOP_MISS_WEIGHTS}
    order_by = list(order_by)
    x = C.drop_confounders(df, confounders=confounders)
    for name, weights in sums.items():
        x = C.weighted_column_sum(x, name, weights)
    x = C.drop_columns(x, redundant)
    x = C.rename_columns(x, renames)
    x = fill.fill_nearest_visit(x, key, order_by)
    if checkpoint:
        x = write_shared(x, "filled")
    x = fill.global_fill(x, mode_columns, exclude=[key, *order_by])
    x = C.category_codes(x, code_columns)
    return C.filter_lt(x, age_column, age_bound)


def load_tabular(spark: SparkSession, input_path: str, write_path: str, quick: bool = True,
                 write: bool = True, schema=None, **prep) -> DataFrame:
    """Read the visit CSV and prepare it; with ``quick``, a copy written from the same files and
    arguments is read instead."""
    def compute():
        return tabular_preparation(io.csv_scan(spark, input_path, ",", schema), **prep)
    if not write:
        return compute()
    return io.reload_unchanged(spark, f"{write_path.rstrip('/')}/processed", [input_path], compute, schema, sorted(prep.items()), quick=quick)


def load_with_imaging(spark: SparkSession, tabular: DataFrame, fa: DataFrame, t1: DataFrame,
                      rsf: DataFrame | None = None, keys: Sequence[str] = ("subject", "visit"),
                      write_path: str | None = None) -> DataFrame:
    """Imaging panels joined on (subject, visit), then joined to the tabular table."""
    imaging = J.join_panels(fa, t1, rsf, keys=keys)
    out = J.common_subjects(tabular, imaging, keys)
    if write_path:
        io.write_processed(out, f"{write_path.rstrip('/')}/processed_with_imaging")
        return io.read_processed(spark, f"{write_path.rstrip('/')}/processed_with_imaging")
    return out


def load_with_imaging_files(spark: SparkSession, input_path: str, panels: Sequence[str], write_path: str, quick: bool = True,
                            keys: Sequence[str] = ("subject", "visit"), schema=None, panel_schemas: Sequence | None = None,
                            sep: str = ";", **prep) -> DataFrame:
    """The whole load from text files: the visit CSV prepared (:func:`load_tabular`), two or three
    imaging CSVs scanned and joined on ``keys``, and both joined.

    With ``quick``, the joined table and the prepared one are each read from a copy
    written from the same files and arguments, if there is one."""
    panel_schemas = list(panel_schemas or [None] * len(panels))

    def compute():
        tabular = load_tabular(spark, input_path, write_path, quick, True, schema, **prep)
        scans = [io.csv_scan(spark, p, sep, kind) for p, kind in zip(panels, panel_schemas, strict=True)]
        return load_with_imaging(spark, tabular, scans[0], scans[1], scans[2] if len(scans) > 2 else None, keys)
    return io.reload_unchanged(spark, f"{write_path.rstrip('/')}/processed_with_imaging", [input_path, *panels], compute,
                               list(keys), schema, panel_schemas, sep, sorted(prep.items()), quick=quick)


def prepare_training_set(df: DataFrame, key: str, target: str, features: Sequence[str],
                         test_fraction: float = S.TEST_FRACTION, seed: int = K.SPLIT_SEED):
    """Split -> fit scaler on train -> scale both -> key and target in front ->
    class weight -> set sizes. Returns (scaled rows with ``split``, fit, weight, sizes)."""
    assignment = S.stratified_split(df, key, target, test_fraction, seed)
    rows = df.join(assignment.select(key, "split"), key, "inner")
    train = rows.where(F.col("split") == "train")
    fit = SC.minmax_fit(train, features)
    scaled = C.attach_columns(SC.minmax_transform(rows, fit, features), [key, target, "split"], features)
    weight = SC.class_weight(train, target)
    sizes = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return scaled, fit, weight, sizes


def prepare_triplets(ages: DataFrame, features: DataFrame, key: str = "subject",
                     label: str = "label", age: str = "age", m0: float = 12.0, step: float = 6.0,
                     test_fraction: float = S.TEST_FRACTION, seed: int = K.SPLIT_SEED,
                     draw_seed: int = 5, scale: Sequence[str] = ()) -> DataFrame:
    """Split subjects, then mine age-band triplets inside each split separately
    (anchors only meet candidates of their own split) and attach features. Those
    named by ``scale`` are scaled to -1..1 by the range of the training subjects first."""
    assignment = S.stratified_split(ages, key, label, test_fraction, seed)
    if scale:
        assignment = write_shared(assignment, "split")
        train = features.join(assignment.where(F.col("split") == "train").select(key), key, "left_semi")
        features = SC.minmax_transform(features, SC.minmax_fit(train, list(scale)), list(scale)).select(*features.columns)
    out = None
    for part in ("train", "test"):
        members = ages.join(assignment.where(F.col("split") == part).select(key), key, "left_semi")
        trip = TR.age_band_triplets(members, key, label, age, m0, step, draw_seed)
        table = TR.triplet_table(trip, features, key).withColumn("split", F.lit(part))
        out = table if out is None else out.unionByName(table)
    return out


def evaluate_run(scored: DataFrame, pos_weight, keys: Sequence[str] = M.EPOCH_KEYS) -> DataFrame:
    """Prediction table -> accuracy, macro accuracy, BCE per run/split/epoch, as a
    long metric log ``(run, split, epoch, metric, value)``."""
    # one pass: counts, hits and losses per class, then per run, split and epoch
    rows = M.with_prediction(scored).withColumn("_bce", bce_with_logits(F.col("logit"), F.col("label"), pos_weight))
    per_class = rows.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("label") == F.col("prediction")).cast("long")).alias("_hits"),
        F.sum("_bce").alias("_loss"))
    n = F.sum("_n")
    wide = per_class.groupBy(*keys).agg((F.sum("_hits") / n).alias("accuracy"), F.avg(F.col("_hits") / F.col("_n")).alias("macro_accuracy"),
                                        (F.sum("_loss") / n).alias("bce_loss"))
    return M.metrics_long(wide, keys, ["accuracy", "macro_accuracy", "bce_loss"])


def evaluate_steps(scored: DataFrame, pos_weight, centers: DataFrame, keys: Sequence[str] = M.EPOCH_KEYS, step: str = "batch_id",
                   mix: Mapping[str, float] = K.TRIPLET_MIX, log_path: str | None = None, predictions_path: str | None = None,
                   **columns) -> DataFrame:
    """Scored embeddings with the vectors of their positive and negative -> accuracy, macro accuracy, BCE,
    centre, triplet and combined loss for every step and every epoch (null step), as a metric log.

    With ``log_path`` and ``predictions_path`` the log and the predictions are written, replacing
    the same runs, splits and epochs, and the log is read back. ``columns`` name the
    inputs of :func:`~cohortlake.operators.metrics.row_losses`."""
    losses = M.row_losses(scored, pos_weight, centers, **columns)
    if predictions_path:
        io.write_predictions(losses.select(*scored.columns, "probability", "prediction"), predictions_path, keys)
    n_classes = centers.agg(F.count(F.lit(1))).scalar()
    log = M.step_metrics(losses, keys, step, columns.get("label", "label"), n_classes, mix)
    if not log_path:
        return log
    io.write_metrics(log, log_path, keys)
    return scored.sparkSession.read.schema(log.schema).parquet(log_path)


def weighted_classifier(scaled: DataFrame, target: str, features: Sequence[str],
                        weight: float, split_col: str = "split", max_iter: int = 50, tol: float = 1e-6):
    """Logistic regression on the scaled features, positives weighted by the class
    weight (the re-aimed stand-in for the network); returns test-set predictions."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=list(features), outputCol="features",
                           handleInvalid="keep").transform(scaled)
    data = data.withColumn("w", F.when(F.col(target) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
    data = data.withColumn("y", F.col(target).cast("double"))
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w",
                               maxIter=max_iter, tol=tol).fit(data.where(F.col(split_col) == "train"))
    pred = model.transform(data.where(F.col(split_col) == "test"))
    return pred.select(*[c for c in scaled.columns if c not in features], "y",
                       F.col("prediction").cast("int").alias("prediction"),
                       F.element_at(vector_to_array("probability"), 2).alias("probability"))


def fit_moments(scores: DataFrame, target: str, features: Sequence[str], weight: float) -> DataFrame:
    """``(term, model_moment, data_moment)``: weighted means of ``probability * feature`` and of ``target *
    feature`` over the rows a classifier was fitted on, for each feature and the constant term.

    Their difference is the gradient of the weighted loss at the fitted coefficients: a fit is at
    the optimum of its (convex) loss exactly where they agree. One aggregate; one row a term."""
    w = F.when(F.col(target) == 1, F.lit(float(weight))).otherwise(F.lit(1.0))
    terms = [("intercept", F.lit(1.0)), *[(f, F.col(f)) for f in features]]
    rows = scores.withColumn("_w", w)
    model = [F.sum(F.col("_w") * F.col("probability") * x) / F.sum("_w") for _, x in terms]
    data = [F.sum(F.col("_w") * F.col(target) * x) / F.sum("_w") for _, x in terms]
    cells = F.array(*[F.struct(F.lit(t).alias("term"), m.alias("model_moment"), d.alias("data_moment"))
                      for (t, _), m, d in zip(terms, model, data, strict=True)])
    return rows.agg(cells.alias("cells")).select(F.inline("cells"))


def calibration_bins(scores: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """``(bin, n, positives, mean_probability)`` over equal score bins (a score of 1 is in the last one)."""
    at = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return scores.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("bigint")).alias("positives"),
                                  F.avg("probability").alias("mean_probability"))
