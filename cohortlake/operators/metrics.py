"""Predictions, accuracies, losses and the metric log, as aggregations over tables.

A prediction table has one row per scored sample with ``run, split, epoch,
batch_id, subject, label, logit``; everything here is a projection or an
aggregate keyed by ``(run, split, epoch[, batch_id])``, so partial aggregation
happens before any exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CENTER_MIX
from ..functions.exprs import bce_with_logits, pairwise_distance, predict_tag, sigmoid, \
    squared_distance
from .index import running

EPOCH_KEYS = ["run", "split", "epoch"]


def with_prediction(df: DataFrame, logit: str = "logit") -> DataFrame:
    return df.withColumns({"probability": sigmoid(F.col(logit)),
                           "prediction": predict_tag(F.col(logit))})


def prediction_table(scored: DataFrame, key: str = "subject", label: str = "label",
                     age: str = "age", sex: str = "sex",
                     extra: Sequence[str] = ("run", "split", "epoch", "batch_id"),
                     target_transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """``subject, label, prediction, age, sex`` per scored row (plus run/split/epoch).

    ``target_transform`` maps the label column."""
    transform = target_transform or (lambda c: c)
    p = with_prediction(scored) if "prediction" not in scored.columns else scored
    keep = [c for c in extra if c in p.columns]
    return p.select(*keep, F.col(key).alias("subject"), transform(F.col(label)).alias("label"),
                    "prediction", F.col(age).alias("age"), F.col(sex).alias("sex"))


def accuracy_micro(preds: DataFrame, keys: Sequence[str] = EPOCH_KEYS) -> DataFrame:
    return preds.groupBy(*keys).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def accuracy_macro(preds: DataFrame, keys: Sequence[str] = EPOCH_KEYS) -> DataFrame:
    """Mean over the classes that occur as a label of the per-class recall."""
    per_class = preds.groupBy(*keys, "label").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("_recall"))
    return per_class.groupBy(*keys).agg(F.avg("_recall").alias("macro_accuracy"))


def bce_loss(scored: DataFrame, pos_weight: Column | float, keys: Sequence[str] = EPOCH_KEYS,
             logit: str = "logit", label: str = "label") -> DataFrame:
    # per-row loss projected first: the weight may be a scalar subquery, which
    # Spark does not accept inside an aggregate's arguments when nondeterministic
    per_row = scored.withColumn("_bce", bce_with_logits(F.col(logit), F.col(label), pos_weight))
    return per_row.groupBy(*keys).agg(F.avg("_bce").alias("bce_loss"))


def class_centers(emb: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Per-class mean vector (the reference learns them; here they are class means):
    one vector aggregate per label."""
    mean = Summarizer.mean(array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return emb.groupBy(label).agg(vector_to_array(mean).alias("center"))


def learned_centers(emb: DataFrame, start: DataFrame, rate: float, label: str = "label", vec: str = "embedding",
                    batch: str = "batch_id") -> DataFrame:
    """``label, center`` after one epoch of gradient descent on the centre loss over the batches in
    order, from ``start (label, center)``.

    With the loss ``sum |x - c|^2 / B`` over a batch of B rows, a step of size ``eta``
    moves the centre of a class with n rows in it to ``(1 - rate n / B) c + rate / B sum x``,
    where ``rate`` is ``2 eta`` times the loss's weight. Steps are affine maps, so an
    epoch is one: the start shrinks by the product of all factors, a batch's sum by
    the factors after it. Those are running sums of logarithms over (class, batch) rows,
    and the vectors are added up by one aggregate, without a job for each batch. A class
    that does not occur keeps its start; ``rate`` must be below 1.
    """
    if not 0 <= rate < 1:
        raise ValueError("rate must be at least 0 and below 1")
    rows = emb.select(F.col(label).alias("_l"), F.col(batch).cast("long").alias("_b"), F.transform(vec, lambda x: x.cast("double")).alias("_v"))
    sums = rows.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("_n"), Summarizer.sum(array_to_vector("_v")).alias("_s"))
    sizes = sums.groupBy("_b").agg(F.sum("_n").alias("_size"))
    factor = F.log(1 - F.lit(float(rate)) * F.col("_n") / F.col("_size"))
    steps = sums.join(sizes, "_b").select("_l", "_s", "_size", (-F.col("_b")).alias("_back"), factor.alias("_f"))
    steps = running(steps, ["_l"], ["_back"], F.col("_f"), "_sum")  # the factors of this batch and those after it
    weight = F.exp(F.col("_sum") - F.col("_f")) * F.lit(float(rate)) / F.col("_size")
    scaled = array_to_vector(F.transform(vector_to_array("_s"), lambda x: x * F.col("_w")))
    moved = steps.withColumn("_w", weight).groupBy("_l").agg(F.exp(F.sum("_f")).alias("_keep"), Summarizer.sum(scaled).alias("_add"))
    out = start.join(moved, F.col(label) == F.col("_l"), "left")
    center = F.zip_with("center", vector_to_array("_add"), lambda c, x: F.col("_keep") * c + x)
    return out.select(label, F.when(F.col("_keep").isNull(), F.col("center")).otherwise(center).alias("center"))


def row_losses(scored: DataFrame, pos_weight: Column | float, centers: DataFrame | None = None, label: str = "label",
               center_label: str = "label", vec: str = "embedding", positive: str | None = None, negative: str | None = None,
               margin: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """Scored rows with ``_hit`` and ``_bce``, with ``_center`` (squared distance to the centre of
    the row's class, in its bounds) where ``centers (center_label, center)`` are given, and ``_triplet``
    (the margin loss of the row as anchor; null without a pair) where the columns of its positive and
    negative vector are. A class without a centre has a null ``_center``."""
    out = with_prediction(scored)
    out = out.withColumns({"_hit": (F.col(label) == F.col("prediction")).cast("long"),
                           "_bce": bce_with_logits(F.col("logit"), F.col(label), pos_weight)})
    if centers is not None:
        c = centers.select(F.col(center_label).alias("_cl"), F.col("center").alias("_c"))
        d = squared_distance(F.col(vec), F.col("_c"))
        out = out.join(c, F.col(center_label) == F.col("_cl"), "left").withColumn("_center", F.least(F.greatest(d, F.lit(1e-12)), F.lit(1e12)))
        out = out.withColumn("_center", F.when(F.col("_cl").isNotNull(), F.col("_center"))).drop("_cl", "_c")
    if positive is not None and negative is not None:
        hinge = F.greatest(pairwise_distance(F.col(vec), F.col(positive), eps) - pairwise_distance(F.col(vec), F.col(negative), eps) + margin, F.lit(0.0))
        out = out.withColumn("_triplet", F.when(F.col(positive).isNotNull() & F.col(negative).isNotNull(), hinge))
    return out


def step_metrics(losses: DataFrame, keys: Sequence[str] = EPOCH_KEYS, step: str = "batch_id", label: str = "label",
                 n_classes: int | Column = 1, mix: Mapping[str, float] = CENTER_MIX) -> DataFrame:
    """The metric log ``(keys, step, metric, value)`` of :func:`row_losses`: a row for each step and, with a null
    step, for each epoch.

    One aggregate over the rows by (keys, step, label) carries the counts and sums of all
    losses; steps and epochs are sums of its rows by grouping sets. ``n_classes`` is the
    number of centres; ``mix`` weighs the losses of ``combined_loss``.
    """
    have = [m for m in ("bce", "center", "triplet") if f"_{m}" in losses.columns]
    parts = losses.groupBy(*keys, step, label).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_hits"),
        *[F.sum(f"_{m}").alias(f"_s_{m}") for m in have], *[F.count(f"_{m}").alias(f"_n_{m}") for m in have])
    carried = ["_n", "_hits", *[f"_{x}_{m}" for x in "sn" for m in have]]
    sets = [[*keys, step, label], [*keys, label]]
    by_label = parts.groupingSets(sets, *keys, step, label).agg(*[F.sum(c).alias(f"{c}_") for c in carried], F.grouping(step).alias("_epoch"))
    k = n_classes if isinstance(n_classes, Column) else F.lit(int(n_classes))
    mean = {m: F.sum(f"_s_{m}_") / F.sum(f"_n_{m}_") for m in have}
    if "center" in mean:
        mean["center"] = mean["center"] + (k - 1).cast("double") * F.lit(1e-12)
    wide = by_label.groupBy(*keys, step, "_epoch").agg((F.sum("_hits_") / F.sum("_n_")).alias("accuracy"),
                                                       F.avg(F.col("_hits_") / F.col("_n_")).alias("macro_accuracy"),
                                                       *[c.alias(f"{m}_loss") for m, c in mean.items()])
    names = ["accuracy", "macro_accuracy", *[f"{m}_loss" for m in have]]
    if all(m in have for m in mix):
        wide, names = wide.withColumn("combined_loss", combined_loss(wide, mix)), [*names, "combined_loss"]
    return metrics_long(wide, [*keys, step], names).withColumnRenamed(step, "step")


def center_loss(emb: DataFrame, centers: DataFrame, keys: Sequence[str], label: str = "label",
                vec: str = "embedding", n_classes: int | Column | None = None) -> DataFrame:
    """Per group: ``sum(clamp(|x - c_y|^2, 1e-12, 1e12)) / n + (k-1) * 1e-12``.

    Distances to other classes' centres are masked to 0 and then clamped to
    1e-12, which is the ``(k-1)*1e-12`` term. Centres join on the label (a
    classes-sized table; Spark broadcasts it by its measured size).
    """
    k = n_classes if n_classes is not None else centers.agg(F.count(F.lit(1))).scalar()
    k = k if isinstance(k, Column) else F.lit(int(k))
    j = emb.join(centers.select(label, "center"), label, "inner")
    d = F.least(F.greatest(squared_distance(F.col(vec), F.col("center")), F.lit(1e-12)), F.lit(1e12))
    return j.groupBy(*keys).agg(
        (F.sum(d) / F.count(F.lit(1)) + (k - 1).cast("double") * F.lit(1e-12)).alias("center_loss"))


def triplet_margin_loss(trip: DataFrame, keys: Sequence[str], anchor: str = "anchor_vec",
                        positive: str = "positive_vec", negative: str = "negative_vec",
                        margin: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """Mean of ``max(d(a,p) - d(a,n) + margin, 0)`` with ``d = |x - y + eps|``."""
    loss = F.greatest(pairwise_distance(F.col(anchor), F.col(positive), eps)
                      - pairwise_distance(F.col(anchor), F.col(negative), eps) + F.lit(margin),
                      F.lit(0.0))
    return trip.groupBy(*keys).agg(F.avg(loss).alias("triplet_loss"))


def combined_loss(parts: DataFrame, weights: Mapping[str, float] = CENTER_MIX) -> Column:
    """Weighted sum of loss columns, e.g. ``1.0*bce_loss + 0.2*center_loss``."""
    out = None
    for name, w in weights.items():
        term = F.lit(float(w)) * F.col(f"{name}_loss")
        out = term if out is None else out + term
    return out


def blocked_running_sum(df: DataFrame, partition: Sequence[str], order: str,
                        values: Sequence[str], block: int = 1024, suffix: str = "_cum") -> DataFrame:
    """Running sums of ``values`` over an integer ``order`` column per ``partition``.

    Two levels so no window holds a whole partition: totals per block of
    ``block`` consecutive order values (a ``block``-times smaller table), their
    running offsets, then a window inside each block only.
    """
    partition = list(partition)
    b = F.floor(F.col(order) / block)
    x = df.withColumn("_blk", b)
    totals = x.groupBy(*partition, "_blk").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    wb = Window.partitionBy(*partition).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*partition, "_blk", *[
        F.coalesce(F.sum(f"_t_{v}").over(wb), F.lit(0)).alias(f"_o_{v}") for v in values])
    wi = Window.partitionBy(*partition, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"_l_{v}": F.sum(v).over(wi) for v in values})
    x = x.join(offsets, [*partition, "_blk"], "inner")
    return x.withColumns({f"{v}{suffix}": F.col(f"_o_{v}") + F.col(f"_l_{v}") for v in values}) \
        .drop("_blk", *[f"_o_{v}" for v in values], *[f"_l_{v}" for v in values])


def running_metrics(preds: DataFrame, keys: Sequence[str] = EPOCH_KEYS,
                    batch: str = "batch_id") -> DataFrame:
    """Per batch: the batch accuracy and the epoch's accumulated accuracy so far."""
    per_batch = preds.groupBy(*keys, batch).agg(
        F.sum((F.col("label") == F.col("prediction")).cast("long")).alias("n_correct"),
        F.count(F.lit(1)).alias("n_rows"))
    cum = blocked_running_sum(per_batch, keys, batch, ["n_correct", "n_rows"])
    return cum.select(*keys, batch,
                      (F.col("n_correct") / F.col("n_rows")).alias("batch_accuracy"),
                      (F.col("n_correct_cum") / F.col("n_rows_cum")).alias("running_accuracy"))


def metrics_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric log rows ``(keys..., metric, value)`` from a wide metrics table."""
    return wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]) \
        .unpivot(list(keys), list(metrics), "metric", "value")
