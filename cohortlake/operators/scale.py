"""Min-max scaling fitted on the training rows, its inverse, and the class weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import minmax_scale, minmax_unscale


def minmax_fit(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row of per-feature ``min`` and ``max`` (nulls skipped): ``<f>_min, <f>_max``."""
    aggs = []
    for f in features:
        aggs += [F.min(F.col(f).cast("double")).alias(f"{f}_min"),
                 F.max(F.col(f).cast("double")).alias(f"{f}_max")]
    return train.agg(*aggs)


def minmax_fit_long(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """The fit as rows ``(feature, min, max)``."""
    wide = minmax_fit(train, features)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}_min").alias("min"),
                 F.col(f"{f}_max").alias("max")) for f in features])).alias("s")).select("s.*")


def _stats(fit: DataFrame, features: Sequence[str]) -> Column:
    """The fit as ONE scalar subquery (a struct), evaluated once per query."""
    return fit.select(F.struct(*[F.col(c) for c in fit.columns])).scalar()


def minmax_transform(df: DataFrame, fit: DataFrame, features: Sequence[str],
                     feature_range=(-1.0, 1.0)) -> DataFrame:
    """``x*s + (a - min*s)``, ``s=(b-a)/(max-min)``; a constant training column
    counts as range 1 (training values map to ``a``). No clipping of other rows.
    The fit is a scalar subquery, so no join and no shuffle of ``df``."""
    st = _stats(fit, features)
    return df.withColumns({f: minmax_scale(F.col(f).cast("double"), st.getField(f"{f}_min"),
                                           st.getField(f"{f}_max"), feature_range)
                           for f in features})


def minmax_inverse(df: DataFrame, fit: DataFrame, features: Sequence[str],
                   feature_range=(-1.0, 1.0)) -> DataFrame:
    st = _stats(fit, features)
    return df.withColumns({f: minmax_unscale(F.col(f), st.getField(f"{f}_min"),
                                             st.getField(f"{f}_max"), feature_range)
                           for f in features})


def class_weight(train: DataFrame, target: str) -> DataFrame:
    """negatives / positives over the training rows; NULL when there is no positive."""
    y = F.col(target).cast("int")
    neg = F.count_if(y == 0)
    pos = F.count_if(y == 1)
    return train.agg(neg.alias("n_negative"), pos.alias("n_positive"),
                     F.try_divide(neg.cast("double"), F.nullif(pos, F.lit(0)).cast("double"))
                     .alias("class_weight"))


def class_weight_value(train: DataFrame, target: str) -> Column:
    """The class weight as a scalar-subquery column (for loss expressions)."""
    return class_weight(train, target).select("class_weight").scalar()
