"""Per-subject and per-label aggregations, key checks and set sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fill import numeric_columns


def subject_mean(df: DataFrame, key: str = "subject", columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of every numeric column per subject (non-numeric columns fall away).

    ``groupBy`` plans a partial aggregate before the exchange, so a subject with
    a third of all rows costs one small buffer per task, not one hot task.
    Null subjects are dropped, as a pandas groupby drops them.
    """
    if columns is None:
        columns = numeric_columns(df, exclude=[key])
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(*[F.avg(c).alias(c) for c in columns]))


def subject_mean_labels(df: DataFrame, key: str = "subject", labels: Sequence[str] = (),
                        columns: Sequence[str] | None = None) -> DataFrame:
    """As :func:`subject_mean`; label means are rounded up (any true visit -> 1.0)."""
    out = subject_mean(df, key, columns)
    return out.withColumns({c: F.ceil(F.col(c)).cast("double") for c in labels if c in out.columns})


def distinct_subjects(df: DataFrame, key: str = "subject") -> DataFrame:
    """Distinct keys; callers sort only when they need an order (range exchange)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def label_groups(df: DataFrame, key: str, label: str, order_by: Sequence[str]) -> DataFrame:
    """Subjects per label, label taken from each subject's first row.

    Returned long (one row per subject with its group label) plus counts; a
    ``collect_list`` per label would put a whole class into one row.
    """
    first = first_rows(df, key, order_by).select(key, label)
    return first


def label_group_sizes(df: DataFrame, key: str, label: str, order_by: Sequence[str]) -> DataFrame:
    return label_groups(df, key, label, order_by).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def first_rows(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """First row per key in ``order_by`` order, via ``min_by`` over a struct.

    An aggregate (partial + final) rather than a ``row_number`` window, so a
    key holding a large share of rows is reduced map-side instead of sorted in
    one task.
    """
    order = [F.col(o) for o in order_by]
    rest = [c for c in df.columns if c != key]
    picked = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order))
    return df.groupBy(key).agg(picked.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def set_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (empty when the key is unique)."""
    keys = list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    dup = duplicate_keys(df, keys).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {dup[0].asDict()}")

