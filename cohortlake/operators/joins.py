"""Key joins between panels, semi/anti filters, first-row lookups and set ops.

Joins are plain DataFrame equi-joins: Catalyst keeps an existing hash
partitioning on the keys (panels produced by ``groupBy(subject, visit)`` join
without a new exchange), AQE turns a small side into a broadcast from runtime
sizes and splits skewed keys (``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agg import first_rows


def _suffix_clashes(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    suffixes=("_x", "_y")) -> tuple[DataFrame, DataFrame]:
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if not clash:
        return left, right
    return (left.withColumnsRenamed({c: c + suffixes[0] for c in clash}),
            right.withColumnsRenamed({c: c + suffixes[1] for c in clash}))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("subject", "visit"),
              null_keys_match: bool = False) -> DataFrame:
    """Inner equi-join on several keys; clashing names get ``_x``/``_y``.

    ``null_keys_match=True`` reproduces pandas, where NULL keys match each other
    (null-safe equality); the default is SQL semantics.
    """
    keys = list(keys)
    left, right = _suffix_clashes(left, right, keys)
    if not null_keys_match:
        return left.join(right, keys, "inner")
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, "inner").drop(*[f"_r_{k}" for k in keys])


def join_panels(first: DataFrame, *others: DataFrame | None,
                keys: Sequence[str] = ("subject", "visit")) -> DataFrame:
    """Chain of inner joins; ``None`` panels (an optional third table) are skipped."""
    out = first
    for p in others:
        if p is not None:
            out = join_keys(out, p, keys)
    return out


def semi_join_subjects(df: DataFrame, other: DataFrame, key: str = "subject") -> DataFrame:
    """Rows of ``df`` whose subject also occurs in ``other`` (LEFT SEMI)."""
    return df.join(other.select(key), key, "left_semi")


def common_subjects(tabular: DataFrame, imaging: DataFrame,
                    keys: Sequence[str] = ("subject", "visit")) -> DataFrame:
    """Subjects in both tables joined on ``keys``.

    The reference first semi-filters imaging on common subjects; an inner join on
    (subject, visit) already implies it, so the plan is one join.
    """
    return join_keys(tabular, imaging, keys)


def join_image_rows(rows: DataFrame, volumes: DataFrame, key: str = "subject",
                    how: str = "inner") -> DataFrame:
    """Attach each row's volume (``inner``); ``left_anti`` lists rows without one."""
    return rows.join(volumes, key, how)


def split_filter(df: DataFrame, assignment: DataFrame, split: str, key: str = "subject",
                 split_col: str = "split") -> DataFrame:
    """Rows whose subject is assigned to ``split`` (a LEFT SEMI join)."""
    chosen = assignment.where(F.col(split_col) == split).select(key)
    return df.join(chosen, key, "left_semi")


def lookup_first_row(df: DataFrame, ids: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """For each requested id, the features of its first row (in ``order_by`` order)."""
    return ids.select(key).join(first_rows(df, key, order_by), key, "inner")


def intersect_subjects(a: DataFrame, b: DataFrame, key: str = "subject") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def union_results(*parts: DataFrame) -> DataFrame:
    """Multiset append by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def other_classes(df: DataFrame, label: str, name: str = "other_label") -> DataFrame:
    """One row per (row, class other than its own label).

    The class set is a scalar subquery (``collect_set`` over the label column,
    bounded by the number of classes); no join is planned.
    """
    classes = df.select(F.sort_array(F.collect_set(label))).scalar()
    return df.withColumn(name, F.explode(F.array_except(classes, F.array(F.col(label)))))
