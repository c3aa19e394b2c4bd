"""Missing-value fills: per-subject next/previous visit, then global mode and mean.

A subject can hold a large share of all rows. ``fill_nearest_visit`` numbers rows by
range parts of (subject, visit order), so that a large subject spans several parts,
fills inside each (subject, part) by windows (one exchange, a sort for each side), and
carries values across parts from a summary of the subjects that span more than one.
One plan for all sizes and for any type of the order columns; nothing is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .index import range_parts

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def _as_list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def fill_nearest_visit(df: DataFrame, key: str | Sequence[str], order_by: str | Sequence[str],
                       columns: Sequence[str] | None = None, direction: str = "both",
                       partitions: int | None = None) -> DataFrame:
    """Fill nulls within each subject from its other visits.

    ``direction='both'`` is backward fill then forward fill: a gap takes the next
    non-null value in visit order, only trailing gaps take the previous one.
    ``'backward'`` and ``'forward'`` are the two halves alone. All-null groups
    stay null. ``order_by`` is required (Spark rows have no file order) and should
    be unique within a subject.
    """
    keys, order = _as_list(key), _as_list(order_by)
    if not order:
        raise ValueError("order_by is required")
    if direction not in ("both", "backward", "forward"):
        raise ValueError(direction)
    if columns is None:
        columns = [c for c in df.columns if c not in keys and c not in order]
    columns = list(columns)
    if not columns:
        return df
    sides = {"both": "np", "backward": "n", "forward": "p"}[direction]
    out = nearest_values(df, keys, order, columns, sides, partitions)
    return out.withColumns({c: F.coalesce(*[F.col(f"_{side}{i}") for side in sides]) for i, c in enumerate(columns)}).select(*df.columns)


def nearest_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], sides: str = "np",
                   partitions: int | None = None) -> DataFrame:
    """Add, for the i-th of ``columns``, ``_p<i>``: the last non-null value at or before the
    row in its group's order, and ``_n<i>``: the first one at or after it."""
    rows, spanning = range_parts(df, [*keys, *order], partitions, len(keys))
    known, carries, edges = {}, {}, []
    for side in sides:  # the next value is the last one in falling order: no frame reads ahead
        turn = F.asc if side == "p" else F.desc
        inside = Window.partitionBy(*keys, "_part").orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        across = Window.partitionBy(*keys).orderBy(turn("_part")).rowsBetween(Window.unboundedPreceding, -1)
        pick = F.max_by if side == "p" else F.min_by
        for i, c in enumerate(columns):
            known[f"_{side}{i}"] = F.last(c, ignorenulls=True).over(inside)
            edges.append(pick(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_e{side}{i}"))
            carries[f"_c{side}{i}"] = F.last(f"_e{side}{i}", ignorenulls=True).over(across)
    # one row for each part of a group that spans some: at most two for each bound, and the parts inside large groups
    summary = spanning.groupBy(*keys, "_part").agg(*edges)
    summary = summary.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_part").alias("_kp"),
                             *[c.alias(name) for name, c in carries.items()])
    on = [*[F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)], F.col("_part") == F.col("_kp")]
    out = rows.withColumns(known).join(F.broadcast(summary), on, "left")
    return out.select(*df.columns, *[F.coalesce(f"_{side}{i}", f"_c{side}{i}").alias(f"_{side}{i}")
                                     for side in sides for i in range(len(columns))])


def backfill(df: DataFrame, key, order_by, columns=None, **kw) -> DataFrame:
    return fill_nearest_visit(df, key, order_by, columns, direction="backward", **kw)


def forward_fill(df: DataFrame, key, order_by, columns=None, **kw) -> DataFrame:
    return fill_nearest_visit(df, key, order_by, columns, direction="forward", **kw)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """The most frequent value of each column as a scalar subquery; ties go to the smallest,
    a column without values has null.

    Values are counted in long form, a row for each (column, value), and reduced by a
    minimum over (falling count, value): both aggregates combine before their exchange
    and no buffer holds a column's values, however many there are. One pass for
    all columns of a type."""
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out: dict[str, Column] = {}
    for same in by_type.values():
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(same)])).alias("e")
        counts = df.select(each).select("e.*").where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))  # a row for each column
        row = best.agg(F.struct(*[F.max(F.when(F.col("i") == i, F.col("b.v"))).alias(f"m{i}") for i in range(len(same))])).scalar()
        out.update({c: row.getField(f"m{i}") for i, c in enumerate(same)})
    return out


def global_mode_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the column's most frequent value; ties go to the smallest.

    A column with no value at all stays null. See :func:`column_modes`.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    return df.withColumns({c: F.coalesce(F.col(c), mode) for c, mode in column_modes(df, columns).items()})


def global_mean_fill(df: DataFrame, columns: Sequence[str] | None = None,
                     exclude: Sequence[str] = ()) -> DataFrame:
    """Fill remaining numeric nulls with the column mean rounded half-to-even to 0 places."""
    if columns is None:
        columns = numeric_columns(df, exclude)
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    stats = df.agg(F.struct(*[F.bround(F.avg(c), 0).alias(c) for c in columns])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), stats.getField(c)) for c in columns})


def null_check(df: DataFrame, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group: does the column hold any null? (``bool_or(c IS NULL)``)."""
    keys = _as_list(key)
    return df.groupBy(*keys).agg(*[F.bool_or(F.col(c).isNull()).alias(f"{c}_has_null")
                                   for c in columns])


def global_fill(df: DataFrame, mode_columns: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Mode fill of ``mode_columns`` then mean fill of every other numeric column.

    Equivalent to :func:`global_mode_fill` followed by :func:`global_mean_fill`:
    mode-filled columns have no nulls left, so their means are never used, and the
    other columns' means do not depend on the mode fill. The means come from one aggregate.
    """
    modes = [c for c in mode_columns if c in df.columns]
    means = [c for c in numeric_columns(df, exclude) if c not in modes]
    fills = {c: F.coalesce(F.col(c), mode) for c, mode in column_modes(df, modes).items()}
    if means:
        stats = df.agg(F.struct(*[F.bround(F.avg(c), 0).alias(f"a_{c}") for c in means])).scalar()
        fills.update({c: F.coalesce(F.col(c), stats.getField(f"a_{c}")) for c in means})
    return df.withColumns(fills) if fills else df
