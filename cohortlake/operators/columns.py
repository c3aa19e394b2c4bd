"""Projections, renames, strict drops, codes, one-hot, hour codes, weighted sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (CODE_COLUMNS, CONFOUNDERS, CONSTRUCT_RENAMES, HOUR_CODES,
                         HOUR_COLUMNS, ONE_HOT_COLUMNS, REDUNDANT_COLUMNS,
                         STROOP_ERROR_WEIGHTS, STROOP_MISS_WEIGHTS)
from ..functions.exprs import hour_code, weighted_sum
from .index import rank_within


def project_target(df: DataFrame, target: str, key: str = "subject") -> DataFrame:
    return df.select(key, target)


def project_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*features)


def split_xy(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Predictors (everything but the target) and the target on its own."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} not in columns")
    return df.drop(target), df.select(target)


def drop_columns(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Drop columns; unlike ``DataFrame.drop`` a missing name raises when strict."""
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*[c for c in columns if c in df.columns])


def drop_confounders(df: DataFrame, age: bool = False, age_column: str = "visit_age",
                     confounders: Sequence[str] = CONFOUNDERS) -> DataFrame:
    cols = list(confounders) + ([age_column] if age else [])
    return drop_columns(df, cols)


def drop_redundant(df: DataFrame, columns: Sequence[str] = REDUNDANT_COLUMNS) -> DataFrame:
    return drop_columns(df, columns)


def rename_columns(df: DataFrame, mapping: Mapping[str, str] = CONSTRUCT_RENAMES) -> DataFrame:
    """Rename; names that are absent are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def drop_by_name(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop features by NAME (the reference drops positions 2 and 3 while meaning age and sex)."""
    return drop_columns(df, names)


def drop_positions(df: DataFrame, features: Sequence[str], positions: Sequence[int] = (2, 3)) -> DataFrame:
    """Drop features by their POSITION in the feature list, as the reference does."""
    return drop_columns(df, [features[i] for i in positions])


def attach_columns(df: DataFrame, front: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Put ``front`` (key, target) before the feature columns, in one projection."""
    return df.select(*front, *rest)


def filter_lt(df: DataFrame, column: str, bound: float) -> DataFrame:
    """Keep ``column < bound`` (strict); null values are dropped."""
    return df.where(F.col(column) < F.lit(bound))


def weighted_column_sum(df: DataFrame, name: str, weights: Mapping[str, float]) -> DataFrame:
    return df.withColumn(name, weighted_sum(weights))


def sum_stroop(df: DataFrame) -> DataFrame:
    """The reference's two Stroop sums (repeated terms kept, three terms never added)."""
    return (df.withColumn("stroop_error_sum", weighted_sum(STROOP_ERROR_WEIGHTS))
              .withColumn("stroop_miss_sum", weighted_sum(STROOP_MISS_WEIGHTS)))


def hours_to_codes(df: DataFrame, columns: Sequence[str] = HOUR_COLUMNS,
                   codes: Mapping[int, int] = HOUR_CODES) -> DataFrame:
    return df.withColumns({c: hour_code(c, codes) for c in columns if c in df.columns})


def code_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(name, value, code)``: 0-based rank of each distinct non-null value of its
    column in sorted order. Columns of one type; distinct values are found in one pass
    and ranked over range parts, so that no task holds a column's values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])).alias("e")
    values = df.select(each).select("e.*").where(F.col("value").isNotNull()).distinct()
    return rank_within(values, "name", ["value"], "code").withColumn("code", F.col("code").cast("int"))


def category_codes(df: DataFrame, columns: Sequence[str] = CODE_COLUMNS) -> DataFrame:
    """Replace values by their rank among the sorted distinct values; null -> -1.

    Code tables are joined; Spark broadcasts one that is small by its measured size,
    and splits skewed values of a large one.
    """
    columns = [c for c in columns if c in df.columns]
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out = df
    for same in by_type.values():
        codes = code_table(df, same)
        for c in same:
            t = codes.where(F.col("name") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            names = out.columns
            out = (out.join(t, out[c] == t["_value"], "left").drop("_value")
                   .withColumn(c, F.coalesce(F.col("_code"), F.lit(-1))).select(*names))
    return out


def one_hot(df: DataFrame, columns: Sequence[str] = ONE_HOT_COLUMNS,
            values: Mapping[str, Sequence] | None = None, max_values: int = 10_000) -> DataFrame:
    """One 0/1 column ``<col>_<value>`` per sorted distinct value; source dropped.

    Null rows get all zeros. New columns go last. ``values`` names the values of a
    column; without it they are counted and, up to ``max_values``, collected, since each
    becomes a column of the schema. More of them are an error that names their number.
    """
    out = df
    for c in columns:
        if c not in out.columns:
            continue
        given = (values or {}).get(c)
        if given is None:
            given = [r[0] for r in out.select(c).where(F.col(c).isNotNull()).distinct().limit(max_values + 1).collect()]
            if len(given) > max_values:
                raise ValueError(f"{c!r} has {out.select(c).distinct().count()} values, more than {max_values}: name those to use in values")
        new = {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in sorted(given)}
        out = out.withColumns(new).drop(c)
    return out


def feature_groups(category_file: DataFrame, data_columns: Sequence[str],
                   categories: Sequence[str]) -> DataFrame:
    """(category, feature, position): names listed per category that exist in the
    data, in data-column order. ``category_file`` has one string column per
    category with ragged (null-padded) cells.
    """
    present = [c for c in categories if c in category_file.columns]
    long = (category_file.unpivot([], present, "category", "feature")
            .where(F.col("feature").isNotNull()))
    pos = category_file.sparkSession.createDataFrame(
        [(n, i) for i, n in enumerate(data_columns)], "feature string, position int")
    return long.join(F.broadcast(pos), "feature", "inner").select("category", "feature", "position").distinct()


def cast_types(df: DataFrame, columns: Sequence[str], to: str = "float") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(to) for c in columns})


def path_columns(df: DataFrame, base: str, key: str = "subject") -> DataFrame:
    """``<base>/<key>.nii.gz`` and ``<base>/<key>/image.nii.gz`` path columns."""
    root = F.lit(base.rstrip("/"))
    k = F.col(key).cast("string")
    return df.withColumns({
        "volume_path": F.concat(F.concat_ws("/", root, k), F.lit(".nii.gz")),
        "image_path": F.concat_ws("/", root, k, F.lit("image.nii.gz")),
    })



def feature_group_tables(data: DataFrame, category_file: DataFrame,
                         categories: Sequence[str]) -> dict[str, DataFrame]:
    """``{category: data restricted to that category's columns}`` in data-column
    order. The (category, feature) list is schema metadata (bounded by the number
    of columns), so it is collected; the tables stay distributed projections."""
    groups = feature_groups(category_file, data.columns, categories)
    by_cat: dict[str, list] = {c: [] for c in categories}
    for r in groups.collect():
        by_cat[r["category"]].append((r["position"], r["feature"]))
    return {c: data.select(*[f for _, f in sorted(v)]) for c, v in by_cat.items()}
