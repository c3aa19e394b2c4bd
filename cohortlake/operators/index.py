"""Range parts of a sort order, and global positions without a single-partition window.

``range_parts`` numbers rows by explicit bounds of the sort key. The bounds are
quantiles of a random sample, fetched once and held as literals: the part of a row is
an expression of the row alone, so nothing has to be written for two steps, or two
runs of a step, to place it alike. Windows inside a part and one small table over the
groups that span parts (at most two rows a bound) then give running values over groups
of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a part: one task sorts them in memory even if they unpack to many times as much.
PART_BYTES = 16 << 20
#: Sampled sort keys for each part; a part then holds its share of the rows within about a quarter.
SAMPLE = 48
#: Up to so many bounds are compared by a compiled tree of conditions, more by a search in their array.
TREE = 64


def _cols(order_by) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def part_count(df: DataFrame) -> int:
    """A part for every ``PART_BYTES`` of ``df`` by Spark's own estimate (the one by which it chooses
    joins; unknown sizes count as huge), at most one for each shuffle partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)))


def _bisect(table: Column, key: Column, low: int, high: int) -> Column:
    """How many of the bounds are at or below ``key``, if ``low`` are and those from ``high`` on are not."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(F.get(table, F.lit(middle)) <= key, _bisect(table, key, middle + 1, high)).otherwise(_bisect(table, key, low, middle))


def range_parts(df: DataFrame, order_by: Sequence[str | Column], partitions: int | None = None, group: int = 0,
                part: str = "_part") -> tuple[DataFrame, DataFrame]:
    """``df`` with ``part``: how many bounds are at or below the row's sort key (nulls sort first); and
    those rows of it whose group of the first ``group`` sort columns may have rows in several parts
    (all rows, without a group).

    Equal sort keys share a part, so the order should be unique where one key may be
    frequent. At most ``partitions - 1`` groups, those of the bounds, span parts."""
    n = partitions or part_count(df)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_cols(order_by))])
    head = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_cols(order_by)[:max(group, 1)])])
    n_bounds = 0
    if n > 1:  # any constants in order serve as bounds, so that their way through text need not be exact
        keys = df.select(key.alias("k"), head.alias("h"))
        sample = keys.withColumn("r", F.rand(17)).orderBy("r").limit(n * SAMPLE)
        cuts = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("a", F.floor(i * F.size("a") / n).cast("int")))
        cuts = sample.agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("a")).select(F.array_distinct(F.filter(cuts, lambda b: b.isNotNull())).alias("b"))
        n_bounds, table, heads = cuts.select(F.size("b"), F.to_json(F.col("b.k")), F.to_json(F.col("b.h"))).first()
    if not n_bounds:
        rows = df.withColumn(part, F.lit(0))
        return rows, rows.where(F.lit(False)) if group else rows
    kinds = [f"array<{keys.schema[c].dataType.simpleString()}>" for c in ("k", "h")]
    table, heads = (F.from_json(F.lit(text), kind) for text, kind in zip((table, heads), kinds, strict=True))
    if n_bounds <= TREE:
        out = df.withColumn(part, _bisect(table, key, 0, n_bounds))
    else:
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(n_bounds.bit_length()))])
        out = df.withColumn(part, F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at)))
    if not group:
        return out, out
    own = df.sparkSession.range(1).select(F.explode(F.array_distinct(heads)).alias("_own")).select("_own.*")  # a row for each bound, or fewer
    on = [c.eqNullSafe(F.col(f"_own{i}")) for i, c in enumerate(_cols(order_by)[:group])]
    return out, out.join(F.broadcast(own.toDF(*[f"_own{i}" for i in range(group)])), on, "left_semi")


def running(df: DataFrame, group: Sequence[str], order_by: Sequence[str | Column], value: Column, name: str,
            partitions: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group up to this one, in order."""
    group = list(group)
    rows, spanning = range_parts(df, [*group, *order_by], partitions, len(group))
    inside = Window.partitionBy(*group, "_part").orderBy(*_cols(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    # one row for each part without groups, else for each part of a group that spans some: a bounded table
    sums = spanning.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), before.alias("_before"))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_part") == F.col("_p")]
    out = rows.withColumn("_in", F.sum(value).over(inside)).join(F.broadcast(sums), on, "left")
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_in")).select(*df.columns, name)


def row_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_index",
              partitions: int | None = None) -> DataFrame:
    """Add a 0-based ``name`` = position of the row in ``order_by`` order.

    ``order_by`` should be unique (add a key as tie-breaker) for a reproducible index.
    """
    out = running(df, [], order_by, F.lit(1).cast("bigint"), name, partitions)
    return out.withColumn(name, F.col(name) - 1)


def rank_within(df: DataFrame, group: str, order_by: Sequence[str | Column],
                name: str = "rank_in_group", partitions: int | None = None) -> DataFrame:
    """0-based rank inside ``group``, which may be a column of few values (labels).

    A ``row_number`` window partitioned by a label would send each class to one
    task; here a class is cut into range parts. A null group is one group.
    """
    out = running(df, [group], order_by, F.lit(1).cast("bigint"), name, partitions)
    return out.withColumn(name, F.col(name) - 1)
