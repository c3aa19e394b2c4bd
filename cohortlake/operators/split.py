"""Stratified split, mini-batches and the cluster bootstrap.

Randomness is a seeded md5 of the key, so every engine and every re-run after an
executor loss draws the same rows. Ranks inside a class come from one global
index over (class, hash) instead of a window partitioned by the class, which
would put a whole class into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BATCH_SIZE, SPLIT_SEED
from ..functions.exprs import hash_int, hash_key, permuted, round_keys
from ..session import write_shared
from .index import rank_within, row_index

TEST_FRACTION = 0.25  # default of this library


def class_quotas(counts: DataFrame, label: str, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """``(label, cnt, test_quota)`` from ``(label, cnt)``, one row per class.

    Test total is ``ceil(f * n)``. The train sizes are distributed first by
    largest remainder (ties to the smaller class value, null last); a class' test
    size is the rest. Whole-number arithmetic in decimals.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("_rem").desc(), F.col(label).asc_nulls_last())
    c = counts.withColumn("_n", F.sum("cnt").over(every))
    c = c.withColumn("_train", F.col("_n") - F.ceil(F.lit(test_fraction) * F.col("_n")))
    share = F.col("_train").cast("decimal(19,0)") * F.col("cnt").cast("decimal(19,0)")
    c = c.withColumns({"_fl": F.floor(share / F.col("_n")).cast("bigint"), "_rem": (share % F.col("_n")).cast("bigint")})
    extra = F.col("_train") - F.sum("_fl").over(every)
    quota = F.col("cnt") - F.col("_fl") - (F.row_number().over(order) <= extra).cast("int")
    return c.select(label, "cnt", quota.alias("test_quota"))


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = TEST_FRACTION,
                     seed: int = SPLIT_SEED, split_col: str = "split",
                     checkpoint: bool = True) -> DataFrame:
    """Assign each distinct subject to 'train' or 'test', stratified by label.

    A subject has one label: the smallest of its rows (null only where it has no
    other; null is a class of its own). Exact quotas (see :func:`class_quotas`);
    inside a class the test subjects are the first ones in ``md5(key|seed)`` order.
    Classes with under two members are rejected, as the reference's splitter does.
    """
    units = write_shared(df.groupBy(key).agg(F.min(label).alias(label)), "split-units")
    counts = units.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    small = [r[0] for r in counts.where("cnt < 2").select(label).limit(10).collect()]
    if small:
        raise ValueError(f"classes with fewer than 2 members: {small}")
    quotas = class_quotas(counts, label, test_fraction).select(F.col(label).alias("_label"), "test_quota")
    ranked = rank_within(units, label, [hash_key(key, F.lit(seed)), F.col(key)], "_rank")
    out = ranked.join(quotas, ranked[label].eqNullSafe(quotas["_label"])).select(
        key, label, F.when(F.col("_rank") < F.col("test_quota"), "test").otherwise("train").alias(split_col))
    # One row per subject: written once to the shared folder, so the training rows, the
    # scaler fit, the class weight and the batches all read the same assignment.
    return write_shared(out, "split") if checkpoint else out


def mini_batches(df: DataFrame, key: str, split_col: str = "split", batch_size: int = BATCH_SIZE,
                 epoch: int = 0, seed: int = SPLIT_SEED, shuffle_splits: Sequence[str] = ("train",),
                 drop_last: bool = True) -> DataFrame:
    """Batch ids per split: shuffled (seeded by epoch) for training, key order otherwise.

    ``drop_last`` drops the incomplete final batch of each split, as the
    reference's loaders do (so up to ``batch_size-1`` rows are never scored).
    """
    shuffled = F.col(split_col).isin(list(shuffle_splits))
    order = F.when(shuffled, hash_key(key, F.lit(epoch), F.lit(seed))).otherwise(F.lit(""))
    ranked = rank_within(df, split_col, [order, F.col(key)], "_pos")
    sizes = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("_n"))
    out = ranked.join(sizes, split_col).withColumn(
        "batch_id", F.floor(F.col("_pos") / batch_size).cast("bigint"))
    if drop_last:
        out = out.where(F.col("batch_id") < F.floor(F.col("_n") / batch_size))
    return out.withColumn("position", F.col("_pos")).drop("_pos", "_n")


def cluster_bootstrap(df: DataFrame, key: str = "subject", seed: int = 7) -> DataFrame:
    """Resample subjects with replacement (as many draws as subjects) and append
    all visits of every draw, repeats included; ``draw`` numbers the draws.

    Draw ``i`` picks subject index ``md5(seed|i) mod n``; the (draw, subject)
    table (one row per subject) joins the visits on the subject. A subject with
    many visits is a skewed key on the visit side only, which AQE's skew-join
    handling splits while replicating that subject's few draws.
    """
    subjects = df.select(key).where(F.col(key).isNotNull()).distinct()
    indexed = row_index(subjects, [key], "_idx")
    n = subjects.agg(F.count(F.lit(1))).scalar()
    draws = indexed.select(F.col("_idx").alias("draw"),
                           (hash_int(F.lit(seed), F.col("_idx")) % n).alias("_pick"))
    picked = draws.join(indexed.withColumnRenamed("_idx", "_pick"), "_pick", "inner").drop("_pick")
    return df.join(picked, key, "inner")


def mini_batches_epochs(df: DataFrame, key: str, epochs: Sequence[int], split_col: str = "split",
                        batch_size: int = BATCH_SIZE, seed: int = SPLIT_SEED,
                        shuffle_splits: Sequence[str] = ("train",), drop_last: bool = True) -> DataFrame:
    """:func:`mini_batches` for several epochs in ONE ranking pass: rows are
    repeated per epoch and ranked inside (split, epoch)."""
    x = df.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    x = x.withColumn("_grp", F.concat_ws("|", F.col(split_col), F.col("epoch").cast("string")))
    shuffled = F.col(split_col).isin(list(shuffle_splits))
    order = F.when(shuffled, hash_key(key, F.col("epoch"), F.lit(seed))).otherwise(F.lit(""))
    ranked = rank_within(x, "_grp", [order, F.col(key)], "_pos")
    sizes = x.groupBy("_grp").agg(F.count(F.lit(1)).alias("_n"))
    out = ranked.join(sizes, "_grp").withColumn(
        "batch_id", F.floor(F.col("_pos") / batch_size).cast("bigint"))
    if drop_last:
        out = out.where(F.col("batch_id") < F.floor(F.col("_n") / batch_size))
    return out.withColumn("position", F.col("_pos")).drop("_pos", "_n", "_grp")


def mini_batches_permuted(df: DataFrame, key: str, epochs: Sequence[int], split_col: str = "split",
                          batch_size: int = BATCH_SIZE, seed: int = SPLIT_SEED,
                          shuffle_splits: Sequence[str] = ("train",), drop_last: bool = True) -> DataFrame:
    """Batches of many epochs from one ranking: rows are ranked by ``key`` inside their split once, and an
    epoch's ``position`` is a seeded permutation of that rank (:func:`~cohortlake.functions.exprs.permuted`),
    so that an epoch costs a projection and neither a sort nor a shuffle.

    One row for each row of ``df`` and epoch. Splits outside ``shuffle_splits`` keep key order;
    a null split is one of its own. Other orders than :func:`mini_batches`, from the same seed."""
    ranked = rank_within(df, split_col, [F.col(key)], "_rank")
    sizes = df.groupBy(F.col(split_col).alias("_split")).agg(F.count(F.lit(1)).alias("_n"))
    # a row for each split and epoch: Spark broadcasts it by its measured size
    orders = sizes.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    orders = orders.withColumn("_keys", round_keys(F.lit(seed), "epoch"))
    rows = ranked.join(orders, F.col(split_col).eqNullSafe(F.col("_split"))).drop("_split")
    shuffled = F.coalesce(F.col(split_col).isin(list(shuffle_splits)), F.lit(False))
    out = rows.withColumn("position", F.when(shuffled, permuted("_rank", "_n", "_keys")).otherwise(F.col("_rank")))
    out = out.withColumn("batch_id", F.floor(F.col("position") / batch_size).cast("bigint"))
    if drop_last:
        out = out.where(F.col("batch_id") < F.floor(F.col("_n") / batch_size))
    return out.drop("_rank", "_keys", "_n")
