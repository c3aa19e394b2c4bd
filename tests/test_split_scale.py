import math

import pytest
from pyspark.sql import functions as F

from cohortlake.functions.exprs import permuted, round_keys
from cohortlake.operators import scale as SC, split as S
from cohortlake.plans.composed import calibration_bins, fit_moments


def test_quotas_match_expected_15_85(spark):
    counts = spark.createDataFrame([(0, 58), (1, 341)], "y int, cnt bigint")
    assert {r.y: r.test_quota for r in S.class_quotas(counts, "y", 0.25).collect()} == {0: 15, 1: 85}


def test_null_labels_and_subjects_with_two_labels(spark):
    df = spark.createDataFrame([(i % 40, None if i % 40 < 4 else i % 3) for i in range(200)], "k int, y int")
    out = S.stratified_split(df, "k", "y").collect()
    assert len(out) == 40 and len({r.k for r in out}) == 40
    assert sum(r.split == "test" for r in out) == 10 and sum(r.y is None for r in out) == 4
    rows = df.join(S.stratified_split(df, "k", "y").select("k", "split"), "k")
    assert rows.count() == 200


def test_stratified_split_on_labels_table(spark):
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = S.stratified_split(lab, "doc_id", "quality", 0.25, 23)
    got = {(r.quality, r.split): r["count"] for r in out.groupBy("quality", "split").count().collect()}
    assert got[(0, "test")] == 15 and got[(1, "test")] == 85
    assert got[(0, "train")] == 43 and got[(1, "train")] == 256


def test_split_rejects_singleton_class(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "k int, y int")
    with pytest.raises(ValueError):
        S.stratified_split(df, "k", "y")


def test_mini_batches_drop_last(spark):
    df = spark.range(0, 50).select(F.col("id").alias("k"), F.lit("val").alias("split"))
    out = S.mini_batches(df, "k", "split", 12)
    assert out.count() == 48
    assert {r.batch_id for r in out.collect()} == {0, 1, 2, 3}


def test_bootstrap_sizes(spark):
    df = spark.createDataFrame([(s, v) for s in range(40) for v in range(s % 3 + 1)], "subject int, v int")
    out = S.cluster_bootstrap(df, "subject", seed=3)
    draws = out.select("draw").distinct().count()
    assert draws == 40
    per_draw = out.groupBy("draw", "subject").count().collect()
    for r in per_draw:
        assert r["count"] == r.subject % 3 + 1


def test_minmax_constant_column_and_inverse(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "x double, c double")
    fit = SC.minmax_fit(df, ["x", "c"])
    z = SC.minmax_transform(df, fit, ["x", "c"])
    assert [r.c for r in z.collect()] == [-1.0, -1.0, -1.0]
    assert sorted(r.x for r in z.collect()) == [-1.0, 0.0, 1.0]
    back = SC.minmax_inverse(z, fit, ["x", "c"]).collect()
    assert all(math.isclose(a.x, b.x) and math.isclose(a.c, b.c) for a, b in zip(back, df.collect()))


def test_class_weight_without_positives_is_null(spark):
    df = spark.createDataFrame([(0,), (0,)], "y int")
    assert SC.class_weight(df, "y").first().class_weight is None
    df2 = spark.createDataFrame([(0,), (0,), (1,)], "y int")
    assert SC.class_weight(df2, "y").first().class_weight == 2.0


def test_batches_for_several_epochs_equal_per_epoch_calls(spark):
    df = spark.range(0, 61).select(F.col("id").alias("k"),
                                   F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"))
    both = S.mini_batches_epochs(df, "k", [0, 1], "split", 12)
    for e in (0, 1):
        one = S.mini_batches(df, "k", "split", 12, epoch=e).select("k", "split", "batch_id", "position")
        got = both.where(F.col("epoch") == e).select("k", "split", "batch_id", "position")
        assert one.exceptAll(got).count() == 0 and got.exceptAll(one).count() == 0


def test_permuted_is_a_bijection_for_any_size(spark):
    sizes = [1, 2, 3, 12, 13, 1000]
    rows = spark.createDataFrame([(i, n, e) for n in sizes for i in range(n) for e in (0, 1)], "i long, n long, e int")
    rows = rows.withColumn("k", round_keys(F.lit(23), "e"))
    out = rows.select("n", "e", "i", permuted("i", "n", "k").alias("p")).collect()
    for n in sizes:
        first, second = ([r.p for r in sorted(out, key=lambda r: r.i) if r.n == n and r.e == e] for e in (0, 1))
        assert sorted(first) == sorted(second) == list(range(n))
        if n == 1000:
            assert first != second and first != list(range(n))
            assert abs(sum(a < b for a, b in zip(first, first[1:], strict=False)) - 500) < 60  # no order is left


def test_permuted_batches_keep_key_order_outside_training_and_null_splits(spark):
    rows = [(i, "train" if i < 30 else "val" if i < 55 else None) for i in range(60)]
    out = S.mini_batches_permuted(spark.createDataFrame(rows, "subject long, split string"), "subject", [0, 4], batch_size=12, drop_last=False).collect()
    assert len(out) == 120
    for split, n in (("train", 30), ("val", 25), (None, 5)):
        for e in (0, 4):
            mine = sorted((r for r in out if r.split == split and r.epoch == e), key=lambda r: r.position)
            assert [r.position for r in mine] == list(range(n)) and all(r.batch_id == r.position // 12 for r in mine)
            assert (split == "train") != ([r.subject for r in mine] == sorted(r.subject for r in mine))


def test_fit_moments_tell_a_wrong_fit(spark):
    rows = [(1, 0.5, 0.6), (0, -0.5, 0.2), (1, 1.0, 0.8), (0, 0.0, 0.4)]
    out = {r.term: r for r in fit_moments(spark.createDataFrame(rows, "y int, a double, probability double"), "y", ["a"], 2.0).collect()}
    assert abs(out["intercept"].data_moment - 4 / 6) < 1e-12 and abs(out["intercept"].model_moment - 3.4 / 6) < 1e-12
    assert abs(out["a"].data_moment - 3.0 / 6) < 1e-12 and abs(out["a"].model_moment - (2 * 0.3 - 0.1 + 2 * 0.8) / 6) < 1e-12


def test_calibration_bins(spark):
    rows = [(0, 0.05), (1, 0.09), (1, 1.0), (1, 0.95)]
    out = calibration_bins(spark.createDataFrame(rows, "y int, probability double"), "y").orderBy("bin").collect()
    assert [(r.bin, r.n, r.positives) for r in out] == [(0, 2, 1), (9, 2, 2)]
