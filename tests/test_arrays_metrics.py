import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions.exprs import bce_with_logits
from cohortlake.operators import arrays as A, metrics as M


def test_resample_1d(spark):
    df = spark.createDataFrame([(1, [1, 4], [0.0, 1.0, 4.0, 9.0])], "k int, dims array<int>, voxels array<float>")
    out = A.volume_resample(df, [7]).first().voxels
    assert [round(x, 6) for x in out] == [0.0, 0.5, 1.0, 2.5, 4.0, 6.5, 9.0]


def test_resample_equals_interpolation_axis_by_axis(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    vol = rng.normal(size=(3, 1, 4, 2))
    df = spark.createDataFrame([(1, list(vol.shape), [float(x) for x in vol.ravel()])], "k int, dims array<int>, voxels array<double>")
    want = vol.squeeze()
    for axis, n in enumerate((5, 3, 6)):
        d = want.shape[axis]
        want = np.apply_along_axis(lambda line: np.interp(np.linspace(0, 1, n), np.linspace(0, 1, d), line), axis, want)
    got = A.volume_resample(df, [5, 3, 6]).first()
    assert got.dims == [5, 3, 6] and np.allclose(got.voxels, want.ravel())


def test_max_scale(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([0.0, 0.0],)], "voxels array<float>")
    out = [r.voxels for r in A.volume_max_scale(df).collect()]
    assert out[0] == [0.25, 0.5, 1.0] and out[1] == [None, None]


def test_bce_matches_formula(spark):
    df = spark.createDataFrame([(0.3, 1), (-2.0, 0), (4.0, 1)], "x double, y int")
    got = [r[0] for r in df.select(bce_with_logits(F.col("x"), F.col("y"), 2.0)).collect()]
    for (x, y), g in zip([(0.3, 1), (-2.0, 0), (4.0, 1)], got):
        sig = 1 / (1 + math.exp(-x))
        exp = -(2.0 * y * math.log(sig) + (1 - y) * math.log(1 - sig))
        assert math.isclose(g, exp, rel_tol=1e-9)


def test_center_loss_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 4))
    y = np.array([0, 1, 2, 0, 1, 2, 0, 1, 1])
    df = spark.createDataFrame([(int(i), int(y[i]), x[i].tolist()) for i in range(9)],
                               "id int, label int, embedding array<double>").withColumn("b", F.lit(0))
    centers = M.class_centers(df)
    got = M.center_loss(df, centers, ["b"]).first().center_loss
    c = np.stack([x[y == k].mean(axis=0) for k in range(3)])
    dist = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1) * (y[:, None] == np.arange(3)[None, :])
    exp = np.clip(dist, 1e-12, 1e12).sum() / 9
    assert math.isclose(got, exp, rel_tol=1e-9)


def test_triplet_loss_matches_numpy(spark):
    a, p, n = [0.0, 1.0], [0.5, 1.0], [3.0, 1.0]
    df = spark.createDataFrame([(0, a, p, n), (0, a, n, p)],
                               "b int, anchor_vec array<double>, positive_vec array<double>, negative_vec array<double>")
    got = M.triplet_margin_loss(df, ["b"]).first().triplet_loss
    d = lambda u, v: float(np.linalg.norm(np.array(u) - np.array(v) + 1e-6))
    exp = (max(d(a, p) - d(a, n) + 1, 0) + max(d(a, n) - d(a, p) + 1, 0)) / 2
    assert math.isclose(got, exp, rel_tol=1e-9)


def test_accuracies_and_running(spark):
    rows = [("r", "val", 0, b, lab, pred) for b, lab, pred in
            [(0, 1, 1), (0, 0, 1), (1, 0, 0), (1, 0, 0), (2, 1, 0), (2, 0, 0)]]
    df = spark.createDataFrame(rows, "run string, split string, epoch int, batch_id long, label int, prediction int")
    assert M.accuracy_micro(df).first().accuracy == 4 / 6
    assert math.isclose(M.accuracy_macro(df).first().macro_accuracy, (1 / 2 + 3 / 4) / 2)
    run = {r.batch_id: r.running_accuracy for r in M.running_metrics(df).collect()}
    assert run == {0: 0.5, 1: 0.75, 2: 4 / 6}


def test_blocked_running_sum_crosses_blocks(spark):
    df = spark.range(0, 100).select(F.lit("g").alias("g"), F.col("id").alias("o"), F.lit(1).alias("v"))
    out = M.blocked_running_sum(df, ["g"], "o", ["v"], block=7)
    assert all(r.v_cum == r.o + 1 for r in out.collect())


@pytest.mark.parametrize("planes", [1, 2, 3, 50])
def test_tiles_resample_like_whole_volumes(spark, planes):
    rng = np.random.default_rng(5)
    shapes = [((7, 5, 6), 0), ((4, 1, 4, 3), 1), ((2, 2, 2), 2), ((11, 3, 2), 3)]
    rows = [(k, list(s), [float(x) for x in rng.normal(size=int(np.prod(s)))], "x") for s, k in shapes]
    vols = spark.createDataFrame([*rows, (9, [0], [], "e"), (10, None, None, "n")], "key int, dims array<int>, voxels array<double>, note string")
    for size in ([5, 4, 7], [1, 3, 2], [13, 2, 2]):
        tiles = A.tiles_resample(A.volume_tiles(vols, planes), size, planes)
        assert tiles.columns == ["key", "dims", "voxels", "note", "tile", "origin"]
        got = {r.key: r for r in A.assemble_tiles(tiles, "key").collect()}
        want = {r.key: r for r in A.volume_resample(vols.where("key < 9"), size).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert list(r.dims) == size
            np.testing.assert_allclose(r.voxels, want[k].voxels, rtol=0, atol=1e-12)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan and "Exchange" not in plan


def test_tiles_flat_rank_and_scaling(spark):
    vols = spark.createDataFrame([(1, [3, 2], [0.0, 1.0, 2.0, 3.0, 4.0, 8.0]), (2, [2, 2], [0.0] * 4), (None, [2, 2], [1.0, 2.0, 4.0, 2.0])],
                                 "key int, dims array<int>, voxels array<double>")
    tiles = A.volume_tiles(vols, 1)
    assert sorted((r.key or 0, r.tile, r.origin, len(r.voxels)) for r in tiles.collect()) == [(0, 0, 0, 4), (1, 0, 0, 4), (1, 1, 1, 4), (2, 0, 0, 4)]
    scaled = {(r.key, r.tile): r.voxels for r in A.tiles_max_scale(tiles, "key").collect()}
    assert scaled[1, 1] == [0.25, 0.375, 0.5, 1.0] and scaled[2, 0] == [None] * 4 and scaled[None, 0] == [0.25, 0.5, 1.0, 0.5]
    with pytest.raises(Exception, match="rank does not match"):
        A.tiles_resample(tiles, [2, 2, 2], 1).collect()
