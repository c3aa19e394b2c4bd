import numpy as np

from cohortlake.sources import io


def test_csv_na_tokens(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text("subject;score;site\nA;1.5;x\nB;NA;NA\nC;;null\n")
    df = io.csv_scan(spark, str(p), ";", "subject string, score double, site string")
    rows = df.orderBy("subject").collect()
    assert [r.score for r in rows] == [1.5, None, None]
    assert [r.site for r in rows] == ["x", None, None]


def test_csv_tokens_never_decide_a_type(spark, tmp_path):
    from cohortlake.operators import fill
    p = tmp_path / "v.csv"
    p.write_text("s;x;n;c\nA;1.5;1;a\nB;NA;NaN;null\nC;NaN;3;b\nD;nan;null;NA\nE;2.5;;c\n")
    df = io.csv_scan(spark, str(p), ";")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "double", "bigint", "string"]
    typed = io.csv_scan(spark, str(p), ";", "s string, x double, n int, c string")
    for d in (df, typed):
        assert [(r.x, r.n) for r in d.orderBy("s").collect()] == [(1.5, 1), (None, None), (None, 3), (None, None), (2.5, None)]
        assert [r.x for r in fill.global_mean_fill(d, ["x"]).orderBy("s").collect()] == [1.5, 2.0, 2.0, 2.0, 2.5]
    bad = io.unparsable(spark, str(p), "s int, x double, n int, c string", ";")
    assert {r.column: r.n for r in bad.collect()} == {"s": 5, "x": 0, "n": 0, "c": 0}


def test_unfinished_table_is_computed_again(spark, tmp_path):
    path = tmp_path / "half"
    (path / "_temporary").mkdir(parents=True)
    assert io.quick_reload(spark, str(path), lambda: spark.range(4)).count() == 4


def test_a_repeated_epoch_is_stored_once(spark, tmp_path):
    p = str(tmp_path / "preds")
    df = spark.createDataFrame([("r", "s", e, i) for e in (0, 1) for i in range(5)], "run string, split string, epoch int, subject int")
    io.write_predictions(df, p)
    io.write_predictions(df.where("epoch = 1"), p)
    assert spark.read.parquet(p).count() == 10


def test_quick_reload_reads_saved_copy(spark, tmp_path):
    path = str(tmp_path / "proc")
    first = io.quick_reload(spark, path, lambda: spark.range(5))
    assert first.count() == 5
    again = io.quick_reload(spark, path, lambda: spark.range(100))
    assert again.count() == 5
    fresh = io.quick_reload(spark, path, lambda: spark.range(7), quick=False)
    assert fresh.count() == 7


def test_npy_volumes(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    np.save(tmp_path / "s1.npy", a)
    np.save(tmp_path / "s2.npy", a * 2)
    df = io.read_npy_volumes(spark, str(tmp_path / "*.npy")).orderBy("subject").collect()
    assert [r.subject for r in df] == ["s1", "s2"]
    assert df[0].dims == [2, 3, 4] and df[1].voxels[5] == 10.0


def test_presplit_scan(spark, tmp_path):
    paths = {}
    for name, n in (("train", 3), ("val", 2), ("test", 1)):
        p = tmp_path / f"{name}.csv"
        p.write_text("Image_id,f\n" + "".join(f"{name}{i},{i}\n" for i in range(n)))
        paths[name] = str(p)
    df = io.presplit_scan(spark, paths, ",", "Image_id string, f double")
    assert {r.split: r["count"] for r in df.groupBy("split").count().collect()} == \
        {"train": 3, "val": 2, "test": 1}
