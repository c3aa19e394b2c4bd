"""The data source over folders of volume files."""
import numpy as np
import pytest

from cohortlake.operators import arrays as A
from cohortlake.sources import volumes


def save(path, **arrays):
    for name, a in arrays.items():
        np.save(path / f"{name}.npy", a)


def rows(df):
    return sorted((r.subject, list(r.dims), np.round(r.voxels, 5).tolist()) for r in df.collect())


def test_types_orders_and_names(spark, tmp_path):
    a = np.arange(24).reshape(2, 3, 4)
    save(tmp_path, c=a.astype("<f8"), big=a.astype(">i2"), f=np.asfortranarray(a), empty=np.zeros((0, 3)), scalar=np.float32(7), _hidden=a)
    (tmp_path / "notes.txt").write_text("no volume")
    flat = [float(x) for x in range(24)]
    want = [(n, [2, 3, 4], flat) for n in ("big", "c", "f")] + [("empty", [0, 3], []), ("scalar", [], [7.0])]
    assert rows(volumes.scan_npy_folder(spark, str(tmp_path))) == sorted(want)


def test_empty_folder(spark, tmp_path):
    assert volumes.scan_npy_folder(spark, str(tmp_path)).count() == 0
    volumes.write_npy_folder(spark.createDataFrame([], volumes.WHOLE), str(tmp_path / "none"))
    assert volumes.scan_npy_folder(spark, str(tmp_path / "none"), planes=2).count() == 0


@pytest.mark.parametrize("planes, partition_bytes", [(1, 1), (2, 100), (3, 300), (50, 1 << 20)])
def test_tiles_of_ranges_are_those_of_whole_volumes(spark, tmp_path, planes, partition_bytes):
    rng = np.random.default_rng(1)
    shapes = {"a": (9, 3, 4), "b": (1, 5, 2), "c": (2, 2, 2), "d": (1, 1, 1), "e": (7,), "g": (0, 4)}
    save(tmp_path, **{k: rng.normal(size=s).astype(np.float32) for k, s in shapes.items()}, h=np.asfortranarray(rng.normal(size=(6, 3, 2))))
    split = volumes.scan_npy_folder(spark, str(tmp_path), planes, partition_bytes=partition_bytes, open_cost=0)
    want = A.volume_tiles(volumes.scan_npy_folder(spark, str(tmp_path)), planes)
    key = lambda df: sorted((r.subject, r.tile, r.origin, list(r.dims), list(r.voxels)) for r in df.collect())
    assert key(split) == key(want)
    if partition_bytes == 100:
        assert split.rdd.getNumPartitions() > len(shapes) + 1  # files are cut


def test_keys_open_their_files_alone(spark, tmp_path):
    save(tmp_path, s1=np.ones(3), s2=np.ones(4))
    (tmp_path / "broken.npy").write_bytes(b"not a volume")
    subjects = lambda df: sorted(r.subject for r in df.select("subject").collect())
    df = volumes.scan_npy_folder(spark, str(tmp_path), keys=["s1", "s2", "s1", "nobody", "a/b", ""])
    assert subjects(df) == ["s1", "s2"]
    assert volumes.scan_npy_folder(spark, str(tmp_path), keys=[]).count() == 0
    assert subjects(df.where("subject = 's1'").union(df.where("subject = 's2'"))) == ["s1", "s2"]
    assert subjects(df.where("subject = 's1'")) == ["s1"] and subjects(df) == ["s1", "s2"]
    with pytest.raises(Exception, match="magic"):
        volumes.scan_npy_folder(spark, str(tmp_path)).collect()


def test_headers_are_read_without_bodies(spark, tmp_path):
    save(tmp_path, cut=np.ones((4, 5), dtype=np.float32))
    whole = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-40])
    heads = volumes.scan_npy_folder(spark, str(tmp_path), headers_only=True)
    assert [(r.subject, r.dims) for r in heads.collect()] == [("cut", [4, 5])]
    with pytest.raises(Exception, match="ends before its last voxel"):
        volumes.scan_npy_folder(spark, str(tmp_path)).collect()


def test_written_files_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("x", [2, 2], [1.0, None, 3.0, 4.0]), ("y y", [1], [5.0])], volumes.WHOLE)
    volumes.write_npy_folder(df, path)
    volumes.write_npy_folder(spark.createDataFrame([("y y", [2], [6.0, 7.0])], volumes.WHOLE), path)  # replaces its own file
    got = {r.subject: (list(r.dims), list(r.voxels)) for r in volumes.scan_npy_folder(spark, path).collect()}
    assert got["y y"] == ([2], [6.0, 7.0]) and got["x"][0] == [2, 2] and np.isnan(got["x"][1][1])
    assert np.load(f"{path}/x.npy")[1, 0] == 3.0
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]
    for bad in ("a/b", "", None, "_x"):
        with pytest.raises(Exception, match="cannot name a file"):
            volumes.write_npy_folder(spark.createDataFrame([(bad, [1], [1.0])], volumes.WHOLE), path)
