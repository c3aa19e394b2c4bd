import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import columns, fill, metrics as M
from cohortlake.plans import composed
from cohortlake.sources import io


@pytest.fixture(scope="module")
def embedded(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), i // 12, [float(x) for x in rng.normal(size=5)]) for i in range(250)]
    return spark.createDataFrame(rows, "id long, label int, batch_id long, embedding array<float>").cache()


@pytest.mark.parametrize("rate", [0.0, 0.2, 0.95])
def test_learned_centers_equal_a_loop_over_batches(spark, embedded, rate):
    start = {k: [float(k + j) for j in range(5)] for k in range(4)}  # class 3 never occurs
    centers = {k: np.array(v) for k, v in start.items()}
    rows = embedded.orderBy("id").collect()
    for b in sorted({r.batch_id for r in rows}):
        batch = [r for r in rows if r.batch_id == b]
        grad = {k: sum((centers[k] - np.array(r.embedding) for r in batch if r.label == k), np.zeros(5)) / len(batch) for k in centers}
        centers = {k: c - rate * grad[k] for k, c in centers.items()}
    df = spark.createDataFrame([(k, v) for k, v in start.items()], "label int, center array<double>")
    got = {r.label: np.array(r.center) for r in M.learned_centers(embedded, df, rate).collect()}
    assert set(got) == set(centers)
    assert all(np.allclose(got[k], centers[k], atol=1e-9) for k in centers)
    with pytest.raises(ValueError):
        M.learned_centers(embedded, df, 1.0)


def test_step_metrics_equal_plain_python(spark, embedded, tmp_path):
    centers = M.class_centers(embedded).where("label < 2")  # one class has no centre
    rows = embedded.withColumns({
        "run": F.lit("r"), "split": F.when(F.col("id") % 5 == 0, "test").otherwise("train"), "epoch": F.lit(1),
        "y": (F.col("label") > 0).cast("int"), "logit": F.element_at("embedding", 1).cast("double"),
        "pos": F.when(F.col("id") % 7 > 0, F.reverse("embedding")), "neg": F.transform("embedding", lambda x: x * 2)})
    log = composed.evaluate_steps(rows, 2.0, centers, label="y", center_label="label", positive="pos", negative="neg",
                                  log_path=str(tmp_path / "log"), predictions_path=str(tmp_path / "predictions"))
    got = {(r.split, r.step, r.metric): r.value for r in log.collect()}
    means = {r.label: np.array(r.center) for r in centers.collect()}
    data = rows.collect()
    for split in ("train", "test"):
        for step in [None, *sorted({r.batch_id for r in data})]:
            part = [r for r in data if r.split == split and step in (None, r.batch_id)]
            hit = [(r.y, int(r.logit > 0) == r.y) for r in part]
            x, y = np.array([r.logit for r in part]), np.array([r.y for r in part])
            bce = (2 * y * np.log1p(np.exp(-x)) + (1 - y) * np.log1p(np.exp(x))).mean()
            far = [min(max(((np.array(r.embedding) - means[r.label]) ** 2).sum(), 1e-12), 1e12) for r in part if r.label in means]
            center = np.mean(far) + 1e-12 if far else None
            hinge = [max(np.linalg.norm(np.array(r.embedding) - np.array(r.pos) + 1e-6) - np.linalg.norm(np.array(r.embedding) - np.array(r.neg) + 1e-6) + 1, 0)
                     for r in part if r.pos is not None]
            triplet = np.mean(hinge) if hinge else None
            want = {"accuracy": np.mean([h for _, h in hit]), "bce_loss": bce, "center_loss": center, "triplet_loss": triplet,
                    "macro_accuracy": np.mean([np.mean([h for c, h in hit if c == k]) for k in {c for c, _ in hit}]),
                    "combined_loss": None if center is None or triplet is None else 0.45 * bce + 0.2 * center + 0.35 * triplet}
            for metric, value in want.items():
                found = got[split, step, metric]
                assert (found is None) == (value is None) and (value is None or abs(found - value) < 1e-6), (split, step, metric)
    assert spark.read.parquet(str(tmp_path / "predictions")).count() == len(data)
    again = composed.evaluate_steps(rows.where("split = 'test'"), 2.0, centers, label="y", center_label="label", positive="pos", negative="neg",
                                    log_path=str(tmp_path / "log"))
    assert {(r.split, r.step, r.metric) for r in again.collect()} == set(got)  # a repeated split is there once


def test_modes_of_columns_with_many_values(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("a"), (F.col("id") % 999_983).alias("b"), F.when(F.col("id") % 2 == 0, "x").alias("c"),
                                       F.lit(None).cast("double").alias("d"))
    out = df.unionByName(spark.createDataFrame([(None, None, None, None)], "a long, b long, c string, d double"))
    filled = fill.global_mode_fill(out, ["a", "b", "c", "d"]).where("a = 0 and c = 'x' and b = 0 and d is null")
    assert filled.count() == 2  # ties of a go to 0, the 17 values of b that occur twice start at 0
    assert "mode(" not in filled._jdf.queryExecution().toString()


def test_codes_over_parts_and_one_hot_bound(spark):
    df = spark.range(3000).select(F.format_string("v%04d", F.col("id") * 7919 % 3000).alias("c"), F.col("id").alias("i"))
    got = columns.category_codes(df, ["c"]).collect()
    assert all(r.c == r.i * 7919 % 3000 for r in got)
    with pytest.raises(ValueError, match="3000"):
        columns.one_hot(df, ["c"], max_values=100)


def test_reload_notices_a_changed_input(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.csv").write_text("s,x\n1,2\n")

    def load(*settings):
        made = []
        def compute():
            made.append(1)
            return io.csv_scan(spark, str(src), ",", "s int, x int")
        return sorted(r.x for r in io.reload_unchanged(spark, out, [str(src)], compute, *settings).collect()), bool(made)
    assert load() == ([2], True)
    assert load() == ([2], False)
    assert load("other") == ([2], True)
    (src / "b.csv").write_text("s,x\n2,5\n")
    assert load() == ([2, 5], True)
    (src / "a.csv").write_text("s,x\n1,3\n")
    os.utime(src / "a.csv", (time.time() + 5, time.time() + 5))  # same size, other time
    assert load() == ([3, 5], True)
    assert load() == ([3, 5], False)


def test_load_with_imaging_files(spark, tmp_path):
    (tmp_path / "visits.csv").write_text("subject,visit,visit_age,x\na,1,12.0,1\na,2,13.0,NA\nb,1,19.0,4\nc,1,14.0,NA\n")
    for name in ("fa", "t1", "rsf"):
        (tmp_path / f"{name}.csv").write_text(f"subject;visit;{name}\na;1;0.5\na;2;0.25\nb;1;1\n" + ("c;1;NA\n" if name == "fa" else ""))
    prep = dict(key="subject", order_by=["visit"], confounders=[], sums={}, redundant=[], renames={}, mode_columns=[], code_columns=[])

    def load():
        out = composed.load_with_imaging_files(spark, str(tmp_path / "visits.csv"), [str(tmp_path / f"{n}.csv") for n in ("fa", "t1", "rsf")],
                                               str(tmp_path / "out"), **prep)
        return sorted((r.subject, r.visit, r.x, r.fa, r.t1, r.rsf) for r in out.collect())
    assert load() == [("a", 1, 1, 0.5, 0.5, 0.5), ("a", 2, 1, 0.25, 0.25, 0.25)]
    (tmp_path / "t1.csv").write_text("subject;visit;t1\na;1;0.75\n")
    assert load() == [("a", 1, 1, 0.5, 0.75, 0.5)]
