"""Queries for sources and sinks: each writes data derived from the given tables to
the shared folder with the library's writer and reads it back with its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as A, fill, metrics as M
from ..session import shared_path
from ..sources import io, volumes
from . import testdata as td
from .catalog import query, r6, with_cte
from .composed_queries import _CSV_SCHEMA, _visits_csv, evaluation
from .metric_queries import SCORED_SQL, TRAIN_SQL, W_SQL, _bce_sql, scored
from .split_queries import SPLIT_SQL, split_assignment

V = with_cte(v=td.VISITS_SQL)
_VCOLS = "subject, visit, visit_age, score, band, priority, status, label"


@query("csv_scan", V + f"SELECT {_VCOLS} FROM v")
def q_csv_scan(spark, sf_dir):
    path = _visits_csv(spark, sf_dir)
    return io.csv_scan(spark, path, ",", _CSV_SCHEMA).select(*_VCOLS.split(", "))


_PRESPLIT_SQL = with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL) + """
SELECT t.subject, t.target, t.n_chars,
       CASE WHEN s.split = 'train' THEN 'train' WHEN t.subject % 2 = 0 THEN 'val' ELSE 'test' END AS split
FROM t JOIN s ON t.subject = s.subject"""


@query("presplit_scan", _PRESPLIT_SQL)
def q_presplit_scan(spark, sf_dir):
    t = td.training(spark, sf_dir).select("subject", "target", "n_chars")
    a = split_assignment(spark, sf_dir).select("subject", "split")
    rows = t.join(a, "subject").withColumn(
        "split", F.when(F.col("split") == "train", "train")
        .when(F.col("subject") % 2 == 0, "val").otherwise("test"))
    base = shared_path(spark, "presplit", unique=True)
    paths = {}
    for name in ("train", "val", "test"):
        paths[name] = f"{base}/{name}.csv"
        io.write_csv(rows.where(F.col("split") == name).drop("split"), paths[name])
    return io.presplit_scan(spark, paths, ",", "subject bigint, target int, n_chars double")


@query("image_table_scan", """
SELECT vec_id AS subject, CAST(len(embedding) AS INTEGER) AS n_voxels,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS voxel_sum
FROM embeddings""")
def q_image_table_scan(spark, sf_dir):
    path = shared_path(spark, "volumes", unique=True)
    vols = A.volume_table(td.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (4, 4, 4))
    io.write_volume_table(vols.withColumnRenamed("vec_id", "subject"), path)
    v = io.read_volume_table(spark, path, "subject")
    total = F.aggregate("voxels", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("subject", F.size("voxels").alias("n_voxels"), r6(total, "voxel_sum"))


def _volume_folder(spark, sf_dir) -> str:
    path = shared_path(spark, "volume_files", unique=True)
    volumes.write_npy_folder(A.volume_table(td.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (4, 4, 4)), path, "vec_id")
    return path


@query("volume_files_scan", """
SELECT vec_id AS subject, '4x4x4' AS dims, CAST(len(embedding) AS INTEGER) AS n_voxels,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS voxel_sum
FROM embeddings""")
def q_volume_files_scan(spark, sf_dir):
    """A file for each volume, read back whole."""
    v = volumes.scan_npy_folder(spark, _volume_folder(spark, sf_dir))
    total = F.aggregate("voxels", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select(F.col("subject").cast("bigint").alias("subject"), F.array_join(F.col("dims").cast("array<string>"), "x").alias("dims"),
                    F.size("voxels").alias("n_voxels"), r6(total, "voxel_sum"))


@query("volume_files_tiles", """
SELECT vec_id AS subject, CAST(pos // 16 AS INTEGER) AS plane, round(sum(value), 6) + 0.0 AS plane_sum FROM (
  SELECT vec_id, pos, CAST(v AS DOUBLE) / max(CAST(v AS DOUBLE)) OVER (PARTITION BY vec_id) AS value
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)) GROUP BY ALL""")
def q_volume_files_tiles(spark, sf_dir):
    """SURVEY op 66 from files: tasks read the planes of their tiles; sums of the scaled planes (without halos)."""
    tiles = A.tiles_max_scale(volumes.scan_npy_folder(spark, _volume_folder(spark, sf_dir), planes=1), "subject")
    last = F.col("origin") + 2 == F.get("dims", F.lit(0))
    planes = F.inline(F.transform(F.sequence(F.lit(0), F.when(last, 1).otherwise(0)),
                                  lambda k: F.struct((F.col("origin") + k).alias("plane"), F.slice("voxels", k * 16 + 1, F.lit(16)).alias("v"))))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return tiles.select(F.col("subject").cast("bigint").alias("subject"), planes).select("subject", "plane", r6(total, "plane_sum"))


_FILLED_SQL = V + """
SELECT subject, visit,
       coalesce(first(score IGNORE NULLS) OVER wa, last(score IGNORE NULLS) OVER wb) AS score,
       coalesce(first(priority IGNORE NULLS) OVER wa, last(priority IGNORE NULLS) OVER wb) AS priority
FROM v WINDOW wa AS (PARTITION BY subject ORDER BY visit_date, visit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
              wb AS (PARTITION BY subject ORDER BY visit_date, visit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def _filled(spark, sf_dir):
    v = td.visits(spark, sf_dir)
    return fill.fill_nearest_visit(v, "subject", ["visit_date", "visit"], ["score", "priority"]) \
        .select("subject", "visit", "score", "priority")


@query("write_processed", _FILLED_SQL)
def q_write_processed(spark, sf_dir):
    path = shared_path(spark, "processed", unique=True)
    io.write_processed(_filled(spark, sf_dir), path, fmt="csv")
    return io.read_processed(spark, path, "csv", "subject bigint, visit bigint, score double, priority string")


@query("quick_reload", _FILLED_SQL)
def q_quick_reload(spark, sf_dir):
    path = shared_path(spark, "quick", unique=True)
    first = io.quick_reload(spark, path, lambda: _filled(spark, sf_dir))
    second = io.quick_reload(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("recomputed")))
    assert first.schema == second.schema
    return second


@query("write_predictions", with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL, p=SCORED_SQL) + """
SELECT run, split, epoch, batch_id, subject, label, CAST(logit > 0 AS INTEGER) AS prediction, age, sex FROM p""")
def q_write_predictions(spark, sf_dir):
    path = shared_path(spark, "predictions", unique=True)
    preds = M.prediction_table(scored(spark, sf_dir))
    io.write_predictions(preds, path)
    io.write_predictions(preds, path)  # a repeated epoch replaces its own rows
    back = spark.read.parquet(path)
    return back.select("run", "split", back.epoch.cast("int").alias("epoch"), "batch_id", "subject",
                       "label", "prediction", "age", "sex")


_METRIC_LOG_SQL = with_cte(t=td.TRAINING_SQL, s=SPLIT_SQL, p=SCORED_SQL, tr=TRAIN_SQL, wt=W_SQL) + f"""
, acc AS (SELECT run, split, epoch, avg(CAST(label = CAST(logit > 0 AS INTEGER) AS DOUBLE)) AS accuracy
          FROM p GROUP BY ALL)
, mac AS (SELECT run, split, epoch, avg(r) AS macro_accuracy FROM (
            SELECT run, split, epoch, label, avg(CAST(label = CAST(logit > 0 AS INTEGER) AS DOUBLE)) AS r
            FROM p GROUP BY ALL) GROUP BY ALL)
, bce AS (SELECT run, split, epoch, avg({_bce_sql('logit', 'CAST(label AS DOUBLE)', '(SELECT w FROM wt)')}) AS bce_loss
          FROM p GROUP BY ALL)
SELECT run, split, epoch, 'accuracy' AS metric, round(accuracy, 6) AS value FROM acc
UNION ALL SELECT run, split, epoch, 'macro_accuracy', round(macro_accuracy, 6) FROM mac
UNION ALL SELECT run, split, epoch, 'bce_loss', round(bce_loss, 6) FROM bce
"""


@query("write_metrics", _METRIC_LOG_SQL)
def q_write_metrics(spark, sf_dir):
    path = shared_path(spark, "metrics", unique=True)
    io.write_metrics(evaluation(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.select("run", "split", "epoch", "metric", r6("value"))
