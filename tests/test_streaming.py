from pyspark.sql import functions as F

from cohortlake.streaming.epoch_metrics import PREDICTION_SCHEMA, start_epoch_metrics


def test_epoch_metrics_follow_new_batches(spark, tmp_path):
    src, out, ck = str(tmp_path / "preds"), str(tmp_path / "metrics"), str(tmp_path / "ck")
    rows1 = [("r", "val", 0, 0, f"s{i}", i % 2, 1) for i in range(12)]
    spark.createDataFrame(rows1, PREDICTION_SCHEMA.replace(", age double, sex double", "")) \
        .withColumn("age", F.lit(12.0)).withColumn("sex", F.lit(0.0)).write.parquet(src + "/b0")
    q = start_epoch_metrics(spark, src + "/*", out, ck, available_now=True)
    q.awaitTermination(120)
    m = spark.read.parquet(out).first()
    assert m.n_rows == 12 and m.accuracy == 0.5 and m.macro_accuracy == 0.5
    rows2 = [("r", "val", 0, 1, f"t{i}", 1, 1) for i in range(12)]
    spark.createDataFrame(rows2, PREDICTION_SCHEMA.replace(", age double, sex double", "")) \
        .withColumn("age", F.lit(12.0)).withColumn("sex", F.lit(0.0)).write.parquet(src + "/b1")
    q = start_epoch_metrics(spark, src + "/*", out, ck, available_now=True)
    q.awaitTermination(120)
    m = spark.read.parquet(out).first()
    assert m.n_rows == 24 and m.accuracy == 18 / 24 and m.last_batch == 1
