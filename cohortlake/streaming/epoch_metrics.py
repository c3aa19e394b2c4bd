"""Epoch metrics kept up to date while prediction batches arrive.

The reference accumulates accuracy over an epoch as batches are scored and logs
the running value. Here each scored batch lands as a parquet file in a folder
(for example written by ``sources.io.write_predictions``); a Structured
Streaming aggregation keyed by ``(run, split, epoch)`` keeps the counts in
Spark's state store and rewrites the metric table after every micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PREDICTION_SCHEMA = ("run string, split string, epoch int, batch_id long, subject string, "
                     "label int, prediction int, age double, sex double")


def epoch_counts(stream: DataFrame) -> DataFrame:
    """Running counts per run/split/epoch (and per class, for macro accuracy)."""
    hit = (F.col("label") == F.col("prediction")).cast("long")
    return stream.groupBy("run", "split", "epoch").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(hit).alias("n_correct"),
        F.sum(F.when(F.col("label") == 1, hit)).alias("tp"),
        F.sum((F.col("label") == 1).cast("long")).alias("n_pos"),
        F.sum(F.when(F.col("label") == 0, hit)).alias("tn"),
        F.sum((F.col("label") == 0).cast("long")).alias("n_neg"),
        F.max("batch_id").alias("last_batch"))


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    recalls = [F.try_divide(F.col("tp").cast("double"), F.col("n_pos")),
               F.try_divide(F.col("tn").cast("double"), F.col("n_neg"))]
    present = (F.when(F.col("n_pos") > 0, 1).otherwise(0) + F.when(F.col("n_neg") > 0, 1).otherwise(0))
    return counts.select(
        "run", "split", "epoch", "last_batch", "n_rows",
        (F.col("n_correct") / F.col("n_rows")).alias("accuracy"),
        F.try_divide(F.coalesce(recalls[0], F.lit(0.0)) + F.coalesce(recalls[1], F.lit(0.0)),
                     present.cast("double")).alias("macro_accuracy"))


def start_epoch_metrics(spark: SparkSession, predictions_dir: str, metrics_path: str,
                        checkpoint_location: str, available_now: bool = False) -> StreamingQuery:
    """Stream prediction files into an always-current metric table at ``metrics_path``.

    ``checkpoint_location`` must be on the shared file system so the query
    resumes exactly-once after a driver or executor loss.
    """
    stream = spark.readStream.schema(PREDICTION_SCHEMA).parquet(predictions_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        metrics_from_counts(batch).write.mode("overwrite").parquet(metrics_path)

    writer = (epoch_counts(stream).writeStream.outputMode("complete")
              .option("checkpointLocation", checkpoint_location).foreachBatch(write))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
