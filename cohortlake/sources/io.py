"""Sources and sinks: delimited text, pre-split sets, volume tables, materialised
tables, prediction and metric logs.

Paths are whatever the caller gives (a shared file system or object store on a
cluster); nothing here writes to a machine-local folder on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES: text tokens a pandas CSV reader treats as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]


def csv_scan(spark: SparkSession, path: str | Sequence[str], sep: str = ";",
             schema: T.StructType | str | None = None,
             na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Delimited text with a header row; missing-value tokens become NULL in every column.

    Fields are read as text, cleaned, and then typed, so that a token never decides
    a type and NaN never stays in a number. With ``schema`` (by position), a field that
    does not parse becomes NULL; :func:`unparsable` counts those. Without it, a column
    whose values are all whole numbers is bigint, all numbers double, else string (one
    more pass over the data).
    """
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("inferSchema", False)
    types = _schema(spark, schema)
    if types is not None:
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in types.fields]))
    raw = reader.csv(path)
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(list(na_tokens)), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return clean.select(*[_typed(f) for f in (types or _inferred(clean)).fields])


def _schema(spark: SparkSession, schema: T.StructType | str | None) -> T.StructType | None:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _typed(field: T.StructField):
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return c
    out = F.trim(c).try_cast(field.dataType)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        out = F.when(~F.isnan(out), out)
    return out.alias(field.name)


def _inferred(clean: DataFrame) -> T.StructType:
    def fits(c: str, kind: str):
        x = F.trim(F.col(f"`{c}`"))
        return F.coalesce(F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), x.try_cast(kind).isNotNull())), F.lit(False))
    row = clean.agg(*[f.alias(f"{k}{i}") for i, c in enumerate(clean.columns) for k, f in (("w", fits(c, "bigint")), ("d", fits(c, "double")))]).first()
    kinds = [T.LongType() if row[f"w{i}"] else T.DoubleType() if row[f"d{i}"] else T.StringType() for i in range(len(clean.columns))]
    return T.StructType([T.StructField(c, k) for c, k in zip(clean.columns, kinds, strict=True)])


def unparsable(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, sep: str = ";",
               na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """``(column, n)``: fields that are neither a missing-value token nor of their type."""
    types = _schema(spark, schema)
    text = csv_scan(spark, path, sep, T.StructType([T.StructField(f.name, T.StringType()) for f in types.fields]), na_tokens)
    bad = text.agg(*[F.count(F.when(F.col(f"`{f.name}`").isNotNull() & _typed(f).isNull(), 1)).alias(f.name) for f in types.fields])
    return bad.unpivot([], [f.name for f in types.fields], "column", "n")


def write_csv(df: DataFrame, path: str, sep: str = ",", null_token: str = "") -> None:
    (df.write.mode("overwrite").option("header", True).option("sep", sep)
     .option("nullValue", null_token).csv(path))


def presplit_scan(spark: SparkSession, paths: dict[str, str], sep: str = ",",
                  schema: T.StructType | str | None = None, split_col: str = "split") -> DataFrame:
    """Read ``{'train': p1, 'val': p2, 'test': p3}`` as one table with a split column."""
    parts = [csv_scan(spark, p, sep, schema).withColumn(split_col, F.lit(name))
             for name, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the prepared table (no index column); parquet by default, CSV on request."""
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType | str | None = None) -> DataFrame:
    if fmt == "csv":
        return csv_scan(spark, path, ",", schema)
    return spark.read.parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing a table at ``path`` (a crashed one leaves no marker)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(conf).exists(p)


def quick_reload(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                 quick: bool = True, fmt: str = "parquet") -> DataFrame:
    """Read the materialised table at ``path`` if ``quick`` and it exists; else
    compute it, write it, and read it back (the written copy cuts the lineage)."""
    if quick and is_complete(spark, path):
        return read_processed(spark, path, fmt)
    write_processed(compute(), path, fmt)
    return read_processed(spark, path, fmt)


def input_fingerprint(spark: SparkSession, inputs: Sequence[str], *settings) -> str:
    """A name for the state of the files below ``inputs`` (path, size, time of change; their contents
    are not read) and for ``settings``, which must have a stable ``repr``.

    The listing is a table: its rows are reduced to counts, sums and an exclusive-or of
    hashes, whatever their number and order."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(inputs))
             .select(F.xxhash64("path", "modificationTime", "length").alias("h"), "length"))
    state = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor("h"), F.sum(F.shiftright("h", 24))).first()
    return hashlib.sha256(repr((tuple(state), sorted(inputs), settings)).encode()).hexdigest()[:20]


def reload_unchanged(spark: SparkSession, path: str, inputs: Sequence[str], compute: Callable[[], DataFrame], *settings,
                     quick: bool = True) -> DataFrame:
    """The table that ``compute`` makes of the files below ``inputs`` under ``settings``, from its written
    copy where there is one of exactly this state.

    Each state has a folder of its own below ``path``, named by :func:`input_fingerprint` and
    in use only once a job has finished it: a changed input is computed anew, and
    readers of an older state are not disturbed."""
    return quick_reload(spark, f"{path.rstrip('/')}/{input_fingerprint(spark, inputs, *settings)}", compute, quick)


def write_volume_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_volume_table(spark: SparkSession, path: str, key: str = "subject") -> DataFrame:
    """Keyed array table ``key, dims, voxels`` (the re-aimed image source)."""
    return spark.read.parquet(path).select(key, "dims", F.col("voxels").cast("array<float>"))


def read_npy_volumes(spark: SparkSession, pattern: str, key_from_name: bool = True) -> DataFrame:
    """Volumes stored one ``.npy`` file per subject (``<dir>/<subject>.npy``).

    ``binaryFile`` lists and reads the files in parallel; a pandas UDF decodes
    each with numpy into ``dims`` and flat C-order ``voxels``. Keep
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` small for large volumes.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")

    @F.pandas_udf("dims array<int>, voxels array<float>")
    def decode(content: pd.Series) -> pd.DataFrame:
        import io
        dims, vox = [], []
        for b in content:
            arr = np.load(io.BytesIO(b), allow_pickle=False)
            dims.append(np.asarray(arr.shape, dtype=np.int32))
            vox.append(np.ascontiguousarray(arr, dtype=np.float32).ravel())
        return pd.DataFrame({"dims": dims, "voxels": vox})

    out = files.select("path", decode("content").alias("v")).select("path", "v.*")
    if key_from_name:
        out = out.withColumn("subject", F.regexp_extract("path", r"([^/]+)\.npy$", 1))
    return out.drop("path")


def write_predictions(preds: DataFrame, path: str,
                      partition_by: Sequence[str] = ("run", "split", "epoch")) -> None:
    """One directory per run/split/epoch (the reference writes one CSV each); what
    these directories held before is replaced, so a repeated epoch is there once."""
    _replace_partitions(preds, path, partition_by)


def write_metrics(metrics_long: DataFrame, path: str,
                  partition_by: Sequence[str] = ("run", "split", "epoch")) -> None:
    """``(run, split, epoch, metric, value)`` rows to the metric log, replacing the
    directories of the same run, split and epoch."""
    _replace_partitions(metrics_long, path, partition_by)


def _replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))
