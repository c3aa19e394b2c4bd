"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: White space of the contracts: \\x20 and \\x09 to \\x0D.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def save(df: DataFrame, name: str, partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing.
    """
    path = shared_path(df.sparkSession, "llm", name, unique=True)
    writer = df.write.option("compression", "zstd").options(**options or {})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Let go of shuffle files of finished jobs: Spark removes them when the driver
    has collected its garbage, which may be long after they are of use."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside pass at most ``rows`` rows at once to Python and back. Whole texts
    take memory by the batch, in the executor (outside its heap) and in its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; NULL for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that are columns of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names (in any case) under free names, and the map back
    for ``withColumnsRenamed``: an operator that adds columns so named leaves their values alone."""
    taken = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    aside = free_names(df, *[f"_kept_{c}" for c in taken])
    return df.withColumnsRenamed(dict(zip(taken, aside, strict=True))), dict(zip(aside, taken, strict=True))


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process (tasks of the same
    worker share it)."""
    holder = sys.modules.setdefault("_cohortlake_worker", types.ModuleType("_cohortlake_worker"))
    return vars(holder).setdefault(name, {})


def load_tokenizer(path: str):
    """The ``tokenizers`` file at ``path``, once per process, single-threaded."""
    cache = process_cache("tokenizers")
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        cache[path] = tokenizer
    return cache[path]


def bounded(cache: dict, limit: int) -> dict:
    """Empty a memo that has grown beyond ``limit`` entries."""
    if len(cache) > limit:
        cache.clear()
    return cache
