"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a table ``(key, n_docs)`` sorted by ``key``, the MD5 of a normalised
line. Documents come in batches. Each batch counts its documents per line hash,
drops by a merge anti join the hashes that the compacted runs have already shown
to be frequent, and adds what is left as a run of level 0. ``fanout`` runs of a
level are merged into one run of the next level; hashes that reach ``min_docs``
there move to the runs of frequent hashes. A last compaction merges all levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, free_names, save, text_or_empty


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levelled sorted runs. ``add`` takes batches of ``(key, n_docs)`` rows with
    unique keys; ``frequent`` compacts everything and returns the hashes that
    ``min_docs`` or more documents hold."""

    def __init__(self, min_docs: int, fanout: int = 2):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: dict[int, list[DataFrame]] = {}
        self.done: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        for run in self.done:
            batch = batch.join(run.hint("merge"), "key", "left_anti")
        self._push(0, save(batch.sortWithinPartitions("key"), "line-run-0"))

    def _push(self, level: int, run: DataFrame) -> None:
        runs = self.levels.setdefault(level, [])
        runs.append(run)
        if len(runs) >= self.fanout:
            self.levels[level] = []
            self._push(level + 1, self._compact(runs, f"line-run-{level + 1}"))

    def _compact(self, runs: list[DataFrame], name: str) -> DataFrame:
        merged = reduce(DataFrame.unionAll, runs).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
        merged = save(merged.sortWithinPartitions("key"), name)
        self.done.append(merged.where(F.col("n_docs") >= self.min_docs).select("key"))
        return merged.where(F.col("n_docs") < self.min_docs)

    def frequent(self) -> DataFrame:
        rest = [run for runs in self.levels.values() for run in runs]
        if rest:
            self.levels = {0: [self._compact(rest, "line-run-last")]}
        return reduce(DataFrame.unionAll, self.done)


def document_lines(docs: DataFrame, id_col: str, text_col: str, n_batches: int) -> DataFrame:
    """``(doc_id, text_hash, pos, key, batch)``, one row per line with a non-empty key."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                        F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("pos", "line"))
    key = line_key(F.col("line"))
    return (lines.withColumn("_key", key).where(F.length("_key") >= 1)
            .select("doc_id", "text_hash", "pos", F.unhex(F.md5("_key")).alias("key"),
                    F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int").alias("batch")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                n_batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop, in every document, the lines whose key ``min_docs`` documents hold.

    Returns the rows of ``docs`` with the kept lines as text, and ``n_lines`` and
    ``n_dropped``. Lines are cut at ``\\n``; a null or empty text is one empty line
    and gives an empty text. Lines with an empty key always stay. Rows with the
    same id are one document when documents are counted (null ids are one
    document, too); every row keeps its own text. A table without rows gives
    none. Columns of the input named ``n_lines`` or ``n_dropped`` are replaced.
    """
    lines = save(document_lines(docs, id_col, text_col, n_batches), "lines", ["batch"])
    runs = LineRuns(min_docs, fanout)
    for batch in range(n_batches):
        held = lines.where(F.col("batch") == batch).select("key", "doc_id").distinct()
        runs.add(held.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs")))
    drops = (lines.join(runs.frequent(), "key").groupBy("doc_id", "text_hash", "pos").agg(F.lit(1).alias("_one"))
             .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("pos")).alias("_pos"))
             .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_pos"))
    # flags 0 and 1 for each line up to the last dropped one, built from the gaps
    gaps = F.transform("_pos", lambda p, i: F.concat(
        F.repeat(F.lit("0"), (p - F.when(i > 0, F.get("_pos", i - 1)).otherwise(-1) - 1).cast("int")), F.lit("1")))
    i, k, flags = free_names(docs, "_id", "_hash", "_flags")
    drops = drops.select(F.col("_id").alias(i), F.col("_hash").alias(k), F.array_join(gaps, "").alias(flags))

    x = docs.drop(*[c for c in ("n_lines", "n_dropped") if c in docs.columns])
    columns = x.columns
    joined = x.join(drops.hint("shuffle_hash"), x[id_col].eqNullSafe(drops[i])
                    & (F.xxhash64(x[text_col]) == drops[k]), "left")
    split = F.split(text_or_empty(text_col), "\n")
    flagged = F.zip_with(split, F.split(F.col(flags), ""), lambda line, flag: F.when(F.coalesce(flag, F.lit("0")) == "0", line))
    kept = F.when(F.col(flags).isNull(), text_or_empty(text_col)).otherwise(F.array_join(flagged, "\n"))
    dropped = F.coalesce(F.length(F.replace(flags, F.lit("0"), F.lit(""))), F.lit(0)).cast("long")
    return joined.select(*[kept.alias(c) if c == text_col else c for c in columns],
                         F.size(split).cast("long").alias("n_lines"), dropped.alias("n_dropped"))
