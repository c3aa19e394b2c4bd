"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that agree in all but ``radius`` bits agree wholly in two of
``radius + 2`` bit blocks, so candidates are the fingerprints of a bucket (two
blocks and their values). A bucket with more than ``cell_rows`` distinct
fingerprints is cut into slices, and every two slices meet in a cell. Inside a
task, the fingerprints of many cells stand vertically, one bit plane per bit, 64
fingerprints per machine word: comparing all rows with those d places further on
is an exclusive or of each plane with its shift, a carry-save counter holds the
number of differing bits, and words whose distances have all exceeded the radius
are abandoned. Only a spanning forest of the links of each cell leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, save
from .components import connected_components, local_roots

BLOCK_ROWS = 65_536


def fingerprint(text: bytes, shingle_words: int) -> int:
    """Unsigned fingerprint of the word shingles of ``text`` (UTF-8)."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z, and blanks \x20 and \x09 to \x0D only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    shingles = max(1, len(words) - shingle_words + 1)
    starts = np.concatenate(([0], ends[:-1]))[:shingles]
    stops = ends[min(shingle_words, len(words)) - 1:] - 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, shingles, 1 << 18):
        pairs = zip(starts[at:at + (1 << 18)].tolist(), stops[at:at + (1 << 18)].tolist(), strict=True)
        h = np.array([xxh64_intdigest(line[i:j], 42) for i, j in pairs], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += bits[k:k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` (the fingerprint as a signed long) of every row."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or b"", shingle_words) for t in batch.column(2).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "text_hash", "fp"])

    x = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(make, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype=np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _shifted(p: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """Words of a plane (padded with zeros) moved d places to the front."""
    q, r = words + (d >> 6), np.uint64(d & 63)
    return p[q] if not r else (p[q] >> r) | (p[q + 1] << (np.uint64(64) - r))


def links_within(fps: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the same cell that differ in at most ``radius`` bits. Rows of
    a cell stand together, larger cells first."""
    n = len(fps)
    counts = np.bincount(cell)[cell]  # size of each row's cell; falls along the rows
    p = planes(fps.view(np.uint64))
    room = p.shape[1] + (int(counts[0]) >> 6) + 2
    p = np.concatenate([p, np.zeros((64, room - p.shape[1]), dtype=np.uint64)], axis=1)
    order = np.arange(64).reshape(4, 16).T.ravel()  # bits of all quarters early on
    digits = max(1, (radius + 1).bit_length())
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for d in range(1, int(counts[0])):
        rows = int(np.searchsorted(-counts, -d))  # rows of cells larger than d
        valid = np.zeros(-(-rows // 64) * 64, dtype=np.uint8)
        stop = min(rows, n - d)
        valid[:stop] = cell[:stop] == cell[d:d + stop]
        alive = np.packbits(valid, bitorder="little").view("<u8")
        words = np.flatnonzero(alive)
        alive = alive[words]
        counter = np.zeros((digits, len(words)), dtype=np.uint64)
        over = np.zeros(len(words), dtype=np.uint64)
        for i, b in enumerate(order):
            carry = p[b][words] ^ _shifted(p[b], words, d)
            for k in range(digits):  # carry-save: one more bit in each of 64 counters
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            above = carry.copy()  # counter > radius, digit by digit
            equal = np.full(len(words), ~np.uint64(0))
            for k in reversed(range(digits)):
                if (radius >> k) & 1:
                    equal &= counter[k]
                else:
                    above |= equal & counter[k]
                    equal &= ~counter[k]
            over |= above
            if i % 8 == 7:
                on = np.flatnonzero(alive & ~over)
                if len(on) < len(words):
                    words, alive, counter, over = words[on], alive[on], counter[:, on], over[on]
                if not len(words):
                    break
        if len(words):
            hits = np.flatnonzero(np.unpackbits((alive & ~over).view(np.uint8), bitorder="little"))
            at = words[hits >> 6] * 64 + (hits & 63)
            left.append(at)
            right.append(at + d)
    return np.concatenate(left), np.concatenate(right)


def link_fingerprints(classes: DataFrame, radius: int = 2, cell_rows: int = 256) -> DataFrame:
    """Edges ``(a, b)`` that connect what links of at most ``radius`` bits connect,
    from a table of distinct ``fp``."""
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]

    def block(i: int):
        return F.shiftrightunsigned("fp", cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1)

    pairs = list(combinations(range(blocks), 2))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), block(i).alias("x"), block(j).alias("y")) for t, (i, j) in enumerate(pairs)])
    banded = classes.select("fp", F.explode(keys).alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    x = banded.join(sizes, "key").withColumn("m", F.ceil(F.col("n") / cell_rows))
    own = F.pmod(F.xxhash64("fp"), F.col("m"))
    cells = F.when(F.col("m") == 1, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda s: s != own),
                    lambda s: F.struct(F.least(s, own).alias("i"), F.greatest(s, own).alias("j"))))
    x = x.select("fp", F.explode(cells).alias("c"), "key").select("fp", F.xxhash64("key", "c").alias("cell"))
    x = x.repartition(F.col("cell")).sortWithinPartitions("cell")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(part: pd.DataFrame) -> pd.DataFrame:
            _, cell, count = np.unique(part["cell"].to_numpy(), return_inverse=True, return_counts=True)
            rank = np.argsort(np.lexsort((np.arange(len(count)), -count)))  # larger cells first
            cell = rank[cell]
            order = np.argsort(cell, kind="stable")
            fps = part["fp"].to_numpy()[order]
            u, v = links_within(fps, cell[order], radius)
            root = local_roots(len(fps), u, v)
            on = np.flatnonzero(root != np.arange(len(fps)))
            return pd.DataFrame({"a": fps[on], "b": fps[root[on]]}).drop_duplicates()

        kept: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            kept.append(batch)
            rows += len(batch)
            if rows >= BLOCK_ROWS:  # all cells but the last are whole
                part = pd.concat(kept)
                whole = part["cell"] != part["cell"].iloc[-1]
                if whole.any():
                    yield links(part[whole])
                kept = [part[~whole]]
                rows = len(kept[0])
        if rows:
            yield links(pd.concat(kept))

    return x.mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fingerprint, component_id``, one row per row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id that links reach (null only if the
    component has null ids alone). A null or empty text, or one of blanks, has
    fingerprint 0 and is linked like any other; a text of fewer words than a
    shingle is one shingle. Repeated rows share a component. No rows give none.
    """
    fps = save(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comps = save(connected_components(link_fingerprints(classes.select("fp"), radius)), "fingerprint-components")
    firsts = classes.join(comps, classes["fp"] == comps["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = firsts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = firsts.join(least, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                                      F.col("fp"))


def keep_one(docs: DataFrame, shingle_words: int = 3, radius: int = 2, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of each component of :func:`near_duplicates`: that of the smallest id
    (among equal ids the smallest text hash; a null id only where there is no other)."""
    fps = save(near_duplicates(docs, shingle_words, radius, id_col, text_col), "near-duplicates")
    # components with null ids alone have a null component id: those are told apart by their fingerprints
    group = F.when(F.col("component_id").isNull(), F.col("fp"))
    kept = fps.groupBy("component_id", group.alias("_g")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("k"))
    # one key of both, in which nulls are equal, so that one exchange of the rows serves the join and the repeats
    (key,) = free_names(docs, "_key")
    kept = kept.select(F.struct(F.col("k.doc_id").alias("i"), F.col("k.text_hash").alias("h")).alias(key))
    x = docs.withColumn(key, F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")))
    return x.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
