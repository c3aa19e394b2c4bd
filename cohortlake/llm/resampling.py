"""Importance resampling towards a target distribution, ordered by a distributed radix sort.

Weights are scored with arrays: hashed word n-grams are counted into one array for
the source and one for the target texts, the log ratio of a bucket is its gain, and a
document's weight is the sum of its features' gains. A Gumbel draw per document,
made from its id, turns the weights into a sample without replacement: the highest
scores are drawn.

Ranks come from an LSD radix sort over the composite key (score falling, id rising).
Rows stand in parts of at most ``PART`` places. A pass takes one digit of the key:
every part is counting-sorted stably by it, the counts of all (digit, part) pairs are
cumulated into global offsets, and offset plus place inside the run is a row's
destination, hence its part and place in the next pass. After the last pass the
destination is the rank. Digits in which all keys agree need no pass.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, save

PART_BITS = 16
PART = 1 << PART_BITS
DIGIT_BITS = 11
MEMO = 400_000

#: Bytes of words (letters in lower case, digits, everything outside ASCII); others become blanks.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only."""
    return (text or b"").translate(_TABLE).split()


def feature_buckets(tokens: list[bytes], n: int, buckets: int, memo: dict[bytes, int]) -> np.ndarray:
    """Bucket of every run of 1 to ``n`` consecutive words, joined by one blank."""
    features = list(tokens)
    for size in range(2, n + 1):
        features += [b" ".join(run) for run in zip(*(tokens[i:] for i in range(size)))]
    bounded(memo, MEMO)
    memo.update((f, zlib.crc32(f) % buckets) for f in set(features).difference(memo))
    return np.fromiter(map(memo.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Features of all ``texts`` (one string column) by bucket, one array of ``buckets`` counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo = np.zeros(buckets, np.int64), {}
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total += np.bincount(feature_buckets(words(text.as_py()), n, buckets, memo), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]  # at most ``buckets`` rows
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` of each of the ``B`` buckets."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _bits(low: int, high: int) -> int:
    """Low bits in which unsigned keys between ``low`` and ``high`` differ."""
    return (low ^ high).bit_length()


def radix_ranks(rows: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Add ``name``: the place (from 0) of each row of ``rows`` in rising order of the
    long columns ``keys``, the first most significant. Nulls stand last; equal keys stand
    in some order. Rows need the columns ``part`` and ``place`` (long), unique pairs with
    at most ``PART`` rows a part; both are replaced.
    """
    sign = F.lit(-(1 << 63)).cast("long")
    stats = rows.agg(*[f(k).alias(f"{tag}_{k}") for k in keys for tag, f in (("lo", F.min), ("hi", F.max))],
                     *[F.count_if(F.col(k).isNull()).alias(f"nulls_{k}") for k in keys]).first()
    passes = []
    for k in reversed(keys):
        lo, hi = stats[f"lo_{k}"], stats[f"hi_{k}"]
        if lo is not None:  # the order of signed numbers is that of unsigned ones with the sign bit turned
            unsigned = F.coalesce(F.col(k), F.lit(lo)).bitwiseXOR(sign)
            top = 1 << 63
            for shift in range(0, _bits((lo + top), (hi + top)), DIGIT_BITS):
                passes.append(F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int"))
        if stats[f"nulls_{k}"]:
            passes.append(F.col(k).isNull().cast("int"))
    if not passes:
        passes.append(F.lit(0))
    names, fields = rows.columns, rows.schema
    at = {c: names.index(c) for c in ("part", "place")}

    def counting_sort(part: pa.Table) -> pa.Table:
        """Stable by ``digit``; ``within`` is the place in the run of equal digits."""
        order = np.argsort(part.column(at["place"]).to_numpy(), kind="stable")
        digit = part.column("digit").to_numpy()[order]
        by = np.argsort(digit.astype(np.uint16), kind="stable")  # a counting sort for 16-bit keys
        digit = digit[by]
        starts = np.searchsorted(digit, digit, side="left")
        out = part.take(pa.array(order[by]))
        return out.append_column("within", pa.array(np.arange(len(digit)) - starts, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", digit int, within long"
    for digit in passes:
        runs = save(rows.withColumn("digit", digit).groupBy("part").applyInArrow(counting_sort, schema), "radix-runs")
        counts = runs.groupBy("part", "digit").agg(F.count(F.lit(1)).alias("n"))
        digits = counts.groupBy("digit").agg(F.sum("n").alias("n"))  # at most 2 ** DIGIT_BITS rows
        smaller = digits.select("digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("smaller"))
        earlier = F.sum("n").over(Window.partitionBy("digit").orderBy("part")) - F.col("n")
        offsets = (counts.select("part", "digit", earlier.alias("earlier")).join(smaller, "digit")
                   .select("part", "digit", (F.col("earlier") + F.col("smaller")).alias("offset")))
        placed = runs.join(offsets, ["part", "digit"]).withColumn("dest", F.col("offset") + F.col("within"))
        rows = placed.withColumns({"part": F.shiftright("dest", PART_BITS), "place": F.col("dest").bitwiseAND(F.lit(PART - 1))}).select(*names)
    return save(rows, "radix-ranks").withColumn(name, F.shiftleft("part", PART_BITS) + F.col("place")).drop("part", "place")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` (all long), one row per row of ``docs``.

    A null or empty text has no features and weight 0. Of the N rows with ``min_words``
    words or more, the ``percent * N // 100`` highest scores are drawn and ranked from
    1; equal scores by smaller id, null ids last. Repeated rows are scored and drawn each
    on its own; rows with the same id and score stand in some order. A null id draws
    with the empty string. Extra columns of either table are not read. An empty table
    gives no rows; without target texts all gains come from smoothing alone.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = gains(bucket_counts(texts.select("text"), n, buckets),
                  bucket_counts(target.select(F.col(target_col).cast("string").alias("text")), n, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            sizes, n_words, weights = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                tokens = words(text.as_py())
                found = feature_buckets(tokens, n, buckets, memo)
                n_words.append(len(tokens))
                sizes.append(len(found))
                weights.append(int(table[found].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(x, pa.int64()) for x in (n_words, sizes, weights)],
                names=["doc_id", "n_words", "n_features", "weight"])

    weighed = texts.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    row = F.monotonically_increasing_id()
    scored = save(weighed.withColumn("score", F.col("weight") + gumbel)
                  .withColumns({"part": F.shiftright(row, PART_BITS), "place": row.bitwiseAND(F.lit(PART - 1))}), "weights")
    able = scored.where(F.col("n_words") >= min_words).withColumn("falling", F.bitwise_not("score"))
    drawn = able.count() * percent // 100
    ranked = radix_ranks(able.drop("n_words"), ["falling", "doc_id"]).withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionAll(rest.select(*out))
