import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + size]) for size in range(1, n + 1) for i in range(len(words) - size + 1)]


def brute(docs, target, n, buckets, min_words, percent, seed):
    """``(doc_id, n_features, weight, score, rank)`` of every row, as a sorted list."""
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, n)[1]))
    for text in target:
        t.update(map(bucket, features(text, n)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        words, fs = features(text, n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    out = [(*r[:4], k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able)]
    out += [(*r[:4], None) for r in rows if r[4] < min_words]
    return sorted(out, key=str)


@pytest.mark.parametrize("n, buckets, min_words, percent", [(1, 10_000, 20, 10), (3, 97, 3, 100)])
def test_equals_brute_force(spark, docs, n, buckets, min_words, percent):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").unionByName(
        spark.createDataFrame([(-1, None), (-2, "")], "item_id long, text string"), allowMissingColumns=True)
    got = sorted((tuple(r) for r in resampling.resample(docs, target, n=n, buckets=buckets, min_words=min_words, percent=percent, seed=7).collect()), key=str)
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()],
                 [r["text"] for r in target.select("text").collect()], n, buckets, min_words, percent, 7)
    assert got == want


def test_empty_tables(spark, docs, no_docs):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(no_docs, target).count() == 0
    out = resampling.resample(docs, target.where("false"), min_words=0, percent=100)
    assert out.where("rank is not null").count() == docs.count()
    assert out.where("n_features = 0 and weight <> 0").count() == 0


@pytest.mark.parametrize("n, high", [(2_000, 50), (200, 1 << 62)])
def test_radix_ranks(spark, monkeypatch, n, high):
    """Ranks of two keys of both signs with ties, nulls and a hot value, over many parts."""
    monkeypatch.setattr(resampling, "PART_BITS", 6)
    monkeypatch.setattr(resampling, "PART", 64)
    rng = np.random.default_rng(3)
    a = rng.integers(-high, high + 1, n).tolist()
    b = rng.integers(-(1 << 62), 1 << 62, n).tolist()
    rows = [(None if i % 17 == 5 else x if i % 3 else 7, None if i % 40 == 1 else y, (i * 7919 % n) // 64, (i * 7919 % n) % 64)
            for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a long, b long, part long, place long")
    found = sorted(resampling.radix_ranks(df, ["a", "b"]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in found] == list(range(n))
    assert [(r["a"], r["b"]) for r in found] == sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0))


def test_equal_keys_need_no_pass(spark):
    df = spark.range(3).select(F.lit(4).cast("long").alias("a"), F.lit(0).cast("long").alias("part"), F.col("id").alias("place"))
    assert sorted(r["rank"] for r in resampling.radix_ranks(df, ["a"]).collect()) == [0, 1, 2]


def test_copies_of_the_target_are_drawn(spark):
    """Among unrelated texts of the same length those like the target come first."""
    rows = [(i, " ".join(f"w{(i * 31 + j * 7) % 500}" for j in range(40))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"goal{(i + j) % 20}" for j in range(40))) for i in range(20)]
    target = spark.createDataFrame([(" ".join(f"goal{j}" for j in range(20)),)] * 50, "text string")
    out = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), target)
    drawn = [r["doc_id"] for r in out.where("rank <= 20").collect()]
    assert sorted(drawn) == list(range(1000, 1020))
