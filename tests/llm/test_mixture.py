import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortlake.llm import mixture


def targets(sizes, weights=(1, 2, 3), limit=3):
    """Reshare by weight until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > limit * sizes[s]}
        for s in over or free:
            out[s] = float(limit * sizes[s]) if over else level * w[s]
        left -= sum(out[s] for s in over)
        free -= over or set(free)
    return out


def test_words_near_targets(docs):
    got = mixture.mixed_words(docs).toPandas()
    rows = docs.select("doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    want = targets(sizes)
    for source, g in got.groupby(got["source"].where(got["source"].notna(), "none"), dropna=False):
        s = None if source == "none" else source
        assert g["source_size"].iloc[0] == sizes[s]
        assert abs(g["target"].iloc[0] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(g["taken"].sum() - want[s]) <= 1
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixture.mixed_words(docs).toPandas()
    by = ["doc_id", "source", "size", "taken"]
    pd.testing.assert_frame_equal(got.sort_values(by)[by].reset_index(drop=True), again.sort_values(by)[by].reset_index(drop=True))


def test_limits_reshare(spark):
    d = spark.createDataFrame([("a", "w " * 1000), ("b", "w " * 3), ("c", "w " * 5), ("d", ""), (None, "w " * 400)], "source string, text string")
    d = d.withColumn("doc_id", F.monotonically_increasing_id())
    got = {r.source: r for r in mixture.mixed_words(d, block_words=16).collect()}
    want = targets({"a": 1000, "b": 3, "c": 5, "d": 0, None: 400})
    for s, t in want.items():
        assert abs(got[s].target - t) < 1e-9 * max(1, t) and abs(got[s].taken - t) <= 1


def test_slots_use_blocks_evenly(docs):
    mix = mixture.mix_sources(docs, block_words=64, shard_slots=32)
    slots = mix["slots"].toPandas()
    blocks = slots.groupby(["source_no", "pass"])["block"].agg(["count", "nunique"])
    assert (blocks["count"] == blocks["nunique"]).all()  # a permutation: no block twice in a pass
    per = slots.groupby("shard").size()
    assert (per.iloc[:-1] == 32).all() and per.max() == 32
    assert not slots.duplicated(["source_no", "slot"]).any()


def test_draws_beyond_numpys_limit():
    """Above 1e9 slots, too, the shards' counts vary as a draw without repeats does,
    and add up to the totals."""
    totals = np.array([6_000_000_000, 2_999_998_000, 2000, 0])
    half = int(totals.sum()) // 2
    got = np.array([mixture.shard_counts(totals, 0, 2, half, seed)[1] for seed in range(400)])
    before, rest = mixture.shard_counts(totals, 1, 2, half, 0)
    assert (before == got[0]).all() and (before + rest == totals).all() and (got.sum(1) == half).all()
    share = totals / totals.sum()
    sd = np.sqrt(totals.sum() / 4 * share * (1 - share))
    assert (np.abs(got.mean(0) - totals / 2) <= 4 * sd / 20).all()
    assert (np.abs(got.std(0) - sd) <= 0.2 * sd).all()
    parts = [mixture.shard_counts(totals, k, 9, 1_000_000_000, 3)[1] for k in range(9)]
    assert (sum(parts) == totals).all() and all(x.sum() == 1_000_000_000 and (x >= 0).all() for x in parts)


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        p = mixture.permute(np.arange(n), n, 5)
        assert sorted(p) == list(range(n))
        assert (mixture.permute(p, n, 5, inverse=True) == np.arange(n)).all()


def test_documents_of_the_mix(docs, no_docs):
    words = mixture.mixed_words(docs)
    mixed = mixture.mixed_documents(docs)
    assert mixed.columns == docs.columns
    n = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    assert mixed.agg(n).first()[0] == words.agg(F.sum("taken")).first()[0]
    assert mixture.mixed_words(no_docs).count() == 0 and mixture.mixed_documents(no_docs).count() == 0
