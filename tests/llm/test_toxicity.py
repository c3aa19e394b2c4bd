import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import toxicity
from cohortlake.llm.common import fold

CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


def vectors(rng, n, n_terms):
    out = []
    for _ in range(n):
        terms = np.sort(rng.choice(n_terms, rng.integers(1, 6), replace=False))
        out.append(toxicity.unit_vector(terms.tolist(), rng.integers(1, 4, len(terms)).tolist(), np.linspace(1, 3, n_terms)))
    return out


@pytest.mark.parametrize("n, n_terms", [(1000, 12), (700, 300), (5, 8), (0, 8)])
def test_nearest_is_exact(n, n_terms):
    """Equal to all cosines in full, ties by id, with and without a left-out id."""
    rng = np.random.default_rng(n)
    data = vectors(rng, n, n_terms)
    ids = rng.permutation(n).tolist()
    index = toxicity.BlockMaxIndex.build(ids, [i % 2 for i in ids], data, n_terms)
    dense = np.zeros((n, n_terms))
    for i, (t, w) in enumerate(data):
        dense[i, t] = w
    for t, w in vectors(rng, 60, n_terms):
        full = np.round(dense[:, t] @ w, 12)
        for without in (None, 0):
            want = sorted(((-s, i) for s, i in zip(full.tolist(), ids, strict=True) if s > 0 and i != without))[:8]
            places, cosines = index.nearest(t, w, 8, without)
            assert np.allclose(cosines, [-s for s, _ in want], rtol=0, atol=1e-9) and len(cosines) == len(want)
            if len({round(s, 9) for s, _ in want}) == len(want):
                assert index.ids[places].tolist() == [i for _, i in want]


def test_ties_go_to_the_smaller_id():
    same = toxicity.unit_vector([1], [1], np.ones(3))
    index = toxicity.BlockMaxIndex.build(list(range(999, -1, -1)), [0] * 1000, [same] * 1000, 3)
    places, cosines = index.nearest(*same, 5)
    assert index.ids[places].tolist() == [0, 1, 2, 3, 4] and (cosines == 1).all()


def test_blocks_out_of_reach_are_not_read():
    """A query that 8 vectors equal exactly leaves most blocks alone."""
    rng = np.random.default_rng(1)
    data = vectors(rng, 20_000, 400)
    index = toxicity.BlockMaxIndex.build(list(range(len(data))), [0] * len(data), data, 400)
    read, scores = [], index._scores

    def watched(terms, weights, blocks):
        read.extend(blocks.tolist())
        return scores(terms, weights, blocks)
    index._scores = watched
    t, w = data[17]
    places, cosines = index.nearest(t, w, 1)
    assert cosines[0] >= 1 - 1e-9
    assert len(read) < 0.3 * len(data) / toxicity.BLOCK


def test_isotonic_rises_and_keeps_the_rate():
    rng = np.random.default_rng(5)
    votes = np.round(rng.random(500), 2)
    labels = (rng.random(500) < votes ** 2).astype(np.int64)
    starts, rates = toxicity.isotonic(votes, labels, np.ones(500))
    assert (np.diff(starts) > 0).all() and (np.diff(rates) >= -0.05).all()
    fitted = rates[np.searchsorted(starts, votes, side="right") - 1]
    assert abs(fitted.mean() - labels.mean()) < 0.02
    assert abs(fitted - votes ** 2).mean() < 0.1


def test_hard_rows(spark, docs, labels):
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    extra = spark.createDataFrame([(None, 0, 1), (10**6 + 1, 0, None), (10**6 + 2, None, 1), (10**6 + 2, None, 0), (10**6 + 4, 0, 7)],
                                  "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, labels.unionByName(extra), ~held_out).cache()
    assert out.count() == docs.count()
    assert out.columns == ["doc_id", "score", "predicted", "evidence"]
    assert out.where("score is null or not score between 0 and 1 or predicted <> (score >= 0.3)::int").count() == 0
    assert out.where("exists(evidence, e -> e.cosine <= 0 or e.cosine > 1.000001 or e.label not in (0, 1))").count() == 0
    assert out.where("doc_id is null").count() == docs.where("doc_id is null").count()
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}[10**6 + 6] == 2
    ids = {r["doc_id"] for r in out.select(F.explode("evidence.doc_id").alias("doc_id")).distinct().join(docs.where(held_out), "doc_id").collect()}
    assert not ids  # held-out rows are never examples


def test_empty_tables(docs, no_docs, labels):
    every = F.lit(True)
    assert toxicity.score_toxicity(no_docs, labels, every).count() == 0
    out = toxicity.score_toxicity(docs, labels.where("false"), every)
    assert {r["score"] for r in out.collect()} == {0.5}
    one_class = toxicity.score_toxicity(docs, labels.where("toxic = 0"), every).collect()
    assert len({r["score"] for r in one_class}) == 1 and one_class[0]["score"] < 0.1


def test_a_word_that_marks_the_label(spark):
    """Stems with changing ends are found, labels of held-out rows have no effect, the sample keeps its bound."""
    rows = [(i, " ".join(f"w{(i * 37 + j) % 211}" for j in range(30)) + (f" Brakul{'abcdefgh'[i % 8] * (i % 5)}." if i % 5 == 0 else "")) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1500)], "doc_id long, toxic int")
    learns = F.col("doc_id") % 3 != 1
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels, learns).collect()}
    assert all(out[i]["predicted"] == (i % 5 == 0) for i in range(1500))
    flipped = labels.withColumn("toxic", F.when(learns, F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, flipped, learns).collect()}
    assert again == out
    small = toxicity.score_toxicity(docs, labels, learns, max_examples=100).cache()
    assert small.where("predicted <> (doc_id % 5 = 0)::int").count() == 0
    assert small.select(F.explode("evidence.doc_id").alias("e")).distinct().count() <= 2 * 150


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{CHECK}/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 4) == 2
    out = toxicity.score_toxicity(docs, labels, ~held_out).join(labels, "doc_id").where(held_out)
    n = {(r["toxic"], r["predicted"]): r["n"] for r in out.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n.get((0, 1), 0) <= 0.02 * n[0, 0]
    assert n[1, 1] >= 0.6 * (n[1, 1] + n.get((1, 0), 0))
