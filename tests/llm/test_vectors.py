import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import hnsw, voronoi
from cohortlake.llm.components import local_roots

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    base = spark.read.parquet(f"{SF}/embeddings.parquet")
    close = base.where("vec_id < 60").select((F.col("vec_id") + 5000).alias("vec_id"),
                                             F.transform("embedding", lambda x: (x * 1.01 + 0.004).cast("float")).alias("embedding"), "label")
    odd = spark.createDataFrame([(-1, None, 0), (-2, [0.0] * 64, 0), (-3, [float("nan")] + [1.0] * 63, 0), (None, [1.0] * 64, 0),
                                 (-4, [], 0), (-5, [None, 1.0], 0), (-100, [0.5, -0.25], 0), (-6, [float("inf")] * 64, 0),
                                 (-7, [1e-30] * 64, None), (-8, [3e30] * 64, None)], SCHEMA)
    return base.unionByName(close).unionByName(odd).withColumns({"cell": F.lit("clash"), "v": F.lit(1), "rank": F.lit(1)}).cache()


def usable(vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if r.vec_id is not None and r.embedding is not None
            and all(x is not None and np.isfinite(x) for x in r.embedding)]
    x = np.zeros((len(rows), 64))
    for i, (_, e) in enumerate(rows):
        x[i, :len(e)] = e
    return np.array([r[0] for r in rows]), x


def top(ids, x, is_query, k):
    v = np.array([[int(c) for c in row] for row in np.floor(1024 * x)], dtype=object)
    want = set()
    for q in np.flatnonzero([is_query(i) for i in ids]):
        s = v @ v[q]
        order = sorted((k_ for k_ in range(len(ids)) if k_ != q), key=lambda j: (-s[j], ids[j]))[:k]
        want |= {(int(ids[q]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)}
    return want


def test_top_k(vectors):
    small = vectors.where("vec_id IS NULL OR vec_id <> -8")
    ids, x = usable(small)
    got = voronoi.knn_join(small, F.col("vec_id") % 10 == 0, k=7, slice_rows=100, query_rows=16)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == top(ids, x, lambda i: i % 10 == 0, 7)


def test_top_k_beyond_double_precision(spark):
    rows = [(i, [float(2.0 ** 17 + i), float(i % 3)], 0) for i in range(30)]
    d = spark.createDataFrame(rows, SCHEMA)
    ids, x = usable(d)
    got = {tuple(r) for r in voronoi.knn_join(d, F.col("vec_id") < 5, k=4).collect()}
    assert got == top(ids, x[:, :64], lambda i: i < 5, 4)


def test_top_k_ties_repeats_and_few(spark, vectors):
    d = spark.createDataFrame([(i, [1.0, 1.0], 0) for i in (9, 3, 7, 3, 5)], SCHEMA)
    got = [tuple(r) for r in voronoi.knn_join(d, F.col("vec_id") == 3, k=10).orderBy("rank").collect()]
    score = 2 * 1024 * 1024
    assert got == [(3, 1, 5, score), (3, 2, 7, score), (3, 3, 9, score)]
    assert voronoi.knn_join(d, F.col("vec_id") == 4, k=10).count() == 0
    assert voronoi.knn_join(vectors.where("1 = 0"), F.lit(True)).count() == 0


def links(ids, x, threshold):
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n > 0, n, 1)[:, None]
    near = (u @ u.T >= threshold) & (n > 0)[:, None] & (n > 0)[None, :]
    np.fill_diagonal(near, False)
    return near


def test_near_vectors(vectors):
    got = {r.vec_id: r for r in hnsw.near_vectors(vectors, 0.9, n_shards=3, query_rows=300).collect()}
    assert len(got) == vectors.count()
    ids, x = usable(vectors)
    order = np.argsort(ids)
    ids, near = ids[order], links(ids, x, 0.9)[order][:, order]
    i, j = np.nonzero(np.triu(near, 1))
    root = ids[local_roots(len(ids), i, j)]
    found = sum(got[a].n_links for a in ids.tolist())
    assert near.sum() > 100 and 0.95 * near.sum() <= found <= near.sum()
    assert np.mean([got[a].component_id == c and got[a].kept == (a == c) for a, c in zip(ids.tolist(), root.tolist())]) > 0.98
    for odd in (-1, -2, -3, -4, -5, -6):
        assert (got[odd].n_links, got[odd].component_id, got[odd].kept) == (0, odd, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert hnsw.near_vectors(vectors.where("1 = 0")).count() == 0


def test_hot_group_is_whole():
    """A beam full of links widens until all of a large group are found."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(700, 16)), rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(500, 16))])
    ids = np.arange(len(x))
    g_ids, unit, graph = hnsw.shard_graph(ids, x, 8, 32)
    u, v = hnsw.find_links(graph, g_ids, unit, ids, hnsw._unit(x), 0.9, 16, 0.99, 200)
    assert len(u) >= 0.99 * links(ids, x, 0.9).sum() and len(set(zip(u.tolist(), v.tolist()))) == len(u)


def test_equal_vectors_are_one_node(spark, monkeypatch):
    """A third of the rows have the same vector, and some of them a near one: no task
    sees a link between members, and all rows get their counts."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8)).round(3)
    x[:300] = x[0]
    x[300:303] = x[0] + 0.01
    x[500] = x[400]
    frame = spark.createDataFrame([(int(i) + 1, e.tolist(), 0) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    most, fold = spark.sparkContext.accumulator(0), hnsw.fold_links

    def counted(batches, *rest):
        def seen():
            for u, w in batches:
                most.add(len(u))
                yield u, w
        return fold(seen(), *rest)

    monkeypatch.setattr(hnsw, "fold_links", counted)
    got = {r.vec_id: r for r in hnsw.near_vectors(frame, 0.99, n_shards=2, query_rows=400).collect()}
    near = links(np.arange(1, 901), x, 0.99)
    i, j = np.nonzero(np.triu(near, 1))
    root = local_roots(900, i, j) + 1
    assert [got[k + 1].n_links for k in range(900)] == near.sum(1).tolist()
    assert [got[k + 1].component_id for k in range(900)] == root.tolist()
    assert [got[k + 1].kept for k in range(900)] == (root == np.arange(1, 901)).tolist()
    assert near.sum() > 300 * 299 and most.value < 2000


def test_links_are_folded_in_batches():
    """Sums and roots over batches equal those over all links together."""
    rng = np.random.default_rng(9)
    ids, q_ids = np.arange(0, 4000, 2), np.arange(1000, 3000)
    u, w = rng.integers(0, 2000, 900), rng.integers(0, 2000, 900)
    size = rng.integers(1, 5, 2000)
    per, names, root = hnsw.fold_links(((u[k:k + 7], w[k:k + 7]) for k in range(0, 900, 7)), q_ids, ids, size)
    assert per.tolist() == np.bincount(u, weights=size[w], minlength=2000).astype(int).tolist()
    a, b = np.searchsorted(names, q_ids[u]), np.searchsorted(names, ids[w])
    assert root.tolist() == local_roots(len(names), a, b).tolist()


def recall_of_pairs(hot):
    """Rare pairs with the nodes of a loose graph: the share found, where no audited
    query has one, or a large group has most of the links."""
    rng = np.random.default_rng(7)
    nodes = rng.normal(size=(6000, 32))
    group = rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(hot, 32))
    ids, unit, graph = hnsw.shard_graph(np.arange(6000 + hot), np.concatenate([nodes, group]), 3, 4)
    queries = rng.normal(size=(1000, 32))
    audited = np.unique(np.linspace(0, 999, 40).astype(int))
    free = np.setdiff1d(np.arange(1000), audited)
    queries[free[::8]] = nodes[:len(free[::8])] + 0.3 * rng.normal(size=(len(free[::8]), 32))
    if hot:
        queries[audited[:-1]] = group[:len(audited) - 1]
    q = hnsw._unit(queries)
    u, v = hnsw.find_links(graph, ids, unit, 10**6 + np.arange(1000), q, 0.9, 16, 0.98, 40)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(q @ unit.T >= 0.9), strict=True) if a in free}
    assert len(want) > 50
    return len(want & set(zip(u.tolist(), v.tolist(), strict=True))) / len(want)


def test_links_that_no_audited_query_has():
    assert recall_of_pairs(0) >= 0.95


def test_pairs_beside_a_large_group():
    assert recall_of_pairs(200) >= 0.95


def test_upper_layer_larger_than_a_batch():
    x = np.random.default_rng(6).normal(size=(3000, 8))
    level = hnsw.Graph.levels(len(x), 4)
    order = np.argsort(-level, kind="stable")
    unit = hnsw._unit(x[order])
    sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)]
    graph = hnsw.Graph.build(unit.astype(np.float32), sizes, 4, 32, batch=64)
    assert sizes[1] > 64
    found, _ = graph.search(unit[:500].astype(np.float32), 64)
    best = np.argsort(-(unit[:500] @ unit.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.tolist(), best.tolist())]) > 0.9


def test_graph_round_trip():
    x = np.random.default_rng(5).normal(size=(300, 8))
    ids, unit, graph = hnsw.shard_graph(np.arange(300), x, 8, 32)
    again = hnsw.Graph.load(graph.dump(), graph.vecs)
    a, b = graph.search(unit[:20].astype(np.float32), 16), again.search(unit[:20].astype(np.float32), 16)
    assert (a[0] == b[0]).all() and (a[0][:, 0] == np.arange(20)).all()


def test_no_row_holds_a_graph(spark, monkeypatch):
    """Rows between tasks stay small however many nodes a shard has; graphs asked in
    several rounds, one after another, find all links of the whole."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 64))
    x[700:760] = x[:60] + 0.01
    frame = spark.createDataFrame([(i, e.tolist(), 0) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    saved, save = [], hnsw.save

    def kept(*args, **more):
        saved.append(save(*args, **more))
        return saved[-1]

    monkeypatch.setattr(hnsw, "save", kept)
    got = {r.vec_id: r for r in hnsw.near_vectors(frame, 0.9, n_shards=2, shard_rows=600, query_rows=400).collect()}
    sizes = [t.agg(F.max(F.length(f.name))).first()[0] for t in saved for f in t.schema if f.dataType.simpleString() == "binary"]
    assert sizes and max(sizes) <= 1 << 18
    near = links(np.arange(1500), x, 0.9)
    i, j = np.nonzero(np.triu(near, 1))
    assert near.sum() >= 120 and [got[k].n_links for k in range(1500)] == near.sum(1).tolist()
    assert [got[k].component_id for k in range(1500)] == local_roots(1500, i, j).tolist()


def test_graph_arrays_in_chunks(monkeypatch):
    rng = np.random.default_rng(13)
    arrays = {"ids": rng.integers(0, 99, 700), "x": rng.normal(size=(700, 3)).astype(np.float32), "l0": rng.integers(-1, 9, (700, 4)).astype(np.int32)}
    monkeypatch.setattr(hnsw, "CHUNK", 1000)
    rows = [r for shard in (4, 2) for part in hnsw.in_chunks(shard, arrays) for r in part.to_dict("records")]
    assert max(len(r["bytes"]) for r in rows) <= 1000
    again = hnsw.from_chunks(iter(rows[::-1]))
    assert sorted(again) == [2, 4]
    for name, want in arrays.items():
        assert again[4][name].dtype == want.dtype and (again[4][name].reshape(want.shape) == want).all()
    double = np.array([[0.1, 1e300], [1.0, 2.0]])
    assert hnsw.narrow(double).dtype == np.float64 and hnsw.narrow(double[1:]).dtype == np.float32
