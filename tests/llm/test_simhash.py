from collections import Counter

import numpy as np
import xxhash

from cohortlake.llm import simhash
from cohortlake.llm.components import connected_components, local_roots


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_matches_brute_force(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    f = np.array([fingerprint(r.text) for r in rows], dtype=np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2, 1))
    root = local_roots(len(rows), i, j)
    least = {}
    for r, c in zip(rows, root.tolist()):
        least[c] = min([x for x in (least.get(c), r.doc_id) if x is not None], default=None)
    want = Counter((r.doc_id, f"{x:016x}", least[c]) for r, x, c in zip(rows, f.tolist(), root.tolist()))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.tolist()))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_links_in_cells():
    rng = np.random.default_rng(1)
    one = np.uint64(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([base[rng.integers(0, 40, 600)] ^ (one << rng.integers(0, 64, 600, dtype=np.uint64))
                          ^ (one << rng.integers(0, 64, 600, dtype=np.uint64)), base])
    size = np.sort(rng.integers(0, 12, len(fps)))
    n = np.bincount(size)
    rank = np.argsort(np.lexsort((np.arange(len(n)), -n)))
    order = np.argsort(rank[size], kind="stable")
    fps, cell = fps[order], rank[size][order]
    for radius in (0, 1, 2, 3, 6):
        u, v = simhash.links_within(fps.view(np.int64), cell, radius)
        near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius) & (cell[:, None] == cell[None, :])
        assert set(zip(u.tolist(), v.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))


def test_hot_bucket_is_cut(spark):
    """A bucket far above the size of a cell loses no link."""
    rng = np.random.default_rng(2)
    one = np.uint64(1)
    f = np.uint64(0x0123456789ABCDEF) ^ (one << rng.integers(32, 64, 400, dtype=np.uint64)) ^ (one << rng.integers(32, 64, 400, dtype=np.uint64))
    f = np.unique(np.concatenate([f, rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    classes = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    got = connected_components(simhash.link_fingerprints(classes, 2, cell_rows=32)).collect()
    i, j = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2, 1))
    root = local_roots(len(f), i, j)
    s = f.view(np.int64)
    want = {}
    for x, c in zip(s.tolist(), root.tolist()):
        want.setdefault(c, set()).add(x)
    found = {}
    for r in got:
        found.setdefault(r.root, set()).add(r.node)
    assert {frozenset(x) for x in found.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 5), (200, 201), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(61), 100], 0), 200: 200, 201: 200}
