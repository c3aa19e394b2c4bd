import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def proof(levels, i):
    out = []
    for nodes in levels[:-1]:
        j = i ^ 1
        out.append(None if j >= len(nodes) else ("L" if j < i else "R", nodes[j]))
        i >>= 1
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], sha(*(field(r[c]) for c in COLUMNS)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (doc_id, leaf, r) in enumerate(groups[g]):
            siblings = proof(trees[g], i) + proof(top, k)
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r["n_chars"] is not None:
                node = sha(*(field(r[c] + 1 if c == "n_chars" else r[c]) for c in COLUMNS))
            for s in siblings:
                node = sha(node) if s is None else sha(s[1], node) if s[0] == "L" else sha(node, s[1])
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], sha(*(s[1] for s in siblings if s)), node, node == top[-1][0]))
    return sorted(out, key=str)


def result(docs, height):
    out = merkle.manifest(docs, COLUMNS, tamper=merkle.crc_tampers(), tampered={"n_chars": F.try_add("n_chars", F.lit(1))}, height=height)
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("height", [3, 12])
def test_equals_brute_force(docs, height):
    """Blocks of every size give one tree; nulls, repeated rows and a group of one included."""
    assert result(docs, height) == brute([r.asDict() for r in docs.select(*COLUMNS).collect()])


@pytest.mark.parametrize("n_groups", [1, 9])
def test_many_small_groups(spark, n_groups):
    rows = [(i, "s", f"g{i % n_groups}", i, f"text {i}") for i in range(37)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert result(docs, 2) == brute([r.asDict() for r in docs.collect()])


def test_empty_table(no_docs):
    assert result(no_docs, 12) == []


@pytest.mark.parametrize("levels", range(1, 13))
def test_addresses_are_a_layout(levels):
    """Every node has its own slot, and each lower subtree is one stretch behind the upper part."""
    slots = [merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)]
    assert sorted(np.concatenate(slots).tolist()) == list(range((1 << levels) - 1))
    if levels > 1:
        top = levels // 2
        upper = np.concatenate(slots[:top])
        assert sorted(upper.tolist()) == list(range((1 << top) - 1))
        for sub in range(1 << top):
            lower = np.concatenate([slots[d][sub << (d - top):(sub + 1) << (d - top)] for d in range(top, levels)])
            assert lower.max() - lower.min() == (1 << (levels - top)) - 2


def test_paths_fold_to_the_root():
    for n in range(1, 20):
        digests = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        levels = (n - 1).bit_length() + 1
        block = merkle.build_subtree(digests, levels)
        for digest, path in zip(digests, merkle.block_paths(block, levels, n, list(range(n))), strict=True):
            assert merkle.fold_path(digest, path) == block[:32]
            if n > 1:
                assert merkle.fold_path(hashlib.sha256(digest).digest(), path) != block[:32]
