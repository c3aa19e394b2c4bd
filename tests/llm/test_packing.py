import itertools
import struct
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from cohortlake.llm import packing
from cohortlake.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_pieces_and_places(docs, capacity):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, PATH, capacity=capacity, with_ids=True).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            raw = struct.pack(f"<{b - a}I", *ids[a:b])
            want[r.doc_id, k, a, b - a, zlib.crc32(raw), raw] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == want
    used = check_sequences(rows, capacity)
    counts = np.bincount([r.length for r in rows], minlength=capacity + 1)
    assert used <= packing.lower_bound(counts, capacity) * 1.02 + 1


def least_bins(items, capacity):
    items = sorted(items, reverse=True)
    for bins in itertools.count(1):
        def place(k, room):
            if k == len(items):
                return True
            for i in range(len(room)):
                if room[i] >= items[k] and room[i] not in room[:i]:
                    if place(k + 1, room[:i] + [room[i] - items[k]] + room[i + 1:]):
                        return True
            return False
        if place(0, [capacity] * bins):
            return bins


@pytest.mark.parametrize("limits", [{}, {"node_limit": None, "step_limit": None}, {"node_limit": 0, "step_limit": 0}])
def test_optimal_on_small_sets(limits):
    rng = np.random.default_rng(3)
    for _ in range(40):
        items = rng.integers(1, 31, rng.integers(1, 11))
        plan = packing.pack_counts(np.bincount(items, minlength=31), 30, **limits)
        assert Counter(x for pattern, n in plan for x in pattern * n) == Counter(items.tolist())
        assert all(sum(pattern) <= 30 for pattern, _ in plan)
        bins = sum(n for _, n in plan)
        best = least_bins(items.tolist(), 30)
        assert packing.lower_bound(np.bincount(items, minlength=31), 30) <= best <= bins <= best + 1
        assert bins == best or limits == {"node_limit": 0, "step_limit": 0}


def test_optimal_where_incumbents_are_not():
    """Repeated lengths in bins of 30: the search must leave its incumbents and take fillings fewer times."""
    rng = np.random.default_rng(8)
    better = 0
    for _ in range(120):
        items = rng.choice(rng.integers(3, 20, 5), rng.integers(8, 14))
        counts = np.bincount(items, minlength=31)
        best = least_bins(items.tolist(), 30)
        assert sum(n for _, n in packing.pack_counts(counts, 30, None, None, depth=1)) == best
        better += sum(n for _, n in packing.pack_counts(counts, 30, 0, 0, depth=1)) > best
    assert better > 0


def dominates(a, b):
    """Whether the items of ``b`` can be dealt into bins as large as the items of ``a``."""
    @lru_cache(maxsize=None)
    def fits(rest, bins):
        if not rest:
            return True
        for i, room in enumerate(bins):
            if room >= rest[0] and (i == 0 or room != bins[i - 1]):
                if fits(rest[1:], tuple(sorted(bins[:i] + (room - rest[0],) + bins[i + 1:], reverse=True))):
                    return True
        return False
    return sum(a) >= sum(b) and fits(tuple(sorted(b, reverse=True)), tuple(sorted(a, reverse=True)))


def test_dominance():
    assert dominates((10,), (6, 4)) and dominates((6, 4), (5, 4)) and not dominates((6, 4), (7, 2))
    counts = np.bincount([10, 7, 6, 5, 4, 2], minlength=11)
    assert packing.undominated((10,), counts, 10) and not packing.undominated((6, 4), counts, 10)
    assert not packing.undominated((5, 4), counts, 10) and not packing.undominated((7, 2), counts, 10)


def test_all_undominated_fillings_once():
    rng = np.random.default_rng(5)
    for trial in range(150):
        room = int(rng.integers(1, 26))
        items = rng.integers(1, 21, rng.integers(0, 9)).tolist()
        subsets = {tuple(sorted(c, reverse=True)) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room}
        want = {f for f in subsets if not any(g != f and dominates(g, f) for g in subsets)}
        counts = np.bincount(items, minlength=31)
        got = list(packing.fillings(counts, room, depth=int(rng.integers(1, 5))))
        assert len(got) == len(set(got)) and set(got) == want
        waste = int(rng.integers(0, 4))
        assert set(packing.fillings(counts, room, lambda: waste)) == {f for f in want if room - sum(f) <= waste}


def test_step_limit_ends_the_search():
    counts = np.bincount(np.random.default_rng(2).integers(1, 600, 3000), minlength=1025)
    plan = packing.pack_counts(counts, 1024, None, 500)
    assert Counter(x for pattern, n in plan for x in pattern * n) == Counter({k: int(v) for k, v in enumerate(counts) if v})


def test_buckets_by_rows(docs, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    rows = packing.pack_documents(docs, PATH, capacity=64).collect()
    assert check_sequences(rows, 64) <= packing.lower_bound(np.bincount([r.length for r in rows], minlength=65), 64) * 1.02 + 1


def test_hot_length_and_empty(spark, no_docs):
    d = spark.range(500).selectExpr("id AS doc_id", "'one two three' AS text")
    rows = packing.pack_documents(d, PATH, capacity=16).collect()
    assert len(rows) == 500 and check_sequences(rows, 16) == 125
    assert packing.pack_documents(no_docs, PATH).count() == 0
