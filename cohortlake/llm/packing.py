"""Best-fit packing of documents into sequences by bin completion.

Documents become token ids; only ones longer than a sequence are cut. What a
sequence can hold depends on lengths alone, so the search runs on the histogram
of lengths (at most ``capacity`` counts, whatever the corpus): branch and bound
that completes the bin of the largest remaining length with every undominated filling
within the waste that the incumbent permits, likely ones first, applied as often as the
counts allow and then fewer times, and keeps best-fit solutions as incumbents. Without
limits the result is optimal; ``node_limit`` and ``step_limit`` bound the driver's work,
after which the incumbent stands. The plan is a list
of fillings with multiplicities (at most a few per length). Pieces of a length
are numbered in a distributed way and take the plan's places of that length.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load_tokenizer, process_cache, save

#: Rows of a bucket in which pieces of a length are numbered.
BUCKET_ROWS = 65_536
#: Default bounds of the search on the driver: states, and partial fillings tried.
NODE_LIMIT, STEP_LIMIT = 20_000, 200_000


#: Pre-token pattern of byte-level vocabularies (fixed value).
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def text_encoder(path: str):
    """A function from a text to its ids (little-endian unsigned 32-bit bytes), as the
    ``tokenizers`` file at ``path`` gives them without added special tokens.

    A byte-level BPE whose merges make their tokens in the order of the ids is run by
    ranks, which gives the same ids several times as fast; texts that may hold special
    strings, and other files, go to the library itself.
    """
    cache = process_cache("encoders")
    if path in cache:
        return cache[path]
    tokenizer = load_tokenizer(path)
    spec = json.loads(tokenizer.to_str())
    vocab, pre = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
    special = [t["content"] for t in spec["added_tokens"]]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    made = [vocab.get("".join(m), -1) for m in spec["model"].get("merges", [])]
    ranked = (spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
              and not pre.get("add_prefix_space") and made == sorted(made) and all(c in vocab for c in byte))

    def by_library(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    if not ranked:
        cache[path] = by_library
        return by_library
    import tiktoken
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    by_rank = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return by_library(text)
        return by_rank.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
    cache[path] = encode
    return encode


def tokenized_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids_crc32`` (and ``ids``, binary) of
    every document: its ids, then ``end_id``. A document longer than ``capacity``
    is cut into full pieces after a first piece that takes the remainder. A null
    text is empty: one piece with the end id alone."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = text_encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    part = ids[4 * start: 4 * (start + length)]
                    rows.append((piece, start, length, zlib.crc32(part), part if with_ids else None))
                    at.append(i)
                    start, piece = start + length, piece + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [batch.column(0).take(pa.array(at, pa.int64()))]
            arrays += [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = x.schema["doc_id"].dataType.simpleString()
    out = x.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


# ---- the search, on counts by length ----

def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 on counts by length."""
    n = np.zeros(capacity + 2, dtype=np.int64)
    n[:len(counts)] = counts
    mass = np.arange(capacity + 2) * n
    upto, mass_upto = np.cumsum(n), np.cumsum(mass)
    best, half = -(-int(mass_upto[-1]) // capacity), capacity // 2
    k = np.arange(half + 1)
    big = upto[-1] - upto[capacity - k]
    middle = upto[capacity - k] - upto[half]
    room = middle * capacity - (mass_upto[capacity - k] - mass_upto[half])
    small = mass_upto[half] - mass_upto[np.maximum(k, 1) - 1]
    return max(best, int((big + middle + np.maximum(0, -(-(small - room) // capacity))).max()))


def _best_fit(counts: np.ndarray, room: int) -> tuple[int, ...]:
    """The largest length that fits, again and again."""
    filling: list[int] = []
    top = min(room, len(counts) - 1)
    below = np.maximum.accumulate(np.where(counts[:top + 1] > 0, np.arange(top + 1), 0))  # largest one present
    size = int(below[top])
    while size:
        times = min(room // size, int(counts[size]))
        filling += [size] * times
        room -= times * size
        size = int(below[min(room, size - 1)])
    return tuple(filling)


def _bits(counts: np.ndarray) -> int:
    """The lengths that occur, as bits."""
    return int.from_bytes(np.packbits(counts > 0, bitorder="little").tobytes(), "little") & ~1


def undominated(filling: tuple[int, ...], counts: np.ndarray, room: int, present: int | None = None) -> bool:
    """Whether no length left over could replace items of ``filling`` (one, several or none) that are together as
    long or shorter and fit ``room``: otherwise the larger length belongs here and its items go where it was.

    Sums of items are bits of an integer, so that all subsets are compared at once."""
    one = several = 0
    left = _bits(counts) if present is None else present
    for size in filling:
        several |= (several | one) << size
        one |= 1 << size
    for size in set(filling):
        if counts[size] <= filling.count(size):
            left &= ~(1 << size)
    waste, longer, span = room - sum(filling), (1 | one | several) << 1, 1
    while span < waste:  # sums raised by 1 to `waste`
        step = min(span, waste - span)
        longer |= longer << step
        span += step
    return not left & (several | (longer if waste else 0))


def _proposals(counts: np.ndarray, room: int, depth: int) -> list[tuple[int, ...]]:
    """Fillings that are likely to be good, least waste first: the best-fit one and the fullest
    ones of one to ``depth`` items (of three or more: from the first lengths tried)."""
    found = {_best_fit(counts, room)}
    def fullest(c: np.ndarray, limit: int, items: int, top: int) -> tuple[int, ...]:
        """The fullest filling of ``limit`` by up to ``items`` lengths of at most ``top``
        (the first found among equals)."""
        top = min(top, limit)
        if top <= 0:
            return ()
        below = np.maximum.accumulate(np.where(c[:top + 1] > 0, np.arange(top + 1), 0))  # largest one present
        if items == 1 or below[top] == 0:
            return (int(below[top]),) if below[top] else ()
        if items == 2:
            first = np.flatnonzero(c[:top + 1] > 0)
            first = first[first > 0]
            rest = np.minimum(limit - first, top)
            second = below[rest]
            alone = (second == first) & (c[first] < 2)
            second[alone] = below[first[alone] - 1]
            best = int(np.argmax((first + second)[::-1]))
            one, two = int(first[::-1][best]), int(second[::-1][best])
            return (one, two) if two else (one,)
        best, size = (), int(below[top])
        for _ in range(16 if items == 3 else 4):
            if size == 0 or sum(best) == limit:
                break
            c[size] -= 1
            option = (size, *fullest(c, limit - size, items - 1, size))
            c[size] += 1
            best = option if sum(option) > sum(best) else best
            size = int(below[size - 1])
        return best

    for items in range(1, depth + 1):
        found.add(tuple(sorted(fullest(counts, room, items, room), reverse=True)))
    return sorted(found, key=lambda f: (room - sum(f), tuple(-x for x in f)))  # small lengths are kept for later


def fillings(counts: np.ndarray, room: int, waste: Callable[[], int] | None = None, depth: int = 4,
             step: Callable[[], bool] = lambda: True) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of ``room`` that wastes at most ``waste()`` (asked anew as the search goes on), once.

    Likely ones come first, then all others by length, from the largest. ``step`` is called for each partial
    filling and ends the enumeration when it is false."""
    most = waste or (lambda: room)
    if room <= 0 or not counts[1:room + 1].any():
        if room <= most():
            yield ()
        return
    if room < len(counts) and counts[room]:  # dominates all others
        yield (room,)
        return
    present, given = _bits(counts), set()
    for f in _proposals(counts.copy(), room, depth):
        if room - sum(f) <= most() and undominated(f, counts, room, present):
            given.add(f)
            yield f
    sizes = np.flatnonzero(counts[:room + 1] > 0)[::-1]
    times = counts[sizes]
    rest = [*np.cumsum((sizes * times)[::-1])[::-1].tolist(), 0]  # mass from each length on
    sizes, times = sizes.tolist(), times.tolist()

    def walk(at: int, left: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not step():
            return
        if left <= most() and chosen not in given and undominated(chosen, counts, room, present):
            yield chosen
        for i in range(at, len(sizes)):
            if left - rest[i] > most():
                return  # the lengths from here on are too few
            for k in range(min(times[i], left // sizes[i]), 0, -1):
                yield from walk(i + 1, left - k * sizes[i], chosen + (sizes[i],) * k)

    yield from walk(0, room, ())


def pack_counts(counts: np.ndarray, capacity: int, node_limit: int | None = NODE_LIMIT, step_limit: int | None = STEP_LIMIT,
                depth: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with multiplicities that use up ``counts`` (index: length).

    Depth-first branch and bound. ``node_limit`` bounds the states and ``step_limit`` the partial fillings tried;
    when one is used up, or a solution meets the lower bound, the incumbent stands. With both None the
    search ends with a proof: no plan has fewer sequences. Deterministic.
    """
    counts = np.asarray(counts, dtype=np.int64).copy()
    total = int((np.arange(len(counts)) * counts).sum())
    bound = lower_bound(counts, capacity)

    def most_times(c: np.ndarray, pattern: tuple[int, ...]) -> tuple[np.ndarray, int]:
        need = np.bincount(pattern, minlength=len(c))
        at = need > 0
        return need, int((c[at] // need[at]).min())

    def descend(choose) -> tuple[int, list]:
        c, plan, bins = counts.copy(), [], 0
        top = len(c) - 1
        while True:
            while top > 0 and not c[top]:
                top -= 1
            if top == 0:
                return bins, plan
            c[top] -= 1
            filling = choose(c, capacity - top)
            c[top] += 1
            pattern = (top, *filling)
            need, times = most_times(c, pattern)
            c -= need * times
            plan.append((pattern, times))
            bins += times

    # incumbents: best fit, and the first undominated filling by proposals of several depths
    best = min((descend(_best_fit), *(descend(lambda c, room, most=most: next(fillings(c, room, depth=most)))
                                      for most in range(2, depth + 2))), key=lambda x: x[0])
    nodes = steps = 0

    def step() -> bool:
        nonlocal steps
        steps += 1
        return step_limit is None or steps <= step_limit

    def children(c: np.ndarray, bins: int, mass: int):
        """``(pattern, need, times)`` of the bins of the largest length."""
        def slack() -> int:  # what one sequence fewer than the incumbent's may still waste
            return (best[0] - 1 - bins) * capacity - mass
        top = int(np.flatnonzero(c)[-1])
        room, others = capacity - top, c.copy()
        others[top] -= 1
        tried = []
        for filling in fillings(others, room, slack, depth, step):
            pattern = (top, *filling)
            need, most = most_times(c, pattern)
            wasted = capacity - sum(pattern)
            times = min(most, slack() // wasted) if wasted else most
            if times > 0:
                tried.append((pattern, need, times))
                yield pattern, need, times
        for pattern, need, most in tried:
            for times in range(most - 1, 0, -1):
                yield pattern, need, times

    seen: dict[bytes, int] = {}  # states that were opened, and with how many bins
    stack = [(children(counts, 0, total), counts, 0, total, ())] if total else []
    while stack and best[0] > bound and (node_limit is None or nodes < node_limit) and (step_limit is None or steps <= step_limit):
        options, c, bins, mass, path = stack[-1]
        option = next(options, None)
        if option is None:
            stack.pop()
            continue
        pattern, need, times = option
        nodes += 1
        d, used, left = c - need * times, bins + times, mass - times * sum(pattern)
        path = (path, (pattern, times))
        if not left:
            if used < best[0]:
                plan = []
                while path:
                    path, last = path
                    plan.append(last)
                best = (used, plan[::-1])
            continue
        if used + lower_bound(d, capacity) >= best[0]:
            continue
        state = hashlib.blake2b(d.tobytes(), digest_size=16).digest()
        if seen.get(state, used + 1) <= used:
            continue
        seen[state] = used
        stack.append((children(d, used, left), d, used, left, path))
    return best[1]


def place_table(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Places by length: ranks ``first .. first + times - 1`` of a length go to
    sequences ``base + rank - first`` at ``offset``. At most the plan's items."""
    rows, used, base = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for size in pattern:
            first = used.get(size, 0)
            rows.append((size, first, times, base, offset))
            used[size] = first + times
            offset += size
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "times", "base", "offset"]).astype("int64").sort_values(["length", "first"])


def assign_sequences(pieces: DataFrame, capacity: int = 1024, node_limit: int | None = NODE_LIMIT,
                     step_limit: int | None = STEP_LIMIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (columns ``doc_id, piece, length, ids_crc32``)."""
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    table = place_table(pack_counts(counts, capacity, node_limit, step_limit))
    by_length = {int(k): g[["first", "base", "offset"]].to_numpy() for k, g in table.groupby("length")}

    # as many buckets of a length as its rows need
    buckets = F.element_at(F.array(*[F.lit(int(-(-n // BUCKET_ROWS)) or 1) for n in counts]), F.col("length").cast("int") + 1)
    x = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets.cast("long")))
    sums = x.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (x.withColumn("_in", F.row_number().over(inside) - 1).join(sums, ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_in")).drop("_bucket", "_before", "_in"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for size in np.unique(lengths):
            at, t = np.flatnonzero(lengths == size), by_length[int(size)]
            k = np.searchsorted(t[:, 0], ranks[at], side="right") - 1
            out[at, 0] = t[k, 1] + ranks[at] - t[k, 0]
            out[at, 1] = t[k, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("_place", place("length", "_rank")).select(
        *pieces.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False, node_limit: int | None = NODE_LIMIT,
                   step_limit: int | None = STEP_LIMIT) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    Offsets are gapless from 0 and no sequence holds more than ``capacity`` ids. A
    null or empty text is one id long. Null ids and repeated rows are documents of
    their own. An empty table gives none. ``with_ids`` keeps the ids as
    little-endian unsigned 32-bit binary.
    """
    pieces = save(tokenized_pieces(docs, path, end_id, capacity, id_col, text_col, with_ids), "pieces")
    return assign_sequences(pieces, capacity, node_limit, step_limit)
