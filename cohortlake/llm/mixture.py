"""Mixing sources to target weights.

The words of a source form one stream (documents in a fixed pseudorandom order)
cut into blocks of ``block_words`` words. Every output shard of ``shard_slots``
slots draws how many of its slots each source gets: multinomial draws,
conditioned on the sources' totals, so that the sum over all shards is the
target. The draws split the totals along a binary tree over the shards; a shard
walks its own path, with a generator seeded by each tree node, and needs no
other shard. The n-th slot of a source reads block ``perm(n mod blocks)`` of the
source, with another pseudorandom permutation for every pass over the source.
Blocks are joined by ``(source, block)``.

On the driver: one row per source (size, target, block count), nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, save

BUCKETS = 1024
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), repeat_limit: int = 3) -> DataFrame:
    """Target words per source from ``(source, source_size)``, one row per source.

    Sources in code point order, null last, get ``weights`` in turn and share the
    sum of all sizes. ``target = min(repeat_limit * size, level * weight)``, with
    the one level at which the targets add up to the sum of all sizes: what is
    above a limit goes to the others by weight until nothing is above. A source
    of size 0 has target 0. Adds ``source_no``, ``weight``, ``target``.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = (sizes.withColumn("source_no", F.row_number().over(order) - 1)
         .withColumn("weight", F.get(w, F.col("source_no") % len(weights)))
         .withColumn("_cap", F.col("source_size") * F.lit(float(repeat_limit))))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy((F.col("_cap") / F.col("weight")).asc(), "source_no")
    capped = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    free = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(capped), F.lit(0.0)))
                     / F.sum("weight").over(free))
    # the level of the first source (by cap/weight) that stays below its cap
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"),
                                            F.struct(F.col("_cap") / F.col("weight"), "_level"))).over(every)["_level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))
    return s.select("source", "source_no", "source_size", "weight", target.alias("target"))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Pseudorandom permutation of ``0..n-1``: four Feistel rounds over the next
    even number of bits, walking the cycle until the value is below ``n``."""
    half = np.uint64(max(1, (max(1, int(n) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    rounds = [np.uint64((key * 4 + r) & 0xFFFFFFFFFFFFFFFF) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in reversed(rounds) if inverse else rounds:
            if inverse:
                left, right = right ^ (_mix64(left + _mix64(r + np.uint64(1))) & mask), left
            else:
                left, right = right, left ^ (_mix64(right + _mix64(r + np.uint64(1))) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        x = once(np.asarray(index, dtype=np.uint64))
        while (out := x >= np.uint64(n)).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def slot_plan(sources: pd.DataFrame, block_words: int, seed: int) -> pd.DataFrame:
    """Blocks and slots of each source so that the slots hold ``round(target)`` words.

    All blocks have ``block_words`` words but the last of a source. ``cut`` words
    are left out at the end of a source's last slot.
    """
    rows = []
    for s in sources.itertuples(index=False):
        size, want = int(s.source_size), int(round(s.target))
        if size <= 0 or want <= 0:
            rows.append((0, 0, 0))
            continue
        blocks = -(-size // block_words)
        short = blocks * block_words - size
        passes, rest = divmod(want, size)
        at = int(permute(np.array([blocks - 1]), blocks, _key(seed, s.source_no, passes), inverse=True)[0])
        slots = -(-rest // block_words)
        if slots > at:
            slots = -(-(rest + short) // block_words)
        cut = slots * block_words - (short if slots > at else 0) - rest
        if cut < 0:  # rest ends inside the short block
            slots, cut = slots + 1, cut + block_words
        if slots == 0:
            cut = 0
        rows.append((blocks, passes * blocks + slots, cut))
    plan = pd.DataFrame(rows, columns=["blocks", "slots", "cut"]).astype("int64")
    return pd.concat([sources.reset_index(drop=True), plan], axis=1)


def _key(seed: int, source_no: int, a_pass: int) -> int:
    return (seed * 1_000_003 + int(source_no)) * 64 + int(a_pass)


def _draw(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``good`` are among ``take`` of all. From 1e9 on, where numpy draws
    none: by the normal approximation, or with a variance below 1,000, when one side
    has few, by the binomial one."""
    every = good + bad
    if every < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, take)) if take else 0
    share = take / every
    var = good * (bad / every) * share * (1 - share)
    if var >= 1000:
        got = round(good * share + var ** 0.5 * float(rng.standard_normal()))
    elif good <= bad:
        got = int(rng.binomial(good, share))
    else:
        got = take - int(rng.binomial(bad, share))
    return min(max(got, 0, take - bad), good, take)


def shard_counts(totals: np.ndarray, shard: int, shards: int, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source before a shard, and in it."""
    counts, before = totals.astype(np.int64).copy(), np.zeros(len(totals), dtype=np.int64)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        take = (mid - lo) * shard_slots
        every = int(counts.sum())
        if every < 1_000_000_000:
            rng = np.random.Generator(np.random.Philox(key=[seed, (lo << 32) | (hi & 0xFFFFFFFF)]))
            left = rng.multivariate_hypergeometric(counts, min(take, every), method="marginals")
        else:
            rng = np.random.Generator(np.random.Philox(key=[seed, (lo << 32) | (hi & 0xFFFFFFFF)]))
            left, rest, some = np.zeros_like(counts), every, min(take, every)
            for i, c in enumerate(counts.tolist()):
                left[i] = _draw(rng, c, rest - c, some)
                rest, some = rest - c, some - int(left[i])
        if shard < mid:
            counts, hi = left, mid
        else:
            counts, before, lo = counts - left, before + left, mid
    return before, counts


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (1, 2, 3), repeat_limit: int = 3, block_words: int = 512,
                shard_slots: int = 4096, seed: int = 8) -> dict[str, DataFrame]:
    """Draw a mix of the sources, as long as all documents together.

    Returns ``documents`` (id, ``text_hash``, source, source_no, size, source_size,
    target, ``start`` in the source's stream), ``slots`` (shard, source_no, slot,
    pass, block, ``words`` taken of the block, ``slot_order`` in the shard) and
    ``taken`` (source_no, start, pass, first, last: word ranges of documents).
    Null or empty texts have size 0 and are never drawn; a null source is a
    source of its own, a null id an ordinary value; repeated rows are documents
    of their own. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    d = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                         F.xxhash64(text_col).alias("text_hash")), "mix-sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, repeat_limit).toPandas()
    plan = slot_plan(sources.sort_values("source_no"), block_words, seed)
    table = spark.createDataFrame(
        [(None if r.source is None or r.source != r.source else str(r.source), int(r.source_no), int(r.source_size), float(r.target))
         for r in plan.itertuples()], "source string, source_no int, source_size long, target double")

    # start of each document in its source's stream: buckets of bounded size, then rows in a bucket
    d = d.join(F.broadcast(table), d["source"].cast("string").eqNullSafe(table["source"])).drop(table["source"])
    d = d.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS)).cast("int"))
    sums = d.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = (Window.partitionBy("source_no", "_bucket").orderBy("doc_id", "text_hash", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    d = (d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
         .join(sums, ["source_no", "_bucket"])
         .withColumn("start", F.col("_before") + F.col("_in")).drop("_bucket", "_before", "_in"))
    d = save(d, "mix-documents")

    totals, blocks = plan["slots"].to_numpy(), plan["blocks"].to_numpy()
    cuts, lengths = plan["cut"].to_numpy(), plan["source_size"].to_numpy()
    every = int(totals.sum())
    shards = max(1, -(-every // shard_slots))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                first, count = shard_counts(totals, int(shard), shards, shard_slots, seed)
                for s in np.flatnonzero(count):
                    slot = np.arange(first[s], first[s] + count[s])
                    a_pass = slot // blocks[s]
                    block = np.empty(len(slot), dtype=np.int64)
                    for p in np.unique(a_pass):
                        at = a_pass == p
                        block[at] = permute(slot[at] - p * blocks[s], int(blocks[s]), _key(seed, s, p))
                    words = np.minimum(block_words, lengths[s] - block * block_words)
                    words = np.where(slot == totals[s] - 1, words - cuts[s], words)
                    with np.errstate(over="ignore"):
                        order = _mix64(slot.astype(np.uint64) + _mix64(np.uint64(_key(seed, s, 63)) + np.uint64(1))).view(np.int64)
                    yield pd.DataFrame({"shard": int(shard), "source_no": int(s), "slot": slot, "pass": a_pass.astype(np.int32),
                                        "block": block, "words": words, "slot_order": order})

    slots = (spark.range(0, shards if every else 0, 1, max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))))
             .mapInPandas(draw, "shard long, source_no int, slot long, pass int, block long, words long, slot_order long"))
    slots = save(slots, "mix-slots")

    spans = d.where(F.col("size") > 0).select("source_no", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"))
    base = F.col("block") * block_words
    taken = (spans.join(slots.select("source_no", "block", "pass", "words"), ["source_no", "block"])
             .select("source_no", "start", "pass", F.greatest(base - F.col("start"), F.lit(0)).alias("first"),
                     F.least(base + F.col("words") - F.col("start"), F.col("size")).alias("last"))
             .where(F.col("last") > F.col("first")))
    return {"documents": d, "slots": slots, "taken": taken}


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: how many of its words the mix takes, repeats counted."""
    mix = mix_sources(docs, **options)
    taken = mix["taken"].groupBy("source_no", "start").agg(F.sum(F.col("last") - F.col("first")).alias("_taken"))
    d = mix["documents"]
    # a source's starts are unique among documents with words; empty ones take nothing
    d = d.withColumn("_key", F.when(F.col("size") > 0, F.col("start")))
    out = d.join(taken.withColumnRenamed("start", "_key"), ["source_no", "_key"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target",
                      F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    One row per document and pass that takes words of it: the text as it is where
    all its words are taken, else the taken words in their order, spaced by one
    blank. Rows that have the same id, source and text share their takes evenly.
    """
    mix = mix_sources(docs, id_col, text_col, source_col, **options)
    spans = mix["taken"].groupBy("source_no", "start", "pass").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_spans"),
        F.sum(F.col("last") - F.col("first")).alias("_taken"))
    d = mix["documents"].where(F.col("size") > 0)
    same = Window.partitionBy("doc_id", "source_no", "text_hash").orderBy("start")
    takes = (d.withColumn("_copy", F.row_number().over(same)).join(spans, ["source_no", "start"])
             .select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"),
                     "_copy", F.struct("size", "_spans", "_taken").alias("_take")))
    names = ["_id", "_source", "_hash", "_copy", "_take"]
    new = free_names(docs, "_h", "_n", *names)
    h, n, renamed = new[0], new[1], dict(zip(names, new[2:], strict=True))
    takes = takes.withColumnsRenamed(renamed)
    x = docs.withColumn(h, F.xxhash64(text_col))
    x = x.withColumn(n, F.row_number().over(Window.partitionBy(id_col, source_col, h).orderBy(F.lit(0))))
    take = F.col(renamed["_take"])
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    # the outer array has one element, so that a text is cut into words once and not for each span
    parts = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        take["_spans"], lambda s: F.slice(w, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), " "))
    text = F.when(take["_taken"] == take["size"], F.col(text_col)).otherwise(F.get(parts, 0))
    joined = x.join(takes, x[id_col].eqNullSafe(takes[renamed["_id"]]) & x[source_col].eqNullSafe(takes[renamed["_source"]])
                    & (x[h] == takes[renamed["_hash"]]) & (x[n] == takes[renamed["_copy"]]))
    return joined.select(*[text.alias(c) if c == text_col else x[c] for c in docs.columns])
