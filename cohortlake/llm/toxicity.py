"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are words (A-Z lower-cased) and the first 4, 5 and 6 characters of longer words,
which catch a stem whatever follows it. Terms that speak for the label are chosen on
the examples by a likelihood-ratio test; inverse document frequencies are counted over
all documents. The examples' unit vectors form an inverted index whose posting lists are
cut into blocks of examples, each with its largest weight. A query adds up these
maxima to a bound per block, visits blocks by falling bound and stops where no block
can reach the k-th best cosine: the result is exact. The k neighbours vote with their
cosine; votes become probabilities by an isotonic fit on the examples, each asked
without itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, save

PREFIXES = (4, 5, 6)
BLOCK = 128
MEMO = 400_000
FLUSH = 300_000
VECTORS = 20_000
#: Bytes between words: ASCII other than letters and digits; A-Z become lower case.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def word_terms(word: bytes) -> list[bytes]:
    """The word, and its first characters (marked by ``*``) where it has more of them."""
    chars = word.decode("utf-8", "replace")
    return [word] + [chars[:n].encode() + b"*" for n in PREFIXES if len(chars) > n]


def choose_terms(examples: DataFrame, max_terms: int, min_g2: float, min_lift: float) -> list[bytes]:
    """Of the terms of ``examples (text, y)`` that are ``min_lift`` times as frequent with label 1
    as with label 0 or more, those with a likelihood-ratio statistic of ``min_g2`` or more, at most the ``max_terms`` highest. The
    bound rises to ``2 ln`` of the number of terms in three examples or more, which about one
    term would pass by chance. Repeated texts count once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts):
            terms = set(counts[0]) | set(counts[1])
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)],
                                              names=["term", "n0", "n1"])
        counts = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                counts[y].update({t for w in set(words(text.as_py())) for t in word_terms(w)})
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield rows(counts)
                    counts = Counter(), Counter()
        yield rows(counts)

    examples = examples.groupBy(F.xxhash64("text"), "y").agg(F.first("text").alias("text")).select("text", "y")
    sizes = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    m0, m1 = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    if not m0 or not m1:
        return []
    found = examples.select("text", "y").mapInArrow(count, "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    p = (F.col("n0") + F.col("n1")) / (m0 + m1)
    g2 = 2 * (part(F.col("n0"), m0 * p) + part(F.col("n1"), m1 * p) + part(m0 - F.col("n0"), m0 * (1 - p)) + part(m1 - F.col("n1"), m1 * (1 - p)))
    found = save(found.where(F.col("n0") + F.col("n1") >= 3), "toxicity-terms")
    least = max(min_g2, 2 * math.log(max(found.count(), 1)))
    best = (found.where(F.col("n1") * m0 >= F.col("n0") * (m1 * min_lift)).withColumn("g2", F.round(g2, 6)).where(F.col("g2") >= least)
            .orderBy(F.desc("g2"), "term").limit(max_terms))
    return sorted(bytes(r["term"]) for r in best.select("term").collect())


def term_counts(texts: DataFrame, terms: list[bytes]) -> DataFrame:
    """``texts`` (its column ``text`` last) with ``terms`` and ``counts`` (arrays, by rising term) in place of the text."""
    ids = {t: i for i, t in enumerate(terms)}
    names = texts.columns[:-1]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            seen, counts = [], []
            for text in batch.column(len(names)).cast(pa.binary()):
                tokens = words(text.as_py())
                bounded(memo, MEMO)
                memo.update((w, tuple(ids[t] for t in word_terms(w) if t in ids)) for w in set(tokens).difference(memo))
                c = Counter(i for hit in filter(None, map(memo.__getitem__, tokens)) for i in hit)
                seen.append(sorted(c))
                counts.append([c[i] for i in seen[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))]
                                             + [pa.array(seen, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                                             names=[*names, "terms", "counts"])

    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names)
    return texts.mapInArrow(extract, schema + ", terms array<int>, counts array<int>")


def unit_vector(terms: list[int], counts: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights ``(1 + ln tf) idf`` of length one."""
    t = np.asarray(terms, np.int64)
    w = (1 + np.log(np.asarray(counts, np.float64))) * idf[t]
    return t, w / np.sqrt((w * w).sum()) if len(w) else w


class BlockMaxIndex:
    """Posting lists of unit vectors, in blocks of ``BLOCK`` vectors with their largest weight.

    Vectors with the same leading terms stand together, so that few blocks have high maxima
    for a term. ``tables`` are plain arrays, to be sent to tasks."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.__dict__.update(tables)
        self.tables = tables

    @classmethod
    def build(cls, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> BlockMaxIndex:
        order = sorted(range(len(ids)), key=lambda i: ([int(t) for _, t in sorted(zip(-vectors[i][1], vectors[i][0], strict=True))], ids[i]))
        lengths = [len(vectors[i][0]) for i in order]
        place = np.repeat(np.arange(len(order)), lengths)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        blocks = -(-len(order) // BLOCK)
        by = np.lexsort((place, term))
        term, place, weight = term[by], place[by], weight[by]
        maxima = np.zeros((n_terms, max(blocks, 1)))
        np.maximum.at(maxima, (term, place // BLOCK), weight)
        cell = term * max(blocks, 1) + place // BLOCK  # postings of (term, block) are one stretch
        starts = np.searchsorted(cell, np.arange(n_terms * max(blocks, 1) + 1))
        return cls({"ids": np.array([ids[i] for i in order], np.int64), "labels": np.array([labels[i] for i in order], np.int8),
                    "maxima": maxima, "starts": starts, "place": place % BLOCK, "weight": weight, "n": np.array(len(order))})

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest vectors with a cosine above 0; ties to the
        smaller id. ``without``: an id that takes no part."""
        width = self.maxima.shape[1]
        bounds = weights @ self.maxima[terms] * (1 + 1e-12)
        order = np.argsort(-bounds, kind="stable")
        best_p, best_s, kth, at, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 4
        while at < width:
            blocks = order[at:at + step]
            blocks = blocks[(bounds[blocks] > 0) & (bounds[blocks] >= kth)]
            if not len(blocks):
                break
            places, scores = self._scores(terms, weights, blocks)
            if without is not None:
                other = self.ids[places] != without
                places, scores = places[other], scores[other]
            best_p, best_s = np.concatenate([best_p, places[scores >= kth]]), np.concatenate([best_s, scores[scores >= kth]])
            keep = np.lexsort((self.ids[best_p], -best_s))[:k]
            best_p, best_s = best_p[keep], best_s[keep]
            kth = best_s[-1] - 1e-12 if len(keep) == k else 0.0
            at, step = at + step, step * 4
        return best_p, best_s

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors in ``blocks`` that share a term with the query, and their cosines."""
        cells = (terms[:, None] * self.maxima.shape[1] + blocks).ravel()
        lo = self.starts[cells]
        size = self.starts[cells + 1] - lo
        postings = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        slot = np.repeat(np.tile(np.arange(len(blocks)) * BLOCK, len(terms)), size) + self.place[postings]
        scores = np.bincount(slot, np.repeat(np.repeat(weights, len(blocks)), size) * self.weight[postings], len(blocks) * BLOCK)
        slot = np.flatnonzero(scores)
        return blocks[slot // BLOCK] * BLOCK + slot % BLOCK, np.round(scores[slot], 12)


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps ``(from vote, probability)`` by pooling adjacent violators; each step
    counts one half of an example of either label on top."""
    order = np.argsort(votes, kind="stable")
    steps: list[list[float]] = []  # from, weighted positives, weight
    for v, y, w in zip(votes[order].tolist(), labels[order].tolist(), weights[order].tolist(), strict=True):
        if steps and steps[-1][0] == v:
            steps[-1][1] += w * y
            steps[-1][2] += w
        else:
            steps.append([v, w * y, w])
    out: list[list[float]] = []
    for step in steps:
        out.append(step)
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, y, w = out.pop()
            out[-1][1] += y
            out[-1][2] += w
    return np.array([s[0] for s in out]), np.array([(s[1] + 0.5) / (s[2] + 1) for s in out])


def score_toxicity(docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   k: int = 16, max_examples: int = 8192, max_terms: int = 1024, min_g2: float = 16.0,
                   min_lift: float = 3.0, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, evidence``, one row per row of ``docs``: the probability of label 1, whether
    it is ``threshold`` or more (0 or 1), and the ``k`` nearest examples as structs of id, cosine and label.

    ``learns`` is a condition on the id column alone, asked of ``labels``. Of the labels for
    which it holds, about ``max_examples`` of each value (chosen by a hash of the id; all,
    if there are fewer) are joined with their texts: the bounded sample of the classifier.
    Terms' frequencies are counted over all documents. Labels other than 0 and 1 are not
    read; of several labels of an id the largest counts, of several texts of an example the
    smallest. Null ids are never examples.

    A text that is null, empty or without any chosen term has no neighbour; its score is the rate
    of label 1 among such examples. Equal cosines go to the smaller id. Repeated rows are
    scored each. Without examples of both labels no term is chosen and the score is the
    rate of label 1 (one half without any example). An empty table gives no rows. Other
    columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    lab = (labels.where(F.col(label_col).isin(0, 1) & learns & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y")))
    n_labels = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, max_examples / max(n_labels.get(y, 0), 1)) for y in (0, 1)}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    # written, so that Spark knows its size (two longs for each of about 2 * max_examples ids) before it joins the texts
    lab = save(lab.where(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0])), "toxicity-labels")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    examples = save(texts.join(lab, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("doc_id", "y", "text"),
                    "toxicity-examples")
    terms = choose_terms(examples.select("text", "y"), max_terms, min_g2, min_lift)

    vectors = save(term_counts(texts, terms), "toxicity-vectors")
    n_docs = vectors.count()
    idf = np.full(len(terms), np.log(n_docs + 1.0) + 1)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():  # at most max_terms rows
        idf[r["t"]] = np.log((n_docs + 1.0) / (r["n"] + 1.0)) + 1
    sample = save(term_counts(examples, terms), "toxicity-sample")
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])  # about 2 * max_examples rows
    hits = [r for r in rows if r["terms"]]
    index = BlockMaxIndex.build([r["doc_id"] for r in hits], [r["y"] for r in hits], [unit_vector(r["terms"], r["counts"], idf) for r in hits], len(terms))
    sampled = Counter(r["y"] for r in rows)
    weight = np.array([n_labels.get(y, 0) / max(sampled[y], 1) for y in (0, 1)])  # labels that an example stands for
    sent = spark.sparkContext.broadcast((index.tables, idf, weight))  # bounded by max_examples and max_terms

    def ask(index: BlockMaxIndex, idf: np.ndarray, weight: np.ndarray, terms: list[int], counts: list[int], without: int | None):
        places, cosines = index.nearest(*unit_vector(terms, counts, idf), k, without) if terms else (np.zeros(0, np.int64), np.zeros(0))
        labels = index.labels[places]
        w = cosines * weight[labels]
        return float((w * labels).sum() / w.sum()) if len(w) else None, places, cosines

    def ask_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, idf, weight = sent.value
        index = BlockMaxIndex(tables)
        for batch in batches:
            ids, ys, terms, counts = (batch.column(c).to_pylist() for c in ("doc_id", "y", "terms", "counts"))
            votes = [ask(index, idf, weight, t, c, i)[0] for i, t, c in zip(ids, terms, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(ys, pa.int32())], names=["vote", "y"])

    asked = sample.mapInArrow(ask_examples, "vote double, y int").collect()  # a pair per example
    alone = [r["y"] for r in asked if r["vote"] is None]
    voted = [(r["vote"], r["y"]) for r in asked if r["vote"] is not None]
    none = float((sum(weight[y] * y for y in alone) + 0.5) / (sum(weight[y] for y in alone) + 1))
    v, y = np.array([x for x, _ in voted], np.float64), np.array([x for _, x in voted], np.int64)
    starts, rates = isotonic(v, y, weight[y]) if len(v) else (np.zeros(1), np.array([none]))

    def ask_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, idf, weight = sent.value
        index = BlockMaxIndex(tables)
        memo: dict = {}
        for batch in batches:
            scores, evidence = [], []
            for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                bounded(memo, VECTORS)
                key = (*t, -1, *c)
                if key not in memo:
                    vote, places, cosines = ask(index, idf, weight, t, c, None)
                    score = none if vote is None else float(rates[max(int(np.searchsorted(starts, vote, side="right")) - 1, 0)])
                    memo[key] = score, [{"doc_id": i, "cosine": s, "label": y} for i, s, y in zip(
                        index.ids[places].tolist(), cosines.tolist(), index.labels[places].tolist(), strict=True)]
                score, near = memo[key]
                scores.append(score)
                evidence.append(near)
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, kind)],
                                             names=["doc_id", "score", "evidence"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    out = vectors.mapInArrow(ask_documents, f"doc_id {kind}, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
