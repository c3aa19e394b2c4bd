"""Language ID by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability
for every piece; the probability of a word is the sum over all ways to cut it into
pieces (forward algorithm), that of a text the product over its words. Piece
probabilities are learned by expectation maximisation: the words of each language
are counted once, then every round sums the expected piece counts of all distinct
words (forward-backward) in Spark. The model on the driver and in broadcasts is
bounded by languages times vocabulary.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import process_cache, save

MARK = "▁"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
UNKNOWN = 1e-7  # probability of a character that is no piece, and least one of a piece
LONG = 1_000      # characters of a word at once
CHUNK = 32      # longer words are cut, so that products stay in range: UNKNOWN ** CHUNK is a double
WORDS = 3_000      # words whose lattices are built together
MEMO = 200_000    # words that a worker remembers
UNDETERMINED = "und"


def load_pieces(path: str) -> list[str]:
    """Normal pieces of a sentencepiece model, in the order of their ids."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]


def letter_words(token: str) -> list[str]:
    """Runs of letters in a blank-separated token, lower case, in parts of ``LONG`` characters."""
    token = token.lower()
    inner = token.strip(PUNCTUATION)
    if inner.isalpha() and len(inner) <= LONG:
        return [inner]
    return [w[i:i + LONG] for w in re.findall(r"[^\W\d_]+", token) if any(map(str.isalpha, w)) for i in range(0, len(w), LONG)]


class Trie:
    """Pieces by their characters: a hash table from (node, character) to node."""

    BITS = 20
    PROBES = 8

    @classmethod
    def of(cls, tables: dict) -> Trie:
        """The trie whose ``vars`` are ``tables``. Broadcasts hold these, since an instance
        would be unpickled by the name of its module, which executors need not have."""
        out = cls.__new__(cls)
        vars(out).update(tables)
        return out

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        nodes, keys, targets = {"": 0}, [], []
        for piece in pieces:
            for j in range(1, len(piece) + 1):
                if piece[:j] not in nodes:
                    nodes[piece[:j]] = len(nodes)
                    keys.append(nodes[piece[:j - 1]] << 21 | ord(piece[j - 1]))
                    targets.append(nodes[piece[:j]])
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        for k, piece in enumerate(pieces):
            self.piece[nodes[piece]] = k
        bits, probes = self.BITS, 2 * self.PROBES
        while probes > self.PROBES:  # a larger table until every key is near its slot
            slots = np.full((1 << bits) + 4 * self.PROBES, -1, dtype=np.int64)
            probes = 0
            for key, at in zip(keys, self._slot(np.array(keys, dtype=np.int64), bits).tolist(), strict=True):
                first = at
                while slots[at] >= 0 and at - first <= self.PROBES:
                    at += 1
                slots[at] = key
                probes = max(probes, at - first + 1)
            bits += 1
        self.bits, self.probes, self.keys = bits - 1, probes, slots
        self.targets = np.zeros(len(slots), dtype=np.int64)
        of = dict(zip(keys, targets, strict=True))
        on = np.flatnonzero(slots >= 0)
        self.targets[on] = [of[k] for k in slots[on].tolist()]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node, -1 without one."""
        key = node << 21 | char
        slot, out = self._slot(key, self.bits), np.full(len(node), -1, dtype=np.int64)
        left = np.arange(len(node))
        for k in range(self.probes):
            there = self.keys[slot[left] + k]
            hit = there == key[left]
            out[left[hit]] = self.targets[slot[left[hit]] + k]
            left = left[~hit & (there >= 0)]
            if not len(left):
                break
        return out


class Lattice:
    """All pieces of many words: arrays of (word, begin, end, piece)."""

    def __init__(self, words: list[str], trie: Trie):
        chunks, owner = [], []
        for k, word in enumerate(words):
            marked = MARK + word
            for at in range(0, len(marked), CHUNK):
                chunks.append(marked[at:at + CHUNK])
                owner.append(k)
        self.owner = np.array(owner, dtype=np.int64)
        self.lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        char = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        word = np.repeat(np.arange(len(chunks)), self.lengths)
        stop = np.cumsum(self.lengths)
        first = (stop - self.lengths)[word]
        active, node, found = np.arange(len(char)), np.zeros(len(char), dtype=np.int64), []
        alone = np.ones(len(char), dtype=bool)  # characters that are no piece
        depth = 0
        while len(active):
            node = trie.step(node, char[active + depth])
            active, node = active[node >= 0], node[node >= 0]
            depth += 1
            piece = trie.piece[node]
            on = active[piece >= 0]
            found.append((word[on], on - first[on], on - first[on] + depth, piece[piece >= 0]))
            if depth == 1:
                alone[on] = False
            inside = active + depth < stop[word[active]]
            active, node = active[inside], node[inside]
        on = np.flatnonzero(alone)
        found.append((word[on], on - first[on], on - first[on] + 1, np.full(len(on), trie.unknown, dtype=np.int64)))
        self.word, self.begin, self.end, self.piece = (np.concatenate(x) for x in zip(*found, strict=True))

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Sums of the weights [edge, g] over all segmentations: [chunk, position, g]."""
        alpha = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, weight.shape[1]))
        alpha[:, 0] = 1
        self._sweep(alpha, weight, self.end, self.begin, range(1, alpha.shape[1]))
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        beta = np.zeros((len(self.lengths), int(self.lengths.max(initial=0)) + 1, weight.shape[1]))
        beta[np.arange(len(self.lengths)), self.lengths] = 1
        self._sweep(beta, weight, self.begin, self.end, range(beta.shape[1] - 2, -1, -1))
        return beta

    def _sweep(self, state: np.ndarray, weight: np.ndarray, to: np.ndarray, of: np.ndarray, positions: range) -> None:
        order = np.lexsort((self.word, to))
        bounds = np.searchsorted(to[order], np.arange(state.shape[1] + 1))
        for j in positions:
            at = order[bounds[j]:bounds[j + 1]]
            if len(at):
                word = self.word[at]
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                state[word[first], j] += np.add.reduceat(state[word, of[at]] * weight[at], first, axis=0)

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(len(self.lengths)), self.lengths]


def count_words(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``(lang, word, n)`` of all rows with a text and a label."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                for lang in pc.unique(part.column(1)).to_pylist():
                    texts = part.column(0).filter(pc.equal(part.column(1), lang))
                    tokens = pc.value_counts(pc.utf8_split_whitespace(texts).flatten())
                    words: Counter = Counter()
                    for token, n in zip(tokens.field("values").to_pylist(), tokens.field("counts").to_pylist(), strict=True):
                        for word in letter_words(token):
                            words[word] += n
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()),
                                                      pa.array(words.values(), pa.int64())], names=["lang", "word", "n"])
            pa.default_memory_pool().release_unused()

    x = docs.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    x = x.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return (x.mapInArrow(count, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def learn(docs: DataFrame, path: str, text_col: str = "text", label_col: str = "lang", rounds: int = 2,
          smooth: float = 200.0) -> dict:
    """A model from labelled rows: languages, log priors, pieces, and piece
    probabilities [piece, language] (the last row: unknown characters).

    A language's probabilities are its expected counts plus ``smooth`` counts spread
    as in all languages together; a share of them is spread evenly, ``UNKNOWN`` a
    piece, so that what a corpus lacks is bounded evidence however large it is.
    """
    pieces = load_pieces(path)
    trie, unknown = Trie(pieces), len(pieces)
    words = save(count_words(docs, text_col, label_col), "language-words")
    sizes = sorted((r["lang"], r["n"]) for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect())
    langs = [lang for lang, _ in sizes]
    theta = np.full((len(pieces) + 1, len(langs)), 1.0 / max(1, len(pieces)))
    theta[unknown] = UNKNOWN
    number = {lang: g for g, lang in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        shared = words.sparkSession.sparkContext.broadcast((vars(trie), theta, number))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables, prob, numbers = shared.value
            tree = Trie.of(tables)
            total = np.zeros(prob.shape)
            for batch in batches:
                for at in range(0, len(batch), WORDS):
                    part = batch.iloc[at:at + WORDS]
                    lattice = Lattice(part["word"].tolist(), tree)
                    lang = part["lang"].map(numbers).to_numpy()[lattice.owner]
                    n = part["n"].to_numpy(dtype=float)[lattice.owner]
                    weight = prob[lattice.piece, lang[lattice.word]][:, None]
                    alpha, beta = lattice.forward(weight), lattice.backward(weight)
                    share = (alpha[lattice.word, lattice.begin] * weight * beta[lattice.word, lattice.end] / lattice.totals(alpha)[lattice.word])[:, 0]
                    np.add.at(total, (lattice.piece, lang[lattice.word]), share * n[lattice.word])
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        counts = words.mapInPandas(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        expected = np.zeros(theta.shape)
        expected[counts["piece"], counts["lang"]] = counts["n"]
        expected = expected[:unknown]
        pool = (expected.sum(1) + 0.01) / (expected.sum() + 0.01 * unknown)
        theta[:unknown] = UNKNOWN + (1 - UNKNOWN * unknown) * (expected + smooth * pool[:, None]) / (expected.sum(0) + smooth)
        shared.unpersist()
    n = np.array([n for _, n in sizes], dtype=float)
    return {"langs": langs, "prior": np.log((n + 1) / (n + 1).sum()) if langs else n, "trie": trie, "theta": theta}


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its posterior probability) to every row.

    Only the text counts. A null text, one without a letter, or a model without
    languages: ``und`` with score 0. Ties go to the first language in order. Columns
    of these names are replaced; null ids and repeated rows pass through.
    """
    x = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model | {"trie": vars(model["trie"]), "id": uuid.uuid4().hex})
    place = x.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = m["langs"]
        memo = process_cache("languages")
        if memo.get("id") != m["id"]:  # words to rows of their log probabilities; a worker keeps those of one model
            memo.update(id=m["id"], words={}, table=np.zeros((MEMO, len(langs))), trie=Trie.of(m["trie"]))
        words, table, trie = memo["words"], memo["table"], memo["trie"]

        def learn_words(new: list[str]) -> None:
            for at in range(0, len(new), WORDS):
                part = new[at:at + WORDS]
                lattice = Lattice(part, trie)
                values = np.zeros((len(part), len(langs)))
                np.add.at(values, lattice.owner, np.log(lattice.totals(lattice.forward(m["theta"][lattice.piece]))))
                first = len(words)
                table[first:first + len(part)] = values
                words.update(zip(part, range(first, first + len(part)), strict=True))

        def token_sums(tokens: list[str]) -> np.ndarray:
            """Sums over the words of each token, and how many there are."""
            found = [letter_words(token) for token in tokens]
            flat, owner = [w for ws in found for w in ws], np.repeat(np.arange(len(tokens)), [len(ws) for ws in found])
            out = np.zeros((len(tokens), len(langs) + 1))
            for at in range(0, len(flat), MEMO // 2):
                some = flat[at:at + MEMO // 2]
                missing = set(some).difference(words)
                if len(words) + len(missing) > MEMO:
                    words.clear()
                    missing = set(some)
                learn_words(list(missing))
                np.add.at(out[:, :-1], owner[at:at + MEMO // 2], table[[words[w] for w in some]])
            out[:, -1] = np.bincount(owner, minlength=len(tokens))
            return out

        for batch in batches:
            names, scores = [], []
            for start in range(0, batch.num_rows, 1024):
                lists = pc.utf8_split_whitespace(pc.fill_null(batch.column(place).slice(start, 1024).cast(pa.string()), ""))
                size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                tokens = lists.flatten().dictionary_encode()
                index, sums = tokens.indices.to_numpy(zero_copy_only=False), token_sums(tokens.dictionary.to_pylist())
                ends = np.cumsum(size)
                for n, end in zip(size.tolist(), ends.tolist(), strict=True):
                    s = np.zeros(len(langs) + 1)
                    for at in range(end - n, end, 1 << 16):
                        s += sums[index[at:min(end, at + (1 << 16))]].sum(0)
                    if not langs or not s[-1]:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    log = s[:-1] + m["prior"]
                    best = int(log.argmax())
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(np.maximum(log - log[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields)
    return x.mapInArrow(judge, schema + ", lang_pred string, score double")


def identify(docs: DataFrame, path: str, learns: Column, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Learn from the rows where ``learns`` holds (and text and label are not null),
    then :func:`predict` every row."""
    return predict(docs, learn(docs.where(learns), path, text_col, label_col), text_col)
