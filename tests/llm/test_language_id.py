import itertools

import numpy as np
from pyspark.sql import functions as F

from cohortlake.llm import language_id
from cohortlake.llm.common import fold
from cohortlake.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
PIECES = ["▁a", "b", "ab", "▁", "a", "bc", "▁ab"]


def total(word, theta):
    """Sum over all segmentations, one by one."""
    word, out = "▁" + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        p = 1.0
        for a, b in zip(at, at[1:]):
            piece = word[a:b]
            p *= theta[PIECES.index(piece)] if piece in PIECES else theta[-1] if len(piece) == 1 else 0
        out += p
    return out


def test_forward_and_backward_sum_all_segmentations():
    theta = np.random.default_rng(0).random((len(PIECES) + 1, 2))
    words = ["abc", "a", "bbabab", "zab"]
    lattice = language_id.Lattice(words, language_id.Trie(PIECES))
    weight = theta[lattice.piece]
    alpha, beta = lattice.forward(weight), lattice.backward(weight)
    want = [[total(w, theta[:, g]) for g in (0, 1)] for w in words]
    assert np.allclose(lattice.totals(alpha), want) and np.allclose(beta[:, 0], want)


def test_trie_finds_every_piece():
    pieces = language_id.load_pieces(PATH)
    trie, words = language_id.Trie(pieces), ["straßenbahn", "日本語の", "the", "é"]
    lattice = language_id.Lattice(words, trie)
    want = set()
    for k, w in enumerate("▁" + w for w in words):
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if w[i:j] in pieces:
                    want.add((k, i, j, pieces.index(w[i:j])))
    got = set(zip(lattice.word.tolist(), lattice.begin.tolist(), lattice.end.tolist(), lattice.piece.tolist()))
    assert {g for g in got if g[3] < len(pieces)} == want
    assert all(g[2] == g[1] + 1 for g in got - want)


def test_held_out_accuracy_and_odd_rows(docs, no_docs):
    d = docs.select("doc_id", "text", "lang", "score")
    learns = F.coalesce(fold(F.col("doc_id"), 3) != 1, F.lit(True))
    rows = language_id.identify(d, PATH, learns).withColumn("held", ~learns).collect()
    assert len(rows) == docs.count()
    base = [r for r in rows if r.doc_id is not None and r.doc_id < 10**6 and r.held]
    assert len(base) > 30 and np.mean([r.lang == r.lang_pred for r in base]) > 0.95
    odd = {r.doc_id: r for r in rows if r.doc_id and r.doc_id > 10**6}
    for k in (1, 2, 3, 8):
        assert (odd[10**6 + k].lang_pred, odd[10**6 + k].score) == ("und", 0.0)
    assert odd[10**6 + 4].lang_pred == "en" and 0 <= min(r.score for r in rows) <= max(r.score for r in rows) <= 1
    assert language_id.identify(no_docs, PATH, F.lit(True)).count() == 0
    none = language_id.identify(d, PATH, F.lit(False)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]


def test_small_memo(docs, monkeypatch):
    d = docs.select("doc_id", "text", "lang")
    model = language_id.learn(d, PATH, rounds=1)
    want = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in language_id.predict(d, model).collect())
    monkeypatch.setattr(language_id, "MEMO", 9000)
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in language_id.predict(d, model).collect()) == want


def log_total(word, model):
    """Log of the sum over all segmentations of each chunk, in logs throughout."""
    pieces, marked, out = {}, "▁" + word, np.zeros(len(model["langs"]))
    for k, piece in enumerate(language_id.load_pieces(PATH)):
        pieces[piece] = k
    theta = np.log(model["theta"])
    for start in range(0, len(marked), language_id.CHUNK):
        chunk = marked[start:start + language_id.CHUNK]
        alpha = np.full((len(chunk) + 1, len(model["langs"])), -np.inf)
        alpha[0] = 0
        for j in range(1, len(chunk) + 1):
            for i in range(j):
                k = pieces.get(chunk[i:j], len(pieces) if i == j - 1 else None)
                if k is not None:
                    alpha[j] = np.logaddexp(alpha[j], alpha[i] + theta[k])
        out += alpha[-1]
    return out


def test_run_of_an_unseen_script(spark, monkeypatch):
    """One long run of letters that training lacks, or that only another language has,
    leaves the evidence of the other words, however large the corpus."""
    han = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分"
    words = {"de": "und der die haus nicht", "en": "and the house not with", "zh": han}
    seen = [(lang, w, 50_000_000) for lang in ("de", "en") for w in words[lang].split()]
    english = " ".join(words["en"].split() * 40)
    texts = [(1, english + " " + han), (2, han), (3, " ".join(words["de"].split() * 40) + " " + han)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert len(han) == 32
    for also in ([], [("zh", w, 1000) for w in han]):
        monkeypatch.setattr(language_id, "count_words", lambda *_, also=also: spark.createDataFrame(seen + also, "lang string, word string, n long"))
        model = language_id.learn(docs, PATH)
        got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
        for k, text in texts:
            log = model["prior"] + sum(log_total(w, model) for w in text.split())
            assert np.isfinite(log).all() and got[k].lang_pred == model["langs"][int(log.argmax())]
            assert np.isclose(got[k].score, 1 / np.exp(log - log.max()).sum()) and 0 <= got[k].score <= 1
        assert (got[1].lang_pred, got[3].lang_pred) == ("en", "de")
        assert np.allclose(model["theta"][:-1].sum(0), 1)
