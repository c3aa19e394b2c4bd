from collections import Counter

from cohortlake.llm import token_count
from cohortlake.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
HARD = ["It's we'll DON'T 'S '' !!'s 12a3", "ÉCOLE é naïve ß ÿ Ÿ × ÷", "ﬁ İstanbul ΣΑΣ e\u0301a x\u3000y", "<|startoftext|>a<|endoftext|> <|endoftext|",
        "a\x1cb\x85c\x00d", "日本 語 한국 😀", "...,;:--- ___ [x](y)"]


def test_matches_the_library(spark, docs):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    every = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(2 * 10**6 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    want = Counter()
    for r in every.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 50] += 1
    got = token_count.count_tokens(every, PATH, limit=50).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_whole_tokens_are_single():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    whole = sorted(token_count.whole_tokens(PATH))
    assert len(whole) > 20_000 and "the" in whole
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in whole[::50])


def test_memo_limit_and_empty(docs, no_docs, monkeypatch):
    want = sorted(token_count.count_tokens(docs, PATH).select("n_tokens").collect())
    monkeypatch.setattr(token_count, "MEMO", 10)
    assert sorted(token_count.count_tokens(docs, PATH).select("n_tokens").collect()) == want
    assert token_count.count_tokens(no_docs, PATH).count() == 0
