"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary is encoded alone; those that give exactly
one token form the set of whole tokens. Texts are cut at blanks, which no token of
the word-level tokenizer spans, and words into pre-tokens; a pre-token in the set
counts 1 without merging. Only the rest goes through the library's merges. Words
with characters outside printable ASCII and the Latin-1 letters, or with ``<|``,
go to the library whole, which normalises them and finds special strings itself.
Counts of words are kept in a memo of bounded size per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, load_tokenizer, process_cache

#: Pre-token pattern of the word-level vocabulary (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
PLAIN = r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
WORD_END = "</w>"
MEMO = 400_000


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (plain, lower case) that encode alone as one token."""
    import regex
    tokenizer = load_tokenizer(path)
    plain, pre = regex.compile(PLAIN), regex.compile(PRE_TOKEN)
    strings = set()
    for token in tokenizer.get_vocab():
        if token.endswith(WORD_END):
            text = token[: -len(WORD_END)]
            # only characters that stand for themselves in the byte alphabet are tried as they are
            strings.add(text)
            try:
                strings.add(text.encode("latin-1").decode("utf-8"))
            except UnicodeError:
                pass
    strings = sorted(s for s in strings if plain.fullmatch(s) and s == s.lower() and "<|" not in s
                     and [m.group() for m in pre.finditer(s)] == [s])
    lengths = [len(e.ids) for e in tokenizer.encode_batch(strings, add_special_tokens=False)]
    return frozenset(s for s, n in zip(strings, lengths, strict=True) if n == 1)


def word_counter(path: str, whole: frozenset[str]):
    """A function from a list of distinct words (UTF-8) to their token counts."""
    import regex
    tokenizer = load_tokenizer(path)
    plain, pre = regex.compile(PLAIN).fullmatch, regex.compile(PRE_TOKEN).findall

    def count(words: list[bytes]) -> list[int]:
        out, rest, at = [0] * len(words), [], []
        merged, owner = [], []
        for i, word in enumerate(words):
            text = word.decode("utf-8")
            if "<|" in text or not plain(text):
                rest.append(text)
                at.append(i)
                continue
            n = 0
            for token in pre(text.lower()):
                if token in whole:
                    n += 1
                else:
                    merged.append(token)
                    owner.append(i)
            out[i] = n
        if merged:  # pre-tokens with blanks between them; the library numbers them
            lengths = np.bincount(tokenizer.encode(" ".join(merged), add_special_tokens=False).word_ids, minlength=len(merged))
            for i, n in zip(owner, lengths.tolist(), strict=True):
                out[i] += n
        for i, e in zip(at, tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            out[i] += len(e.ids)
        return out
    return count


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per row of ``docs``.

    No added special tokens, truncation or padding; special strings inside texts
    are found as the library does by default. A null text counts as empty: no
    bytes, no tokens. Null ids and repeated rows pass through.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = word_counter(path, whole.value)
        memo = process_cache(f"token-counts {path}")
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                bounded(memo, MEMO)
                if new := list(set(words).difference(memo)):
                    memo.update(zip(new, counter(new), strict=True))
                sizes.append(len(text or b""))
                counts.append(sum(map(memo.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = x.schema["doc_id"].dataType.simpleString()
    out = x.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
