from collections import Counter

from cohortlake.llm import line_runs


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def expected(rows, min_docs):
    held = {}
    for r in rows:
        for k in {key(x) for x in (r.text or "").split("\n")}:
            held.setdefault(k, set()).add(r.doc_id)
    gone = {k for k, ids in held.items() if k and len(ids) >= min_docs}
    out = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out[r.doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def test_matches_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    for min_docs, n_batches, fanout in ((2, 3, 2), (3, 1, 2), (2, 5, 3), (10, 4, 2)):
        got = line_runs.dedup_lines(docs, min_docs=min_docs, n_batches=n_batches, fanout=fanout)
        assert got.columns == docs.columns + ["n_lines", "n_dropped"]
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == expected(rows, min_docs)


def test_hot_line_and_empty_table(spark, no_docs):
    d = spark.range(300).selectExpr("id AS doc_id", "concat(' Shared LINE', char(13), char(10), 'own ', id, char(10), char(10), 'Shared line') AS text")
    got = line_runs.dedup_lines(d, min_docs=10).collect()
    assert {(r.n_lines, r.n_dropped, r.text) for r in got} == {(4, 2, f"own {i}\n") for i in range(300)}
    assert line_runs.dedup_lines(no_docs).count() == 0
