import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cohortlake.llm import queries

SF = "/root/testdata/sf0.001"
DOCUMENT_QUERIES = {"op1", "op4", "op5", "op7", "op8", "op9", "op11", "op12", "op13"}


def test_registered():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(queries.QUERIES) | {"pipeline"} <= set(qs) and len(queries.QUERIES) == 13
    assert set(queries.ORACLES) <= set(sql)
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_on_the_whole_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    source = "embeddings" if name.split("_")[0] in ("op3", "op10") else "pages" if name.startswith("op2_") else "documents"
    n = queries.table(spark, SF, source).count()
    if name.split("_")[0] in DOCUMENT_QUERIES or name.startswith(("op2_", "op10_")):
        assert out.count() == n
    else:
        assert out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(res.fetchall(), key=str) == sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_stages_against_their_operators(spark, docs):
    """Each stage returns the columns of documents and does what its operator finds."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    a = stage[names[0]](spark, docs, SF)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in a.collect()}
    assert gone == {10**6 + 1, 10**6 + 2, 10**6 + 3, 10**6 + 8}  # no letter
    b = stage[names[1]](spark, a, SF)
    assert b.count() == a.count() and b.columns == docs.columns
    c = stage[names[2]](spark, b, SF)
    ids = [r.doc_id for r in c.collect()]
    assert len(ids) == len(set(ids)) and 10**6 + 6 in ids
    d = stage[names[3]](spark, c, SF)
    assert d.columns == docs.columns and d.count() > 0
    e = stage[names[4]](spark, d, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(e.columns) and e.count() >= d.count()


def test_language_stage_takes_few_texts_at_once(spark, monkeypatch):
    """Batches of 1,024 rows at most, so that their texts do not fill an executor's memory."""
    import pyarrow as pa

    def judge(batches):
        for b in batches:
            few = pa.array([1.0 if b.num_rows <= 1024 else 0.0] * b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(["en"] * b.num_rows), few], names=[*b.schema.names, "lang_pred", "score"])

    monkeypatch.setattr(corpus_pipeline.language_id, "identify",
                        lambda docs, *_: docs.mapInArrow(judge, "doc_id long, text string, lang_pred string, score double"))
    docs = spark.range(5000).coalesce(1).selectExpr("id AS doc_id", "repeat('a ', 10) AS text")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    assert corpus_pipeline.known_language(spark, docs, SF).count() == 5000  # rows of large batches would be below one half
    assert spark.conf.get(name) == before


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_entry_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('cohortlake.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
qs = e.queries()
assert len(qs) > 50 and not any(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in qs) and set(e.oracle_sql()) <= set(qs)
"""
    top = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, timeout=120)


def test_row_keeping_stages_leave_extra_columns(spark, docs):
    """Also columns named like those the operators add keep their values, by row."""
    names = ("lang_pred", "score", "N_lines", "n_dropped", "_kept_score", "fingerprint", "component_id", "text_hash")
    own = docs.drop("score").withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names})
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, own, SF)
        assert out.dtypes == own.dtypes
        extra = [c for c in own.columns if c != "text"]
        assert Counter(map(tuple, out.select(*extra).collect())) <= Counter(map(tuple, own.select(*extra).collect()))


def test_executors_need_no_copy_of_the_package(tmp_path):
    """All queries and the pipeline from a folder where workers cannot import the package."""
    script = tmp_path / "far.py"
    script.write_text(f"""
import sys
root = {os.path.dirname(os.path.abspath(corpus_pipeline.__file__))!r}
sys.path.insert(0, root)
import __spark_entry__ as entry
from cohortlake.session import build_session
from cohortlake.llm import queries
spark = build_session("local[8]", 4, extra={{"spark.driver.memory": "4g"}})
def probe(batches):
    for b in batches:
        try:
            import cohortlake
            yield b.assign(found=1)
        except ImportError:
            yield b.assign(found=0)
assert spark.range(1).mapInPandas(probe, "id long, found int").first()["found"] == 0
for name in [*queries.QUERIES, "pipeline"]:
    assert entry.queries()[name](spark, {SF!r}).count() > 0, name
print("all ran")
""")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    tokenizers = os.path.dirname(os.path.dirname(os.path.abspath(__import__("public_tokenizers").__file__)))
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=900,
                         env=env | {"PYTHONPATH": tokenizers} if tokenizers not in sys.prefix else env)
    assert "all ran" in out.stdout, out.stderr[-3000:]
