import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """sf0.001 documents with hard rows: null and empty texts, a null id, repeated
    rows, one long text, and columns whose names operators use inside."""
    from pyspark.sql import functions as F
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(10**6 + 1, None, None, None), (10**6 + 2, "", "en", None), (None, "the null id of them", "en", "src1"),
            (10**6 + 3, " \t\n\n  \r", None, ""), (10**6 + 4, "The same. " * 4000, "en", "src0"),
            (10**6 + 5, "x" * 50_000, "en", "src0"), (10**6 + 6, "Twice the same row\nof two lines", "en", "src2"),
            (10**6 + 6, "Twice the same row\nof two lines", "en", "src2"), (10**6 + 7, "<|endoftext|> a  b\x00 | c\u00a0É. D", "fr", "src2"),
            (10**6 + 8, "12 345 !!", "de", "src2")]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    every = base.unionByName(extra, allowMissingColumns=True)
    return every.withColumns({c: F.lit("clash") for c in ("key", "n", "batch", "size", "fp", "score", "_h", "_id", "_hash", "_take", "rank", "word")}).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("1 = 0")
