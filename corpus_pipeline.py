"""The corpus pipeline: stages over documents, each by one operator of
``cohortlake.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import language_id, line_runs, mixture, packing, simhash
from cohortlake.llm.common import arrow_rows, fold, save, set_aside
from cohortlake.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (``und``), or whose best language has a posterior below one half, go.

    Null and empty texts have no letter and go; repeated rows are judged each; rows with a null
    id teach and are judged. An empty table stays empty. All columns keep their values,
    also those named like the operator's own. The result is written, with 1,024 texts at a
    time in Python's memory."""
    learns = F.coalesce(fold(F.col("doc_id"), 3) != 1, F.lit(True))
    rows, back = set_aside(docs, "lang_pred", "score")
    with arrow_rows(spark, 1024):
        found = language_id.identify(rows, tokenizer_path("piece_bpe_32k.model"), learns)
        kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= 0.5)).drop("lang_pred", "score")
        return save(kept.withColumnsRenamed(back).select(*docs.columns), "known-language")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents hold go; documents stay, if need be empty.

    A null text becomes empty; repeated rows stay. All other columns keep their values."""
    rows, back = set_aside(docs, "n_lines", "n_dropped")
    return line_runs.dedup_lines(rows, min_docs=10).drop("n_lines", "n_dropped").withColumnsRenamed(back).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints (3-word shingles) are within 2 bits, the one with the smallest id stays.

    Texts without words (null or empty) are near duplicates of each other."""
    return simhash.keep_one(docs, shingle_words=3, radius=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3: one row per document and pass that takes words of it.

    A null source is one of its own; documents without words take no part."""
    return mixture.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 1024 tokens; an empty text is its end token."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", known_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: Language models, fingerprints and token ids are not SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
