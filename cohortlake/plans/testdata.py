"""How the driver's tables stand in for the reference's inputs.

Each role is a Spark DataFrame derived from the given parquet tables and, next to
it, the same derivation as DuckDB SQL (used by the oracle). Nulls are injected by
fixed expressions because the given tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- visits: orders as a longitudinal panel --------------------------------
# subject = o_custkey, visit = o_orderkey, visit order (visit_date, visit).

def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("subject"),
        k.alias("visit"),
        F.col("o_orderdate").alias("visit_date"),
        ((F.year("o_orderdate") - 1980).cast("double")
         + (F.month("o_orderdate") - 1).cast("double") / 12.0).alias("visit_age"),
        F.when((k % 5).isin(0, 1), F.lit(None)).otherwise(F.col("o_totalprice")).alias("score"),
        F.when(k % 3 == 0, F.lit(None))
         .otherwise(F.floor(F.col("o_totalprice") / 100000.0)).alias("band"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


VISITS_SQL = """
SELECT o_custkey AS subject,
       o_orderkey AS visit,
       o_orderdate AS visit_date,
       CAST(year(o_orderdate) - 1980 AS DOUBLE) + CAST(month(o_orderdate) - 1 AS DOUBLE) / 12.0 AS visit_age,
       CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE o_totalprice END AS score,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 100000.0) AS BIGINT) END AS band,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority,
       o_orderstatus AS status,
       CAST(o_orderstatus = 'F' AS INTEGER) AS label
FROM orders
"""

VISIT_VALUE_COLUMNS = ["visit_age", "score", "band", "priority", "status", "label"]


# --- subjects: customers as a cross-sectional table --------------------------
# age in whole months (integer months keep band edges exact in both engines),
# label = market segment BUILDING.

def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("subject"),
        (F.lit(144) + (F.col("c_custkey") * 37) % 96).cast("double").alias("age_months"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_nationkey").alias("nationkey"),
    )


SUBJECTS_SQL = """
SELECT c_custkey AS subject,
       CAST(144 + (c_custkey * 37) % 96 AS DOUBLE) AS age_months,
       CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS label,
       c_acctbal AS acctbal,
       c_nationkey AS nationkey
FROM customer
"""


# --- training table: labelled documents -------------------------------------
# subject = doc_id, target = quality, features from the document row.

def training(spark: SparkSession, sf_dir: str, target: str = "quality") -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(doc, "doc_id", "inner").select(
        F.col("doc_id").alias("subject"),
        F.col(target).alias("target"),
        (F.col("doc_id") % 2).cast("double").alias("sex"),
        (F.lit(12.0) + (F.col("doc_id") % 60).cast("double") / 10.0).alias("age"),
        F.log(F.lit(1.0) + F.col("n_chars").cast("double")).alias("log_chars"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.col("toxic" if target == "quality" else "quality").cast("double").alias("other_label"),
    )


TRAINING_SQL = """
SELECT l.doc_id AS subject,
       l.quality AS target,
       CAST(l.doc_id % 2 AS DOUBLE) AS sex,
       12.0::DOUBLE + CAST(l.doc_id % 60 AS DOUBLE) / 10.0 AS age,
       ln(1 + CAST(d.n_chars AS DOUBLE)) AS log_chars,
       CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(l.toxic AS DOUBLE) AS other_label
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

TRAINING_FEATURES = ["sex", "age", "log_chars", "n_chars", "other_label"]


# --- predictions: a fixed logit per labelled document --------------------------
# Stand-in for the network's output: logit is a fixed function of the key.

def logit_expr(key):
    return ((F.col(key) % 11).cast("double") - 5.0) / 2.0 \
        + (F.col("log_chars") - 6.0) / 4.0


LOGIT_SQL = "(CAST(subject % 11 AS DOUBLE) - 5.0) / 2.0 + (log_chars - 6.0) / 4.0"
