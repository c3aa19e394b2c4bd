import pytest
from pyspark.sql import functions as F

from cohortlake.functions.exprs import sentence
from cohortlake.operators import columns as C
from cohortlake.operators.index import rank_within, row_index


def test_category_codes_sorted_rank_null_minus_one(spark):
    df = spark.createDataFrame([("M",), ("F",), (None,)], "sex string")
    assert [r.sex for r in C.category_codes(df, ["sex"]).collect()] == [1, 0, -1]


def test_category_codes_of_several_types(spark):
    df = spark.createDataFrame([(0, "M", 10, 2.5), (1, "F", 9, None), (2, None, 10, -1.0), (3, "X", None, 2.5)],
                               "i int, sex string, n int, d double")
    out = C.category_codes(df, ["sex", "n", "d"]).orderBy("i").collect()
    assert [(r.sex, r.n, r.d) for r in out] == [(1, 1, 1), (0, 0, -1), (-1, 1, 0), (2, -1, 1)]


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "M"), (2, "F"), (3, None)], "id int, sex string")
    out = C.one_hot(df, ["sex"]).orderBy("id").collect()
    assert [(r.sex_F, r.sex_M) for r in out] == [(0, 1), (1, 0), (0, 0)]
    assert C.one_hot(df, ["sex"]).columns == ["id", "sex_F", "sex_M"]


def test_hours_to_codes(spark):
    df = spark.createDataFrame([(2400,), (0,), (1430,), (1445,)], "youthreport2_shq1 int")
    assert [r[0] for r in C.hours_to_codes(df).collect()] == [18, 19, 48, 1445]


def test_strict_drop_and_lenient_rename(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        C.drop_columns(df, ["a", "zz"])
    assert C.rename_columns(df, {"a": "x", "zz": "y"}).columns == ["x", "b"]


def test_weighted_sum_null_if_any_part_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "p double, q double")
    out = C.weighted_column_sum(df, "s", {"p": 1, "q": 3}).collect()
    assert [r.s for r in out] == [7.0, None]


def test_sentence(spark):
    df = spark.createDataFrame([(0.0, 17.0), (1.0, 16.578)], "sex double, age double")
    out = [r[0] for r in df.select(sentence(F.col("sex"), F.col("age"))).collect()]
    assert out == ["This subject is female and 17.0 years old",
                   "This subject is male and 16.58 years old"]


def test_row_index_matches_row_number(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5003)
    idx = row_index(df, ["k", "id"], partitions=7)
    got = sorted((r.k, r.id, r.row_index) for r in idx.collect())
    assert [g[2] for g in got] == list(range(5000))


def test_row_index_with_payload(spark):
    """More rows than the range sampler looks at, and columns beside the key."""
    df = spark.range(0, 200_000).select((F.col("id") * 7919 % 200_003).alias("k"), F.format_string("%050d", "id").alias("payload"))
    for n in (3, 8):
        idx = row_index(df, ["k"], partitions=n)
        assert idx.select("row_index").distinct().count() == 200_000
        rank = idx.join(df.select("k").distinct().select("k", F.row_number().over(__import__("pyspark").sql.Window.orderBy("k")).alias("r")), "k")
        assert rank.where("row_index + 1 <> r").count() == 0


def test_rank_within_group(spark):
    df = spark.range(0, 300).withColumn("g", F.col("id") % 3)
    out = rank_within(df, "g", ["id"], partitions=5).collect()
    for r in out:
        assert r.rank_in_group == r.id // 3


def test_feature_groups_keep_data_order(spark):
    cats = spark.createDataFrame([("a", "z"), ("c", None), ("q", None)], "demographics string, sleep string")
    out = C.feature_groups(cats, ["x", "c", "a", "z"], ["demographics", "sleep", "life"]).collect()
    assert sorted((r.category, r.feature, r.position) for r in out) == [
        ("demographics", "a", 2), ("demographics", "c", 1), ("sleep", "z", 3)]


def test_feature_group_tables(spark):
    cats = spark.createDataFrame([("a", "z"), ("c", None)], "demographics string, sleep string")
    data = spark.createDataFrame([(1, 2, 3, 4)], "x int, c int, a int, z int")
    t = C.feature_group_tables(data, cats, ["demographics", "sleep", "life"])
    assert t["demographics"].columns == ["c", "a"]
    assert t["sleep"].columns == ["z"] and t["life"].columns == []
