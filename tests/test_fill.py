from pyspark.sql import functions as F

from cohortlake.operators import fill
from cohortlake.plans import testdata as td


def _rows(df, col):
    return [r[col] for r in df.orderBy("s", "t").collect()]


def test_fill_next_then_previous(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, None), (1, 4, 7.0), (1, 5, None)],
                               "s int, t int, x double")
    out = fill.fill_nearest_visit(df, "s", ["t"], ["x"])
    assert _rows(out, "x") == [5.0, 5.0, 7.0, 7.0, 7.0]
    assert _rows(fill.backfill(df, "s", ["t"], ["x"]), "x") == [5.0, 5.0, 7.0, 7.0, None]
    assert _rows(fill.forward_fill(df, "s", ["t"], ["x"]), "x") == [None, 5.0, 5.0, 7.0, 7.0]


def test_all_null_group_stays_null_and_strings_fill(spark):
    df = spark.createDataFrame([(1, 1, None, "a"), (1, 2, None, None), (2, 1, None, None)],
                               "s int, t int, x double, c string")
    out = fill.fill_nearest_visit(df, "s", ["t"], ["x", "c"]).orderBy("s", "t").collect()
    assert [r.x for r in out] == [None, None, None]
    assert [r.c for r in out] == ["a", "a", None]


def test_hot_subject_chunks_equal_plain_window(spark):
    v = td.visits(spark, "/root/testdata/sf0.001")
    cols = ["score", "band", "priority"]
    for d in ("both", "backward", "forward"):
        a = fill.fill_nearest_visit(v, "subject", ["visit_date", "visit"], cols, direction=d,
                                    partitions=1)
        b = fill.fill_nearest_visit(v, "subject", ["visit_date", "visit"], cols, direction=d,
                                    partitions=13)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_one_subject_holding_most_rows(spark):
    # one subject with 300 rows and scattered gaps, the chunked path against the plain one
    rows = [(0 if i % 10 else i, i, None if i % 3 else float(i)) for i in range(330)]
    df = spark.createDataFrame(rows, "s int, t int, x double")
    a = fill.fill_nearest_visit(df, "s", ["t"], ["x"], partitions=1)
    b = fill.fill_nearest_visit(df, "s", ["t"], ["x"], partitions=9)
    assert a.exceptAll(b).count() == 0


def test_global_mode_ties_go_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    out = fill.global_mode_fill(df, ["c"]).collect()
    assert out[-1].c == "a"


def test_global_mean_half_even(spark):
    df = spark.createDataFrame([(2.0, 3.0), (3.0, 4.0), (None, None)], "x double, y double")
    out = fill.global_mean_fill(df).collect()
    assert out[-1].x == 2.0 and out[-1].y == 4.0


def test_null_check(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, 1.0)], "s int, x double")
    got = {r.s: r.x_has_null for r in fill.null_check(df, "s", ["x"]).collect()}
    assert got == {1: True, 2: False}


def test_one_long_subject_with_string_visits_is_linear(spark):
    import time
    df = spark.range(200_000).select(F.lit("s").alias("subject"), F.format_string("v%08d", "id").alias("visit"),
                                     F.when(F.col("id") % 1000 == 7, F.col("id")).alias("x"))
    t = time.time()
    out = fill.fill_nearest_visit(df, "subject", ["visit"], ["x"], partitions=8)
    want = F.floor((F.substring("visit", 2, 8).cast("long") - 8) / 1000 + 1) * 1000 + 7
    wrong = out.where(F.col("x") != F.least(want, F.lit(199_007))).count()
    assert wrong == 0 and out.where("x IS NULL").count() == 0
    assert time.time() - t < 20


def test_null_keys_and_ties_of_parts(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, None), (None, 3, None), ("a", 1, None), ("a", 2, 5.0)], "s string, t int, x double")
    for n in (1, 4):
        got = sorted((str(r.s), r.t, r.x) for r in fill.fill_nearest_visit(df, "s", ["t"], ["x"], partitions=n).collect())
        assert got == [("None", 1, 2.0), ("None", 2, 2.0), ("None", 3, 2.0), ("a", 1, 5.0), ("a", 2, 5.0)]


def test_third_of_rows_in_one_subject(spark):
    # every third visit re-assigned to subject 0: one key holds a third of the table
    v = td.visits(spark, "/root/testdata/sf0.01")
    v = v.withColumn("subject", F.when(F.col("visit") % 3 == 0, F.lit(0)).otherwise(F.col("subject")))
    cols = ["score", "band", "priority"]
    a = fill.fill_nearest_visit(v, "subject", ["visit_date", "visit"], cols, partitions=1)
    b = fill.fill_nearest_visit(v, "subject", ["visit_date", "visit"], cols, partitions=8)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_global_fill_equals_mode_then_mean(spark):
    v = td.visits(spark, "/root/testdata/sf0.01").select("subject", "visit", "score", "band", "priority")
    a = fill.global_mean_fill(fill.global_mode_fill(v, ["priority", "band"]), exclude=["subject", "visit"])
    b = fill.global_fill(v, ["priority", "band"], exclude=["subject", "visit"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fill_matches_python_on_random_groups(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for s in range(30):
        for t in range(rnd.randint(1, 9)):
            rows.append((s, t, None if rnd.random() < 0.5 else float(rnd.randint(0, 9))))
    df = spark.createDataFrame(rows, "s int, t int, x double")
    got = {(r.s, r.t): r.x for r in fill.fill_nearest_visit(df, "s", ["t"], ["x"]).collect()}
    for s in range(30):
        xs = [r[2] for r in rows if r[0] == s]
        for i, x in enumerate(xs):
            nxt = next((y for y in xs[i:] if y is not None), None)
            prv = next((y for y in reversed(xs[:i + 1]) if y is not None), None)
            assert got[(s, i)] == (nxt if nxt is not None else prv)


def test_parts_follow_the_order_and_hold_their_share(spark, monkeypatch):
    """Many bounds (searched in an array) and few (a tree) number rows alike; nulls come first."""
    from cohortlake.operators import index
    df = spark.range(5000).select(F.when(F.col("id") % 9 != 0, F.col("id") % 3).alias("g"), F.format_string("k%05d", "id").alias("k"),
                                  F.timestamp_micros(F.col("id") * 1234567).alias("t"), (F.col("id") / 7).alias("x"))
    for tree in (0, 1000):
        monkeypatch.setattr(index, "TREE", tree)
        rows, spanning = index.range_parts(df, ["g", "x", "k", "t"], 100, 1)
        got = [r._part for r in sorted(rows.collect(), key=lambda r: (r.g is not None, r.g or 0, r.x, r.k))]
        assert got == sorted(got) and len(set(got)) > 80 and max(got.count(p) for p in set(got)) < 5 * 50
        assert spanning.count() == 5000  # each of the four groups spans parts
    lone, few = index.range_parts(df, ["k"], 100, 1)
    assert few.count() <= 99 and lone.count() == 5000


def test_row_index_and_rank_over_many_parts(spark):
    from cohortlake.operators import index
    df = spark.range(999).select(F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 999).alias("k"))
    for n in (1, 7):
        found = sorted((r.k, r.row_index) for r in index.row_index(df, ["k"], partitions=n).collect())
        assert found == [(i, i) for i in range(999)]
        ranks = index.rank_within(df, "g", ["k"], partitions=n).collect()
        for g in (None, 0, 1):
            inside = sorted((r.k, r.rank_in_group) for r in ranks if r.g == g)
            assert [k for _, k in inside] == list(range(len(inside))) and len(inside) > 190
