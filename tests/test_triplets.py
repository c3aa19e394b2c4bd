import hashlib
import random

from pyspark.sql import functions as F

from cohortlake.operators import triplets as TR


def _h(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:15], 16)


def _margin(d, m0, step):
    m = m0
    while not d < m:  # the reference's loop
        m += step
    return m


def brute(rows, m0, step, seed):
    out = {}
    classes = sorted({r[1] for r in rows})
    for s, y, a in rows:
        res = {}
        neg = [c for c in classes if c != y]
        for kind, cls in (("pos", y), ("neg", neg[0] if neg else None)):
            cands = [r for r in rows if r[1] == cls and r[0] != s]
            if not cands:
                res[kind] = (None, 0, None)
                continue
            d = min(abs(r[2] - a) for r in cands)
            m = _margin(d, m0, step)
            band = sorted((r for r in cands if a - m < r[2] < a + m), key=lambda r: (r[2], r[0]))
            pick = band[_h(s, seed, kind) % len(band)][0]
            res[kind] = (m, len(band), pick)
        out[s] = res
    return out


def test_margin_rule_examples(spark):
    df = spark.createDataFrame([(1.0,), (1.4,), (1.5,), (0.2,)], "d double")
    got = [r[0] for r in df.select(TR.final_margin(F.col("d"), 1.0, 0.5)).collect()]
    assert got == [1.5, 1.5, 2.0, 1.0]


def test_age_band_triplets_against_brute_force(spark):
    rnd = random.Random(11)
    for trial in range(3):
        n = 60 + 20 * trial
        rows = [(i, rnd.randint(0, 1), float(rnd.choice(range(140, 140 + 15 * (trial + 1), 1 + trial))))
                for i in range(n)]
        df = spark.createDataFrame(rows, "subject int, label int, age double")
        got = TR.age_band_triplets(df, m0=12.0, step=6.0, seed=5).collect()
        exp = brute(rows, 12.0, 6.0, 5)
        assert len(got) == n
        for r in got:
            e = exp[r.subject]
            assert (r.pos_margin, r.pos_band_size, r.positive) == e["pos"]
            assert (r.neg_margin, r.neg_band_size or 0, r.negative) == e["neg"]


def test_sparse_ages_need_wider_margins(spark):
    rows = [(0, 0, 100.0), (1, 0, 160.0), (2, 1, 130.0), (3, 1, 131.0), (4, 0, 161.0)]
    df = spark.createDataFrame(rows, "subject int, label int, age double")
    got = {r.subject: r for r in TR.age_band_triplets(df, m0=12.0, step=6.0, seed=1).collect()}
    exp = brute(rows, 12.0, 6.0, 1)
    for s, e in exp.items():
        assert (got[s].pos_margin, got[s].pos_band_size, got[s].positive) == e["pos"]
        assert (got[s].neg_margin, got[s].neg_band_size, got[s].negative) == e["neg"]


def test_single_member_class_gives_null(spark):
    df = spark.createDataFrame([(0, 0, 10.0), (1, 1, 12.0), (2, 1, 13.0)], "subject int, label int, age double")
    got = {r.subject: r for r in TR.age_band_triplets(df).collect()}
    assert got[0].positive is None and got[0].negative in (1, 2)


def test_candidates_in_band_counts(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 1), float(rnd.randint(100, 160))) for i in range(80)]
    df = spark.createDataFrame(rows, "subject int, label int, age double")
    got = {r.subject: (r.n_positive, r.n_negative) for r in TR.candidates_in_band(df, 6.0).collect()}
    for s, y, a in rows:
        pos = sum(1 for t in rows if t[1] == y and t[0] != s and abs(t[2] - a) < 6.0)
        neg = sum(1 for t in rows if t[1] != y and abs(t[2] - a) < 6.0)
        assert got[s] == (pos, neg)


def _brute_loop(rows, m0, step, seed):
    """The reference's literal loop on float ages (float comparisons)."""
    out = {}
    classes = sorted({r[1] for r in rows})
    for s, y, a in rows:
        res = {}
        neg = [c for c in classes if c != y]
        for kind, cls in (("pos", y), ("neg", neg[0])):
            cands = [r for r in rows if r[1] == cls and r[0] != s]
            m = m0
            band = [r for r in cands if r[2] > a - m and r[2] < a + m]
            while not band:
                m += step
                band = [r for r in cands if r[2] > a - m and r[2] < a + m]
            band.sort(key=lambda r: (r[2], r[0]))
            res[kind] = (m, len(band), band[_h(s, seed, kind) % len(band)][0])
        out[s] = res
    return out


def test_float_ages_follow_the_reference_loop(spark):
    rnd = random.Random(21)
    rows = [(i, rnd.randint(0, 1), round(rnd.uniform(12.0, 20.0), 2)) for i in range(120)]
    # ages exactly one or one and a half years apart stress the band edges
    rows += [(200, 0, 13.1), (201, 0, 14.1), (202, 1, 14.6), (203, 1, 16.1), (204, 0, 17.3)]
    df = spark.createDataFrame(rows, "subject int, label int, age double")
    got = {r.subject: r for r in TR.age_band_triplets(df, m0=1.0, step=0.5, seed=9).collect()}
    exp = _brute_loop(rows, 1.0, 0.5, 9)
    for s, e in exp.items():
        assert (got[s].pos_margin, got[s].pos_band_size, got[s].positive) == e["pos"], s
        assert (got[s].neg_margin, got[s].neg_band_size, got[s].negative) == e["neg"], s


def test_repeated_subject_is_never_its_own_positive(spark):
    rows = [(1, 0, 10.0), (1, 0, 10.0), (2, 0, 11.0), (3, 1, 10.0), (4, 1, 12.0)]
    got = TR.age_band_triplets(spark.createDataFrame(rows, "subject int, label int, age double")).collect()
    assert len(got) == 4 and all(r.positive != r.subject for r in got)


def test_many_float_ages_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.randint(0, 1), rnd.uniform(100, 400)) for i in range(400)]
    got = {r.subject: r for r in TR.age_band_triplets(spark.createDataFrame(rows, "subject int, label int, age double"),
                                                      m0=0.25, step=0.5, seed=2).collect()}
    for s, e in brute(rows, 0.25, 0.5, 2).items():
        assert (got[s].pos_margin, got[s].pos_band_size, got[s].positive) == e["pos"]
        assert (got[s].neg_margin, got[s].neg_band_size, got[s].negative) == e["neg"]


def test_target_transform(spark):
    trip = spark.createDataFrame([(1, 2, 3)], "subject int, positive int, negative int")
    feats = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "subject int, label int")
    r = TR.triplet_table(trip, feats, target_transform=lambda c: c * 10).first()
    assert (r.anchor_label, r.negative_label) == (0, 10)
