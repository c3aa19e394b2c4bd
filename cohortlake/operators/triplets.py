"""Triplet mining: same-label positive and other-label negative near the anchor's age.

The reference grows a margin around the anchor's age (start ``m0``, step
``step``) until a candidate exists, then draws one candidate uniformly. The final
margin only depends on the distance ``d`` to the nearest candidate:
``m = m0`` if ``d < m0`` else ``m0 + step * (floor((d - m0) / step) + 1)``.

No anchor-candidate pairs are built. Work splits in two:

* age level -- a table of distinct ``(label, age)`` with counts. Nearest
  distances and the rank intervals of band edges come from as-of lookups: probes
  in one table with the class ages, dealt over range parts of (class, age), so
  that no task holds a class, whatever the resolution of the ages.
* subject level -- every anchor draws a rank inside its interval
  (``lo + md5(anchor|seed) mod size``, skipping its own rank in its own class)
  and an equi-join on ``(label, rank)`` fetches the subject. Ranks come from a
  global index, not from a window per class.

A class with no other subject gives NULL (the reference would loop forever).
Ages should be exact in the unit used (e.g. whole months with ``m0=12, step=6``)
so that band edges compare the same way in every engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_int
from ..session import write_shared
from .fill import nearest_values
from .index import rank_within, running


def final_margin(d, m0: float, step: float):
    return (F.when(d.isNull(), F.lit(None))
            .when(d < F.lit(m0), F.lit(float(m0)))
            .otherwise(F.lit(float(m0)) + F.lit(float(step))
                       * (F.floor((d - F.lit(float(m0))) / F.lit(float(step))) + 1)))


def _other_class(df: DataFrame, label: str):
    """Negative class of each label, as a column: the smallest other class (binary
    labels: the other one). The two smallest classes are a scalar subquery."""
    two = df.agg(F.slice(F.sort_array(F.collect_set(label)), 1, 2)).scalar()
    lo, hi = F.get(two, 0), F.get(two, 1)
    return lambda c: F.when(c == lo, hi).otherwise(lo)


def _age_table(df: DataFrame, label: str, age: str) -> DataFrame:
    """Distinct (label, age) with counts and ``cum_end``, the class members up to that age.

    Cumulated inside range parts of (label, age), then across the parts of a class."""
    d = df.groupBy(label, age).agg(F.count(F.lit(1)).alias("cnt"))
    # counted and cumulated once: probes, bounds of parts and joins all read the small written table
    return write_shared(running(d, [label], [age], F.col("cnt"), "cum_end"), "age-table")


def _asof(d: DataFrame, probes: DataFrame, label: str, age: str, sides: str) -> DataFrame:
    """Nearest class ages of each probe ``(cls, value, kind, name, o_label, o_age)``:
    ``prev`` and ``n_le`` (age and count of members) at or before it, ``next`` at or after
    it; kind -1 stands before, 1 after the members of its own age."""
    kinds = d.schema[label].dataType
    pts = d.select(F.col(label).alias("cls"), F.col(age).cast("double").alias("value"), F.lit(0).alias("kind"),
                   F.lit(None).cast("string").alias("name"), F.lit(None).cast(kinds).alias("o_label"),
                   F.lit(None).cast("double").alias("o_age"), F.col(age).cast("double").alias("pt"), F.col("cum_end"))
    u = pts.unionByName(probes.withColumns({"pt": F.lit(None).cast("double"), "cum_end": F.lit(None).cast("bigint")}))
    out = nearest_values(u, ["cls"], ["value", "kind", "name", "o_label", "o_age"], ["pt", "cum_end"], sides)
    found = {"p": [F.col("_p0").alias("prev"), F.coalesce("_p1", F.lit(0)).alias("n_le")], "n": [F.col("_n0").alias("next")]}
    return out.where(F.col("name").isNotNull()).select("o_label", "o_age", "name", "value", *[c for s in sides for c in found[s]])


def _nearest(d: DataFrame, label: str, age: str, other) -> DataFrame:
    """Per (label, age): distance to the nearest OTHER subject of the same class
    (0 when the age is shared) and to the nearest subject of the negative class."""
    a = F.col(age).cast("double")
    d = d.withColumn("neg_label", other(F.col(label)))
    probes = _probes(d, [(F.col(label), a, F.lit(-1), "own_prev"), (F.col(label), a, F.lit(1), "own_next"),
                         (F.col("neg_label"), a, F.lit(1), "neg_prev"), (F.col("neg_label"), a, F.lit(-1), "neg_next")], label, a)
    near = _asof(d, probes, label, age, "pn")

    def gap(kind):  # probes before (after) their own age look back (ahead)
        return F.min(F.when(F.col("name") == f"{kind}_prev", F.col("value") - F.col("prev"))
                     .when(F.col("name") == f"{kind}_next", F.col("next") - F.col("value"))).alias(f"d_{kind}")
    near = near.groupBy("o_label", "o_age").agg(gap("own"), gap("neg"))
    out = d.join(near, (d[label] == near["o_label"]) & (a == near["o_age"]), "left").drop("o_label", "o_age")
    return out.withColumn("d_pos", F.when(F.col("cnt") > 1, F.lit(0.0)).otherwise(F.col("d_own"))).drop("d_own")


def _probes(d: DataFrame, specs, label: str, a) -> DataFrame:
    """All probe rows ``(cls, value, kind, name, o_label, o_age)`` from ONE pass
    over the age table (explode of an array of structs, no union of copies)."""
    arr = F.array(*[F.struct(cls.cast(d.schema[label].dataType).alias("cls"),
                             value.cast("double").alias("value"), kind.cast("int").alias("kind"),
                             F.lit(name).alias("name")) for cls, value, kind, name in specs])
    return (d.select(F.col(label).alias("o_label"), a.alias("o_age"), F.explode(arr).alias("p"))
            .select("p.cls", "p.value", "p.kind", "p.name", "o_label", "o_age")
            .where(F.col("value").isNotNull() & F.col("cls").isNotNull()))


def band_intervals(ages: DataFrame, label: str = "label", age: str = "age",
                   m0: float = 12.0, step: float = 6.0) -> DataFrame:
    """Age-level table: per (label, age) the final margins and the rank intervals
    ``[lo, lo+size)`` of the positive and negative bands (self not removed).

    The band is counted with the reference's own comparisons
    (``age > a - m`` and ``age < a + m``). With inexact (float) ages the margin
    from the nearest distance can sit one rounding error short of a non-empty
    band, so the band is also counted at ``m + step`` and the first non-empty
    one is kept -- what the reference's loop would do.
    """
    d = write_shared(_nearest(_age_table(ages, label, age), label, age, _other_class(ages, label)), "ages")
    d = d.withColumns({"_pm": final_margin(F.col("d_pos"), m0, step),
                       "_nm": final_margin(F.col("d_neg"), m0, step)})
    a = F.col(age).cast("double")
    lt = F.lit(-1)
    le = F.lit(1)
    stp = F.lit(float(step))

    specs = []
    for tag, cls, m in (("pos", F.col(label), F.col("_pm")), ("neg", F.col("neg_label"), F.col("_nm"))):
        for suffix, mm in (("0", m - stp), ("", m), ("2", m + stp)):
            specs += [(cls, a - mm, le, f"{tag}_lo{suffix}"), (cls, a + mm, lt, f"{tag}_hi{suffix}")]
    probes = _probes(d, specs, label, a)
    names = [f"{t}_{e}{x}" for t in ("pos", "neg") for x in ("0", "", "2") for e in ("lo", "hi")]
    found = (_asof(d, probes, label, age, "p")
             .groupBy("o_label", "o_age").pivot("name", names).agg(F.first("n_le")))
    out = (d.withColumn("o_label", F.col(label)).withColumn("o_age", a)
           .join(found, ["o_label", "o_age"], "left"))
    # The smallest non-empty band among m - step (only when m - step >= m0), m and
    # m + step. The positive band always holds the anchor's own age, so
    # "non-empty" means more than one member there.
    cols = []
    for tag, m, need in (("pos", F.col("_pm"), 1), ("neg", F.col("_nm"), 0)):
        size = {x: F.col(f"{tag}_hi{x}") - F.col(f"{tag}_lo{x}") for x in ("0", "", "2")}
        use0 = (m - stp >= F.lit(float(m0))) & (size["0"] > need)
        use1 = size[""] > need
        cols += [
            F.when(m.isNull(), m).when(use0, m - stp).when(use1, m).otherwise(m + stp).alias(f"{tag}_margin"),
            F.when(use0, F.col(f"{tag}_lo0")).when(use1, F.col(f"{tag}_lo"))
             .otherwise(F.col(f"{tag}_lo2")).alias(f"{tag}_lo"),
            F.when(use0, size["0"]).when(use1, size[""]).otherwise(size["2"]).alias(f"{tag}_size")]
    return out.select(label, age, "neg_label", *cols)


def _ranked(ages: DataFrame, key: str, label: str, age: str) -> DataFrame:
    return rank_within(ages.select(key, label, age), label, [F.col(age), F.col(key)], "rank")


def age_band_triplets(ages: DataFrame, key: str = "subject", label: str = "label",
                      age: str = "age", m0: float = 12.0, step: float = 6.0,
                      seed: int = 5) -> DataFrame:
    """Per anchor: positive and negative subject, margins and band sizes.

    One row per subject: of a subject's rows the one with the smallest (label, age)
    counts, so that a positive is never the anchor itself."""
    one = ages.groupBy(key).agg(F.min(F.struct(label, age)).alias("_r"))
    ages = write_shared(one.select(key, F.col("_r")[label].alias(label), F.col("_r")[age].alias(age)), "anchors")
    ranked = _ranked(ages, key, label, age)
    bands = band_intervals(ages, label, age, m0, step)
    a = ranked.join(bands, [label, age], "inner")
    pos_size = F.col("pos_size") - 1  # the anchor itself is always inside its own band
    pos_k = hash_int(F.col(key), F.lit(seed), F.lit("pos")) % pos_size
    pos_rank = F.col("pos_lo") + pos_k
    pos_rank = F.when(pos_rank >= F.col("rank"), pos_rank + 1).otherwise(pos_rank)
    neg_k = hash_int(F.col(key), F.lit(seed), F.lit("neg")) % F.col("neg_size")
    a = a.select(key, label, age, "neg_label", "pos_margin", "neg_margin",
                 pos_size.alias("pos_band_size"), F.col("neg_size").alias("neg_band_size"),
                 F.when(pos_size > 0, pos_rank).alias("_prank"),
                 F.when(F.col("neg_size") > 0, F.col("neg_lo") + neg_k).alias("_nrank"))
    cand = ranked.select(F.col(label).alias("_cl"), F.col("rank").alias("_cr"),
                         F.col(key).alias("_ck"))
    p = cand.withColumnRenamed("_ck", "positive")
    n = cand.withColumnRenamed("_ck", "negative")
    out = (a.join(p, (F.col(label) == p._cl) & (F.col("_prank") == p._cr), "left")
           .drop("_cl", "_cr")
           .join(n, (F.col("neg_label") == n._cl) & (F.col("_nrank") == n._cr), "left")
           .drop("_cl", "_cr", "_prank", "_nrank"))
    return out


def candidates_in_band(ages: DataFrame, margin: float, key: str = "subject",
                       label: str = "label", age: str = "age") -> DataFrame:
    """Per anchor, the number of same-label others and other-label subjects with
    ``|age - anchor age| < margin`` (counts from the age table; no pairs)."""
    d = _age_table(ages, label, age)
    a = F.col(age).cast("double")
    m = F.lit(float(margin))

    negc = _other_class(ages, label)(F.col(label))
    probes = _probes(d, [(F.col(label), a - m, F.lit(1), "pos_lo"), (F.col(label), a + m, F.lit(-1), "pos_hi"),
                         (negc, a - m, F.lit(1), "neg_lo"), (negc, a + m, F.lit(-1), "neg_hi")], label, a)
    found = (_asof(d, probes, label, age, "p")
             .groupBy("o_label", "o_age").pivot("name", ["pos_lo", "pos_hi", "neg_lo", "neg_hi"])
             .agg(F.first("n_le")))
    per_age = found.select(F.col("o_label").alias(label), F.col("o_age").alias("_age"),
                           (F.col("pos_hi") - F.col("pos_lo") - 1).alias("n_positive"),
                           F.coalesce(F.col("neg_hi") - F.col("neg_lo"), F.lit(0)).alias("n_negative"))
    return (ages.select(key, label, age).withColumn("_age", a)
            .join(per_age, [label, "_age"], "left").drop("_age"))


def random_triplets(ages: DataFrame, key: str = "subject", label: str = "label",
                    seed: int = 5) -> DataFrame:
    """Baseline: uniform positive of the same label (may be the anchor itself) and
    uniform negative of the other label, by seeded rank draws."""
    ranked = rank_within(ages.select(key, label), label, [F.col(key)], "rank")
    sizes = ranked.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    a = (ranked.withColumn("neg_label", _other_class(ages, label)(F.col(label)))
         .join(sizes, label)
         .join(sizes.withColumnRenamed(label, "neg_label").withColumnRenamed("_n", "_nn"), "neg_label", "left"))
    a = a.select(key, label, "neg_label",
                 (hash_int(F.col(key), F.lit(seed), F.lit("rpos")) % F.col("_n")).alias("_pr"),
                 (hash_int(F.col(key), F.lit(seed), F.lit("rneg")) % F.col("_nn")).alias("_nr"))
    cand = ranked.select(F.col(label).alias("_cl"), F.col("rank").alias("_cr"), F.col(key).alias("_ck"))
    p = cand.withColumnRenamed("_ck", "positive")
    n = cand.withColumnRenamed("_ck", "negative")
    return (a.join(p, (F.col(label) == p._cl) & (F.col("_pr") == p._cr), "left").drop("_cl", "_cr")
            .join(n, (F.col("neg_label") == n._cl) & (F.col("_nr") == n._cr), "left")
            .drop("_cl", "_cr", "_pr", "_nr"))


def triplet_table(triplets: DataFrame, features: DataFrame, key: str = "subject",
                  anchor: str = "subject", positive: str = "positive",
                  negative: str = "negative", label: str = "label",
                  target_transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """Attach features (and label) of anchor, positive and negative: three key joins.

    ``target_transform`` maps the ``label`` column of the features."""
    if target_transform is not None and label in features.columns:
        features = features.withColumn(label, target_transform(F.col(label)))
    feats = [c for c in features.columns if c != key]

    def side(prefix, col):
        f = features.select(F.col(key).alias(col), *[F.col(c).alias(f"{prefix}_{c}") for c in feats])
        return f
    base = triplets.select(F.col(anchor).alias("anchor_id"), F.col(positive).alias("positive_id"),
                           F.col(negative).alias("negative_id"))
    return (base.join(side("anchor", "anchor_id"), "anchor_id", "left")
            .join(side("positive", "positive_id"), "positive_id", "left")
            .join(side("negative", "negative_id"), "negative_id", "left"))
