"""Column expressions (JVM-side, code-generated where Spark allows).

Every function returns a ``Column``; none of them calls Python per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import HOUR_CODES


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- deterministic randomness ----------------------------------------------

def hash_key(*parts: str | Column) -> Column:
    """``md5('p1|p2|..')`` as hex text: a seeded, engine-portable sort key."""
    return F.md5(F.concat_ws("|", *[col_of(p).cast("string") for p in parts]))


def hash_int(*parts: str | Column) -> Column:
    """First 60 bits of :func:`hash_key` as a non-negative bigint."""
    return F.conv(F.substring(hash_key(*parts), 1, 15), 16, 10).cast("bigint")


#: The prime field in which a round's coin is drawn: squares of its members fit a bigint.
_FIELD = (1 << 31) - 1


def round_keys(*parts: str | Column, rounds: int = 24) -> Column:
    """The keys of :func:`permuted`'s rounds: one 60-bit draw for each, from ``parts`` and its number."""
    return F.array(*[hash_int(*parts, F.lit(r)) for r in range(rounds)])


def permuted(index: str | Column, size: str | Column, keys: str | Column) -> Column:
    """A keyed permutation of ``index`` on ``[0, size)``, for any size.

    Swap or not: in each round a keyed partner ``(K - x) mod size`` is taken or not by a coin that both
    partners share, so a round is a bijection and the whole needs no shuffle. ``keys`` is
    :func:`round_keys`, best computed once for each order in a small table."""
    n = col_of(size).cast("bigint")

    def one_round(x: Column, key: Column) -> Column:
        mate = F.pmod(F.pmod(key, n) - x, n)
        seed = F.pmod(F.greatest(x, mate) + key, F.lit(_FIELD))
        coin = F.aggregate(F.array(F.lit(1), F.lit(1)), seed, lambda c, one: F.pmod(c * c + one, F.lit(_FIELD)))
        return F.when(coin % 2 == 1, mate).otherwise(x)

    return F.aggregate(col_of(keys), col_of(index).cast("bigint"), one_round)


# --- codes and sums ---------------------------------------------------------

def hour_code(c: str | Column, codes: Mapping[int, int] = HOUR_CODES) -> Column:
    """Map HHMM bedtimes to ordinal codes; values outside the map pass through."""
    kv = []
    for k, v in codes.items():
        kv += [F.lit(k), F.lit(v)]
    m = F.create_map(*kv)
    x = col_of(c)
    return F.coalesce(F.try_element_at(m, x.cast("int")), x)


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """``sum(w_i * c_i)``; NULL as soon as any part is NULL (plain arithmetic)."""
    terms = [F.col(c) * F.lit(w) if w != 1 else F.col(c) for c, w in weights.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


# --- scaling ----------------------------------------------------------------

def minmax_scale(x: Column, lo: Column, hi: Column, feature_range=(-1.0, 1.0)) -> Column:
    """``x*s + (a - lo*s)`` with ``s = (b-a)/(hi-lo)``; a zero range counts as 1."""
    a, b = feature_range
    rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    s = F.lit(b - a) / rng
    return x * s + (F.lit(a) - lo * s)


def minmax_unscale(z: Column, lo: Column, hi: Column, feature_range=(-1.0, 1.0)) -> Column:
    a, b = feature_range
    rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    s = F.lit(b - a) / rng
    return (z - (F.lit(a) - lo * s)) / s


# --- predictions and losses -------------------------------------------------

def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def predict_tag(logit: Column) -> Column:
    """``round(sigmoid(x))`` with half-to-even: positive logits give 1, zero gives 0."""
    return (logit > 0).cast("int")


def bce_with_logits(x: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """Per-row binary cross entropy on logits, with a positive-class weight."""
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    y = y.cast("double")
    log_term = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return (F.lit(1.0) - y) * x + (F.lit(1.0) + (w - F.lit(1.0)) * y) * log_term


def squared_distance(a: Column, b: Column) -> Column:
    diffs = F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) ** 2)
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)


def pairwise_distance(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Euclidean norm of ``a - b + eps`` (the triplet loss' distance)."""
    diffs = F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double") + F.lit(eps)) ** 2)
    return F.sqrt(F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v))


# --- text -------------------------------------------------------------------

def sentence(sex: Column, age: Column) -> Column:
    """'This subject is <female|male> and <age to 2 places> years old'."""
    word = F.when(sex == 0, F.lit("female")).otherwise(F.lit("male"))
    return F.concat(F.lit("This subject is "), word, F.lit(" and "),
                    F.bround(age.cast("double"), 2).cast("string"), F.lit(" years old"))
