"""URL filter by a character language-model ratio (DataFrame functions only).

Domain rules decide the URLs they fit. Those URLs are the training data of two
variable-order Markov models over characters, one for accepted and one for
rejected URLs: Witten-Bell smoothing interpolates orders 0 to ``max_order``, and
order -1 is uniform. The other URLs are judged by the log-likelihood difference
of the two models per character, against a threshold calibrated on held-out
rule-decided URLs.

All counts derive from the distinct (max_order + 1)-grams; shorter ones are sums
over grams with the same suffix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, save

#: (rule, verdict): host, then path.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]
START, END = "\u0002", "\u0003"
ALPHABET = 1_114_112


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits (null without one). Rules of
    the same length: the first in code point order."""
    def fits(rule: str) -> Column:
        at = rule.index("/") if "/" in rule else len(rule)
        return ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
    ranked = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    none = F.lit(None).cast("string")
    if not ranked:
        return none, none
    return (F.coalesce(*[F.when(fits(r), F.lit(r)) for r, _ in ranked]),
            F.coalesce(*[F.when(fits(r), F.lit(v)) for r, v in ranked]))


def char_grams(text: Column, order: int) -> Column:
    """The (order + 1)-grams that end at each character of the text and at its end."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, order + 1))


def gram_ratios(grams: DataFrame, order: int) -> DataFrame:
    """``(gram, ratio)``: ln P(last char | rest) under the accepted model less that
    under the rejected one, from ``(gram, n_allow, n_block)`` with unique grams."""
    p = None
    for k in range(order + 1):
        g = (grams.groupBy(F.substring("gram", order - k + 1, k + 1).alias("g"))
             .agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")))
        g = g.withColumn("_ctx", F.substring("g", 1, k))
        same = Window.partitionBy("_ctx")
        lower = [F.lit(1.0 / ALPHABET)] * 2
        if p is not None:
            g = g.join(p, F.substring(g["g"], 2, k) == p["_g"])
            lower = [F.col("_p_allow"), F.col("_p_block")]
        out = []
        for kind, low in zip(("allow", "block"), lower, strict=True):
            n = F.col(f"n_{kind}")
            total, types = F.sum(n).over(same), F.sum((n > 0).cast("long")).over(same)
            out.append(F.when(total > 0, (n + types * low) / (total + types)).otherwise(low).alias(f"_p_{kind}"))
        p = g.select(F.col("g").alias("_g"), *out)
    return p.select(F.col("_g").alias("gram"), (F.log("_p_allow") - F.log("_p_block")).alias("ratio"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules: Sequence[tuple[str, str]] = RULES, max_order: int = 4) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``.

    Columns: the id, ``host``, ``path``, ``rule`` (null where the model judges),
    ``verdict`` (``allow`` or ``block``) and ``ratio`` (per character, less the
    threshold; null where a rule decides). A fifth of the distinct rule-decided
    URLs, by hash, calibrates: the threshold lies between the mean ratios of
    accepted and rejected ones, nearer to the one that spreads less. With one kind
    only, or none, the missing mean counts as 0. A ratio of 0 or more is
    ``allow``. A null URL, or one without ``://``, has empty parts and is judged
    like any other. Equal URLs get equal verdicts; an empty table gives none.
    """
    host, path = url_parts(F.col(url_col))
    x = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    x = save(x.withColumn("rule", rule).withColumn("_verdict", verdict), "urls")

    urls = x.select("host", "path", F.col("_verdict").alias("label")).distinct()
    check = (F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0) & F.col("label").isNotNull()
    chars = F.concat("host", "path")
    grams = save(urls.select("host", "path", "label", check.alias("check"), F.explode(char_grams(chars, max_order)).alias("gram")),
                 "url-grams")
    learn = ~F.col("check")
    counts = grams.groupBy("gram").agg(*[
        F.sum((learn & F.col("label").eqNullSafe(F.lit(kind))).cast("long")).alias(f"n_{kind}") for kind in ("allow", "block")])
    ratios = gram_ratios(save(counts, "url-gram-counts"), max_order)

    judged = grams.where(F.col("label").isNull() | F.col("check"))
    scores = save(judged.join(ratios, "gram").groupBy("host", "path", "label")
                  .agg(F.avg("ratio").alias("ratio")), "url-ratios")
    stats = [F.coalesce(f(F.when(F.col("label") == kind, F.col("ratio"))), F.lit(0.0)).alias(f"{name}_{kind}")
             for kind in ("allow", "block") for name, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    s = scores.agg(*stats).first()
    spread = s["sd_allow"] + s["sd_block"]
    share = s["sd_allow"] / spread if spread > 0 else 0.5
    threshold = s["mean_allow"] + share * (s["mean_block"] - s["mean_allow"])
    scores = scores.where(F.col("label").isNull()).select("host", "path", (F.col("ratio") - threshold).alias("ratio"))
    out = x.join(scores, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        "_verdict", F.when(F.col("ratio") >= 0, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("ratio")).alias("ratio"))
