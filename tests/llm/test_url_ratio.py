import math
from collections import defaultdict

import pytest

from cohortlake.llm import url_ratio
from cohortlake.llm.queries import table

SF = "/root/testdata/sf0.001"
ODD = [(10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, "no scheme example.org/es/1"), (10**6 + 4, "http://EXAMPLE.org/es/1?x#y"),
       (10**6 + 5, "a://b://c.com/fr/d"), (10**6 + 6, "http://example.org"), (10**6 + 7, "http://notexample.org/es/1"),
       (10**6 + 8, "https://Straße.NET/\u00fcber\nx?q"), (None, "http://x.com/de/1"), (10**6 + 9, "http://x.com/de/1"),
       (10**6 + 9, "http://x.com/de/1"), (10**6 + 10, "http://y.net/" + "z" * 3000)]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return host, rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]


def rule(host, path):
    best = None
    for r, v in url_ratio.RULES:
        at = r.index("/")
        if (host == r[:at] or host.endswith("." + r[:at])) and path.startswith(r[at:]) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return best or (None, None)


class Model:
    """Witten-Bell, orders 0 to n, by the book."""

    def __init__(self, urls, order):
        self.order, self.n = order, defaultdict(lambda: defaultdict(int))
        for u in urls:
            s = url_ratio.START * order + u + url_ratio.END
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.n[s[i - k:i]][s[i]] += 1

    def p(self, context, c):
        out = 1 / url_ratio.ALPHABET
        for k in range(self.order + 1):
            seen = self.n.get(context[len(context) - k:])
            if seen:
                total, types = sum(seen.values()), len(seen)
                out = (seen.get(c, 0) + types * out) / (total + types)
        return out

    def log(self, u):
        s = url_ratio.START * self.order + u + url_ratio.END
        return [math.log(self.p(s[i - self.order:i], s[i])) for i in range(self.order, len(s))]


@pytest.fixture(scope="module")
def pages(spark):
    return table(spark, SF, "pages").select("page_id", "url").unionAll(spark.createDataFrame(ODD, "page_id long, url string")).cache()


def test_parts_rules_and_model(spark, pages):
    order = 3
    got = url_ratio.judge_urls(pages, max_order=order).collect()
    rows = [(r.page_id, *parts(r.url)) for r in pages.collect()]
    want = sorted((str(i), h, p, str(rule(h, p)[0])) for i, h, p in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == want
    assert all(r.verdict == rule(r.host, r.path)[1] for r in got if r.rule)

    urls = sorted({(h, p) for _, h, p in rows})
    fold = {(r.host, r.path): r.f for r in spark.createDataFrame(urls, "host string, path string")
            .selectExpr("host", "path", "pmod(xxhash64(host, path), 5) AS f").collect()}
    kind = {u: rule(*u)[1] for u in urls}
    models = {k: Model([h + p for h, p in urls if kind[h, p] == k and fold[h, p] != 0], order) for k in ("allow", "block")}

    def ratio(u):
        a, b = (models[k].log(u[0] + u[1]) for k in ("allow", "block"))
        return sum(x - y for x, y in zip(a, b)) / len(a)

    held = {k: [ratio(u) for u in urls if kind[u] == k and fold[u] == 0] for k in ("allow", "block")}
    mean = {k: sum(v) / len(v) for k, v in held.items()}
    sd = {k: (sum((x - mean[k]) ** 2 for x in v) / len(v)) ** 0.5 for k, v in held.items()}
    t = mean["allow"] + sd["allow"] / (sd["allow"] + sd["block"]) * (mean["block"] - mean["allow"])
    for r in got:
        if not r.rule:
            x = ratio((r.host, r.path)) - t
            assert abs(x - r.ratio) < 1e-9
            assert r.verdict == ("allow" if x >= 0 else "block") or abs(x) < 1e-9


def test_no_training_and_no_rows(pages):
    got = url_ratio.judge_urls(pages, rules=[]).collect()
    assert len(got) == pages.count() and {r.verdict for r in got} == {"allow"} and all(r.ratio == 0 for r in got)
    assert url_ratio.judge_urls(pages.where("1 = 0")).count() == 0


def test_longest_rule_wins(spark):
    d = spark.createDataFrame([(1, "http://a.example.org/en/12"), (2, "http://example.org/en/2"), (3, "http://example.org/es/"), (4, "http://q.com/fr/")],
                              "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_ratio.judge_urls(d).collect()}
    assert got == {1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: ("example.org/es/", "block"), 4: ("com/fr/", "allow")}
