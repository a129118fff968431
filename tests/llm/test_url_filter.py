import re

import numpy as np
import pytest

from gridspark.llm import url_filter as U
from gridspark.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, host string, trust double"


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [
    None, "", "no scheme", "http://", "://x.net/", "http://A.Example.NET/en/x?y#z", "http://example.net/en", "http://net/",
    "http://net", "http://anet/", "https://b.example.com/de/1", "https://example.com/de", "http://x.org/fr/", "http://x.org/en/",
    "http://ÄÖ.org/fr/é", "http://h.net:80/", "http://u@h.net/", "http://a.com?x=://b.net/", "x://y://z.net/", "http://a.com#/de/",
    "http://a\nb.net/\nq",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, None, "clash", 1.0) for i, u in enumerate(URLS)], SCHEMA)
    rows = {r.page_id: r for r in U.judge(df).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == (verdict or rows[i].verdict)
    assert {rows[i].verdict for i in (0, 1, 2)} == {"allow"}


def brute_scores(edges, seeds, keep=0.85):
    """(score over the mean seed) of every host: two dense systems of equations over edges (src, dst, n), one with seeds and one without."""
    nodes = sorted({n for e in edges for n in e[:2]} | set(seeds))
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, n in edges:
        w[at[b], at[a]] += n
    w /= np.maximum(w.sum(axis=0), 1)
    start = np.array([seeds.get(n, 0.0) for n in nodes])
    solve = lambda p: np.linalg.solve(np.eye(len(nodes)) - keep * w, (1 - keep) * p)
    return dict(zip(nodes, solve(start) / solve(np.ones(len(nodes))), strict=True)), start.mean()


def test_scores_match_a_dense_solution(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 3), ("c", "d", 1), ("e", "a", 1), ("b", "e", 4)]
    seeds = {"a": 1.0, "x": 0.5}
    got = U.spread(
        spark.createDataFrame([("k", *e) for e in edges], "kind string, src string, dst string, n long"),
        spark.createDataFrame([("k", *x) for x in seeds.items()], "kind string, host string, seed double"), Scratch(spark, "t"),
    )
    scores, mean = brute_scores(edges, seeds)
    rows = got.collect()
    assert {r.host: r.score for r in rows} == {n: pytest.approx(s, abs=1.5e-3) for n, s in scores.items()}
    assert all(r["mean"] == pytest.approx(mean) for r in rows)


def _dense(rows):
    """(page rows as (id, html, host, path, rule, verdict)) to trust and distrust of every host over the mean."""
    links = [(h, brute(u if "://" in u else "x:" + u)[0]) for _, html, h, *_ in rows for u in re.findall(r"<a\s[^<>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)", html)]
    ups = set()
    for h in {r[2] for r in rows} | {d for _, d in links}:
        while h.count(".") > 1:
            ups.add((h, up := h.split(".", 1)[1]))
            h = up
    edges = [(a, b, 1) for a, b in links if a and b and a != b] + [(a, b, 1) for a, b in ups] + [(b, a, 1) for a, b in ups]
    of = lambda v: {h: np.mean([r[5] == v for r in rows if r[2] == h]) for h in {r[2] for r in rows} - {""}}
    out = []
    for e, v in ((edges, "allow"), ([(b, a, n) for a, b, n in edges], "block")):
        scores, mean = brute_scores(e, of(v))
        out.append({h: s / mean for h, s in scores.items()})
    return out


def test_verdicts_on_pages_follow_from_the_dense_scores(spark):
    """All pages of a table: edges, scores and verdicts anew, without Spark."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    extra = [(-1, "https://mail.example.net", ""), (-2, "https://farm.test/a", '<p><a href="//x.y.example.net/p">x</a> <a href=/own>y</a>'), (-3, "https://sub.farm.test", None)]
    pages = pages.unionByName(spark.createDataFrame(extra, "page_id long, url string, html string"))
    rows = [(r.page_id, r.html or "", *brute(r.url)) for r in pages.collect()]
    trust, distrust = _dense(rows)
    got = {r.page_id: r for r in U.judge(pages).collect()}
    for i, _, host, _, _, verdict in rows:
        t, d = trust.get(host, 0.0), distrust.get(host, 0.0)
        assert (got[i].trust, got[i].distrust) == (pytest.approx(t, abs=0.02), pytest.approx(d, abs=0.02))
        assert got[i].verdict == (verdict or ("block" if got[i].distrust >= 1 and got[i].distrust > got[i].trust else "allow"))
    assert got[-2].distrust > 0.1 and got[-3].distrust > 0.01


def test_verdicts_depend_on_what_spreads(spark):
    """Against the hosts' own seeds alone: verdicts of pages without a rule change both on their own and where a rule page stands nearby."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    free = lambda df: {r.page_id: r.verdict for r in df.filter("rule IS NULL").collect()}
    spread, own = free(U.judge(pages)), free(U.judge(pages, keep=0.0))
    changed = sum(spread[i] != own[i] for i in own)
    print(len(own), "pages without a rule,", sum(v == "block" for v in spread.values()), "blocked,", sum(v == "block" for v in own.values()), "by own seeds,", changed, "changed")
    assert changed > 0 and 0 < sum(v == "block" for v in spread.values()) < len(spread) / 2


def test_distrust_follows_links_backwards(spark):
    """bad.net hands its distrust to those that link to it, and they to those that link to them; friends of good hosts stay."""
    link = '<a class="x" href="https://{}/p">x</a>'.format
    pages = [
        (1, "https://bad.net/x", ""), (2, "https://farm.com/x", link("bad.net") * 3), (3, "https://good.org/fr/x", link("friend.com")),
        (4, "https://friend.com/x", '<a href="/own">x</a>'), (5, "https://far.com/", link("farm.com")),
        (6, "https://mixed.com/", link("bad.net") + link("farm.com")),
    ] + [(10 + i, f"https://other{i}.com/", "") for i in range(10)]
    df = spark.createDataFrame([(*p, None, None) for p in pages + pages[:1]], SCHEMA)
    got = {r.page_id: r.verdict for r in U.judge(df).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 5, 6}
    assert U.judge(df).count() == len(pages) + 1


def test_equal_trust_and_distrust_allow(spark):
    link = '<a href="https://{}/p">x</a>'.format
    pages = [(1, "https://bad.net/x", link("mixed.com")), (2, "https://good.org/fr/x", link("mixed.com")), (3, "https://mixed.com/", link("bad.net") + link("good.org"))]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame([(*p, None, None) for p in pages], SCHEMA)).collect()}
    assert got[3].trust == pytest.approx(got[3].distrust) and got[3].verdict == "allow"


def test_very_long_urls_and_pages(spark):
    long = "https://" + "a." * 40 + "example.org/" + "p" * 200_000
    pages = [(1, long, None), (2, "https://x.com/", f'<a href="{long}">x</a>' * 3 + "w " * 500_000), (3, "http://" + "h" * 100_000 + "/", "")]
    rows = {r.page_id: r for r in U.judge(spark.createDataFrame([(*p, None, None) for p in pages], SCHEMA)).collect()}
    assert rows[1].host == "a." * 40 + "example.org" and len(rows[1].path) == 200_001 and rows[3].host == "h" * 100_000


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0
