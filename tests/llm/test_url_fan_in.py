import pytest

from gridspark.llm import url_filter as U

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("linkers", [1, 1000])
def test_linkers_of_a_blocked_host_are_blocked_however_many(spark, linkers):
    pages = [(-1, "https://bad.net/x", "")]
    pages += [(i, f"https://farm{i}.com/", '<a href="https://bad.net/p">x</a>') for i in range(linkers)]
    pages += [(-2 - i, f"https://other{i}.com/", "") for i in range(2 * linkers)]
    got = U.judge(spark.createDataFrame(pages, SCHEMA)).filter("page_id >= 0").select("verdict").collect()
    assert [r.verdict for r in got] == ["block"] * linkers


def test_links_without_a_scheme_count(spark):
    pages = [(1, "https://bad.net/x", ""), (2, "https://farm.com/", "<a href='//BAD.net/p'>x</a>"), (3, "https://own.com/", '<a href="/bad.net/">x</a>')]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
