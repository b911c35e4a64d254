import pytest

from rankloom.llm import bloom, queries, url_filter
from rankloom.llm.url_filter import Rule

PAGES = "page_id long, url string"


@pytest.fixture(scope="module")
def judge(spark):
    def run(urls, listed=(), rules=queries.RULES, **more):
        pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
        entries = spark.createDataFrame([(u,) for u in listed], "url string")
        return {r.page_id: r for r in url_filter.judge(pages, entries, rules, **more).collect()}

    return run


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.COM/en/1?x=/fr/#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/2", "x.www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("http://www.example.com/EN/", "www.example.com", "/EN/", "com/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        ("http://a.net?/es/", "a.net", "", None, "allow"),
        ("http://a.net/en/http://b.net/es/", "a.net", "/en/http://b.net/es/", None, "allow"),
        ("a.net/es/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_rules(judge, url, host, path, rule, verdict):
    row = judge([url])[0]
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_list_by_canonical_form(judge):
    listed = ["http://www.spam.org/a/?b=2&a=1&utm_source=x#top"]
    same = ["https://SPAM.org:443/a?a=1&b=2", "http://spam.org/a//?b=2&ref=q&a=1"]
    other = ["http://spam.org/a?a=1", "http://spam.org/A?a=1&b=2", "http://m.spam.org/a?a=1&b=2"]
    rows = judge(same + other, listed)
    assert [rows[k].verdict for k in range(5)] == ["block", "block", "allow", "allow", "allow"]


def test_a_rule_goes_before_the_list(judge):
    rows = judge(["http://a.com/x", "http://a.org/x"], ["http://a.com/x", "http://a.org/x"])
    assert (rows[0].verdict, rows[0].listed) == ("allow", True)
    assert (rows[1].verdict, rows[1].listed) == ("block", True)


@pytest.mark.parametrize("max_blocks", [1, 2, 1 << 17])
def test_no_listed_url_is_lost_and_no_other_is_caught(judge, max_blocks):
    """With one block nearly every page is a possible hit; the exact join decides."""
    listed = [f"http://h{k % 7}.org/{k}" for k in range(0, 600, 3)]
    rows = judge([f"https://h{k % 7}.org/{k}/" for k in range(600)], listed, rules=(), max_blocks=max_blocks)
    assert {k for k, r in rows.items() if r.listed} == set(range(0, 600, 3))


def test_the_filter_passes_few_others(spark):
    listed = spark.range(2000).selectExpr("concat('l', id) AS canonical")
    blocks = bloom.block_count(2000)
    probes = spark.range(20000).selectExpr("concat('p', id) AS canonical").unionByName(listed)
    hits = bloom.mark(probes, "canonical", bloom.build(listed, "canonical", blocks), blocks).where("possible")
    assert hits.where("canonical LIKE 'l%'").count() == 2000
    assert hits.where("canonical LIKE 'p%'").count() < 0.02 * 20000


def test_ties_repeats_and_empty_tables(spark, judge):
    rules = (Rule("block", "a.org", "/"), Rule("allow", "a.org", "/x"), Rule("block", "a.org", "/x/y"))
    rows = judge(["http://a.org/x/y", "http://a.org/xy", "http://a.org/"] * 2, rules=rules)
    assert [rows[k].verdict for k in range(6)] == ["block", "allow", "block"] * 2
    assert judge([], ["http://a.org/"]) == {}
    pages = spark.createDataFrame([(1, "http://a.org/", "x", "y")], "page_id long, url string, Host string, block string")
    assert url_filter.judge(pages, pages.limit(0).select("url")).collect()[0].host == "a.org"
    hot = spark.range(3000).selectExpr("id AS page_id", "'http://a.org/q' AS url")
    assert url_filter.judge(hot, hot.limit(1).select("url")).where("verdict = 'block'").count() == 3000


def test_the_list_comes_from_what_pages_hold(spark, tmp_path):
    """A clean page with the url of a bad one is listed; another page of its host is not."""
    junk, clean = "<p>" + "a*** b### " * 5, "<p>" + "word " * 50
    rows = [
        (1, "http://a.org/x?utm_source=1", junk),
        (2, "https://www.a.org/x/", clean),
        (3, "http://a.org/y", clean),
        (4, "http://a.org/z", "a*** " * 9),
        (5, "http://casino-win.org/", clean),
        (6, "http://a.org/n", None),
        (7, None, junk),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: (r.listed, r.verdict) for r in queries.op7_url_filter(spark, str(tmp_path)).collect()}
    assert {k for k, r in found.items() if r == (True, "block")} == {1, 2}
    assert {k for k, r in found.items() if r == (False, "allow")} == {3, 4, 5, 6, 7}
