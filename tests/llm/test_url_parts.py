"""Host, path, rule and the rules' verdicts of every page against plain Python."""

from llm import url_filter

SF = "/root/testdata/sf0.001"
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def judged(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None, None
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    at = min(ends, default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:].split("#")[0].split("?")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_every_page(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = {r.page_id: r for r in url_filter.op2_url_filter(spark, SF).collect()}
    assert got.keys() == urls.keys()
    ruled = 0
    for i, url in urls.items():
        host, path, rule, verdict = judged(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow")), url
        ruled += rule is not None
    assert ruled > 10


def test_odd_urls(spark):
    urls = ["a://b://c/en/", "://X.com/en/é?q#f", "h://example.com#/en/7", "h://example.com?x/en/7", "h://notexample.com/en/7", "h://example.com/en/71", "h://EXAMPLE.ÄÖ.com/en/", "no://", "x\n://a.org/es/\n1", "", None, "h://exampleXcom/en/", "h://org/es/", "h://a.example.net/de/8", "h://example.net/de/9"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    for i, url in enumerate(urls):
        host, path, rule, verdict = judged(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert verdict is None or got[i].verdict == verdict
