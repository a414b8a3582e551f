import re

from compare import duck, same
from llmdata import SF
from tracewalk.llm import url_reputation as ur
from tracewalk.llm.queries import QUERIES, SQL, URL_RULES


def test_query_agrees_with_sql(spark):
    for folder in (SF, "/root/testdata/sf0.01"):
        same(QUERIES["op3_host_reputation"](spark, folder), duck(folder), SQL["op3_host_reputation"])


def judge(spark, urls, outcomes=(), rules=URL_RULES, **kw):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in urls], "page_id long, url string, rule string, bad int")
    labels = spark.createDataFrame(list(outcomes), "page_id long, bad boolean")
    return {r.page_id: r for r in ur.judge_urls(pages, labels, rules, **kw).collect()}


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for v, r in URL_RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(r), r, v))
    return host, path, min(fits)[1:] if fits else (None, None)


URLS = [
    "http://A.Example.COM/en/7x", "https://b.example.com/en/8", "x://net/de/", "http://q.example.net/de/89", "http://example.net/de/9", "ftp://org/es/?a", "http://norg/es/", "http://org/ES/",
    None, "", "no scheme", "http://", "://x/en/", "http://com?x=/en/", "http://com#/en/", "http://a.com/en/?q#f", "http://É.com/en/", "a://b://c/d", "http://user@host.org:80/es/1", "http://x.com/en/\nnext",
]


def test_hosts_paths_and_rules(spark):
    got = judge(spark, enumerate(URLS))
    for i, u in enumerate(URLS):
        host, path, (rule, verdict) = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or "allow")


def test_bad_hosts_are_blocked_and_thin_evidence_is_not(spark):
    urls, bad, n = [], [], 0
    for host, total, wrong in (("bad.spam.io", 60, 58), ("good.fine.io", 60, 1), ("thin.new.io", 1, 1), ("mid.fine.io", 60, 6)):
        for i in range(total):
            urls.append((n, f"http://{host}/{i}"))
            bad.append((n, i < wrong))
            n += 1
    urls.append((n, "http://never.seen.io/"))
    got = judge(spark, urls, bad)
    verdict = {r.host: r.verdict for r in got.values()}
    assert verdict == {"bad.spam.io": "block", "good.fine.io": "allow", "thin.new.io": "allow", "mid.fine.io": "allow", "never.seen.io": "allow"}
    rate = {r.host: r.bad_rate for r in got.values()}
    assert rate["good.fine.io"] < rate["mid.fine.io"] < rate["thin.new.io"] < rate["bad.spam.io"]
    assert all(r.bad_rate_lower <= r.bad_rate for r in got.values())


def test_longer_suffixes(spark):
    got = judge(spark, [(1, "http://a.b.co.uk/"), (2, "http://co.uk/")], [(1, True)], suffixes=("co.uk",))
    assert got[1].verdict == "allow" and got[2].host == "co.uk"


def test_odd_rows(spark):
    got = judge(spark, [(1, "http://a.b/"), (1, "http://a.b/"), (None, "http://a.b/"), (2, None)], [(1, True), (1, False), (None, True), (2, None)])
    assert len(got) == 3 and got[2].host == "" and got[1].bad_rate == got[None].bad_rate
    assert judge(spark, []) == {}
