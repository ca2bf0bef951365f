from grovelens.llm import urlfilter

RULES = urlfilter.CONTRACT_RULES


def plain(url):
    """host, path, rule, verdict by trying every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, "allow")


URLS = [None, "", "no scheme", "http://", "http://a.ORG/x", "http://org/", "http://org", "https://u.example.org/es/1?q#f", "x://example.org/en/12", "x://example.org/en/2", "x://forg/", "http://b.com/fr/", "http://b.com/de/?a", "http://b.com?/de/", "http://b.com#/de/", "http://É.com/de/x://y", "a://b://c.com/de/", "http://a.org/" + "p/" * 5000, "http://x.com:80/de/", "http://a\n.org/x"]


def test_every_case(spark):
    rows = [(i, u, "h", "p", "r", "v", "f") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string, found string")
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, urlfilter.rule_table(spark, RULES)).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS * 2)}


def test_shuffled_rules_no_rules_no_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rules = urlfilter.rule_table(spark, RULES)
    first = sorted(map(tuple, urlfilter.judge(df, rules).select("page_id", "rule", "verdict").collect()))
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, urlfilter.judge(df, rules).select("page_id", "rule", "verdict").collect())) == first
    empty = urlfilter.judge(df, rules.limit(0), otherwise="block").collect()
    assert {(r.rule, r.verdict) for r in empty} == {(None, "block")} and len(empty) == len(URLS)
    assert urlfilter.judge(df.limit(0), rules).count() == 0
