from pledgetrace.llm import hosts as h

SCHEMA = "page_id long, url string, host string, verdict int"


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net/en", "net", None, "x://net", "http://net/", "http://fakenet/en/",
            "ftp://a.example.com?x", "http://b.example.com/de/1#t", "http://q.org/fr/", "http://q.org/fr", "a://b://c/d", "http://www.x.org/EN/é?"]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)] + [(None, urls[0], "c", 1), (0, urls[0], "c", 1)], SCHEMA)
    none = spark.createDataFrame([], "page_id long, good int")
    got = h.url_verdicts(pages, none).collect()
    assert len(got) == pages.count()
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert [(by[i]["host"], by[i]["path"]) for i in range(len(urls))] == [
        ("a.example.net", "/en/x"), ("example.net", "/en"), ("", ""), ("", ""), ("net", ""), ("net", "/"), ("fakenet", "/en/"),
        ("a.example.com", ""), ("b.example.com", "/de/1"), ("q.org", "/fr/"), ("q.org", "/fr"), ("b:", "//c/d"), ("www.x.org", "/EN/é")]
    assert [by[i]["rule"] for i in range(len(urls))] == [
        "example.net/en/", "net/", None, None, None, "net/", None, None, "example.com/de/", "org/fr/", None, None, None]
    assert [by[i]["verdict"] for i in (0, 1, 5, 8, 9)] == ["allow", "block", "block", "block", "allow"]
    assert h.url_verdicts(pages.limit(0), none).collect() == []


def test_reputation_shrinks_and_filters(spark):
    plan = [("good.a.com", 40, 38), ("bad.a.com", 40, 2), ("new.a.com", 0, 0), ("one.b.com", 1, 0), ("two.b.com", 60, 59), ("lone.c.org", 2, 2)]
    pages, marks, at = [], [], 0
    for host, n, good in plan:
        for k in range(n + 1):  # the last page has no label
            pages.append((at, f"http://{host}/{k}", "c", 1))
            if k < n:
                marks.append((at, int(k < good)))
            at += 1
    marks += [(None, 1), (0, None)]
    out = h.url_verdicts(spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(marks, "page_id long, good int"), rules=())
    by = {r["host"]: r["verdict"] for r in out.collect()}
    assert by["good.a.com"] == "allow" and by["two.b.com"] == "allow" and by["bad.a.com"] == "block"
    counts = spark.createDataFrame([(a, n, g) for a, n, g in plan], "host string, n long, good long")
    bound = {r["host"]: r["bound"] for r in h.host_reputation(counts).collect()}
    # no host is trusted without pages of its own as one that has shown good ones; one bad page
    # of a good domain weighs less than many
    assert bound["bad.a.com"] < bound["good.a.com"] > bound["new.a.com"] and bound["one.b.com"] < bound["two.b.com"]
    assert h.LEAST < bound["good.a.com"] and bound["bad.a.com"] < h.LEAST
