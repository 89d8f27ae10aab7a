import json

import pytest

from pledgetrace.operators import pages as pg
from pledgetrace.operators import places as pl
from pledgetrace.operators import sourcing as so
from pledgetrace.profile import cue_table, profile_frame
from pledgetrace.sources import exports as ex
from pledgetrace.sources import files as fl
from pledgetrace.sources import tables as tb
from pledgetrace.sources import web

SHEET = """# header
=== 1. c1 / e1 ===
PASSAGE:
grade: 3 (sure)
note:

=== 2. c1 / e2 ===
you: 0

=== 3. c2 / e3 ===
grade:
"""


def test_grade_sheets(spark, tmp_path):
    (tmp_path / "anna.txt").write_text(SHEET)
    got = sorted(map(tuple, fl.read_grade_sheets(spark, str(tmp_path)).collect()))
    assert got == [("anna", "c1", "e1", 3), ("anna", "c1", "e2", 0)]


def test_grade_sheets_read_by_several_tasks(spark, tmp_path):
    """Cut every 64 bytes: headers, grades and notes fall into different blocks."""
    rows = [(f"c{i % 7}", f"e{i}", i % 5) for i in range(300)]
    text = "".join(f"=== {i}. {q} / {d} ===\nPASSAGE:\n{'words ' * (i % 40)}\ngrade:{' ' + str(g) if g < 4 else ''}\ngrade: 0\n"
                   for i, (q, d, g) in enumerate(rows))
    (tmp_path / "a b.txt").write_text(text + "=== 301. c0 / e0 ===\nyou: 3\n")
    (tmp_path / "grader=x+y%2F").mkdir()
    (tmp_path / "grader=x+y%2F" / "p0.txt").write_text("grade: 1\n=== 1. c / d ===\n")
    (tmp_path / "grader=x+y%2F" / "p1.txt").write_text("grade: 2\ngrade: 3\n")
    want = {("a b", q, d): g % 4 for q, d, g in rows} | {("a b", "c0", "e0"): 3, ("x+y/", "c", "d"): 2}
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = fl.read_grade_sheets(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r["grader"], r["query"], r["doc"]): r["grade"] for r in got} == want and len(got) == len(want)


def test_jsonl_is_strict(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"query": "a", "doc": "b", "grade": 1}\n\n{"query": "a", "doc": "c", "grade": 2}\n')
    schema = "query string, doc string, grade int"
    assert fl.validated(fl.read_jsonl(spark, str(p), schema)).count() == 2
    with pytest.raises(Exception, match="query cannot be a"):
        fl.validated(fl.read_jsonl(spark, str(p), schema, {"query": ("z",)}))
    p.write_text('{"query": "a"\n')
    with pytest.raises(Exception):
        fl.validated(fl.read_jsonl(spark, str(p), schema))


def test_corpus(spark, tmp_path):
    p = tmp_path / "c.json"
    body = {"documents": [{"id": "a", "text": "x"}, {"id": "b", "text": "y"}],
            "queries": [{"text": "q0", "relevant": ["b"]}, {"id": "named", "text": "q1"}]}
    p.write_text(json.dumps(body, indent=1))
    docs, queries, rel = fl.read_corpus(spark, str(p))
    assert docs.count() == 2 and sorted(map(tuple, queries.collect())) == [("0", "q0"), ("named", "q1")]
    assert list(map(tuple, rel.collect())) == [("0", "b")]
    body["queries"][0]["relevant"] = ["zz"]
    p.write_text(json.dumps(body))
    with pytest.raises(ValueError, match="does not have"):
        fl.read_corpus(spark, str(p))


def test_gazetteer(spark, tmp_path):
    pt = lambda x: {"lat": 1.0, "lon": float(x)}
    els = [{"type": "way", "id": 1, "tags": {"name": " Oak ", "highway": "x"}, "geometry": [pt(1), pt(2)]},
           {"type": "way", "id": 2, "tags": {"name": "Oak"}, "geometry": [pt(9)]},
           {"type": "way", "id": 3, "tags": {"name": "P", "leisure": "garden"}, "geometry": [pt(1), pt(2), pt(3), pt(1)]},
           {"type": "relation", "id": 4, "tags": {"name": "R", "place": "square"},
            "members": [{"geometry": [pt(1)]}, {}]}, {"type": "way", "id": 5, "tags": {}}, {"type": "way", "id": 6}]
    p = tmp_path / "osm.json"
    p.write_text(json.dumps({"elements": els}))
    got = {r["name"]: r for r in fl.load_gazetteer(spark, str(p), "VIII").collect()}
    assert set(got) == {"Oak", "P", "R"} and got["Oak"]["osm_id"] == "way/1"
    assert [got[n]["kind"] for n in ("Oak", "P", "R")] == ["street", "park", "square"]
    assert json.loads(got["P"]["geojson"])["type"] == "Polygon"
    assert json.loads(got["R"]["geojson"]) == {"type": "MultiLineString", "coordinates": [[[1.0, 1.0]]]}
    assert json.loads(got["Oak"]["geojson"])["coordinates"] == [[1.0, 1.0], [2.0, 1.0]]


def test_html(spark):
    page = ("<html><head><title> A &amp; B </title><meta property='article:published_time' content='2024-02-03T10:00'>"
            "<style>x{}</style></head><body><nav>menu</nav><script>if(a<b)</script><p>One <b>two</b></p><p>three&nbsp;4</p></body></html>")
    rows = spark.createDataFrame([("u1", page), ("u2", "<p> </p>"), ("u3", page.replace("2024-02-03", "2024-19-39").replace(" A &amp; B ", ""))],
                                 "url string, html string")
    got = {r["url"]: r for r in web.read_html(rows).collect()}
    assert set(got) == {"u1", "u3"} and got["u1"]["title"] == "A & B" and got["u1"]["text"] == "One two\nthree 4"
    assert str(got["u1"]["published_on"]) == "2024-02-03"
    assert got["u3"]["published_on"] is None and got["u3"]["title"] == "u3"


def test_sitemaps(spark):
    maps = [("https://a.hu/sitemap.xml", '<sitemapindex xmlns="s"><sitemap><loc>https://a.hu/m1.xml</loc></sitemap>'
             '<sitemap><loc>https://evil.test/m.xml</loc></sitemap></sitemapindex>'),
            ("https://a.hu/m1.xml", "<urlset><url><loc> https://a.hu/x/One.PDF?v=1 </loc></url><url><loc>https://evil.test/b.pdf</loc></url>"
             "<url><loc>https://a.hu/page</loc></url></urlset>"),
            ("https://a.hu/feed/", '<rss><item><link>/two.pdf</link><enclosure url="https://docs.a.hu/3.pdf"/></item></rss>'),
            ("https://b.hu/sitemap.xml", "<!DOCTYPE x><urlset><url><loc>https://b.hu/z.pdf</loc></url></urlset>"),
            ("https://b.hu/feed/", "not xml")]
    m = spark.createDataFrame(maps, "url string, xml string")
    d = spark.createDataFrame([("a.hu",), ("b.hu",)], "domain string")
    got = sorted(map(tuple, web.discover_documents(m, d).collect()))
    assert got == [("https://a.hu/two.pdf", "two.pdf", "a.hu"), ("https://a.hu/x/One.PDF?v=1", "One.PDF", "a.hu"),
                   ("https://docs.a.hu/3.pdf", "3.pdf", "docs.a.hu")]
    assert web.discover_documents(m, d, max_urls=1).count() == 1


def test_sitemaps_are_followed_all_the_way_down(spark):
    name = lambda i: "https://a.hu/sitemap.xml" if i == 0 else f"https://a.hu/{i}.xml"
    maps = [(name(i), f"<sitemapindex><sitemap><loc>{name(i + 1)}</loc></sitemap><sitemap><loc>{name(0)}</loc></sitemap></sitemapindex>")
            for i in range(6)] + [(name(6), "<urlset><url><loc>https://a.hu/deep.pdf</loc></url></urlset>")]
    m = spark.createDataFrame(maps, "url string, xml string")
    d = spark.createDataFrame([("a.hu",)], "domain string")
    assert [r["url"] for r in web.discover_documents(m, d).collect()] == ["https://a.hu/deep.pdf"]
    assert web.discover_documents(m, d, max_maps=6).collect() == []


def test_allowlist(spark):
    urls = ["https://a.hu/x", "http://sub.A.hu:8443/x", "https://user@a.hu/", "https://evila.hu/", "ftp://a.hu/", "https://a.hu.evil.test/", "nonsense"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    d = spark.createDataFrame([("a.hu",)], "domain string")
    assert sorted(r["url"] for r in pg.allowed(df, d).collect()) == sorted(urls[:2])


def test_place_names(spark):
    places = spark.createDataFrame([(1, "street", "Tompa utca"), (2, "square", "Kálvária tér"), (3, "park", "Orczy-kert"),
                                    (4, "parcel", "36542/1"), (5, "street", "Kiss")], "id bigint, kind string, name string")
    texts = [(1, "felújítás a Kálvária téren"), (2, "a Nagytompa utca fásítása"), (3, "az ORCZY-KERTBEN 36542/1 Kiss")]
    df = spark.createDataFrame(texts, "id bigint, text string")
    got = sorted((r["id"], r["name"]) for r in pl.mentions(df, ["id"], "text", places).collect())
    assert got == [(1, "Kálvária tér"), (3, "Orczy-kert")]


SRC = "id bigint, url string, title string, publisher string, sort_order int, jurisdiction string"


def test_sources_follow_the_owner(spark):
    s = spark.createDataFrame([(1, "https://city.hu/", "t", "City", 1, None), (2, "https://water.hu:8443/a#x", "t", "Water Co", 2, "w"),
                               (3, "https://state.hu/", "t", "State", 3, "n"), (4, "https://city.hu/w", "t", "", 0, "w")], SRC)
    c = spark.createDataFrame([(7, "Replace pipes", "M1", "w")], "id bigint, title string, code string, jurisdiction string")
    dom = {r["domain"]: (r["routed"], r["term"]) for r in so.owner_domains(c, s, ["Extra.hu"]).collect()}
    assert dom == {"city.hu": (False, "Water Co"), "water.hu": (True, "Water Co"), "extra.hu": (False, "Water Co")}
    hits = spark.createDataFrame([(1, "water co", "https://water.hu/hit"), (2, "PIPES", "https://city.hu/hit#f"),
                                  (3, "pipes", "https://evil.test/hit"), (4, "extra.hu replace", "https://extra.hu/hit")],
                                 "pos bigint, query_substring string, url string")
    got = so.collected_urls(c, s, hits, ["Extra.hu"]).orderBy("position").collect()
    assert [r["url"] for r in got] == ["https://city.hu/hit", "https://extra.hu/hit", "https://water.hu/hit",
                                       "https://city.hu/w", "https://city.hu/", "https://water.hu:8443/a"]
    p = spark.createDataFrame([("https://www.city.hu/1",), ("https://hu/2",), ("https://other.org/3",)], "url string")
    got = {r["url"][-1]: r["publisher"] for r in so.publishers(p, s).collect()}
    # the first source on that host has no name, so the host stands in
    assert got == {"1": "www.city.hu", "2": "hu", "3": "other.org"}


def test_profile_order_survives(spark):
    rows = cue_table(profile_frame(spark, {"code": "x", "budget_cues": {"z": ["b", "a"], "a": ["c"]},
                                           "status_rules": [["completed", ["x", "y"]]], "other": 1})).collect()
    got = sorted((r["family"], r["label_rank"], r["label"], r["cue_rank"], r["cue"]) for r in rows)
    assert got == [("budget_cues", 0, "z", 0, "b"), ("budget_cues", 0, "z", 1, "a"), ("budget_cues", 1, "a", 0, "c"),
                   ("status_rules", 0, "completed", 0, "x"), ("status_rules", 0, "completed", 1, "y")]
    assert cue_table(profile_frame(spark, {"code": "empty"})).count() == 0


def test_training_examples(spark):
    cols = "id bigint, document_id bigint, suggested_type string, normalized_title string, text string, source_page int, source_excerpt string, review_status string"
    c = spark.createDataFrame([(1, 1, "measure", "T", "x", 1, "Plant trees", "accepted"), (2, 1, "unclear", "U", "x", 1, "Plant trees", "accepted"),
                               (3, 1, "measure", "T", "x", 2, "no", "rejected"), (4, 1, "measure", "T", "x", 3, "q", "accepted"),
                               (5, 1, "measure", "T", "x", 3, "q", "unreviewed"), (6, 2, "measure", "T", "x", 1, "q", "accepted")], cols)
    com = spark.createDataFrame([(1, "target", "Edited")], "candidate_id bigint, kind string, title string")
    pages = spark.createDataFrame([(1, 1, "We Plant\n trees"), (1, 2, "x"), (1, 3, "q"), (2, 1, "q")], "document_id bigint, page_number int, text string")
    held = spark.createDataFrame([(2,)], "document_id bigint")
    got = {r["page"]: json.loads(r["answer"]) for r in ex.export_training(c, com, pages, held, "Go\n").collect()}
    assert got == {1: {"items": [{"type": "target", "normalized_title": "Edited", "text": "x", "page": 1, "excerpt": "Plant trees"}]}, 2: {"items": []}}


def test_listing_order_and_lookup(spark):
    df = spark.createDataFrame([(1, None), (2, "B"), (3, "A")], "id bigint, code string")
    assert [r["id"] for r in tb.scan(df, "commitments").collect()] == [3, 2, 1]
    ids = spark.createDataFrame([(1,), (1,), (9,)], "id bigint")
    assert [r["id"] for r in tb.lookup_many(df, ids).collect()] == [1]


def test_place_names_in_shards_against_the_pattern(spark, monkeypatch):
    import random
    import re
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(2, 4)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 3))).capitalize() for _ in range(120)})
    texts = [rng.choice([" ", ", ", "-"]).join(rng.choice([word(), rng.choice(names), rng.choice(names).upper() + "n"]) for _ in range(30))
             for _ in range(60)] + ["", None, "x" + names[0], "_" + names[0], names[-1]]
    places = spark.createDataFrame([("street", n) for n in names] * 2 + [("parcel", "1234/5")], "kind string, name string")
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    want = sorted((i, n) for i, t in enumerate(texts) for n in names
                  if len(n) >= pl.MIN_NAME and re.search(r"(?i)(?<!\w)" + re.escape(n), t or ""))
    got = lambda: sorted((r["id"], r["name"]) for r in pl.mentions(df, ["id"], "text", places).collect())
    assert got() == want and len(want) > 100
    monkeypatch.setattr(pl, "NAMES", 20)
    assert got() == want


def searched(spark, sent=None):
    """Commitments, sources and results whose substrings lie anywhere in a search: behind the domain, in
    it, across both, or nowhere, with one that every search holds."""
    c = spark.createDataFrame([(1, "Plan A", "M1", "x"), (2, "Plan B", None, "y"), (3, "Other plan", "M3", "x"), (4, "Alone", None, "z")],
                              "id long, title string, code string, jurisdiction string")
    s = spark.createDataFrame(
        [(1, "https://a.hu/1#f", "Office X", "t", 2, "x"), (2, "https://a.hu/2", None, "t", 1, None),
         (3, "https://b.hu/3", "Office Y", "t", 1, "y"), (4, "https://c.hu/4", "Office X", "t", 3, "x")],
        "id long, url string, publisher string, title string, sort_order int, jurisdiction string")
    r = spark.createDataFrame(
        [(n, sub, f"https://{host}/{page}") for n, (sub, host, page) in enumerate([
            ("plan", "a.hu", "p1#x"), ("plan", "evil.hu", "p2"), ("a.hu plan", "sub.a.hu", "p3"), ("plan a m1 office", "c.hu", "p4"),
            ("site:b", "b.hu", "p5"), ("", "a.hu", "2"), ("PLAN B", "b.hu", "3"), (None, "a.hu", "p6"), ("nowhere", "a.hu", "p7"),
            ("hu o", "c.hu", "p8"), ("plan", "a.hu", "p9"), ("plan", "b.hu", "p10")])], "pos int, query_substring string, url string")
    return c, s, r


def found_by_hand(c, s, r, limit):
    rows = {}
    for com in c.collect():
        own = sorted((x for x in s.collect() if x.jurisdiction in (None, com.jurisdiction)), key=lambda x: (x.sort_order, x.id))
        hosts = {x.url.split("/")[2]: True for x in own}
        for x in own:
            hosts[x.url.split("/")[2]] &= x.jurisdiction is not None
        term = next((x.publisher for x in own if x.jurisdiction and x.publisher), "")
        urls = []
        for host in sorted(hosts):
            text = f"site:{host} " + " ".join(t for t in (f"{com.title} {com.code or ''}".strip(), term if hosts[host] else "") if t)
            held = [x for x in r.collect() if x.query_substring is not None and x.query_substring.lower() in text.lower()]
            urls += [x.url.split("#")[0] for x in sorted(held, key=lambda x: x.pos)[:limit]]
        urls += [x.url.split("#")[0] for x in own]
        ok = [u for u in dict.fromkeys(urls) if any(("." + u.split("/")[2]).endswith("." + h) for h in hosts)]
        rows |= {(com.id, u): i + 1 for i, u in enumerate(ok)}
    return rows


@pytest.mark.parametrize("sent", [100_000, 0])
def test_searches_against_plain_search(spark, monkeypatch, sent):
    monkeypatch.setattr(so, "SENT", sent)
    c, s, r = searched(spark)
    for limit in (2, 5):
        got = so.collected_urls(c, s, r, [], limit).collect()
        want = found_by_hand(c, s, r, limit)
        assert {(x.commitment_id, x.url): x.position for x in got} == want and len(got) == len(want)
        counts = so.collected_counts(c, s, r, [], limit)
        assert {x.commitment_id: x.n for x in counts.collect()} == {i: sum(k[0] == i for k in want) for i in {k[0] for k in want}}


def test_no_substring_passes_through_the_driver(spark):
    """Searches are joins: no Python task holds all substrings."""
    c, s, r = searched(spark)
    hits = so.search_hits(c.select(c.id.alias("query_id"), c.title.alias("query")), r, 3)
    assert "InPandas" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_searches_send_no_table_of_substrings_to_every_task(spark):
    """A staged file is much smaller than its rows, so the planner would send them through the driver."""
    subs = so._substrings(spark.createDataFrame([("a b", 1, "u"), ("st", 2, "v")], "query_substring string, pos int, url string"), 5)
    domains = spark.createDataFrame([("x.a",), ("y.st",)], "domain string")
    special = so._special_domains(domains, subs, [2, 3])
    found = so._found(spark.createDataFrame([(1, "at last")], "k int, t string"), ["k"], subs, [2, 3], 5, "t")
    assert {r["domain"] for r in special.collect()} == {"x.a", "y.st"} and [r["url"] for r in found.collect()] == ["v"]
    for df in (special, found):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, room", [("J4_source_routing", 0.2), ("J7_search_hits", 0.5)])
def test_products_take_little_room(spark, tmp_path, name, room):
    """The result is commitments times sources, so its files must not take bytes for each of its rows."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    tables = {"customer": "select id as c_custkey, concat('Customer#', lpad(cast(id as string), 9, '0')) as c_name, cast(1 as double) as c_acctbal from range(600)",
              "supplier": "select id as s_suppkey, concat('Supplier#', id) as s_name from range(4500)",
              "orders": "select id as o_orderkey, id % 600 as o_custkey from range(3000)"}
    con = duckdb.connect()
    for table, sql in tables.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{table}.parquet"))
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    entry.queries()[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    con.execute(f"create view got as select * from '{tmp_path}/out/*.parquet'")
    con.execute(f"create table want as {entry.oracle_sql()[name]}")
    cols = ", ".join(c[0] for c in con.execute("describe want").fetchall())
    n = con.execute("select count(*) from want").fetchone()[0]
    assert con.execute("select count(*) from got").fetchone()[0] == n > 1_400_000
    assert con.execute(f"select count(*) from (select {cols} from want except select {cols} from got)").fetchone()[0] == 0
    assert sum(f.stat().st_size for f in files) < room * n
