import duckdb
import pandas as pd

from paneloom.llm import queries, url_filter

ROWS = [
    (1, "https://A.Example.net/en/1?x=1#f", None), (2, "http://a.example.net/de/1", ""), (3, "http://example.com/de/", "<html>"), (4, "http://notexample.com/de/x", None),
    (5, "HTTP://x.ORG/fr/", "x"), (6, "http://org/fr", None), (7, None, None), (8, "no scheme", None), (9, "http://", None), (10, "://net", None), (11, "http://net?q=/", None),
    # aliases by form: http, www, slash and utm parameters
    (20, "http://plain.io/a", None), (21, "https://www.plain.io/a/?utm_source=z#q", None),
    # a chain of redirects and canonical links to a blocked page
    (30, "http://one.io/a", '<meta http-equiv="refresh" content="0; url=http://two.io/b?x=1&amp;y=2">'),
    (31, "http://two.io/b?x=1&y=2", '<LINK href="/c" rel="canonical"> <link rel=stylesheet href="http://example.net/en/q">'),
    (32, "http://m.two.io/c", "<link rel='canonical' href='//example.com/de/9'>"), (33, "http://one.io/z/k", "<link rel=canonical href=other>"),
    # a class with a blocked and an allowed alias: only the blocked page itself stays blocked
    (40, "http://three.io/", '<link rel="canonical" href="http://b.net/x">'), (41, "http://three.io/", '<meta http-equiv=refresh content="3;URL=http://example.net/en/x">'), (42, "http://b.net/x", None),
    (30, "http://one.io/a", None), (None, "http://one.io/a", None), (50, "http://long.io/" + "y" * 100000, "<p>" * 50000),
]
WANT = {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("example.com/de/", "block"), 4: (None, "allow"), 5: ("org/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"),
        9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 20: (None, "allow"), 21: (None, "allow"), 30: (None, "block"), 31: (None, "block"), 32: (None, "block"), 33: (None, "allow"),
        40: (None, "allow"), 41: (None, "allow"), 42: ("net/", "block"), None: (None, "block"), 50: (None, "allow")}


def test_rules_and_aliases(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, host string")
    got = url_filter.judge(df, queries.RULES).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["rule"], r["verdict"]) == WANT[r["page_id"]], r["page_id"]
    by = {r["page_id"]: r for r in got}
    assert (by[1]["host"], by[1]["path"]) == ("a.example.net", "/en/1") and (by[11]["host"], by[11]["path"]) == ("net", "")
    assert (by[7]["host"], by[7]["path"]) == ("", "") and by[20]["alias_of"] == by[21]["alias_of"] == "plain.io/a"
    assert url_filter.judge(df.limit(0), queries.RULES).count() == 0
    # the SQL says the same of these rows
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([(i, u, h) for i, u, h in ROWS], columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    cur = con.execute(queries.OP1_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got)


def test_links_from_elsewhere(spark):
    pages = spark.createDataFrame([(1, "http://a.io/1", None)], "page_id long, url string, html string")
    more = spark.createDataFrame([("http://a.io/1", "http://b.io/2"), ("http://c.net/3", "http://b.io/2"), (None, "x")], "from_url string, to_url string")
    assert url_filter.judge(pages, queries.RULES, more).first()["verdict"] == "block"
    allowed = spark.createDataFrame([("http://a.io/1", "http://org/fr/")], more.schema)
    assert url_filter.judge(pages, queries.RULES, more.unionByName(allowed)).first()["verdict"] == "allow"
