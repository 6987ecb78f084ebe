import random

from pyspark.sql import functions as F

from lodeseek.llm import op4_url_filters as op4


def test_op4_sql(spark, sf_dir, duck, same):
    same(op4.query(spark, sf_dir), duck, op4.SQL)


PAGES = [
    (1, "https://WWW.Example.com/en/a?x=1#y", ""),
    (2, "http://example.com/en/", None),
    (3, "http://a.example.net/es/1", '<link href="http://a.example.org/1" rel="canonical">'),
    (4, "https://a.example.org/1#top", ""),
    (5, "http://b.org/x/y", '<META http-equiv=Refresh content="0; url=/1">'),
    (6, "http://b.org/1", '<link rel="canonical" href="https://a.example.org/1/">'),
    (7, "http://c.org", "<link rel=canonical href='http://shop.com/'>"),
    (8, "http://c.org/", '<link rel="canonical" href="http://example.com/en/x">'),
    (9, None, "x"),
    (10, "no scheme", "<p>"),
    (10, "no scheme", "<p>"),
    (11, "ftp://com", ""),
    (12, "http://net/fr/a://b", ""),
    (13, "http://xcom/", '<link rel="stylesheet" href="http://example.com/en/x">'),
]


def test_op4_cases(spark, duck, same):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op4.judge(df).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("a.example.net", "/es/1", "net/es/", "block")
    assert [got[i][3] for i in (4, 5, 6)] == ["block"] * 3  # by redirects, over two steps
    assert [got[i][3] for i in (7, 8)] == ["allow", "allow"]  # an allowed alias comes before a blocked one
    assert got[9] == got[10] == ("", "", None, "allow")
    assert got[11] == ("com", "", None, "allow") and got[12][2] == "net/fr/" and got[13][3] == "allow"
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))
    same(op4.judge(df), con, op4.SQL)
    assert op4.judge(df.limit(0)).count() == 0


def test_op4_forms_of_targets(spark):
    link = '<html><head>{}</head><body>x</body></html>'.format
    blocked = "http://m.net/es/b"  # blocked by a rule
    forms = {
        "http://a.org/p?a=1&b=2": link('<link rel="nofollow canonical" href="http://m.net/es/b?x=1&amp;y=2">'),
        "http://b.org/d/e/f": link('<link rel=canonical href="../../../hop/./x/../b">'),
        "http://b.org/hop/b": link(f'<link rel="CANONICAL" href="{blocked}">'),
        "http://c.org/q": link('<link rel="canonical" href="?p=2">'),
        "http://c.org/q?p=2": link(f'<link rel="canonical" href=" {blocked} ">'),
        "http://d.org/x": link('<base href="http://m.net/es/"><link rel="canonical" href="b">'),
        "http://e.org/x": link('<meta http-equiv="refresh" content="0;URL=&quot;http://m.net/es/b&quot;">'),
        "http://f.org/?a=1&b=2": link(f'<link rel="canonical" href="{blocked}">'),
        "http://g.org/x": link('<link rel="canonical" href="http://f.org/?a=1&amp;b=2">'),
        "http://h.org/x": link(f'<link rel="canonical" href="{blocked}"><base href="http://m.net/">'),
        "http://i.org/x": link('<meta http-equiv="refresh" content="5">') + f'<!-- <link rel="canonical" href="{blocked}"> -->',
        "http://j.org/x": link('<link rel="canonical" href="http://[bad">'),
        "http://k.org/x": link(f'<link title="a>b" rel="canonical" href="{blocked}">'),
        "http://l.org/x": link(f'<LINK\nREL="canon&#105;cal" HREF="{blocked}">'),
        "http://m.org/x": link(f'<meta content="0;url={blocked}" http-equiv=\'re&#102;resh\'>'),
    }
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(forms.items())], "page_id long, url string, html string")
    got = {list(forms)[r.page_id]: r.verdict for r in op4.judge(df).collect()}
    assert got == {u: "allow" if u[7] in "ij" else "block" for u in forms}


def test_op4_random_graph_against_sql(spark, same):
    """Hubs, chains and cycles of canonical links over hosts with and without rules."""
    import duckdb
    import pandas as pd

    rng = random.Random(11)
    name = lambda i: f"http://{'shop.com' if i % 23 == 0 else 'm.net' if i % 17 == 0 else 'w%d.org' % (i % 9)}/{'es/' if i % 2 else ''}p{i}"
    to = {i: i + 1 for i in range(0, 60)} | {i: 100 for i in range(101, 190)} | {i: rng.randrange(200, 320) for i in range(200, 300)}
    rows = [(i, name(i), f'<link rel="canonical" href="{name(to[i])}">' if i in to else "") for i in range(340)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    out = op4.judge(df)
    assert out.filter("by_alias AND verdict = 'block'").count() > 20 and out.filter("by_alias AND verdict = 'allow'").count() > 20
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    same(op4.judge(df), con, op4.SQL)


def test_op4_ties_and_clashes(spark):
    rules = (("block", "a.org", "/x"), ("allow", "a.org", "/x"), ("allow", "a.org", "/"), ("block", "a.org", "/xy"))
    rows = [(1, "http://a.org/x", "", "n"), (2, "http://a.org/xyz", "", "n"), (2, "http://a.org/xyz", "", "n"), (None, "http://b.org/" + "x" * 300000, None, "n")]
    df = spark.createDataFrame(rows, "host long, url string, html string, node string").withColumn("u", F.lit(1))
    out = op4.judge(df, rules, key="host")
    assert out.columns[0] == "key"
    assert sorted((str(r.key), r.verdict, str(r.rule)) for r in out.collect()) == [("1", "allow", "a.org/x"), ("2", "block", "a.org/xy"), ("2", "block", "a.org/xy"), ("None", "allow", "None")]
