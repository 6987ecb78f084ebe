import math

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import html, scoring, text, urls
from lodeseek.functions.stem import stem
from lodeseek.operators import crawl, embed, graph, index, queues, search, spell, store, vectors
from lodeseek.sources import tables


@pytest.mark.parametrize("word,want", [
    ("consigned", "consign"), ("consistency", "consist"), ("knackeries", "knackeri"), ("running", "run"), ("organization", "organ"),
    ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("flies", "fli"), ("ties", "tie"), ("gas", "gas"), ("kiwis", "kiwi"),
    ("relational", "relat"), ("happy", "happi"), ("by", "by"), ("say", "say"), ("sky", "sky"), ("luxuriated", "luxuri"), ("exceed", "exceed"),
])
def test_stem(word, want):
    assert stem(word) == want


URLS = [
    ("HTTPS://WWW.Example.COM/Path", "https://www.example.com/Path"), ("http://example.com:80/home", "http://example.com/home"),
    ("https://example.com:443/home", "https://example.com/home"), ("https://example.com:8080/home", "https://example.com:8080/home"),
    ("https://example.com/", "https://example.com"), ("https://example.com/path?b=2&a=1", "https://example.com/path"),
    ("https://example.com", "https://example.com"), ("://invalid-url", None), ("https://example.com/page?a=1#section-heading", "https://example.com/page"),
    ("https://a.com/x//", "https://a.com/x/"), ("http://a.com:443/x", "http://a.com:443/x"), (None, None),
]


def test_normalize(spark):
    df = spark.createDataFrame(URLS, "u string, want string")
    for r in df.select("u", "want", urls.normalized(F.col("u")).alias("got")).collect():
        assert r.got == r.want, r.u


def test_html_unclosed_b(spark):
    h = "<html><head><title>Alpha Beta</title></head><body><h1>Gamma</h1><p><b>Delta.<br><p>Epsilon</p><p><b>Zeta.<br><p>Eta</p></body></html>"
    assert html.page_record("http://a.org/", h)[0] == "Alpha Beta"
    pages = spark.createDataFrame([(1, h), (2, "<ul><li><p>Fox</p></li></ul>"), (3, None), (4, "")], "page_id long, html string")
    tok = index.page_tag_tokens(pages)
    tf = {(r.page_id, r.term): r.tf for r in index.postings(store.stemmed(index.page_word_counts(html.with_tag_texts(pages))), "stem").collect()}
    assert tf == {(1, "gamma"): 3, (1, "delta"): 2.5, (1, "epsilon"): 2.5, (1, "zeta"): 4, (1, "eta"): 4, (2, "fox"): 2}
    assert {r.page_id: r.doc_length for r in index.doc_lengths(tok).collect()} == {1: 11, 2: 2}
    assert {r.page_id: r.doc_length for r in index.page_lengths(html.with_tag_texts(pages)).collect()} == {1: 11, 2: 2}
    assert {r.page_id: r.heading for r in index.headings(pages).collect()} == {1: "Gamma..", 2: "..", 3: "..", 4: ".."}


def test_html_links_and_images(spark):
    body = "".join(f'<a href="{x}">x</a>' for x in ("/wiki/B", "/wiki/B#s", "/wiki/Talk:C", "/wiki/Main_Page", "mailto:x@y", "https://www.google.com/q", "https://fr.wikipedia.org/wiki/D"))
    body += '<img src="/i.png?x=1" alt="one"><img src="/i.png" alt="two"><img src="/j.png" alt=" ">'
    rec = html.with_records(spark.createDataFrame([(1, "https://en.wikipedia.org/wiki/A", body)], "page_id long, url string, html string"))
    assert [r.to_url for r in index.links_found(rec).collect()] == ["https://en.wikipedia.org/wiki/B"]
    assert rec.first().images == {"https://en.wikipedia.org/i.png": "two"}


def test_query_words(spark):
    q = "The Quick-brown FOX, v1.4.5 a!"
    row = spark.range(1).select(text.normalized_words(F.lit(q)).alias("a"), text.clean_words(F.lit(q)).alias("b")).first()
    assert row.a == ["the", "quick", "brown", "fox", "v1"] and row.b == ["quick", "brown", "fox", "v1"]
    assert search.check_query(q) == row.a
    for bad in (None, "", "the", "!"):
        with pytest.raises(search.BadRequest):
            search.check_query(bad)


def test_scores(spark):
    c = lambda *x: [F.lit(v) for v in x]
    row = spark.range(1).select(
        scoring.bm25(*c(3, 2, 100, 10, 80.0)).alias("a"), scoring.idf(*c(10, 8)).alias("b"), scoring.bm25(*c(3, 2, 0, 10, 0.0)).alias("z"),
        F.array(*[scoring.backlink_boost(F.lit(n)) for n in (0, 1, 10, 100, 1000, 10**6)]).alias("l"),
        scoring.relevance_boost(F.array(F.lit("fox")), *[text.normalized_words(F.lit(x)) for x in ("fox.example.org", "Fox den", "The fox.")]).alias("r"),
    ).first()
    assert row.a == pytest.approx(1.831501, abs=1e-6) and row.b == pytest.approx(-1.223775, abs=1e-6) and row.z is None
    assert row.l == pytest.approx([1, 1.050164, 1.173540, 1.334005, 1.5, 1.5], abs=1e-6) and row.r == 12


def test_fusion(spark):
    bm = spark.createDataFrame([(7, 1), (3, 2), (9, 3)], "page_id long, bm25_rank int")
    vec = spark.createDataFrame([(3, 1), (5, 2)], "page_id long, vector_rank int")
    rows = search.fuse(bm, vec).orderBy(F.desc("rrf_score"), "ord").collect()
    assert [(r.page_id, r.type) for r in rows] == [(3, "both"), (7, "bm25"), (5, "embedding"), (9, "bm25")]
    assert all(r.rrf_score <= 2 / 60 for r in rows) and rows[0].rrf_score == pytest.approx(1 / 61 + 1 / 60)


def test_stop_words():
    w = text.STOP_WORDS
    assert len(w) == len(set(w)) == 317 and list(w) == sorted(w)
    assert {"the", "bill", "thickv", "couldnt", "yourselves", "un"} <= set(w)


def test_spell_of_many_words(spark, monkeypatch):
    monkeypatch.setattr(spell, "MAX_WORDS", 2)
    test_spell(spark)


def test_spell(spark):
    vocab = spark.createDataFrame([("fox",), ("fax",), ("box",), ("foxes",)], "word string")
    words = spark.createDataFrame(list(enumerate(["foz", "qqqqq", "q9q9q9q9", "the", "fox"])), "pos long, word string")
    assert [r.corrected for r in spell.correct(words, vocab).orderBy("pos").collect()] == ["fox", "foxes", "q9q9q9q9", "the", "fox"]


def test_fetched_and_upsert(spark):
    log = spark.createDataFrame([("a", 200, "text/html; charset=utf-8", "x"), ("b", 404, "text/html", "y"), ("c", 200, "image/png", "z"), ("d", None, None, None)], "url string, status_code int, content_type string, body string")
    assert [r.url for r in tables.fetched(log).collect()] == ["a"]
    rows = spark.createDataFrame([("u", 1, "old"), ("u", 2, "new"), ("v", 1, "x")], "url string, seq int, title string")
    assert {(r.url, r.title) for r in index.latest(rows, "url", "seq").collect()} == {("u", "new"), ("v", "x")}
    assert index.corpus_stats(spark.createDataFrame([], "page_id long, doc_length long")).first().avg_doc_length == 0.0
    assert math.isclose(search.limit_for(20, 10), 200)


def test_whole_numbers():
    assert [search.whole_number(x, "page", 1) for x in (None, "3", " 7x", 2, "+4")] == [1, 3, 7, 2, 4]
    for bad in ("x", "", "0", "-2", "NaN", [1]):
        with pytest.raises(search.BadRequest):
            search.whole_number(bad, "page", 1)
    assert search.whole_number("-5", "id", least=None) == -5
    assert search.BadRequest.status == 400 and search.NotFound.status == 404


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A stored index of six pages with links, images and vectors."""
    html_of = lambda t, body: f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>{body}</p></body></html>"
    rows = [
        (1, "http://a.org/fox", html_of("Running foxes", 'The quick foxes jumped <a href="/dog">dog</a> <img src="/f.png" alt="a fox">')),
        (2, "http://a.org/dog", html_of("Lazy dogs", 'dogs sleep all day <a href="/fox">f</a> <a href="/none">n</a>')),
        (3, "http://b.org/x", html_of("Foxes again", 'foxes and dogs run <a href="http://a.org/fox/">f</a>')),
        *((i, f"http://c.org/{i}", html_of("Others", f"nothing number{i} dogs run here jumped")) for i in (4, 5, 6)),
    ]
    folder = str(tmp_path_factory.mktemp("site"))
    store.build_site(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, 4)
    out = store.build_pages(spark, folder, f"{folder}/words", buckets=4, min_df=1)
    texts = out.table("embed_texts")
    vectors.write_vectors(embed.embedded(texts, embed.hashed(16)).select("page_id", "embedding"), folder)
    pics = out.table("images").selectExpr("1L AS image_id", "url", "alt_text")
    embed.embedded(pics, embed.hashed(16), "alt_text").write.parquet(f"{folder}/image_vectors")
    return out


def test_answer(spark, small):
    got = search.answer(small, "The runing FOXES!", embed.hashed(16), page="1", page_size="2")
    assert got.corrected and got.full_q == ["the", "running", "foxes"] and got.q == ["running", "foxes"]
    assert got.total_results == 6 and (got.page, got.page_size) == (1, 2)
    rows = got.results.collect()
    assert [r.page_id for r in rows][0] == 1 and len(rows) == 2
    first = rows[0]
    assert {(t.term, t.df) for t in first.terms} <= {("run", 5), ("fox", 2)} and first.backlink_count == 2 and first.relevance_boost == 3.0
    import json

    said = json.loads(got.json().first().response)
    assert said["pagination"] == {"totalResults": 6, "page": 1, "pageSize": 2} and said["corrected"] is True and said["fullQ"] == got.full_q
    assert [x["id"] for x in said["results"]] == [r.page_id for r in rows]
    for bad in (None, "", "!", "the of"):
        with pytest.raises(search.BadRequest):
            search.answer(small, bad, embed.hashed(16))
    with pytest.raises(search.BadRequest):
        search.answer(small, "fox", embed.hashed(16), page="x")
    none = spark.createDataFrame([], "page_id long, embedding array<float>, norm double")
    gone = type("Gone", (store.Stored,), {"tables": lambda self, words, limit=None: {**store.Stored.tables(self, words, limit), "vectors": none}})(spark, small.folder, small.site)
    with pytest.raises(search.NotFound):
        search.answer(gone, "qqqqqqqqqqqqqqqqqqqqqqqqqqq", embed.hashed(16))


def test_answer_reads_its_words_only(small):
    plan = small.postings(["fox", "dog"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term, [" in plan
    assert small.posting("fox", 1).count() == 1


def test_images_and_links(spark, small):
    got = search.image_answer(small, "a fox", embed.hashed(16))
    assert [r.url for r in search.top_images(got).collect()] == ["http://a.org/f.png"]
    back, forward = search.links_answer(small, "1")
    assert [r.page_id for r in back.orderBy("page_id").collect()] == [2, 3] and [r.page_id for r in forward.collect()] == [2]
    _, forward = search.links_answer(small, "2")
    blank = [r for r in forward.collect() if r.page_id < 0]
    assert [(r.url, r.title) for r in blank] == [("http://a.org/none", None)]
    with pytest.raises(search.BadRequest):
        search.links_answer(small, "one")
    with pytest.raises(search.NotFound):
        search.links_answer(small, "5")
    assert {(r.source, r.target) for r in graph.ego_edges(small.table("links"), 1).collect()} == {(2, 1), (3, 1), (1, 2)}


def test_store_scan_insert_and_conform(spark, small):
    scan = store.full_scan(small)
    assert scan.columns == ["term", "page_id", "tf"] and scan.count() > 10
    row = store.insert_posting(small, "zzz", 1, 2.5).first()
    assert (row.term, row.page_id, row.tf) == ("zzz", 1, 2.5) and small.posting("zzz", 1).first().tf == 2.5
    assert store.conform(small.table("pages"), "idx_pages").columns == ["page_id", "url", "title", "heading", "embedding", "doc_length", "crawled_at"]


def test_embedding_batches(spark):
    def provider(texts):
        assert 0 < len(texts) <= 32
        return [[float(len(t)), float(len(texts))] for t in texts]

    rows = spark.createDataFrame([(i, None if i == 3 else " " if i == 5 else "x" * (i + 1)) for i in range(70)], "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in embed.embedded(rows, provider).collect()}
    assert got[3] is None and got[5] is None and got[9][0] == 10 and sorted({v[1] for v in got.values() if v}) == [4, 32]
    with pytest.raises(Exception, match="another number"):
        embed.embedded(rows, lambda texts: [[1.0]]).collect()


def test_queues(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://a/{i}") for i in range(9)], "seq long, url string")
    for _ in range(2):  # a batch that is pushed again replaces itself
        queues.push(spark, str(tmp_path), rows, 0, "seq")
    q = queues.entries(spark, str(tmp_path))
    assert queues.length(q) == 9 and queues.has_room(q, 10) and not queues.has_room(q, 9) and queues.members(q) == 9
    first = queues.front(q, 2, "seq")
    again, aside = queues.requeued(first)
    assert again.count() == 2 and aside.count() == 0
    queues.push(spark, str(tmp_path), again, 1, "seq")
    q = queues.entries(spark, str(tmp_path)).orderBy("batch", "seq")
    assert [(r.seq, r.tries) for r in q.collect()][-2:] == [(0, 1), (1, 1)]
    assert queues.requeued(q.filter("tries = 1"), 2)[1].count() == 2
    said = queues.encoded(spark.createDataFrame([("http://a", "<p>", "t", ["x"], {"i": "a"})], "url string, html string, title string, outgoing_links array<string>, image_map map<string,string>"))
    both = said.unionByName(spark.createDataFrame([("no json",)], "message string"))
    got = {r.url: r for r in queues.decoded(both).collect()}
    assert got["http://a"].outgoing_links == ["x"] and got["http://a"].image_map == {"i": "a"} and got[None].broken == "no json"


def test_cool_down_against_the_plain_rule(spark):
    import datetime
    import random

    rng = random.Random(3)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b"]), t0 + datetime.timedelta(seconds=rng.randrange(400)), rng.choice([200, 200, 429])) for i in range(300)]
    got = {r.id: r.blocked for r in crawl.cooled(spark.createDataFrame(rows, "id long, host string, ts timestamp_ntz, status int")).collect()}
    for i, h, t, _ in rows:
        before = [x for x in rows if x[1] == h and x[3] == 429 and (x[2], x[0]) < (t, i)]
        assert got[i] == any((t - x[2]).total_seconds() < 30 for x in before)


@pytest.mark.parametrize("stretch,in_turn", [(10, 5), (60, 100), (3600, 10**6)])
def test_rate_limit_against_a_plain_loop(spark, stretch, in_turn):
    """Dense, sparse and tied requests of a hot client and others; windows of 10 seconds."""
    import random

    rnd, rows = random.Random(stretch), []
    for i in range(1500):
        client = None if i % 11 == 0 else 7 if i % 3 else rnd.randrange(5)
        at = None if i % 97 == 0 else 1_700_000_000_000_000 + rnd.choice([rnd.randrange(400), rnd.randrange(20_000)]) * rnd.choice([1_000_000, 250_000])
        rows.append((i, client, at))
    want, state = {}, {}
    for i, client, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if client not in state or at >= state[client][0] + 10_000_000:
            state[client] = [at, 0]
        state[client][1] += 1
        want[i] = (client, state[client][0], state[client][1], state[client][1] <= 4)
    df = spark.createDataFrame(rows, "id long, client long, us long").selectExpr("id", "client", "timestamp_micros(us) AS ts")
    got = {r.id: (r.client, r.w, r.n, r.allowed) for r in crawl.limited(df, 4, 10, stretch, in_turn).selectExpr("*", "unix_micros(window_start) AS w").collect()}
    assert got == want and {x[3] for x in want.values()} == {True, False}
    assert crawl.limited(df.limit(0)).count() == 0


def test_metrics_and_log(spark, tmp_path):
    rec = spark.createDataFrame([("ERROR", "2024", "x", 5)], "metricType string, timestamp string, text string, duration_ms int")
    for _ in range(2):
        tables.write_metrics(rec, str(tmp_path / "m"))
    assert [tuple(r) for r in tables.read_metrics(spark, str(tmp_path / "m")).collect()] == [("ERROR", "2024", "x", 5)] * 2
    log = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.678' AS at, '1.2.3.4' AS client, 'GET' AS method, '/x' AS url, 200 AS status, 17 AS bytes, 1.5 AS ms UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL")
    assert sorted(r.line for r in tables.access_log(log).collect()) == ["- - - - - - - - ms", "2024-01-02T03:04:05.678Z 1.2.3.4 GET /x 200 17 - 1.500 ms"]


def test_tables_settings_and_session(spark, tmp_path):
    from lodeseek import schemas, session

    spark.sql(f"CREATE DATABASE engine LOCATION 'file://{tmp_path}/db'")
    try:
        for _ in range(2):  # those that exist stay
            schemas.create_tables(spark, "engine")
        assert {r.tableName for r in spark.sql("SHOW TABLES IN engine").collect()} == set(schemas.TABLES)
        assert [f.name for f in spark.table("engine.postings").schema] == ["term", "page_id", "tf"]
    finally:
        spark.sql("DROP DATABASE engine CASCADE")
    assert session.require({"a": "1", "b": ""}, "a") == {"a": "1"}
    with pytest.raises(KeyError, match="b"):
        session.require({"a": "1", "b": ""}, "a", "b")
    assert session.session() is spark or session.session().sparkContext is spark.sparkContext
    assert session.fresh_folder(spark, "x") != session.fresh_folder(spark, "x")


def test_messages_stream(spark, tmp_path):
    rec = spark.createDataFrame([("http://a", "<p>x</p>", "t", ["http://b"], {"i": "alt"})], "url string, html string, title string, outgoing_links array<string>, image_map map<string,string>")
    rec.write.json(f"{tmp_path}/in")
    q = tables.messages(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("messages").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("messages").collect() == rec.collect()
