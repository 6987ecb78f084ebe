import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import graph, search, spell, store, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pruned(df, column="bucket"):
    """Whether a partition filter on the column reaches the scan."""
    return re.search(r"PartitionFilters: \[[^\]]*" + column, plan(df)) is not None


def corpus(spark, n=600, seed=1):
    """Documents of ten common words, many rare ones and a few long documents, ids with gaps."""
    rnd = random.Random(seed)
    common, rare = [f"common{c}" for c in "abcdefghij"], [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = []
    for i in range(n):
        words = [rnd.choice(common[: 1 + i % 10]) for _ in range(rnd.randrange(1, 30))] + [rnd.choice(rare) for _ in range(rnd.randrange(4))]
        if i % 97 == 0:
            words += ["commonj"] * 40
        rows.append((i * 3 + 5, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def docs_index(spark, tmp_path_factory):
    return store.build_documents(corpus(spark), str(tmp_path_factory.mktemp("index")), block_df=40)


def test_an_index_is_opened_with_its_own_numbers(spark, tmp_path, docs_index, monkeypatch):
    docs = corpus(spark, 40)
    want = {r.page_id: r.tf for r in store.build_documents(docs, f"{tmp_path}/a").postings(["commona"]).collect()}
    for n in (1, 3, 50):
        store.build_documents(docs, f"{tmp_path}/b{n}", buckets=n)
        x = store.Stored(spark, f"{tmp_path}/b{n}")
        assert x.facts("postings")["buckets"] == n
        assert {r.page_id: r.tf for r in x.postings(["commona"]).collect()} == want
    with pytest.raises(ValueError, match="manifest"):
        store.Stored(spark, f"{tmp_path}/none").postings(["commona"])
    monkeypatch.setattr(store, "FORMAT", 99)
    with pytest.raises(ValueError, match="format"):
        store.manifest(spark, f"{tmp_path}/a")


def test_partitions_follow_the_rows_and_heavy_terms_are_split(spark, tmp_path, monkeypatch, docs_index):
    assert [store.bucket_count(n) for n in (0, 10**8, 10**9, 10**12)] == [8, 50, 500, store.MAX_BUCKETS]
    want = sorted(map(tuple, store.full_scan(docs_index).collect()))
    monkeypatch.setattr(store, "ROWS_A_BUCKET", 100)
    monkeypatch.setattr(store, "MAX_BUCKETS", 16)
    x = store.build_documents(corpus(spark), f"{tmp_path}/x")
    assert sorted(map(tuple, store.full_scan(x).collect())) == want and x.facts("postings")["buckets"] == 16
    files = lambda s, w: s.postings([w]).select(F.input_file_name().alias("f")).distinct().count()
    assert files(x, "commona") >= 4 and files(docs_index, "commona") == 1
    # a file holds a stretch of page ranges
    spans = sorted(tuple(r) for r in x.postings(["commona"]).groupBy(F.input_file_name()).agg(F.min("range").alias("a"), F.max("range").alias("b")).select("a", "b").collect())
    assert all(b < a for (_, b), (a, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("words", [["commonj"], ["commona", "commonj", "rareaa"], ["rareba", "rareca"], ["commonb", "none"], ["none"], ["commona", "commonb", "commonc"]])
@pytest.mark.parametrize("limit", [1, 10, 100])
def test_blocks_leave_the_best_pages(docs_index, words, limit):
    top = lambda post: [tuple(r) for r in search.bm25_top(search.posting_scores(post, docs_index.terms(words), None, docs_index.table("stats"), words), limit).collect()]
    kept, told = store.best_postings(docs_index, words, limit)
    assert top(kept) == top(docs_index.postings(words))
    assert all(a <= b for a, b in (told.ranges, told.blocks, told.postings))
    if words == ["commonj"] and limit == 1:
        assert told.ranges[0] > 0 and told.blocks[0] > 0 and told.postings[0] > 0
        assert "(range" in plan(kept).split("PushedFilters")[1]


def test_blocks_bound_negative_and_many_scores(spark, tmp_path):
    """A term in more than half of the pages scores below zero; a page without it is better than one with it."""
    rows = [(i, "all " * (1 + i % 7) + ("some " if i % 5 == 0 else "")) for i in range(700)]
    x = store.build_documents(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/n", block_df=10, stop_words=())
    for words in (["all"], ["all", "some"]):
        top = lambda post: [tuple(r) for r in search.bm25_top(search.posting_scores(post, x.terms(words), None, x.table("stats"), words), 20).collect()]  # noqa: E731,B023
        assert top(store.best_postings(x, words, 20)[0]) == top(x.postings(words))


def test_spelling_by_deletions_is_the_full_scan(spark, docs_index):
    vocab = {r.word for r in docs_index.vocabulary().collect()}
    rnd = random.Random(2)
    asked = ["common", "comonja", "xcommonb", "zzzzzzzz", "raraaa", "commonj", "the", "q", "commonabc", "reraab" * 9, "commno"]
    edit = lambda w, i: w[:i] + rnd.choice(["", w[i] + "x", "y"]) + w[i + 1 :]
    asked += [edit(edit(w, rnd.randrange(len(w))), 1) for w in rnd.sample(sorted(vocab), 25)]
    want = [r.corrected for r in spell.correct(spark.createDataFrame(list(enumerate(asked)), "pos long, word string"), docs_index.vocabulary()).orderBy("pos").collect()]
    got, scanned = spell.correct_stored(asked, docs_index)
    assert got == want and 0 < scanned < len(asked) / 2
    near = docs_index.some("deletes", "key", sorted(spell.keys_of("comonja")))
    assert pruned(near) and "In(key, [" in plan(near)


def test_deletions_are_what_two_edits_share(spark):
    words = ["abc", "a", "", "aab", "abcd"]
    got = {}
    for r in spell.deletions(spark.createDataFrame([(w,) for w in words], "word string")).collect():
        got.setdefault(r.word, []).append(r.key)
    assert {w: sorted(k) for w, k in got.items()} == {w: sorted(spell.keys_of(w)) for w in words}


def test_a_posting_put_in_by_hand_is_found_once(spark, tmp_path):
    x = store.build_documents(corpus(spark, 60), f"{tmp_path}/x", block_df=2)
    for i, page in enumerate((5, 8, 11, 11)):
        row = store.insert_posting(x, "byhand", page, 2.5).first()
        assert (row.term, row.page_id, row.tf) == ("byhand", page, 2.5)
        assert x.terms(["byhand"]).first().df == min(i + 1, 3)
    assert store.insert_posting(x, "byhand", 11, 9.0).first().tf == 2.5
    x = store.Stored(spark, f"{tmp_path}/x")
    assert x.postings(["byhand"]).count() == 3 and [r.word for r in x.vocabulary([6]).filter("word = 'byhand'").collect()] == ["byhand"]
    assert spell.correct_stored(["byhnad"], x)[0] == ["byhand"]
    post, _ = store.best_postings(x, ["byhand"], 10)
    assert {r.page_id for r in search.bm25_top(search.posting_scores(post, x.terms(["byhand"]), None, x.table("stats"), ["byhand"]), 10).collect()} == {5, 8, 11}


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("site"))
    page = lambda i, links: (i, f"http://a.org/{i}", "<html><body><p>words here</p>" + "".join(f'<a href="/{j}">x</a>' for j in links) + "</body></html>")
    rows = [page(i, [0, (i * 7) % 300]) for i in range(300)] + [(400, "http://A.org/7/#x", "<p>the last of its URL</p>")] * 2
    store.build_site(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    return store.Stored(spark, folder)


def test_links_are_read_by_either_end(spark, site):
    links = {(r.from_page_id, r.to_page_id) for r in site.table("links").collect()}
    for i in (0, 5, 400, 10**6):
        assert {(r.from_page_id, r.to_page_id) for r in site.links_from(i).collect()} == {x for x in links if x[0] == i}
        assert {(r.from_page_id, r.to_page_id) for r in site.links_to(i).collect()} == {x for x in links if x[1] == i}
        assert {(r.from_page_id, r.to_page_id) for r in graph.around(site, i).collect()} == {x for x in links if i in x}
    assert pruned(site.links_to(0)) and pruned(site.links_from(0))


def test_hubs_are_split(spark, site, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROWS_A_BUCKET", 50)
    store.write_links(site.table("links"), str(tmp_path), 8)
    x = store.Stored(spark, str(tmp_path))
    hub = x.links_to(0)
    assert hub.select(F.input_file_name().alias("f")).distinct().count() >= 3
    assert sorted(map(tuple, hub.select("from_page_id", "to_page_id").collect())) == sorted(map(tuple, site.links_to(0).select("from_page_id", "to_page_id").collect()))


def test_last_page_of_a_url_stays_once(site):
    assert [r.page_id for r in site.table("pages").filter("url = 'http://A.org/7' OR url = 'http://a.org/7'").collect()] == [400]


def test_search_reads_its_pages_only(spark, docs_index, site):
    """With broadcasts by size off, as on large tables, neither pages nor backlinks are shuffled."""
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(300)]
    vec = spark.createDataFrame(rows, "page_id long, embedding array<float>").withColumn("norm", F.sqrt(F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)")))
    q = spark.createDataFrame([([1.0, 2.0, 3.0],)], "q array<double>")
    x = store.Stored(spark, docs_index.folder, site.folder)
    words = ["commona", "rareaa"]
    tables = {"postings": x.postings(words), "terms": x.terms(words), "stats": x.table("stats"), "vectors": vec, "backlinks": x.by_ids("backlinks"), "pages": x.by_ids("pages")}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fused = search.fused_list(tables, words, q, 100)
        out = search.shown_page(fused, tables["pages"], words, 1, 10)
        for df in (fused, out):
            assert "Exchange hashpartitioning" not in plan(df) and "SortMergeJoin" not in plan(df) and pruned(df)
        got = [tuple(r) for r in out.select("page_id", "url", "pos", "backlink_count").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    whole = {**tables, "backlinks": x.table("backlinks"), "pages": x.table("pages")}
    again = search.search(whole, words, q)
    assert [tuple(r) for r in again.select("page_id", "url", "pos", "backlink_count").collect()] == got and len(got) == 10


# Vectors ----------------------------------------------------------------------------------------


def clustered(n=4000, dim=24, k=40, seed=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(k, dim))
    return centres[rnd.integers(0, k, n)] + 0.25 * rnd.normal(size=(n, dim))


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("vectors"))
    x = clustered()
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 24)]
    vectors.write_vectors(spark.createDataFrame(rows, "page_id long, embedding array<float>"), folder)
    return store.Stored(spark, folder), x.astype(np.float32).astype(float)


def exact(x, q, k, leave=None):
    s = 1 - (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
    order = [int(i) for i in np.lexsort((np.arange(len(x)), s)) if i != leave]
    return order[:k]


def test_recall_and_files_of_probed_cells(spark, cells):
    stored, x = cells
    about = stored.facts("vectors")
    assert about["recall"] >= vectors.RECALL and about["probes"] < about["cells"] / 2
    asked = [i for i in range(len(x)) if i % 100 == 0]
    q = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in asked], "query_id long, q array<double>")
    got = {}
    for r in vectors.nearest_to_all(stored, q, 50).collect():
        got.setdefault(r.query_id, []).append(r.page_id)
    found = np.mean([len(set(got[i]) & set(exact(x, x[i], 50, i))) / 50 for i in asked])
    assert found >= 0.9
    near = vectors.nearest_ann(stored, list(x[0]), 10)
    assert [r.page_id for r in near.collect()] == exact(x, x[0], 10)
    files = len({f.rsplit("/", 2)[-2] for f in stored.table("vectors").filter(F.col("cell").isin(*vectors.probed(stored, list(x[0])))).select(F.input_file_name().alias("f")).distinct().toPandas().f})
    assert files <= about["probes"] < about["cells"] and pruned(near, "cell")
    # every vector is stored, those without a direction too, and the exact path stays
    assert stored.table("vectors").count() == len(x) + 2 and stored.table("vectors").filter(F.col("cell") == vectors.NOWHERE).count() == 2
    one = spark.createDataFrame([([float(c) for c in x[100]],)], "q array<double>")
    assert [r.page_id for r in search.nearest(stored.table("vectors"), one, 30, "page_id").collect()] == exact(x, x[100], 30)


def test_all_probes_are_the_exact_search(spark, cells):
    stored, x = cells
    n = stored.facts("vectors")["cells"]
    q = spark.createDataFrame([(7, [float(c) for c in x[7]]), (-1, [0.0] * 24), (-2, None)], "query_id long, q array<double>")
    got = sorted((r["rank"], r.page_id) for r in vectors.nearest_to_all(stored, q, 20, n).collect())
    assert [p for _, p in got] == exact(x, x[7], 20, 7)


def test_vectors_few_none_and_alike(spark, tmp_path):
    for name, rows in (("none", []), ("null", [(1, None)]), ("alike", [(i, [1.0, 2.0]) for i in range(50)])):
        vectors.write_vectors(spark.createDataFrame(rows, "page_id long, embedding array<float>"), f"{tmp_path}/{name}")
    alike = store.Stored(spark, f"{tmp_path}/alike")
    assert [r.page_id for r in vectors.nearest_ann(alike, [2.0, 4.0], 5).collect()] == [0, 1, 2, 3, 4]


def test_recall_of_the_registered_search(spark):
    from lodeseek.plans import catalog

    sf = "/root/testdata/sf0.01"
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None}
    ids, x = np.array(list(rows)), np.array(list(rows.values()))
    got = {}
    for r in catalog.queries()["cosine_ann_all"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [i for i in range(len(ids)) if ids[i] % 100 == 0]
    found = [len(got[ids[i]] & {int(ids[j]) for j in exact(x, x[i], 10, i)}) / 10 for i in asked]
    assert set(got) == {ids[i] for i in asked} and np.mean(found) >= 0.9
