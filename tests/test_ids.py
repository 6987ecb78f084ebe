import random

from pyspark.sql import functions as F

from lodeseek.operators import ids
from lodeseek.streaming import ingest


def urls_of(spark, names):
    return spark.createDataFrame([(u,) for u in names], "url string")


def table(df):
    return {r.url: r.page_id for r in df.collect()}


def test_ids_are_dense_kept_and_the_same_when_run_again(spark, tmp_path):
    rnd, folder, seen = random.Random(6), str(tmp_path), {}
    for b in range(3):
        names = [f"http://a.org/{rnd.randrange(300)}" for _ in range(120)] + [None]
        new = table(ids.assign(spark, folder, urls_of(spark, names), b))
        assert set(new) == set(names) - set(seen) - {None}
        assert sorted(new.values()) == list(range(len(seen), len(seen) + len(new)))
        seen |= new
        assert table(ids.known(spark, folder)) == seen
    assert table(ids.assign(spark, folder, urls_of(spark, names), 2)) == new and table(ids.known(spark, folder)) == seen
    some = sorted(seen)[:2]
    got = ids.look_up(spark, folder, [*some, "http://no/"])
    assert table(got) == {u: seen[u] for u in some}
    p = got._jdf.queryExecution().executedPlan().toString()
    assert "digits" in p.split("PartitionFilters: [")[1].split("]")[0]
    assert ids.look_up(spark, folder, []).count() == 0


def test_a_frontier_lets_each_url_through_once(spark, tmp_path):
    rnd, given = random.Random(8), []
    for run in range(2):  # the query starts twice on one checkpoint
        for _ in range(2):
            names = [f"HTTP://a.org:80/{rnd.randrange(40)}{rnd.choice(['', '/', '#x'])}" for _ in range(30)]
            urls_of(spark, names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ids.frontier(spark, f"{tmp_path}/in", "url string", f"{tmp_path}/seen", f"{tmp_path}/state", lambda new, b: given.extend(r.url for r in new.collect()), 1)
    assert len(given) == len(set(given)) > 25 and all(u.startswith("http://a.org/") for u in given)
    assert sorted(given) == sorted(table(ids.known(spark, f"{tmp_path}/seen")))
    # nothing of what was seen is in the query's own state
    assert not (tmp_path / "state" / "state").exists()


def test_a_page_keeps_the_id_that_links_to_it_had(spark, tmp_path):
    page = lambda i, url, to: (i, url, f'<html><body><p>words <a href="{to}">x</a></p></body></html>')
    sink, names, schema = f"{tmp_path}/index", f"{tmp_path}/ids", "page_id long, url string, html string"
    ingest.index_pages(spark.createDataFrame([page(900, "http://a.org/x", "/y"), page(901, "http://a.org/w", "/y")], schema), 0, sink, names)
    before = table(ids.known(spark, names))
    first = sorted(map(tuple, ingest.links(spark, sink, names).collect()))
    ingest.index_pages(spark.createDataFrame([page(5, "http://a.org/y", "/x")], schema), 1, sink, names)
    after = table(ids.known(spark, names))
    assert before.items() <= after.items() and set(before) == {f"http://a.org/{c}" for c in "xyw"}
    y = before["http://a.org/y"]
    assert {r.page_id for r in ingest.live(spark, sink, "pages").filter("url = 'http://a.org/y'").collect()} == {y}
    links = sorted(map(tuple, ingest.links(spark, sink, names).collect()))
    assert set(first) <= set(links) and len([1 for _, b in links if b == y]) == 2
    # a later version of a page has the same id and leaves one set of postings
    ingest.index_pages(spark.createDataFrame([page(77, "http://a.org/x/", "/w")], schema), 2, sink, names)
    assert ingest.postings(spark, sink).filter(F.col("page_id") == before["http://a.org/x"]).groupBy("term").count().filter("count > 1").count() == 0
    assert ingest.stats(spark, sink).first().total_documents == 3
