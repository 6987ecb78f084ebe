from pyspark.sql import functions as F

from lodeseek.operators import index, store
from lodeseek.plans import catalog
from lodeseek.streaming import ingest


def files(spark, sf_dir, tmp_path, name, key, n):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for r in range(n):
        df.filter(F.col(key) % n == r).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df


def rows(df):
    return sorted(map(str, df.collect()))


def test_batches_that_run_again_change_nothing(spark, sf_dir, tmp_path):
    p = files(spark, sf_dir, tmp_path, "pages", "page_id", 3)
    sink = f"{tmp_path}/index"
    ingest.index_stream(spark, f"{tmp_path}/in", p.schema, sink, f"{tmp_path}/state", files_per_batch=1, pages=True)
    read = lambda: [rows(x) for x in (ingest.terms(spark, sink), ingest.vocabulary(spark, sink), ingest.stats(spark, sink), ingest.links(spark, sink))]
    first = read()
    assert spark.read.parquet(f"{sink}/sums").count() == 3
    # a batch after a failure: the same rows with the same number
    seen = spark.read.parquet(f"{sink}/parsed").filter("batch = 1").select("page_id")
    ingest.index_pages(p.join(seen, "page_id", "left_semi"), 1, sink)
    assert read() == first
    # the stream itself, started again, has nothing to do; a new file is one batch more
    ingest.index_stream(spark, f"{tmp_path}/in", p.schema, sink, f"{tmp_path}/state", files_per_batch=1, pages=True)
    assert read() == first
    p.limit(1).withColumns({"page_id": F.lit(10**6).cast("long"), "url": F.lit("http://new.org/")}).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.index_stream(spark, f"{tmp_path}/in", p.schema, sink, f"{tmp_path}/state", files_per_batch=1, pages=True)
    assert ingest.stats(spark, sink).first().total_documents == p.select(catalog.urls.normalized(F.col("url"))).distinct().count() + 1


def test_streams_terms_are_the_index_terms(spark, sf_dir, tmp_path):
    d = files(spark, sf_dir, tmp_path, "documents", "doc_id", 4)
    ingest.index_stream(spark, f"{tmp_path}/in", d.schema, f"{tmp_path}/index", f"{tmp_path}/state", files_per_batch=2)
    assert rows(ingest.terms(spark, f"{tmp_path}/index")) == rows(index.terms(index.postings(catalog.tokens(spark, sf_dir))))


def test_later_versions_replace_earlier_ones(spark, tmp_path):
    """Documents that come again in later batches: totals, postings and the stored index are those of the last versions."""
    import random

    rnd = random.Random(9)
    schema, last = "doc_id long, text string", {}
    for b in range(4):
        said = {rnd.randrange(40): " ".join(rnd.choice(["running", "runs", "fox", "foxes", "dogs", "batch" + "abcd"[b], "a", "the"]) for _ in range(rnd.randrange(6))) for _ in range(25)}
        if b == 2:
            said |= {39: None, 38: ""}
        last |= said
        spark.createDataFrame(list(said.items()), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sink = f"{tmp_path}/index"
    ingest.index_stream(spark, f"{tmp_path}/in", schema, sink, f"{tmp_path}/state", files_per_batch=1, stems=True)
    assert spark.read.parquet(f"{sink}/tombstones").count() > 20
    whole = store.build_documents(spark.createDataFrame(list(last.items()), schema), f"{tmp_path}/whole", stems=True)
    want = [rows(whole.all_terms()), rows(whole.vocabulary().select("word", "stem")), rows(whole.table("stats")), rows(store.full_scan(whole))]
    assert [rows(ingest.terms(spark, sink)), rows(ingest.vocabulary(spark, sink)), rows(ingest.stats(spark, sink)), rows(ingest.postings(spark, sink))] == want
    out = ingest.compacted(spark, sink, f"{tmp_path}/stored")
    assert [rows(out.all_terms()), rows(out.vocabulary().select("word", "stem")), rows(out.table("stats")), rows(store.full_scan(out))] == want
    # the last batch, run again, replaces itself
    batch = spark.createDataFrame([(0, "fox"), (100, "dogs")], schema)
    ingest.index_documents(batch, 4, sink, stems=True)
    again = [rows(ingest.terms(spark, sink)), rows(ingest.stats(spark, sink))]
    ingest.index_documents(batch, 4, sink, stems=True)
    assert [rows(ingest.terms(spark, sink)), rows(ingest.stats(spark, sink))] == again


def test_a_page_that_comes_again_leaves_one_set(spark, tmp_path):
    page = lambda i, url, body: (i, url, f"<html><head><title>t</title></head><body><h1>head{i}</h1><p>{body}</p></body></html>")
    batches = [
        [page(1, "http://a.org/x", 'common old <a href="/gone">g</a>'), page(2, "http://a.org/y", 'common <a href="/x">x</a>')],
        [page(1, "http://a.org/x", 'common new <a href="/y">y</a>'), page(7, "http://A.org/y/#z", "common moved")],
    ]
    sink, schema = f"{tmp_path}/index", "page_id long, url string, html string"
    for i, rows_ in enumerate(batches):
        ingest.index_pages(spark.createDataFrame(rows_, schema), i, sink)
    assert ingest.stats(spark, sink).first().total_documents == 2
    df = {r.term: r.df for r in ingest.terms(spark, sink).collect()}
    assert df["common"] == 2 and "old" not in df and df["new"] == df["move"] == 1
    assert sorted((r.term, r.page_id) for r in ingest.postings(spark, sink).collect() if r.term == "common") == [("common", 1), ("common", 7)]
    assert sorted(tuple(r) for r in ingest.links(spark, sink).collect()) == [(1, 7)]


def test_first_seen_and_running_stats(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_length long, k string").withColumn("at", F.to_timestamp(F.lit("2024-01-01")))
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("seen1", ingest.first_seen(stream(), "k"), "append"), ("seen2", ingest.first_seen(stream(), "k", "at"), "append"), ("stats", ingest.running_stats(stream()), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen1").count() == spark.table("seen2").count() == 2
    assert tuple(spark.table("stats").first()) == (3, 2.0)


def test_waiting_rows_are_flushed_at_an_interval(spark, sf_dir, tmp_path):
    d = files(spark, sf_dir, tmp_path, "documents", "doc_id", 2)
    q = ingest.started(spark, f"{tmp_path}/in", d.schema, lambda b, i: ingest.index_documents(b, i, f"{tmp_path}/index"), f"{tmp_path}/state", 1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert ingest.stats(spark, f"{tmp_path}/index").first().total_documents == d.count()
