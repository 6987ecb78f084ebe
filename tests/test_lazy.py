import random

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import html
from lodeseek.operators import index, store
from lodeseek.plans import catalog
from lodeseek.streaming import ingest


def corpus(spark, n):
    rnd = random.Random(n)
    rows = [(i * 3 + 5, " ".join(rnd.choice(("commona", "commonb", "likes", "liked", f"rare{i % 40}")) for _ in range(rnd.randrange(1, 30)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_counts_of_rows_are_those_of_the_words_without_a_shuffle(spark, tmp_path):
    rows = [(1, "The Straße İstanbul \u212Aelvin kelvin KELVIN ab-ab a x1"), (2, None), (3, ""), (4, "w" * 3000 + " w9 w9"), (2, "late word"), (2, "late again"), (None, "no id"), (None, "id id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = index.document_tokens(docs).groupBy("page_id", "term").agg(F.count(F.lit(1))).collect()
    got = store.count_documents(docs, f"{tmp_path}/c")
    same = lambda x: sorted(map(repr, map(tuple, x)))
    assert same(got.select("page_id", "word", "n").collect()) == same(want)
    whole = index.doc_lengths(index.document_tokens(docs)).collect()
    assert same(got.select("page_id", "doc_length").distinct().collect()) == same(whole)
    assert "Exchange" not in index.document_counts(docs)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stems", [False, True])
def test_a_lazy_index_writes_what_is_asked_for_and_is_the_same(spark, tmp_path, stems):
    docs = corpus(spark, 120)
    whole, lazy = (store.build_documents(docs, f"{tmp_path}/{kind}", stems, block_df=10, lazy=kind) for kind in (False, True))
    assert not whole.steps
    assert sorted(map(tuple, lazy.postings(["commona"]).collect())) == sorted(map(tuple, whole.postings(["commona"]).collect()))
    assert {"terms", "blocks", "vocab", "deletes"} <= set(lazy.steps)
    lazy.finish()
    for name in ("words", "lengths", "stats", "postings", "terms", "blocks", "vocab", "deletes"):
        assert sorted(map(tuple, lazy.table(name).collect())) == sorted(map(tuple, whole.table(name).collect()))


def test_a_lookup_needs_no_page_and_no_vector(spark):
    sf = "/root/testdata/sf0.001"
    catalog._SITES.clear()
    catalog.queries()["posting_lookup"](spark, sf).collect()
    catalog.queries()["bm25_posting"](spark, sf).collect()
    assert {"parsed", "pages", "vectors"} <= set(catalog.site_index(spark, sf).steps)
    catalog.queries()["tag_doc_length"](spark, sf).collect()
    assert {"words", "postings", "deletes"} <= set(catalog.pages_index(spark, sf).steps)


def test_each_word_is_stemmed_once(spark):
    counts = spark.createDataFrame([("likes",), ("likes",), ("s",)], "word string")
    words = store.word_stems(counts, True, 2)
    tree = words._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in words.collect()] == [("likes", "like")]
    assert tree.count("ArrowEvalPython") == 1 and tree.index("ArrowEvalPython") < tree.index("HashAggregate")  # above the distinct


def test_workers_get_bounded_batches_of_pages(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    html.with_tag_texts(spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string"))
    assert int(spark.conf.get(name)) <= 1000
    spark.conf.set(name, before)


def test_batches_of_a_stream_are_as_many_files_as_they_come_in(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")).repartition(4)
    catalog._fed(spark, str(tmp_path), (rows, rows.withColumn("text", F.lit("fresh words"))))
    assert len(list(tmp_path.glob("in/*.parquet"))) == 8
    assert {p.name for p in tmp_path.glob("index/sums/*")} == {"batch=0", "batch=1"}
    assert tuple(ingest.stats(spark, f"{tmp_path}/index").first()) == (40, 2.0)
