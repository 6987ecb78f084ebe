"""Micro-batch indexing of document and page files, as an upsert.

A document is known by its id, a page by its normalised URL; what comes again replaces what was there. A batch
writes its own folders, named by its number, from its rows and from what earlier batches wrote, so one that runs
again after a failure replaces itself and changes nothing. Rows of earlier batches are never rewritten: a batch
leaves a tombstone (page and batch) for each version that it replaces, and takes back what that version had
added to the totals. Totals (terms, words, statistics) are kept as a row a batch and key, some of them negative,
and are added up when they are read; postings and links are read without what tombstones name. compacted() writes all
of it as one stored index.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import ids, index, store

#: The interval at which waiting rows are flushed.
FLUSH = "500 milliseconds"


def _write(df: DataFrame, sink: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{sink}/{name}/batch={batch_id}")


def _own(spark: SparkSession, sink: str, name: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{sink}/{name}/batch={batch_id}")


def _all(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """All batches of a table, with batch."""
    return spark.read.option("basePath", f"{sink}/{name}").parquet(f"{sink}/{name}")


def _earlier(spark: SparkSession, sink: str, name: str, batch_id: int) -> DataFrame | None:
    """The batches before one; None where there is none."""
    try:
        return _all(spark, sink, name).filter(F.col("batch") < batch_id)
    except AnalysisException:
        return None


def _replace(versions: DataFrame, sink: str, batch_id: int) -> DataFrame | None:
    """Writes a batch's versions (key, page_id) and the tombstones (page_id, generation) of those that they replace; returns these if there are any.

    The live version of a key is that of the latest batch.
    """
    spark = versions.sparkSession
    _write(versions, sink, "versions", batch_id)
    new = _own(spark, sink, "versions", batch_id)
    before = _earlier(spark, sink, "versions", batch_id)
    old = spark.createDataFrame([], "page_id long, generation int")
    if before is not None:
        last = before.join(new.select("key"), "key", "left_semi").groupBy("key").agg(F.max(F.struct(F.col("batch").cast("int").alias("generation"), "page_id")).alias("x"))
        old = last.select("x.page_id", "x.generation")
    _write(old, sink, "tombstones", batch_id)
    gone = _own(spark, sink, "tombstones", batch_id)
    return None if gone.isEmpty() else gone


def _retracted(spark: SparkSession, sink: str, name: str, batch_id: int, gone: DataFrame) -> DataFrame:
    """What the replaced versions had in a table."""
    old = _earlier(spark, sink, name, batch_id)
    return old.join(gone.withColumnRenamed("generation", "batch"), ["page_id", "batch"], "left_semi").drop("batch")


def _delta(new: DataFrame, old: DataFrame | None, keys: list[str], count: str) -> DataFrame:
    """Rows a key that come less rows that go; keys without a change are left out."""
    rows = new.select(*keys, F.lit(1).alias("__d"))
    if old is not None:
        rows = rows.unionByName(old.select(*keys, F.lit(-1).alias("__d")))
    return rows.groupBy(*keys).agg(F.sum("__d").alias(count)).filter(F.col(count) != 0)


def index_documents(batch: DataFrame, batch_id: int, sink: str, stems: bool = False, key: str = "doc_id", column: str = "text") -> None:
    """Postings, lengths, terms, words and statistics of a batch of documents (an id once in a batch); its texts are read once."""
    spark = batch.sparkSession
    gone = _replace(batch.select(F.col(key).cast("string").alias("key"), F.col(key).alias("page_id")).filter("key IS NOT NULL").distinct(), sink, batch_id)
    counts = index.document_counts(batch, key, column).drop("doc_length")
    if not batch.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():  # only then counts move
        counts = counts.groupBy("page_id", "word", "weight").agg(F.sum("n").alias("n"))
    _write(counts, sink, "counts", batch_id)
    counts = _own(spark, sink, "counts", batch_id)
    _write_words(counts, counts.groupBy("page_id").agg(F.sum("n").alias("doc_length")), sink, batch_id, gone, stems, True)


def _write_words(counts: DataFrame, lengths: DataFrame, sink: str, batch_id: int, gone: DataFrame | None, stems: bool = True, single: bool = False) -> None:
    """single: counts have a row for each page and word, so that without stems they are the postings."""
    spark = counts.sparkSession
    old = lambda name: None if gone is None else _retracted(spark, sink, name, batch_id, gone)
    pages = lambda df: None if df is None else df.select("page_id", "word") if single else df.select("page_id", "word").distinct()
    every = counts.select("word") if gone is None else counts.select("word").unionByName(old("counts").select("word"))
    _write(store.word_stems(every, stems), sink, "stems", batch_id)  # each word is stemmed once
    known = _own(spark, sink, "stems", batch_id)
    _write(_delta(pages(counts), pages(old("counts")), ["word"], "n").join(known, "word"), sink, "words", batch_id)
    if single and not stems:
        _write(counts.select(F.col("word").alias("term"), "page_id", (F.col("weight") * F.col("n")).cast("float").alias("tf")), sink, "postings", batch_id)
    else:
        _write(index.postings(counts.join(known, "word"), "stem"), sink, "postings", batch_id)
    _write(_delta(_own(spark, sink, "postings", batch_id), old("postings"), ["term"], "df"), sink, "terms", batch_id)
    _write(lengths, sink, "lengths", batch_id)
    rows = _own(spark, sink, "lengths", batch_id).select(F.lit(1).alias("d"), "doc_length")
    if gone is not None:
        rows = rows.unionByName(old("lengths").select(F.lit(-1).alias("d"), "doc_length"))
    sums = rows.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("d") * F.col("doc_length")), F.lit(0)).alias("total"))
    _write(sums, sink, "sums", batch_id)


def index_pages(batch: DataFrame, batch_id: int, sink: str, dictionary: str | None = None) -> None:
    """The same of a batch of HTML pages, and its pages and links.

    Of several pages of a batch with one URL the one with the greatest id stays. With a dictionary's folder, pages and
    link targets have their ids from there, so that a page keeps the one that links to it had before it came; without,
    targets get the ids of blank pages until they are indexed.
    """
    spark = batch.sparkSession
    parsed = html.parsed(batch).withColumn("url", urls.normalized(F.col("url"))).filter("url IS NOT NULL")
    parsed = index.latest(parsed, "url", "page_id")
    if dictionary:
        _write(parsed, sink, "read", batch_id)
        parsed = _own(spark, sink, "read", batch_id)
        named = parsed.select("url").unionByName(index.links_found(parsed).select(F.col("to_url").alias("url")))
        ids.assign(spark, dictionary, named, batch_id)
        parsed = parsed.drop("page_id").join(ids.known(spark, dictionary), "url")
    _write(parsed, sink, "parsed", batch_id)
    seen = _own(spark, sink, "parsed", batch_id)
    gone = _replace(seen.select(F.col("url").alias("key"), "page_id"), sink, batch_id)
    _write(index.page_word_counts(seen), sink, "counts", batch_id)
    _write_words(_own(spark, sink, "counts", batch_id), index.page_lengths(seen), sink, batch_id, gone)
    _write(seen.select("page_id", "url", "title", index.heading_of(F.col("texts")).alias("heading")), sink, "pages", batch_id)
    _write(index.links_found(seen), sink, "targets", batch_id)


def started(spark: SparkSession, source: str, schema, write, checkpoint: str, files_per_batch: int = 10, flush: str | None = FLUSH):
    """A running query that feeds the files of a folder to write(batch, batch_id): ever more at an interval, or without one those that are there."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=flush) if flush else out.trigger(availableNow=True)).start()


def index_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, files_per_batch: int = 10, pages: bool = False, stems: bool = False) -> None:
    """Indexes every file that is there, batch by batch, below sink."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if pages:
            index_pages(batch, batch_id, sink)
        else:
            index_documents(batch, batch_id, sink, stems)

    started(spark, source, schema, write, checkpoint, files_per_batch, None).awaitTermination()


def live(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """A table by page (page_id, ...) without the versions that were replaced."""
    gone = _all(spark, sink, "tombstones").select("page_id", F.col("generation").alias("batch"))
    return _all(spark, sink, name).join(gone, ["page_id", "batch"], "left_anti").drop("batch")


def postings(spark: SparkSession, sink: str) -> DataFrame:
    """(term, page_id, tf) of the pages as they are now."""
    return live(spark, sink, "postings").select("term", "page_id", "tf")


def terms(spark: SparkSession, sink: str) -> DataFrame:
    """(term, df) over all batches."""
    return spark.read.parquet(f"{sink}/terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def vocabulary(spark: SparkSession, sink: str, min_df: int = store.MIN_WORD_DF) -> DataFrame:
    words = spark.read.parquet(f"{sink}/words").groupBy("word", "stem").agg(F.sum("n").alias("n")).filter("n > 0")
    return index.vocabulary(words, terms(spark, sink), min_df)


def stats(spark: SparkSession, sink: str) -> DataFrame:
    """(total_documents, avg_doc_length) from a row a batch."""
    got = spark.read.parquet(f"{sink}/sums").agg(F.sum("n").alias("n"), F.sum("total").alias("t"))
    return got.select(F.coalesce("n", F.lit(0)).alias("total_documents"), F.coalesce(F.try_divide(F.col("t").cast("double"), F.col("n")), F.lit(0.0)).alias("avg_doc_length"))


def links(spark: SparkSession, sink: str, dictionary: str | None = None) -> DataFrame:
    """(from_page_id, to_page_id): targets by their ids in a dictionary; without one those that are pages of any batch by their ids, others by those of blank pages."""
    if dictionary:
        return index.edges(live(spark, sink, "targets"), ids.known(spark, dictionary))
    pages = live(spark, sink, "pages").select(F.col("page_id").alias("to_page_id"), F.col("url").alias("to_url"))
    found = live(spark, sink, "targets").join(pages, "to_url", "left")
    return found.select(F.col("page_id").alias("from_page_id"), F.coalesce("to_page_id", index.blank_id(F.col("to_url"))).alias("to_page_id")).distinct()


def compacted(spark: SparkSession, sink: str, folder: str, **kw) -> store.Stored:
    """What all batches hold now, as one stored index that searches read."""
    return store.build(live(spark, sink, "counts"), folder, live(spark, sink, "lengths"), **kw)


def first_seen(stream: DataFrame, key: str, time: str | None = None, keep: str = "1 day") -> DataFrame:
    """A stream's first row of each key. With a time column, keys are remembered for so long, else for ever."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def running_stats(stream: DataFrame) -> DataFrame:
    """Count and mean of doc_length so far (output mode complete)."""
    return stream.agg(F.count(F.lit(1)).alias("total_documents"), F.avg("doc_length").alias("avg_doc_length"))
