"""A stored dictionary of URLs: which were seen, and the id of each, which it keeps.

URLs are dealt out by the first hex digits of their md5, in folders by batch and digits. A batch is compared with
the digits that it touches only, and hands out ids to its new URLs: those of earlier batches are counted, each group
of digits begins where the groups before it end, and within a group URLs stand in order. So no id depends on a sort of
all URLs, and a batch that runs again gives the same ids. Files carry Bloom filters of the URLs, so that a look for one
URL passes over files without it. A frontier that is fed from a stream keeps no state in the query: what was seen is here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from . import store

#: Hex digits of a new dictionary: 2 are 256 groups, each sorted by one task.
DIGITS = 2
#: URLs that a task places, about.
URLS_A_TASK = 10_000
_URLS = "url string, page_id long, digits string"


def digits_of(url: Column, n: int) -> Column:
    return F.substring(F.md5(url.cast("binary")), 1, n)


def _digits(spark: SparkSession, folder: str, wanted: int) -> int:
    """How many digits a dictionary has; a new one takes what is wanted."""
    try:
        return store.manifest(spark, folder)["urls"]["digits"]
    except ValueError:
        store.record(spark, folder, "urls", digits=wanted)
        return wanted


def every(spark: SparkSession, folder: str) -> DataFrame:
    """(url, page_id, batch, digits) of all URLs."""
    try:
        return spark.read.schema(f"{_URLS}, batch int").option("basePath", f"{folder}/urls").parquet(f"{folder}/urls")
    except AnalysisException:
        return spark.createDataFrame([], f"{_URLS}, batch int")


def assign(spark: SparkSession, folder: str, found: DataFrame, batch_id: int, digits: int = DIGITS) -> DataFrame:
    """Hands out ids to the URLs (url) that no earlier batch had, and returns these (url, page_id). Null URLs have none."""
    n = _digits(spark, folder, digits)
    new = found.select("url").filter("url IS NOT NULL").distinct().withColumn("digits", digits_of(F.col("url"), n))
    groups = {r.digits: r.n for r in new.groupBy("digits").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 16 ** digits
    touched = list(groups)
    tasks = max(1, min(len(groups), sum(groups.values()) // URLS_A_TASK))
    before = every(spark, folder).filter(F.col("batch") < batch_id)
    base = before.count()
    new = new.join(before.filter(F.col("digits").isin(*touched)).select("url"), "url", "left_anti")
    own = Window.partitionBy("digits").orderBy("url")
    placed = new.repartition(tasks, "digits").withColumn("place", F.row_number().over(own))
    placed.write.mode("overwrite").parquet(f"{folder}/placed/batch={batch_id}")
    placed = spark.read.parquet(f"{folder}/placed/batch={batch_id}")
    sizes = placed.groupBy("digits").agg(F.count(F.lit(1)).alias("n"))
    begins = sizes.withColumn("begin", F.sum("n").over(Window.orderBy("digits")) - F.col("n")).select("digits", "begin")  # at most 16 ** digits rows
    out = placed.join(F.broadcast(begins), "digits").select("url", (F.lit(base) + F.col("begin") + F.col("place") - 1).cast("long").alias("page_id"), "digits")
    out = out.repartition(tasks, "digits").sortWithinPartitions("digits", "url")
    filtered = out.write.mode("overwrite").option("parquet.bloom.filter.enabled#url", "true").option("parquet.bloom.filter.expected.ndv#url", str(max(groups.values(), default=1)))
    filtered.partitionBy("digits").parquet(f"{folder}/urls/batch={batch_id}")
    return every(spark, folder).filter(F.col("batch") == batch_id).select("url", "page_id")


def known(spark: SparkSession, folder: str) -> DataFrame:
    """(url, page_id) of all URLs so far."""
    return every(spark, folder).select("url", "page_id")


def look_up(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(url, page_id) of some URLs, from the files that can hold them."""
    if not names:
        return known(spark, folder).limit(0)
    n = _digits(spark, folder, DIGITS)
    return every(spark, folder).filter(F.col("digits").isin(*[digits_of(F.lit(u), n) for u in names]) & F.col("url").isin(*names)).select("url", "page_id")


def frontier(spark: SparkSession, source: str, schema, folder: str, checkpoint: str, give: Callable[[DataFrame, int], None], files_per_batch: int = 10) -> None:
    """Feeds the URLs (url) of a folder's files, normalised, to give(new, batch_id): each URL once, whatever came before and however often the query starts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        give(assign(spark, folder, batch.select(urls.normalized(F.col("url")).alias("url")), batch_id), batch_id)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
