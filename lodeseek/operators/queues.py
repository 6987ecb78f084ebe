"""Queues of URLs and page messages as tables of numbered rows.

A queue is a folder of Parquet files with seq, the place in the queue, and the row. Entries are pushed
at the end and popped from the front; a failed entry goes back to the end and is set aside
after some tries. Pops name a range of places, so that one that runs again takes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .crawl import QUEUE_LIMIT

#: Tries of an entry before it is set aside.
MAX_TRIES = 3


def encoded(messages: DataFrame) -> DataFrame:
    """Page messages as one JSON text (message)."""
    return messages.select(F.to_json(F.struct(*messages.columns)).alias("message"))


def decoded(texts: DataFrame) -> DataFrame:
    """JSON texts (message) as page messages; texts that are none become rows of nulls with the text in `broken`."""
    x = texts.select("*", F.from_json("message", schemas.PAGE_MESSAGE).alias("m"))
    return x.select(*[c for c in texts.columns if c != "message"], "m.*", F.when(F.col("m.url").isNull(), F.col("message")).alias("broken"))


def push(spark: SparkSession, folder: str, rows: DataFrame, batch: int, order: str) -> None:
    """Appends rows, in an order, as a batch; the same batch pushed again replaces itself.

    Places are numbered within the batch without a sort of it in one task: a row's place is its order.
    """
    numbered = rows.withColumns({"batch": F.lit(batch), "tries": F.coalesce(F.col("tries"), F.lit(0)) if "tries" in rows.columns else F.lit(0)})
    numbered.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").parquet(f"{folder}/batch={batch:09d}")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(folder)


def front(queue: DataFrame, n: int, order: str) -> DataFrame:
    """The n oldest entries: earlier batches first, then by order."""
    return queue.orderBy("batch", order).limit(n)


def length(queue: DataFrame) -> int:
    return queue.count()


def has_room(queue: DataFrame, limit: int = QUEUE_LIMIT) -> bool:
    """Whether a crawl may go on: fewer entries than the limit wait. Reads no more than the limit."""
    return queue.limit(limit).count() < limit


def members(seen: DataFrame, key: str = "url") -> int:
    """Size of a set of visited URLs."""
    return seen.select(key).distinct().count()


def requeued(failed: DataFrame, max_tries: int = MAX_TRIES) -> tuple[DataFrame, DataFrame]:
    """Failed entries with one try more: those to push at the end again, and those to set aside."""
    more = failed.drop("batch").withColumn("tries", F.col("tries") + 1)
    return more.filter(F.col("tries") < max_tries), more.filter(F.col("tries") >= max_tries)
