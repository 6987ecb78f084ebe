"""Sources and sinks: tables, fetch logs, page messages, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table below a folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fetched(log: DataFrame) -> DataFrame:
    """Rows of a fetch log (url, status_code, content_type, body) that hold a page."""
    return log.filter((F.col("status_code") <= 299) & F.contains("content_type", F.lit("text/html")))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of page messages in JSON files."""
    return spark.readStream.schema(schemas.PAGE_MESSAGE).json(folder)


def metric_type(error: Column) -> Column:
    return F.when(error.isNull(), "SUCCESS").when(F.contains(error, F.lit("INFO")), "INFO").otherwise("ERROR")


def metrics(events: DataFrame, text: Column, error: Column, duration_ms: Column, at: Column) -> DataFrame:
    """Metric records, ready to be written as JSON lines."""
    return events.select(metric_type(error).alias("metricType"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), text.alias("text"), duration_ms.cast("int").alias("duration_ms"))


def write_metrics(records: DataFrame, folder: str) -> None:
    """Appends metric records as JSON lines."""
    records.write.mode("append").json(folder)


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).json(folder)


def access_log(requests: DataFrame) -> DataFrame:
    """(line) of requests (at, client, method, url, status, bytes, ms): one line a request, a hyphen for what is missing."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    at = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return requests.select(F.concat_ws(" ", F.coalesce(at, F.lit("-")), *map(show, ("client", "method", "url", "status", "bytes")), F.lit("-"), F.when(F.col("ms").isNull(), "-").otherwise(F.format_string("%.3f", F.col("ms").cast("double"))), F.lit("ms")).alias("line"))
