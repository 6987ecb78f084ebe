"""Neighbours, ego graphs and their layout."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def around(stored, page_id: int) -> DataFrame:
    """(from_page_id, to_page_id) of the links that leave or reach a page, looked up by either end of a stored index."""
    ends = ("from_page_id", "to_page_id")
    own = stored.links_from(page_id).select(*ends)
    return own.unionByName(stored.links_to(page_id).select(*ends).filter(F.col("from_page_id") != page_id))


def forward(links: DataFrame, pages: DataFrame, page_id: int) -> DataFrame:
    """(page_id, url, title) of the pages that a page links to, without itself."""
    ids = links.filter((F.col("from_page_id") == page_id) & (F.col("to_page_id") != page_id)).select(F.col("to_page_id").alias("page_id"))
    return pages.join(ids, "page_id").select("page_id", "url", "title")


def back(links: DataFrame, pages: DataFrame, page_id: int) -> DataFrame:
    ids = links.filter((F.col("to_page_id") == page_id) & (F.col("from_page_id") != page_id)).select(F.col("from_page_id").alias("page_id"))
    return pages.join(ids, "page_id").select("page_id", "url", "title")


def neighbour_ids(links: DataFrame, page_id: int) -> DataFrame:
    """(page_id, kind) of the pages that link to a page (backlink) or that it links to (forward), without itself."""
    near = links.filter("from_page_id <> to_page_id")
    back = near.filter(F.col("to_page_id") == page_id).select(F.col("from_page_id").alias("page_id"), F.lit("backlink").alias("kind"))
    return back.unionByName(near.filter(F.col("from_page_id") == page_id).select(F.col("to_page_id").alias("page_id"), F.lit("forward").alias("kind")))


def ego_edges(links: DataFrame, page_id: int) -> DataFrame:
    """(source, target) of the ego graph: each backlink to the page, the page to each forward link."""
    ids = neighbour_ids(links, page_id)
    back = F.col("kind") == "backlink"
    return ids.select(F.when(back, F.col("page_id")).otherwise(F.lit(page_id)).alias("source"), F.when(back, F.lit(page_id)).otherwise(F.col("page_id")).alias("target"))


def ego(links: DataFrame, pages: DataFrame, page_id: int) -> DataFrame:
    """(page_id, url, title, kind): the page, then pages that link to it, then pages it links to; the first kind wins."""
    me = pages.filter(F.col("page_id") == page_id).select("page_id", "url", "title")
    all_ = me.withColumn("o", F.lit(0)).unionByName(back(links, pages, page_id).withColumn("o", F.lit(1))).unionByName(forward(links, pages, page_id).withColumn("o", F.lit(2)))
    one = all_.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("o"))).filter("n = 1")
    kinds = F.array(F.lit("current"), F.lit("backlink"), F.lit("forward"))
    return one.select("page_id", "url", "title", F.get(kinds, F.col("o")).alias("kind"))


def layout(nodes: DataFrame) -> DataFrame:
    """(page_id, kind, x, y): backlinks on the left, forward links on the right, over 170 degrees each."""
    w = Window.partitionBy("kind")
    i = F.row_number().over(w.orderBy("page_id")) - 1
    n = F.count(F.lit(1)).over(w)
    span = math.radians(170)
    mid = F.when(F.col("kind") == "backlink", F.lit(math.pi)).otherwise(F.lit(0.0))
    angle = F.when(F.col("n") > 1, mid - span / 2 + span * F.col("i") / (F.col("n") - 1)).otherwise(mid)
    radius = F.when(F.col("kind") == "current", F.lit(0.0)).otherwise(150.0 + (F.col("i") % 5) * 40)
    x = nodes.withColumns({"i": i, "n": n}).withColumns({"a": angle, "r": radius})
    return x.select("page_id", "kind", (F.col("r") * F.cos("a")).alias("x"), (F.col("r") * F.sin("a")).alias("y"))
