"""Stored vectors: an inverted file of cells around centroids, searched by probing some cells or all of them.

Centroids come from spherical k-means on a bounded sample; every vector is stored in the cell of its nearest
centroid, a partition of the table, so that a search reads the files of the probed cells only. How many cells
must be probed depends on how clustered the vectors are, so the index measures it as it is built: for sampled
queries against all rows, the fewest cells that hold the wanted share of the nearest neighbours. Null and zero
vectors stand in a cell of their own, which no search probes.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from . import search
from .store import Stored, record

#: Cells, and vectors that k-means is fitted on for each of them; rounds of k-means.
MAX_CELLS, SAMPLE_A_CELL, ROUNDS = 4_096, 32, 8
#: Queries that the number of probes is measured with, neighbours of each, and the share of them that probes shall hold.
QUERIES, NEIGHBOURS, RECALL = 128, 100, 0.95
#: Vectors of a cell's file, about.
ROWS_A_FILE = 1_000_000
#: Vectors of a cell that are compared with queries at once, about, and how far a product can be from the distance that ranks.
ROWS_A_GROUP, NEARLY = 20_000, 1e-9
#: The cell of vectors without a direction.
NOWHERE = -1


def cell_count(rows: int) -> int:
    return max(1, min(MAX_CELLS, round(math.sqrt(rows))))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without a direction are zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=np.isfinite(n) & (n > 0))


def matrix(col: pa.Array) -> np.ndarray:
    """Vectors as rows, null ones, and those with a null component, as zeros."""
    rows = col.to_pylist()
    dim = max((len(v) for v in rows if v is not None), default=0)
    return np.array([v if v is not None and len(v) == dim and None not in v else [0.0] * dim for v in rows], np.float64).reshape(len(rows), dim)


def centroids_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """The first rows of a sample of unit vectors, moved to the means of the rows around them so many times; an empty cell's stays."""
    c = sample[:cells].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        moved = unit(sums)
        c = np.where((moved != 0).any(axis=1)[:, None], moved, c)
    return c


def _assigned(centroids: np.ndarray):
    def run(batches):
        for b in batches:
            x = unit(matrix(b.column("embedding")))
            there = (x != 0).any(axis=1) if x.shape[1] == centroids.shape[1] else np.zeros(len(x), bool)
            cell = np.full(len(x), NOWHERE, np.int32)
            if there.any():
                cell[there] = (x[there] @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return run


def sampled(vectors: DataFrame, n: int) -> DataFrame:
    """The n vectors (page_id, embedding) with a direction that a hash of the id draws."""
    return vectors.filter("norm > 0").select("page_id", "embedding").orderBy(F.md5(F.col("page_id").cast("string").cast("binary")), "page_id").limit(n)


def write_vectors(vectors: DataFrame, folder: str, cells: int | None = None, rounds: int = ROUNDS, recall: float | None = RECALL, probes: int | None = None) -> None:
    """Writes vectors (page_id, embedding, norm, cell) and centroids (cell, centroid).

    cells: instead of the square root of their number. probes: cells of a search; measured if it isn't given, all if recall is None.
    """
    spark = vectors.sparkSession
    normed = vectors.withColumn("norm", scoring.norm(F.col("embedding")))
    rows = normed.filter("norm > 0").count()
    cells = min(rows, cells or cell_count(rows)) or 1
    got = sampled(normed, cells * SAMPLE_A_CELL).toArrow()
    sample = unit(matrix(got.column("embedding").combine_chunks())) if rows else np.zeros((1, 0))
    centroids = centroids_of(sample, cells, rounds)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in normed.schema.fields)
    placed = normed.mapInArrow(_assigned(centroids), f"{kinds}, cell int")
    part = F.pmod(F.xxhash64("page_id"), F.lit(max(1, math.ceil(rows / cells / ROWS_A_FILE))))
    placed.repartition(max(1, min(cells, 1 + rows // 10_000)), "cell", part).sortWithinPartitions("cell", "page_id").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    facts = {"cells": cells, "rows": rows, "probes": probes or cells}
    if probes is None and recall is not None and rows:
        facts["probes"], facts["recall"] = measured(spark.read.parquet(f"{folder}/vectors"), centroids, recall)
    record(spark, folder, "vectors", **facts)


def measured(stored: DataFrame, centroids: np.ndarray, recall: float) -> tuple[int, float]:
    """The fewest probes that hold the share `recall` of the nearest neighbours of sampled queries, and the share that they hold."""
    queries = unit(matrix(sampled(stored, QUERIES).toArrow().column("embedding").combine_chunks()))  # bounded
    order = np.argsort(-(queries @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell in each query's order

    def run(batches):
        best: list = [np.zeros((0, 2))] * len(queries)
        for b in batches:
            x, cell = unit(matrix(b.column("embedding"))), b.column("cell").to_numpy(zero_copy_only=False)
            scores = queries @ x.T
            for q, s in enumerate(scores):
                rows = np.concatenate([best[q], np.stack([s, cell], axis=1)])
                best[q] = rows[np.argsort(-rows[:, 0], kind="stable")[:NEIGHBOURS]]
        for q, rows in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(rows), pa.int32()), pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32))], names=["q", "score", "cell"])

    near = stored.filter(F.col("cell") != NOWHERE).select("embedding", F.col("cell").cast("int").alias("cell")).mapInArrow(run, "q int, score double, cell int")
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell"))).filter(F.col("r") <= NEIGHBOURS)
    counts = top.groupBy("q", "cell").count().collect()  # at most QUERIES * NEIGHBOURS rows
    held = np.zeros(len(centroids))
    for r in counts:
        held[place[r.q, r.cell]] += r["count"]
    share = np.cumsum(held) / held.sum()
    probes = int(np.searchsorted(share, recall)) + 1
    return min(probes, len(centroids)), float(share[min(probes, len(centroids)) - 1])


def centroids(stored: Stored) -> np.ndarray:
    """At most MAX_CELLS rows, read once."""
    if "centroid matrix" not in stored.opened:
        rows = sorted(stored.table("centroids").collect())
        stored.opened["centroid matrix"] = np.array([r.centroid for r in rows])
    return stored.opened["centroid matrix"]


def probed(stored: Stored, query: list[float], probes: int | None = None) -> list[int]:
    """The cells nearest to a query, by default as many as the index has measured to be enough."""
    c = centroids(stored)
    near = c @ unit(np.array([query], np.float64))[0]
    return [int(i) for i in np.argsort(-near, kind="stable")[: probes or stored.facts("vectors")["probes"]]]


def nearest_ann(stored: Stored, query: list[float], limit: int, probes: int | None = None) -> DataFrame:
    """(page_id, distance) of the nearest vectors in the probed cells; the exact search is search.nearest over the whole table."""
    one = stored.spark.createDataFrame([(list(map(float, query)),)], "q array<double>")
    return search.nearest(stored.table("vectors").filter(F.col("cell").isin(*probed(stored, query, probes))), one, limit, "page_id")


def nearest_to_all(stored: Stored, queries: DataFrame, limit: int, probes: int | None = None) -> DataFrame:
    """(query_id, page_id, distance, rank) of the nearest vectors in the cells that each query (query_id, q) probes, itself left out.

    Queries and vectors meet by group: a part of a cell, and the queries that probe it. Matrix products of a group
    give the rows that can be among a query's nearest there; only their distances are computed and ranked.
    """
    c, n = centroids(stored), probes or stored.facts("vectors")["probes"]

    def run(batches):
        for b in batches:
            x = unit(matrix(b.column("q")))
            cells = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n] if len(x) and x.shape[1] == c.shape[1] else np.zeros((len(x), 0), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[int(i) for i in r] for r in cells], pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = left["page_id"].to_numpy(), right["query_id"].to_numpy()
        x, q = (unit(matrix(t[name].combine_chunks())) for t, name in ((left, "embedding"), (right, "q")))
        found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in range(0, len(q), QUERIES) if len(ids) and x.shape[1] == q.shape[1] else ():
            scores = q[i : i + QUERIES] @ x.T
            scores[ids[None, :] == asked[i : i + QUERIES, None]] = -np.inf
            k = min(limit, len(ids))
            least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            at, row = np.nonzero((scores >= least[:, None] - NEARLY) & np.isfinite(scores))
            found.append((at + i, row))
        at, row = (np.concatenate(f) for f in zip(*found))
        return pa.table({"query_id": right["query_id"].take(at), "q": right["q"].take(at), "qn": right["qn"].take(at), "page_id": left["page_id"].take(row), "embedding": left["embedding"].take(row), "norm": left["norm"].take(row)})

    rows = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).withColumn("qn", scoring.norm(F.col("q"))).filter("qn > 0")
    asked = rows.mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, q array<double>, qn double, cells array<int>")
    parts = max(1, math.ceil(stored.facts("vectors")["rows"] / stored.facts("vectors")["cells"] / ROWS_A_GROUP))
    own = stored.table("vectors").filter(F.col("cell") != NOWHERE).withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("cell", F.explode("cells")).drop("cells").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, q array<double>, qn double, page_id {kind['page_id']}, embedding {kind['embedding']}, norm double"
    got = own.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(near, schema)
    pairs = got.select("query_id", "page_id", scoring.cosine_distance(F.col("embedding"), F.col("q"), F.col("norm"), F.col("qn")).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "page_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= limit)
