"""SimHash fingerprints, and components of fingerprints at few differing bits.

The search has two levels. Exact blocks of bits come first, since a vantage-point tree over random
64-bit fingerprints alone would send each of them to half of all shards (see the README): if two
fingerprints differ in at most r bits, then of m blocks of bits m - r are equal, so each choice of
m - r blocks is a table, and a shard is the value of a table's blocks. m grows with the number of
fingerprints, so that shards of fingerprints that aren't alike stay small. Below, each shard's rows
(dealt out as pairs of bounded groups) are searched by a vantage-point tree: a vantage point's
distances split both sides at their median, branches that the triangle bound excludes are
pruned, rows within r of the boundary are asked on both sides, and small leaves are compared.

Equal fingerprints are one node. What a group of rows finds is returned as the least node of
each local component, never as pairs; nodes met in several groups tie these together.

Edge cases: a null text counts as empty; texts without a word have fingerprint 0, which links
like any other; repeated rows are documents of their own; texts of any length are read whole; a
row with a null key links like any other, but names no component, which is null where no row of it
has a key; rows that share a key but no text are in different components; other columns are left out, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh_name, resolve_roots, text_of
from .grouping import GROUP, by_group, deal, groups, local_roots
from .tokens import slices, text_batches

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Rows of a block; a group has two blocks at most.
BLOCK = 512
#: Rows on both sides of a leaf of a vantage-point tree.
LEAF = 128
#: A shard of fingerprints that aren't alike has at most so many rows, if blocks can see to it.
SHARD_ROWS = 256


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and white space only
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, n)
    stops = np.cumsum(lens) + np.arange(n)
    starts = (stops - lens)[: n - shingle + 1].tolist()
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops[shingle - 1 :].tolist())), np.uint64, n - shingle + 1)
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint as a signed long."""
    kind = T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, T.LongType())])
    keep = [f.name for f in kind.fields[:-1]]

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, text):
                fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fp)], names=[*keep, name])

    return text_batches(docs).mapInArrow(run, kind)


def linked(a: np.ndarray, b: np.ndarray, radius: int, leaf: int = LEAF) -> np.ndarray:
    """Matrix of rows of a and b at most radius bits apart, by a vantage-point tree over both."""
    out = np.zeros((len(a), len(b)), bool)
    todo = [(np.arange(len(a)), np.arange(len(b)), 0)]
    while todo:
        i, j, depth = todo.pop()
        if not len(i) or not len(j):
            continue
        if min(len(i), len(j)) <= leaf or depth > 40:
            out[np.ix_(i, j)] = np.bitwise_count(a[i][:, None] ^ b[j][None, :]) <= radius
            continue
        vantage = a[i[depth % len(i)]]
        da, db = np.bitwise_count(a[i] ^ vantage).astype(np.int16), np.bitwise_count(b[j] ^ vantage).astype(np.int16)
        middle = int(np.median(da))
        inner = da <= middle
        near, far = j[db <= middle + radius], j[db > middle - radius]
        if len(near) + len(far) > 1.9 * len(j) or inner.all():  # this vantage point splits nothing: rows of one ball
            out[np.ix_(i, j)] = np.bitwise_count(a[i][:, None] ^ b[j][None, :]) <= radius
            continue
        todo += [(i[inner], near, depth + 1), (i[~inner], far, depth + 1)]
    return out


def tables(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits of each table for n fingerprints: of m blocks, m - radius at a time, of which one choice must be equal."""
    for m in range(radius + 1, radius + 5):
        blocks = [(1 << (64 * (i + 1) // m)) - (1 << (64 * i // m)) for i in range(m)]
        if n >> (64 * (m - radius) // m) <= SHARD_ROWS:
            break
    return [sum(c) for c in combinations(blocks, m - radius)]


def components(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes: node (long) and fp, each fp once. Returns node, component."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    shards = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(mask)))) for i, mask in enumerate(tables(nodes.count(), radius))]
    rows = nodes.withColumn("shard", F.explode(F.array(*shards)))
    rows = by_group(deal(rows, "shard", "fp", BLOCK).select(*GROUP, "left", "right", "node", "fp"))

    def run(batches):
        nodes_out, roots_out = [], []
        for _, t in groups(batches):
            if t.num_rows > 1:
                fp = t.column("fp").to_numpy().view(np.uint64)
                node = t.column("node").to_numpy()
                left, right = t.column("left").to_numpy(), t.column("right").to_numpy()
                ia, ib = np.flatnonzero(left), np.flatnonzero(right)
                if len(ia) and len(ib):
                    link = linked(fp[ia], fp[ib], radius)
                    adj = np.zeros((len(fp), len(fp)), bool)
                    adj[np.ix_(ia, ib)] = link
                    adj |= adj.T
                    np.fill_diagonal(adj, False)
                    some = np.flatnonzero(adj.any(1))
                    if len(some):
                        nodes_out.append(node[some])
                        roots_out.append(local_roots(adj[np.ix_(some, some)], node[some]))
            if len(nodes_out) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes_out)), pa.array(np.concatenate(roots_out))], names=["node", "root"])
                nodes_out, roots_out = [], []
        if nodes_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes_out)), pa.array(np.concatenate(roots_out))], names=["node", "root"])

    parts = rows.mapInArrow(run, "node long, root long")
    return resolve_roots(parts)


def roots_of(fps: DataFrame, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """fp and root, for each fingerprint of fps: the root is the least fingerprint (as a signed number) of its component."""
    nodes = cut(fps.select(F.col(fp).alias("fp")).distinct())
    comp = components(nodes.select(F.col("fp").alias("node"), "fp"), radius)
    return cut(nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (the smallest key reachable)."""
    fps = cut(fingerprints(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), "t", "fp", shingle).drop("t"))
    roots = roots_of(fps, "fp", radius)
    least = fps.groupBy("fp").agg(F.min("id").alias("id")).join(roots, "fp")
    named = least.groupBy("root").agg(F.min("id").alias("component_id"))
    out = fps.join(cut(roots.join(named, "root")), "fp", "left")
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component: that of the least key (null last), then of the least hash of its text, then the first.

    Rows that share a key are told apart by their texts; of rows that share both, one stays. Rows are
    numbered when they are checkpointed, so that the chosen ones are found again by a number.
    """
    fp, place = fresh_name(docs, "fp"), fresh_name(docs, "place")
    rows = cut(fingerprints(docs, text, fp, shingle).withColumn(place, F.monotonically_increasing_id()))
    order = F.min(F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(text_of(text)), F.col(place).alias("place"), F.col(fp).alias("fp")))
    least = rows.groupBy(fp).agg(order.alias("x")).select("x", F.col(fp).alias("fp"))
    first = least.join(roots_of(rows, fp, radius), "fp").groupBy("root").agg(F.min("x").alias("x"))
    first = cut(first.select(F.col("x.place").alias(place), F.col("x.fp").alias(fp)))
    return rows.join(first, [place, fp], "left_semi").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
