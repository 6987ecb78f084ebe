"""Embedding near-duplicates by spherical-cap filters.

A filter is a unit vector made of one codeword for each half of a randomly rotated space; a
vector passes the filters whose caps hold it. Each vector's list of filters is decoded from
its scores with the two halves' codewords: first codewords that no partner could lift over the
cap's height are dropped, then the rest is paired. There are several such product codes, each
with a height at which a vector passes LIST filters on average. Directions far from all codewords
pass few caps or none, so each vector takes at least its FEWEST best filters of each code. The
number of codewords grows with the number of vectors, and codes are added until simulated pairs at
the least cosine are found (see codes()).

Vectors meet on filters in two rounds. The first moves ids and sketches (signs of 192 random
projections) only, and keeps the places (filter, vector) that have a partner whose sketch differs in
no more bits than DEVIATIONS above what the least cosine gives. The second takes the vectors of
these places alone and verifies in double precision. Up to FEW_DIMS components, cells of a grid
take the place of filters, no sketch is asked, and the search is exact.

Equal vectors are one node with a count. A pair that shares several filters counts in the
least of them only, so numbers of links need no list of pairs; filters with many vectors are
dealt out as pairs of bounded blocks.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; so do rows with a null key, which get a null component and are kept; vectors of
different lengths don't link; repeated rows are vectors of their own that link with each other; other
columns are left out, whatever their names; an empty table gives no row. In more than FEW_DIMS
components links are searched, not proven: figures of the recall are in the README.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, resolve_roots
from .grouping import GROUP, by_group, deal, groups, local_roots

MIN_COSINE = 0.9
#: Filters of a code that a vector passes on average, and at least, however far its direction is from the codewords.
LIST, FEWEST = 1, 4
#: Vectors of a filter to aim at; the least and the greatest number of codewords of a half.
TARGET, LEAST_CODES, MOST_CODES = 256, 8, 4096
#: Product codes: so many at least and at most, and the share of simulated pairs to find before no more are added.
LEAST_ROTATIONS, MOST_ROTATIONS, RECALL = 5, 32, 0.9985
SEED = 31
BLOCK = 512
#: Vectors of so many components or fewer are searched exactly, in cells.
FEW_DIMS = 8
#: Words of 64 signs of a sketch, and deviations above the expected number of differing signs: of pairs at the least cosine
#: one in 4,000 is lost, and what passes by chance has a cosine of 0.74 or so where 0.9 is asked.
WORDS, DEVIATIONS = 3, 3.5


def codewords(n: int, dim: int) -> int:
    """Codewords of each half for n vectors: filters hold TARGET vectors or so; few components have few directions."""
    return max(LEAST_CODES, min(round((n * FEWEST / TARGET) ** 0.5), MOST_CODES, 2 ** (dim // 2)))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=8)
def codes(dim: int, size: int, min_cosine: float = MIN_COSINE) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Rotation, codewords of both halves and the least sum of two scores of each code, for vectors of dim (even) components.

    Codes are added until RECALL of 2000 simulated pairs at min_cosine share a filter, then one more.
    """
    r = np.random.default_rng(SEED + dim)
    half, out = dim // 2, []
    x = unit(r.normal(size=(2000, dim)))
    z = r.normal(size=x.shape)
    y = min_cosine * x + (1 - min_cosine**2) ** 0.5 * unit(z - (z * x).sum(1, keepdims=True) * x)
    met, enough = np.zeros(len(x), bool), False
    while len(out) < MOST_ROTATIONS:
        rotation = np.linalg.qr(r.normal(size=(dim, dim)))[0]
        u, v = unit(r.normal(size=(size, half))), unit(r.normal(size=(size, half)))
        w = x[:300] @ rotation
        top = -np.sort(-best_sums(w[:, :half] @ u.T, w[:, half:] @ v.T, min(8 * LIST, size)), axis=1)
        out.append((rotation, u, v, float(np.quantile(top[:, :LIST], 0.5))))
        both = [best_of(a @ rotation[:, :half] @ u.T, a @ rotation[:, half:] @ v.T, FEWEST) for a in (x, y)]
        f, g = (i.astype(np.int64) * size + j for i, j in both)
        met |= (f[:, :, None] == g[:, None, :]).any((1, 2))
        if enough and len(out) >= LEAST_ROTATIONS:
            break
        enough = met.mean() >= RECALL
    return out


@lru_cache(maxsize=8)
def planes(dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).normal(size=(dim, 64 * WORDS))


def sketches(x: np.ndarray) -> np.ndarray:
    """WORDS words of signs of each row."""
    return np.packbits(x @ planes(x.shape[1]) > 0, axis=1, bitorder="little").view("<i8")


def most_bits(min_cosine: float) -> int:
    p = float(np.arccos(min_cosine)) / np.pi
    n = 64 * WORDS
    return int(np.ceil(n * p + DEVIATIONS * (n * p * (1 - p)) ** 0.5))


SKETCH = tuple(f"s{i}" for i in range(WORDS))


def even(x: np.ndarray) -> np.ndarray:
    """Unit vectors with a zero component more where their number is odd."""
    x = x / np.abs(x).max(1, keepdims=True)
    x = unit(x)
    return np.hstack([x, np.zeros((len(x), 1))]) if x.shape[1] % 2 else x


@lru_cache(maxsize=8)
def turn(dim: int) -> np.ndarray:
    """A random rotation, so that sparse vectors aren't on the borders of cells."""
    return np.linalg.qr(np.random.default_rng(SEED + dim).normal(size=(dim, dim)))[0]


def cells_of(x: np.ndarray, min_cosine: float) -> list[np.ndarray]:
    """The cells of a grid that each row's cap of half the links' angle meets, ascending.

    The middle of two vectors that link lies in the caps of both, so its cell is in both lists.
    Cells are as wide as the cap at least: in each component a cap meets its own cell and the nearest one.
    """
    reach = (1 - min_cosine) / 2  # square of the cap's radius
    n = 4 if x.shape[1] <= 4 and 16 * reach <= 1 else 2  # cells of each component
    y = (x @ turn(x.shape[1]) + 1) * n / 2
    own = np.clip(np.floor(y), 0, n - 1)
    near = np.where((own == n - 1) | ((y - own < 0.5) & (own > 0)), own - 1, own + 1)
    cost = ((y - np.maximum(own, near)) * 2 / n) ** 2
    row, cell, spent = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(x.shape[1]):
        more = np.flatnonzero(spent + cost[row, i] <= reach + 1e-9)
        cell = np.concatenate([cell * n + own[row, i].astype(np.int64), cell[more] * n + near[row[more], i].astype(np.int64)])
        row, spent = np.concatenate([row, row[more]]), np.concatenate([spent, spent[more] + cost[row[more], i]])
    return by_row(row, cell, len(x))


def by_row(row: np.ndarray, f: np.ndarray, n: int) -> list[np.ndarray]:
    """f (below 2**32) of each of n rows, ascending, without repetitions."""
    both = np.unique(row.astype(np.int64) << 32 | f)
    return np.split(both & ((1 << 32) - 1), np.searchsorted(both >> 32, np.arange(1, n)))


def best_of(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The filters (i, j) of the k greatest sums a[i] + b[j] of each row; they are among the k best of both halves."""
    i, j = np.argpartition(-a, k - 1, 1)[:, :k], np.argpartition(-b, k - 1, 1)[:, :k]
    sums = np.take_along_axis(a, i, 1)[:, :, None] + np.take_along_axis(b, j, 1)[:, None, :]
    top = np.argpartition(-sums.reshape(len(a), -1), k - 1, 1)[:, :k]
    return np.take_along_axis(i, top // k, 1), np.take_along_axis(j, top % k, 1)


def best_sums(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    i, j = best_of(a, b, k)
    return np.take_along_axis(a, i, 1) + np.take_along_axis(b, j, 1)


def filters_of(x: np.ndarray, size: int, min_cosine: float = MIN_COSINE) -> list[np.ndarray]:
    """The filters of each row of unit vectors, ascending."""
    half = x.shape[1] // 2
    out_row, out_f = [], []
    for c, (rotation, u, v, height) in enumerate(codes(x.shape[1], size, min_cosine)):
        y = x @ rotation
        a, b = y[:, :half] @ u.T, y[:, half:] @ v.T
        rows, i = np.nonzero(a + b.max(1, keepdims=True) >= height)
        for at in range(0, len(rows), 4_000_000 // size + 1):
            r, k = rows[at : at + 4_000_000 // size + 1], i[at : at + 4_000_000 // size + 1]
            p, j = np.nonzero(a[r, k][:, None] + b[r] >= height)
            out_row.append(r[p])
            out_f.append((c * size + k[p]) * size + j)
        i, j = best_of(a, b, FEWEST)
        out_row.append(np.repeat(np.arange(len(x)), FEWEST))
        out_f.append(((c * size + i.astype(np.int64)) * size + j).ravel())
    return by_row(np.concatenate(out_row), np.concatenate(out_f), len(x))


def lists_of(x: np.ndarray, dim: int, size: int, min_cosine: float) -> list[np.ndarray]:
    """Filters of rows that had dim components; cells where there are few."""
    return cells_of(x, min_cosine) if dim <= FEW_DIMS else filters_of(x, size, min_cosine)


def matrix(col) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


#: Rows that are read into matrices at once.
ROWS = 2000


def places(reps: DataFrame, sizes: dict[int, int], min_cosine: float = MIN_COSINE) -> DataFrame:
    """shard, node and SKETCH: a row for each filter of reps (node, embedding), with the sketch."""

    def run(batches):
        for batch in batches:
            dims = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                for at in range(0, part.num_rows, ROWS):
                    some = part.slice(at, ROWS)
                    x = even(matrix(some.column("embedding")))
                    lists, s = lists_of(x, d, sizes[d], min_cosine), sketches(x)
                    row = np.repeat(np.arange(len(x)), [len(f) for f in lists])
                    shard = (d << 32) + np.concatenate(lists)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), some.column("node").take(pa.array(row)), *(pa.array(w) for w in s[row].T.copy())], names=["shard", "node", *SKETCH])

    return reps.mapInArrow(run, ", ".join(f"{c} long" for c in ("shard", "node", *SKETCH)))


def likely(rows: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The places (shard, node) that have a partner with a near sketch, from places()."""
    most = most_bits(min_cosine)
    rows = by_group(deal(rows, "shard", "node", BLOCK).select(*GROUP, "left", "right", "node", *SKETCH))

    def run(batches):
        shards, nodes = [], []
        for shard, t in groups(batches):
            if t.num_rows > 1:
                node = t.column("node").to_numpy()
                s = np.stack([t.column(c).to_numpy() for c in SKETCH], 1).view(np.uint64)
                ia, ib = np.flatnonzero(t.column("left").to_numpy()), np.flatnonzero(t.column("right").to_numpy())
                near = np.ones((len(ia), len(ib)), bool)
                if shard >> 32 > FEW_DIMS:
                    near = sum(np.bitwise_count(s[ia, k][:, None] ^ s[ib, k][None, :]).astype(np.int16) for k in range(WORDS)) <= most
                near &= ia[:, None] != ib[None, :]
                some = np.union1d(ia[near.any(1)], ib[near.any(0)])
                if len(some):
                    shards.append(np.full(len(some), shard))
                    nodes.append(node[some])
            if len(nodes) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shards, nodes)], names=["shard", "node"])
                shards, nodes = [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shards, nodes)], names=["shard", "node"])

    return rows.mapInArrow(run, "shard long, node long").distinct()


def verify(t: pa.Table, this: int, dim: int, size: int, min_cosine: float):
    """node, added links and local root of the rows of a group that link."""
    x = even(matrix(t.column("embedding")))
    node, mult = t.column("node").to_numpy(), t.column("mult").to_numpy()
    ia, ib = np.flatnonzero(t.column("left").to_numpy()), np.flatnonzero(t.column("right").to_numpy())
    if not len(ia) or not len(ib):
        return None
    n = len(x)
    adj = np.zeros((n, n), bool)
    adj[np.ix_(ia, ib)] = x[ia] @ x[ib].T >= min_cosine
    adj |= adj.T
    np.fill_diagonal(adj, False)
    some = np.flatnonzero(adj.any(1))
    if not len(some):
        return None
    adj = adj[np.ix_(some, some)]
    lower = [f[f < this] for f in lists_of(x[some], dim, size, min_cosine)]
    held = np.concatenate(lower)
    names, at = np.unique(held, return_inverse=True)
    row = np.repeat(np.arange(len(some)), [len(f) for f in lower])
    own = adj
    for k in range(0, len(names), 1024):  # pairs that share a lesser filter count there
        here = (at >= k) & (at < k + 1024)
        m = np.zeros((len(some), 1024), np.float32)
        m[row[here], at[here] - k] = 1
        own = own & (m @ m.T < 0.5)
    return node[some], own @ mult[some], local_roots(adj, node[some])


def links(reps: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(node, added, root) parts of all groups, from reps (node, mult, embedding)."""
    # one row for each length of vectors
    sizes = {r.d: codewords(r.n, r.d + r.d % 2) for r in reps.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = cut(likely(cut(places(reps, sizes, min_cosine)), min_cosine))
    rows = by_group(deal(found, "shard", "node", BLOCK).join(reps, "node").select(*GROUP, "left", "right", "node", "mult", "embedding"))

    def run(batches):
        for shard, t in groups(batches):
            if t.num_rows > 1:
                d = shard >> 32
                got = verify(t, shard & ((1 << 32) - 1), d, sizes[d], min_cosine)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["node", "added", "root"])

    return rows.mapInArrow(run, "node long, added long, root long")


def dedup(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """key, n_links, component_id, kept."""
    rows = vectors.select(F.col(key).cast("long").alias("vec"), F.col(embedding).alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)))
    valid = rows.filter("ok AND vec IS NOT NULL")
    reps = cut(valid.groupBy("embedding").agg(F.min("vec").alias("node"), F.count(F.lit(1)).alias("mult")))
    parts = cut(links(reps.select("node", "mult", "embedding"), min_cosine))
    added = parts.groupBy("node").agg(F.sum("added").alias("added"))
    comp = resolve_roots(parts.select("node", "root"))
    named = reps.join(added, "node", "left").join(comp, "node", "left")
    named = cut(named.select(F.col("embedding").alias("e"), (F.coalesce("added", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "node").alias("c")))
    out = rows.join(named, F.col("ok") & F.col("vec").isNotNull() & (F.col("embedding") == F.col("e")), "left")
    comp_id = F.coalesce("c", "vec")
    return out.select(F.col("vec").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec") == comp_id, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
