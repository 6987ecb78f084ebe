"""Bounded groups in sorted partitions: large shards are dealt out as pairs of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A table of shard sizes of up to this many rows (16 bytes each) is broadcast.
MAX_SHARDS = 1_000_000


def deal(rows: DataFrame, shard: str, salt: str, block: int) -> DataFrame:
    """rows with their group (`gs` long, `gi` and `gj` int) and `left` and `right` (boolean): whether the row's block is the pair's first, second or both.

    A shard (long) of n rows has k = ceil(n / block) blocks, filled by the salt's hash; each pair
    of blocks i <= j is a group, so that every two rows of a shard meet in exactly one group and
    no group is much larger than two blocks, however large the shard. Each row of it is in k groups.
    """
    sizes = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.filter(F.col("n") > block).select(F.col(shard).alias("__s"), F.ceil(F.col("n") / block).cast("int").alias("k")))
    few = large.count() <= MAX_SHARDS
    out = rows.join(F.broadcast(large) if few else large, F.col(shard) == F.col("__s"), "left")
    out = out.withColumn("k", F.coalesce("k", F.lit(1))).withColumn("b", F.pmod(F.xxhash64(salt, F.lit(5)), F.col("k")).cast("int"))
    out = out.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    i, j = F.least("b", "x"), F.greatest("b", "x")
    return out.withColumns({"gs": F.col(shard), "gi": i, "gj": j, "left": F.col("b") == i, "right": F.col("b") == j}).drop("__s", "k", "b", "x")


GROUP = ("gs", "gi", "gj")


def by_group(rows: DataFrame) -> DataFrame:
    """Rows of a group together, groups one after the other."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *GROUP).sortWithinPartitions(*GROUP)


def groups(batches):
    """(shard, table) of each group of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        g = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in GROUP], 1)
        cuts = np.r_[0, np.flatnonzero((g[1:] != g[:-1]).any(1)) + 1, len(g)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = tuple(g[a].tolist())
            if held and last != own:
                yield last[0], pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield last[0], pa.Table.from_batches(held)


def local_roots(adjacent: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name of each row's component under a symmetric boolean matrix."""
    lab = names.copy()
    top = np.iinfo(lab.dtype).max
    while True:
        new = np.minimum(lab, np.where(adjacent, lab[None, :], top).min(1))
        if (new == lab).all():
            return lab
        lab = new
