"""Click deduplication in expiring windows, by two chained stateful operators of one streaming query.

Copies of clicks arrive in batches. The first operator keeps the opener and the deadline of each
click's open window, and tags what arrives with a window's identity (click and start). The second
one adds up counters per window. A window closes by a control event: the first operator sends it
when another opener takes the click over, or when the batch's own control event, which every shard
gets, moves the clock beyond the deadline; it travels with the counts or alone, and makes the
second operator give the window out and forget it.

State is kept in shards of click ids, as arrays, so that a control event reaches every open window
without a list of them, and Python is called once a shard instead of once a click. What a shard
holds is its open windows; there are more shards for more clicks.

Hot clicks: rows of a click, hour and batch are summed up where they are cut (a head: their number,
checksum, least hash), so that the first operator gets one row a click, hour and task, whatever the
number of rows. Rows of another hash than the least one go to the second operator as details, dealt
out by click and hash; there they meet the hours whose window has that hash as its opener's.

Edge cases: rows without click_id or arrived_at have no place in the order and are left out, as are
those whose click_id gives no copy (negative remainders); a value that is not a finite number or
beyond a long's range counts as null; null texts count as empty; repeated rows count each; an empty
table gives no window; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder

BATCHES = 12
#: Hours that a window takes repeats for, and hours that a copy can be behind the latest one of earlier batches.
WINDOW_HOURS, LATE_HOURS = 72, 48
#: Shards: at least so many, and more for every so many copies.
MIN_SHARDS, COPIES_A_SHARD = 64, 100_000
#: Files of a batch: at least so many, and more for every so many copies.
MIN_FILES, COPIES_A_FILE = 4, 1_000_000

HEAD, DETAIL, TICK = 0, 1, 2
#: The deadline clock of the last control event: every window closes.
NEVER = 1 << 60
_FED = "kind int, shard int, click_id long, hour long, hash binary, n long, crc long, same long"
_TAGGED = "kind int, click_id long, start long, hour long, hash binary, n long, crc long, same long, closed int"
_CLOSED = "click_id long, start_hour long, closed_batch int, n long, crc long, same long, hash binary"
_CLICK = np.dtype([("click", "<i8"), ("start", "<i8"), ("hash", "V32")])
_WINDOW = np.dtype([("click", "<i8"), ("start", "<i8"), ("n", "<i8"), ("crc", "<i8"), ("same", "<i8"), ("hash", "V32")])


# Cutting ----------------------------------------------------------------------------------------


def _micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time, one without a zone taken as UTC."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column).cast("timestamp"))


def copies(clicks: DataFrame) -> DataFrame:
    """click_id, hour, place (which decides the batch) and what the hash is made of, a row for each copy."""
    least = F.when(F.col("click_id") % 3 >= 0, F.sequence(F.lit(0), (F.col("click_id") % 3).cast("int")))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cents = 100 * F.col("value") + 0.5
    cents = F.when(~F.isnan("value") & (F.abs(cents) < 9e18), F.floor(cents).cast("long"))
    rows = clicks.select("click_id", F.floor(_micros(clicks, "arrived_at") / F.lit(3_600_000_000)).cast("long").alias("at"), F.explode(least).alias("j"),
                         F.concat_ws("|", said("client_id"), said("kind"), F.coalesce(cents.cast("string"), F.lit("")), F.coalesce(_micros(clicks, "ts").cast("string"), F.lit("")), said("props"), F.lit("")).alias("told")).filter("at IS NOT NULL")
    rows = rows.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary")))
    rows = rows.withColumn("hour", F.col("at") + 6 * F.col("j") * (F.col("c") % 10))
    return rows.select("click_id", "hour", (F.col("hour") + F.floor(F.col("c") / 10) % 200).alias("place"), F.concat("told", (F.col("c") % 3).cast("string")).alias("told"))


def _keys(hashes: list[bytes]) -> np.ndarray:
    """Hashes as rows of four numbers that sort alike."""
    return np.frombuffer(b"".join(hashes), ">u8").reshape(-1, 4).astype("<u8")


def _blobs(keys: np.ndarray) -> list[bytes]:
    raw = keys.astype(">u8").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


def merged(at: np.ndarray, hashes: np.ndarray, n: np.ndarray, crc: np.ndarray, same: np.ndarray):
    """Heads and details of rows that are heads themselves.

    at: columns that tell groups apart. A head has a group's n and crc in total, its least hash and
    how many of its rows have that one; details are the other hashes and how many rows have each.
    """
    order = np.lexsort((*hashes.T[::-1], *at.T[::-1]))
    at, hashes, n, crc, same = at[order], hashes[order], n[order], crc[order], same[order]
    new = np.ones(len(n), bool)
    new[1:] = (at[1:] != at[:-1]).any(axis=1)
    own = new.copy()
    own[1:] |= (hashes[1:] != hashes[:-1]).any(axis=1)
    groups, runs = np.flatnonzero(new), np.flatnonzero(own)
    if not len(n):
        return (at, hashes, n, crc, same), (at, hashes, same)
    times, first = np.add.reduceat(same, runs), new[runs]
    heads = (at[groups], hashes[groups], np.add.reduceat(n, groups), np.add.reduceat(crc, groups), times[first])
    rest = runs[~first]
    return heads, (at[rest], hashes[rest], times[~first])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies (batch, click_id, hour, hash, crc) as heads and details, an Arrow batch at a time."""
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("batch", "click_id", "hour")], axis=1)
        one = np.ones(len(at), np.int64)
        heads, details = merged(at, _keys(b.column("hash").to_pylist()), one, b.column("crc").to_numpy(zero_copy_only=False).astype(np.int64), one)
        for kind, (where, hashes, n, *more) in ((HEAD, heads), (DETAIL, details)):
            crc, same = more or (np.zeros_like(n), np.zeros_like(n))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), *(pa.array(where[:, i]) for i in range(3)), pa.array(_blobs(hashes), pa.binary()), pa.array(n), pa.array(crc), pa.array(same)], names=["kind", "batch", "click_id", "hour", "hash", "n", "crc", "same"])


def _shard(shards: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(shards)).cast("int")


def cut(clicks: DataFrame, folder: str, batches: int, late: int) -> tuple[int, list[int | None]]:
    """Writes copies as folders batch=0, 1, ... with a control event for each shard and batch.

    Returns the number of shards and, for each batch, the least hour that is not late (None: any).
    A control event holds the next batch's least hour; windows whose deadline is before it close.
    """
    spark = clicks.sparkSession
    all_ = copies(clicks)
    lo, hi, total = all_.agg(F.min("place"), F.max("place"), F.count(F.lit(1))).first()
    if not total:
        return 0, []
    shards = max(MIN_SHARDS, total // COPIES_A_SHARD)
    files = max(MIN_FILES, total // batches // COPIES_A_FILE)
    batch = F.floor((F.col("place") - lo) * batches / F.lit(hi - lo + 1)).cast("long")
    rows = all_.select(batch.alias("batch"), "click_id", "hour", F.sha2("told", 256).alias("hex"))
    rows = rows.select("batch", "click_id", "hour", F.unhex("hex").alias("hash"), F.crc32(F.col("hex").cast("binary")).alias("crc"))
    fed = rows.mapInArrow(_summed, "kind int, batch long, click_id long, hour long, hash binary, n long, crc long, same long")
    shard = F.when(F.col("kind") == HEAD, _shard(shards, "click_id")).otherwise(_shard(shards, "click_id", "hash"))
    fed = fed.withColumn("shard", shard)
    fed = fed.repartition(batches * files, "batch", F.pmod("shard", F.lit(files)))
    fed.write.partitionBy("batch").parquet(folder)
    tops = {r.batch: r.top for r in spark.read.parquet(folder).filter(F.col("kind") == HEAD).groupBy("batch").agg(F.max("hour").alias("top")).collect()}  # a row a batch
    floors: list[int | None] = [None]
    for b in range(batches):
        top = max([x for i, x in tops.items() if i <= b], default=None)
        floors.append(None if top is None else top - late)
    clock = F.element_at(F.array(*[F.lit(NEVER if b == batches - 1 else floors[b + 1]).cast("long") for b in range(batches)]), (F.col("batch") + 1).cast("int"))
    ticks = spark.range(shards).select(F.lit(TICK).alias("kind"), F.explode(F.array(*[F.lit(b).cast("long") for b in range(batches)])).alias("batch"), F.col("id").cast("int").alias("shard"))
    zero = F.lit(0).cast("long")
    ticks = ticks.select("kind", "batch", zero.alias("click_id"), clock.alias("hour"), F.unhex(F.lit("00" * 32)).alias("hash"), F.col("batch").alias("n"), zero.alias("crc"), zero.alias("same"), "shard")
    ticks.coalesce(1).write.mode("append").partitionBy("batch").parquet(folder)
    return shards, floors[:batches]


# The chained operators --------------------------------------------------------------------------


def _gathered(frames: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> tuple[list[np.ndarray], list[bytes]]:
    parts = list(frames)
    numbers = [np.concatenate([f[c].to_numpy() for f in parts]).astype(np.int64) for c in columns]
    return numbers, [h for f in parts for h in f["hash"].tolist()]


def _raw(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), "V32")


def tagger(window: int):
    """The first operator: state (click, start, opener's hash) of open windows; gives counts and control events by window.

    Rows of a click go by hour, then hash. A click's heads are taken one after the other, those of
    all clicks of the shard at once.
    """

    def run(key, frames, state):
        (kind, click, hour, n, crc, same), hashes = _gathered(frames, ("kind", "click_id", "hour", "n", "crc", "same"))
        raw = _raw(hashes)
        tick = np.flatnonzero(kind == TICK)
        if len(tick) != 1:
            raise ValueError("a batch without its one control event")
        clock, batch = int(hour[tick[0]]), int(n[tick[0]])
        out = []  # kind, click, start, hour, hash, n, crc, same, closed

        def give(kind, click, start, hour, raw, n, crc, same, closed):
            if m := len(click):
                whole = lambda x: np.full(m, x, np.int64) if np.isscalar(x) else x
                blob = np.ascontiguousarray(raw).tobytes()
                out.append((whole(kind), click, whole(start), whole(hour), [blob[i : i + 32] for i in range(0, 32 * m, 32)], whole(n), whole(crc), whole(same), whole(closed)))

        heads = kind == HEAD
        (at, opener, n_, crc_, same_), (other, other_hash, other_n) = merged(np.stack([click[heads], hour[heads]], axis=1), np.frombuffer(raw[heads].tobytes(), ">u8").reshape(-1, 4).astype("<u8"), n[heads], crc[heads], same[heads])
        detail = kind == DETAIL
        give(DETAIL, click[detail], 0, hour[detail], raw[detail], n[detail], 0, 0, -1)
        give(DETAIL, other[:, 0], 0, other[:, 1], _raw(_blobs(other_hash)), other_n, 0, 0, -1)
        was = np.frombuffer(state.get[0], _CLICK) if state.exists else np.zeros(0, _CLICK)
        opener = np.frombuffer(opener.astype(">u8").tobytes(), "V32")
        # slots: clicks with an open window or a head
        ids = np.unique(np.concatenate([was["click"], at[:, 0]]))
        start, has, own = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), np.zeros(len(ids), "V32")
        slot = np.searchsorted(ids, was["click"])
        start[slot], has[slot], own[slot] = was["start"], True, was["hash"]
        slots = np.searchsorted(ids, at[:, 0])
        first = np.ones(len(slots), bool)
        first[1:] = slots[1:] != slots[:-1]
        begins = np.flatnonzero(first)
        rank = np.arange(len(slots)) - np.repeat(begins, np.diff(np.r_[begins, len(slots)]))
        tag, tag_hash = np.zeros(len(slots), np.int64), np.zeros(len(slots), "V32")
        by_rank = np.argsort(rank, kind="stable")
        ends = np.cumsum(np.bincount(rank)) if len(rank) else []
        begin = 0
        for end in ends:
            i = by_rank[begin:end]
            begin, k = end, slots[i]
            opens = ~has[k] | (at[i, 1] > start[k] + window)
            over = k[opens & has[k]]
            give(HEAD, ids[over], start[over], 0, own[over], 0, 0, 0, batch)
            new = k[opens]
            start[new], own[new], has[new] = at[i[opens], 1], opener[i[opens]], True
            tag[i], tag_hash[i] = start[k], own[k]
        due = has & (start + window < clock)
        # counts of a window's heads together, with the control event of those that are due
        if len(slots):
            again = np.ones(len(slots), bool)
            again[1:] = first[1:] | (tag[1:] != tag[:-1])
            w = np.flatnonzero(again)
            alike = np.where(opener == tag_hash, same_, 0)
            sums = [np.add.reduceat(x, w) for x in (n_, crc_, alike)]
            closed = np.where(due[slots[w]] & (tag[w] == start[slots[w]]), batch, -1)
            give(HEAD, at[w, 0], tag[w], 0, tag_hash[w], *sums, closed)
            told = np.zeros(len(ids), bool)
            told[slots] = True
            alone = due & ~told
            mixed = n_ > same_  # hours with more hashes than one
            give(TICK, at[mixed, 0], tag[mixed], at[mixed, 1], tag_hash[mixed], 0, 0, 0, -1)
        else:
            alone = due
        give(HEAD, ids[alone], start[alone], 0, own[alone], 0, 0, 0, batch)
        left = has & ~due
        kept = np.zeros(int(left.sum()), _CLICK)
        kept["click"], kept["start"], kept["hash"] = ids[left], start[left], own[left]
        state.update((kept.tobytes(),))
        if out:
            cols = list(zip(*out))
            join = lambda i: np.concatenate(cols[i])
            yield pd.DataFrame({"kind": join(0).astype(np.int32), "click_id": join(1), "start": join(2), "hour": join(3), "hash": [h for x in cols[4] for h in x], "n": join(5), "crc": join(6), "same": join(7), "closed": join(8).astype(np.int32)})

    return run


def counter(key, frames, state):
    """The second operator: state (click, start, n, crc, same, opener's hash) of windows; gives those out that a control event closes.

    A detail counts for the window that its click and hour are tagged with, if it has the opener's hash.
    """
    (kind, click, start, hour, n, crc, same, closed), hashes = _gathered(frames, ("kind", "click_id", "start", "hour", "n", "crc", "same", "closed"))
    raw = _raw(hashes)
    was = np.frombuffer(state.get[0], _WINDOW) if state.exists else np.zeros(0, _WINDOW)
    add = kind == HEAD
    at = [np.concatenate([was["click"], click[add]]), np.concatenate([was["start"], start[add]])]
    order = np.lexsort((at[1], at[0]))
    at = [x[order] for x in at]
    new = np.ones(len(order), bool)
    new[1:] = (at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1])
    w = np.flatnonzero(new)
    if not len(w):
        return
    total = lambda old, more, f=np.add: f.reduceat(np.concatenate([old, more])[order], w)
    now = np.zeros(len(w), _WINDOW)
    now["click"], now["start"] = at[0][w], at[1][w]
    now["n"], now["crc"], now["same"] = total(was["n"], n[add]), total(was["crc"], crc[add]), total(was["same"], same[add])
    now["hash"] = np.concatenate([was["hash"], raw[add]])[order][w]
    done = total(np.full(len(was), -1), closed[add], np.maximum)
    hours = {(int(click[i]), int(hour[i]), hashes[i]): int(start[i]) for i in np.flatnonzero(kind == TICK)}
    if hours:
        places = {(int(c), int(s)): i for i, (c, s) in enumerate(zip(now["click"], now["start"]))}
        for i in np.flatnonzero(kind == DETAIL):
            s = hours.get((int(click[i]), int(hour[i]), hashes[i]))
            if s is not None:
                now["same"][places[int(click[i]), s]] += n[i]
    state.update((now[done < 0].tobytes(),))
    out = now[done >= 0]
    if len(out):
        blob = np.ascontiguousarray(out["hash"]).tobytes()
        yield pd.DataFrame({"click_id": out["click"], "start_hour": out["start"], "closed_batch": done[done >= 0].astype(np.int32), "n": out["n"], "crc": out["crc"], "same": out["same"], "hash": [blob[i : i + 32] for i in range(0, len(blob), 32)]})


def chained(fed: DataFrame, shards: int, window: int = WINDOW_HOURS) -> DataFrame:
    """Closed windows of a stream of heads, details and control events."""
    tagged = fed.groupBy("shard").applyInPandasWithState(tagger(window), _TAGGED, "windows binary", "append", "NoTimeout")
    return tagged.withColumn("shard", _shard(shards, "click_id", "hash")).groupBy("shard").applyInPandasWithState(counter, _CLOSED, "windows binary", "append", "NoTimeout")


@contextmanager
def _chain_allowed(spark: SparkSession):
    """Spark's check of plans refuses a second operator of this kind, as watermarks and timeouts would go wrong there.

    These two have neither: what the second one sees in a batch is what the first one gave in it.
    The other chainable operator, transformWithState, starts a Python process for every task, which
    took 8 seconds a batch on four cores. The setting of before comes back.
    """
    name = "spark.sql.streaming.unsupportedOperationCheck"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _step(spark: SparkSession, folder: str, batch: int, least: int | None, shards: int, window: int) -> None:
    """Feeds one more batch to the query, which starts anew on its checkpoint."""
    paths = "{" + ",".join(map(str, range(batch + 1))) + "}"
    fed = spark.readStream.schema(_FED).parquet(f"{folder}/in/batch={paths}")
    if least is not None:
        fed = fed.filter((F.col("kind") == TICK) | (F.col("hour") >= least))
    out = chained(fed, shards, window).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windows(clicks: DataFrame, batches: int = BATCHES, window: int = WINDOW_HOURS, late: int = LATE_HOURS) -> DataFrame:
    """click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash of every window.

    Everything goes to a new folder: the batches, the one checkpoint that the query is started on anew for each of them, and the windows.
    """
    spark = clicks.sparkSession
    folder = fresh_folder(spark, "clicks")
    shards, floors = cut(clicks, f"{folder}/in", batches, late)
    with _chain_allowed(spark):
        for b, least in enumerate(floors):
            _step(spark, folder, b, least, shards, window)
    got = spark.read.schema(_CLOSED).parquet(f"{folder}/out") if floors else spark.createDataFrame([], _CLOSED)
    got = got.withColumn("hash", F.lower(F.hex("hash")))
    own = F.crc32(F.col("hash").cast("binary"))
    return got.select("click_id", "start_hour", F.col("closed_batch").cast("long").alias("closed_batch"), (F.col("n") - 1).alias("n_repeats"), (F.col("n") - F.col("same")).alias("n_conflicts"), (F.col("crc") - F.col("same") * own).alias("conflict_crc"), "hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
