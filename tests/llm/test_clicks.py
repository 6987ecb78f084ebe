import collections
import datetime as dt
import hashlib
import zlib

from pyspark.sql import functions as F

from lodeseek.llm import op12_clicks

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
EPOCH = dt.datetime(1970, 1, 1)


def micros(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def brute(rows, batches=12, window=72, late=48):
    """A plain loop over (click_id, ts, arrived_at, client_id, kind, value, props)."""
    import math

    got = []
    for i, ts, at, client, kind, value, props in rows:
        if i is None or at is None or i % 3 != math.fmod(i, 3):
            continue
        for j in range(i % 3 + 1):
            c = zlib.crc32(f"{i}:{j}".encode())
            hour = micros(at) // 3_600_000_000 + 6 * j * (c % 10)
            cents = "" if value is None else str(math.floor(100 * value + 0.5))
            told = "|".join(["" if client is None else str(client), kind or "", cents, "" if ts is None else str(micros(ts)), props or "", str(c % 3)])
            got.append((hour + c // 10 % 200, i, hour, hashlib.sha256(told.encode()).hexdigest()))
    if not got:
        return []
    lo, hi = min(got)[0], max(got)[0]
    by = collections.defaultdict(list)
    for place, i, hour, h in got:
        by[(place - lo) * batches // (hi - lo + 1)].append((i, hour, h))
    out, opened, most = [], {}, None
    for b in range(batches):
        for i, hour, h in sorted(x for x in by[b] if most is None or x[1] >= most - late):
            w = opened.get(i)
            if w and hour <= w[0] + window:
                w[2] += 1
                if h != w[1]:
                    w[3] += 1
                    w[4] += zlib.crc32(h.encode())
            else:
                if w:
                    out.append((i, w[0], b, *w[2:], w[1]))
                opened[i] = [hour, h, 0, 0, 0]
        most = max([hour for _, hour, _ in by[b]] + ([] if most is None else [most]), default=None)
        for i, w in list(opened.items()):
            if b == batches - 1 or w[0] + window < most - late:
                out.append((i, w[0], b, *w[2:], w[1]))
                del opened[i]
    return sorted(out)


def of(df):
    return sorted(tuple(r) for r in df.select("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash").collect())


def test_query_is_the_plain_loop(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/clicks.parquet").select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").collect()
    want = brute(rows)
    assert len(want) > 1000 and any(x[4] for x in want) and len({x[2] for x in want}) > 6
    assert of(op12_clicks.query(spark, sf_dir)) == want


def test_hot_click_nulls_ties_and_repeats(spark):
    import random

    rnd, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = []
    for k in range(1500):
        i = 2 if k % 3 == 0 else rnd.choice([None, *range(40), -5])
        at = None if rnd.random() < 0.02 else start + dt.timedelta(minutes=rnd.randrange(60 * 24 * 60))
        rows.append((i, None if k % 7 == 0 else start, at, k % 2 or None, rnd.choice([None, "a", "a|b"]), rnd.choice([None, 1.005, -2.5]), rnd.choice([None, "{}"])))
    rows += rows[:200]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("batch", F.lit("another column"))
    for batches in (12, 3):
        want = brute(rows, batches)
        assert max(x[3] for x in want if x[0] == 2) > 10
        assert of(op12_clicks.windows(df, batches)) == want


def test_no_clicks(spark):
    assert op12_clicks.windows(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(1, None, dt.datetime(2024, 1, 1), None, None, v, None) for v in (float("nan"), float("inf"))]
    assert {r.n_repeats for r in op12_clicks.windows(spark.createDataFrame(odd, SCHEMA), 2).collect()} == {3}


def test_hot_rows_are_summed_before_they_are_dealt_out():
    import numpy as np

    at, keys = np.array([[0, 5, 1]] * 6), np.zeros((6, 4), "<u8")
    keys[:, 3] = [3, 1, 1, 2, 3, 3]
    one = np.ones(6, np.int64)
    heads, details = op12_clicks.merged(at, keys, one, one * 10, one)
    assert [x.tolist() for x in heads] == [[[0, 5, 1]], [[0, 0, 0, 1]], [6], [60], [2]]
    assert [x.tolist() for x in details] == [[[0, 5, 1]] * 2, [[0, 0, 0, 2], [0, 0, 0, 3]], [1, 3]]
