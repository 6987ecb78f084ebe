"""Frontier expansion, claims, cool-downs and rate limits over DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import shared_folder

PAGE_LIMIT, QUEUE_LIMIT = 50_000, 5_000
COOL_DOWN_SECONDS = 30
RATE_LIMIT, RATE_WINDOW, RATE_WINDOW_SECONDS = 150, "10 minutes", 600


def expand(targets: DataFrame, visited: DataFrame, limit: int | None = PAGE_LIMIT) -> DataFrame:
    """(url): targets (url), normalised once more, that weren't visited; by url, at most limit or all if it is None."""
    new = targets.select(urls.normalized(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()
    new = new.join(visited.select("url").distinct(), "url", "left_anti").orderBy("url")
    return new if limit is None else new.limit(limit)


def claim(rows: DataFrame, url: str, order: str) -> DataFrame:
    """The first row of each URL."""
    w = Window.partitionBy(url).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def cooled(fetches: DataFrame, seconds: int = COOL_DOWN_SECONDS) -> DataFrame:
    """fetches (id, host, ts, status) with blocked: whether a 429 of the host came before (by ts, then id) and less than so many seconds back.

    A host's time is cut into stretches of that many seconds. What blocks a row stands in its own
    stretch or in the one before: of that one the last 429 is enough, so no host is sorted as a whole.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    width = seconds * 1_000_000
    rows = fetches.withColumns({"us": us, "cell": F.floor(us / F.lit(width))})
    own = Window.partitionBy("host", "cell").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.when(F.col("status") == 429, F.col("us"))
    last = rows.groupBy(F.col("host").alias("h"), (F.col("cell") + 1).alias("c")).agg(F.max(stop).alias("far")).filter("far IS NOT NULL")
    out = rows.withColumn("near", F.max(stop).over(own)).join(last, F.col("host").eqNullSafe(F.col("h")) & (F.col("cell") == F.col("c")), "left")
    return out.select(*fetches.columns, F.coalesce(F.col("us") - F.greatest("near", "far") < width, F.lit(False)).alias("blocked"))


def over_limit(events: DataFrame, client: str, ts: str, limit: int = RATE_LIMIT, window: str = RATE_WINDOW) -> DataFrame:
    """(client, window_start, n) of clients with more than limit requests in a window."""
    got = events.groupBy(client, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return got.select(client, F.col("w.start").alias("window_start"), "n")


#: Requests of a client that are read one after the other; the time of clients with more is cut into stretches of so many seconds.
REQUESTS_IN_TURN, STRETCH_SECONDS = 1_000_000, 3_600
#: Clients with so many requests that are broadcast at most.
MAX_HOT = 100_000


def _exits(us: np.ndarray, width: int) -> np.ndarray:
    """For windows that begin with each of a stretch's sorted times: when the last window of the chain from there ends."""
    n = len(us)
    to = np.searchsorted(us, us + width)
    last, at = np.arange(n), to
    while (at < n).any():
        ok = at < n
        last = np.where(ok, np.minimum(at, n - 1), last)
        at = np.where(ok, to[np.minimum(at, n - 1)], n)
    return us[last] + width


def limited(requests: DataFrame, limit: int = RATE_LIMIT, seconds: int = RATE_WINDOW_SECONDS, stretch: int = STRETCH_SECONDS, in_turn: int = REQUESTS_IN_TURN) -> DataFrame:
    """requests (id, client, ts) with window_start, n (its place in the window, by ts and id) and allowed.

    A client's window begins with its first request and lasts so many seconds; the first request at or after its
    end begins the next. Up to limit requests of a window are allowed. Requests without a time are left out; those
    without a client count as one client.

    Requests are read in the order of clients and times. The time of clients with more than in_turn requests is cut
    into stretches, none shorter than a window, so that no such client is read as a whole: for each stretch it is
    worked out when its last window would end, for every time at which the first could begin. Few of these ends
    differ, as chains of windows meet. A client's stretches are then followed by these alone, and each stretch is
    read on its own, told when the window before it ends.
    """
    width, span = seconds * 1_000_000, max(stretch, seconds) * 1_000_000
    never = -(1 << 62)
    rows = requests.select("id", "client", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).filter("us IS NOT NULL")
    rows = rows.withColumn("who", F.coalesce(F.concat(F.lit("c"), F.col("client").cast("string")), F.lit(""))).drop("client")
    hot = rows.groupBy("who").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > in_turn).select("who", F.lit(True).alias("hot"))
    many = hot.count()
    if many:
        rows = rows.join(F.broadcast(hot) if many <= MAX_HOT else hot, "who", "left")
        rows = rows.withColumn("cell", F.when(F.col("hot"), F.floor(F.col("us") / F.lit(span))).otherwise(0).cast("long"))
        told = _follow(rows.filter("hot").select("who", "cell", "us").distinct(), width, span, never)
        rows = rows.join(told, (F.col("who") == F.col("w")) & (F.col("cell") == F.col("c")), "left").select("id", "us", "who", "cell", F.coalesce("free", F.lit(never)).alias("free"))
    else:
        rows = rows.withColumns({"cell": F.lit(0).cast("long"), "free": F.lit(never)})

    def name(frames):
        last, start = None, never
        for f in frames:
            out = []
            for who, cell, us, free in zip(f["who"].tolist(), f["cell"].tolist(), f["us"].tolist(), f["free"].tolist()):
                if (who, cell) != last:
                    last, start = (who, cell), free - width if free > never else never
                if us >= start + width:
                    start = us
                out.append(start)
            yield f[["id", "who", "us"]].assign(start=out)

    kind = requests.schema["id"].dataType.simpleString()
    named = rows.repartition("who", "cell").sortWithinPartitions("who", "cell", "us").mapInPandas(name, f"id {kind}, who string, us long, start long")
    out = named.withColumn("n", F.row_number().over(Window.partitionBy("who", "start").orderBy("us", "id")))
    client = F.when(F.col("who") != "", F.substring("who", 2, 1 << 30)).cast(requests.schema["client"].dataType)
    return out.select("id", client.alias("client"), F.timestamp_micros("us").alias("ts"), F.timestamp_micros("start").alias("window_start"), "n", (F.col("n") <= limit).alias("allowed"))


def _follow(times: DataFrame, width: int, span: int, never: int) -> DataFrame:
    """(w, c, free): for each stretch of a client's times (who, cell, us) when the window before it ends."""

    def ends(pdf):
        us = np.sort(pdf["us"].to_numpy())
        first = int(np.searchsorted(us, int(pdf["cell"].iloc[0]) * span + width)) + 1  # the window before ends within the first `width`
        exits = _exits(us, width)[:first]
        keep = np.r_[exits[1:] != exits[:-1], True]
        return pd.DataFrame({"who": pdf["who"].iloc[0], "cell": pdf["cell"].iloc[0], "upto": us[:first][keep], "until": exits[keep]})

    def follow(pdf):
        out, free = [], never
        for cell, part in pdf.sort_values(["cell", "upto"]).groupby("cell", sort=True):
            out.append((cell, free))
            i = int(np.searchsorted(part["upto"].to_numpy(), free))
            free = int(part["until"].iloc[i]) if i < len(part) else free
        return pd.DataFrame({"w": pdf["who"].iloc[0], "c": [x[0] for x in out], "free": [x[1] for x in out]})

    pieces = times.groupBy("who", "cell").applyInPandas(ends, "who string, cell long, upto long, until long")
    return pieces.groupBy("who").applyInPandas(follow, "w string, c long, free long")


def simulate(pages: DataFrame, links: DataFrame, seed: str, rounds: int, limit: int = PAGE_LIMIT) -> DataFrame:
    """(url, depth): what a crawl from a seed reaches over links (from_url, to_url) among pages (url); the nearest first, then by url.

    Each round's frontier is checkpointed, so that plans don't grow, and a crawl that has reached the limit or nothing new ends.
    """
    shared_folder(pages.sparkSession)
    frontier = pages.filter(F.col("url") == seed).select("url", F.lit(0).alias("depth")).checkpoint()
    reached, n = frontier, frontier.count()
    for depth in range(1, rounds + 1):
        out = frontier.join(links, F.col("url") == F.col("from_url")).select(F.col("to_url").alias("url"))
        frontier = expand(out, reached, None).join(pages.select("url"), "url", "left_semi").select("url", F.lit(depth).alias("depth")).checkpoint()
        new = frontier.count()
        reached, n = reached.unionByName(frontier), n + new
        if not new or n >= limit:
            break
    return reached.orderBy("depth", "url").limit(limit)
