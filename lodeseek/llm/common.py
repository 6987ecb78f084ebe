"""What the operators of this folder share: checkpoints, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: ASCII white space of the word contracts; a regular-expression class body.
WS = r"\x20\x09-\x0D"
#: The same six characters, for translate().
WS_CHARS = " \t\n\x0b\x0c\r"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: lineage ends here."""
    shared_folder(df.sparkSession)  # sets where checkpoints go
    return df.checkpoint(eager=True)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df (in any case) begins with it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name = "_" + name
    return name


def text_of(col: Column | str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges of one orderable type -> (node, component), component the least node reachable.

    Large-star and small-star rounds: each moves edges towards the least neighbour and keeps
    the components. A round's minima are checkpointed before they are joined, so that both
    sides of the join are plain exchanges and a hub's edges can be split. Nodes of self loops
    count; rows with a null end are left out.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("ok")).filter("ok").drop("ok")
    e = cut(e.distinct())
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = e.filter("a <> b")
    if e.isEmpty():
        return nodes.select("node", F.col("node").alias("component"))
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = cut(large)
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = cut(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"))
        joined = down.join(low, F.col("u") == F.col("w"))
        small = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("w").alias("b")))
        e = cut(small.filter("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == mark:
            break
        mark = (now.n, now.h)
    else:
        raise RuntimeError("components did not settle")
    root = e.groupBy("b").agg(F.min("a").alias("component"))
    return nodes.join(root, F.col("node") == F.col("b"), "left").select("node", F.coalesce("component", "node").alias("component"))


def resolve_roots(parts: DataFrame) -> DataFrame:
    """(node, root) rows of overlapping local results -> (node, component).

    root is the least node of a local component. A node met in several local results ties
    their roots together; only the few roots go through the rounds of components.
    """
    parts = cut(parts.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n")).drop("n"))
    first = cut(parts.groupBy("node").agg(F.min("root").alias("m")))
    ties = parts.join(first, "node").filter("root <> m").select(F.col("m").alias("a"), F.col("root").alias("b"))
    # a root is itself a node of its local component
    comp = cut(connected_components(ties))
    return first.join(comp.withColumnRenamed("node", "r"), F.col("m") == F.col("r"), "left").select("node", F.coalesce("component", "m").alias("component"))
