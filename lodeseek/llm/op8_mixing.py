"""Mixing sources to target weights by hierarchical budgeting [native].

A token budget goes down a tree domain > language > source. Every node splits its budget among
its children in proportion to their weights, but no child gets more than its subtree can give
(tokens x max_epochs); what a child can't use goes to its siblings first, and only what all
siblings together can't use is left to the ancestors' other branches. Each leaf then reads
whole seeded epochs and a token-prefix of one more epoch, in an order drawn anew for each epoch.

Budgets are exact integers: roundings are cumulative, so a node's children sum to its budget.
The prefix is found without ordering a leaf as a whole: sums by the leading hex digits of the
order key, then by the next ones, then single rows of the one group that holds the cut.

Edge cases: null levels become the empty name; a null or empty text has no tokens, and a row
without tokens follows its place in the order (it is taken if it stands before the cut);
repeated rows are separate rows that follow each other; a null key is drawn like an empty one; ties
of the drawn order go by key (null first), then tokens; texts of any length are counted whole; an empty
table gives an empty result; a weight of zero or less shuts a branch; other columns are left out, whatever
their names; a key named like a result column is returned as `key`.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, cut, text_of

LEVELS = ("domain", "lang", "source")
#: Weights by level and name, whole or not; names that are not listed have weight 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "es": 2, "fr": 2}, "source": {"src0": 2}}
#: Greatest common denominator of a level's weights.
MAX_UNIT = 1_000_000
#: Budget as a share of all tokens, in hundredths.
BUDGET_PERCENT = 80
MAX_EPOCHS = 3
SEED = 17
#: Up to this many leaves the table of cuts is broadcast (about 100 bytes a row); beyond it is joined by a shuffle.
MAX_BROADCAST_LEAVES = 20_000
#: Hex digits of the order key that group rows at the first and at both levels.
DIGITS = (2, 4)
#: Copies of one row that are dealt out at once.
COPIES = 10_000
RESULT = (*LEVELS, "n_tokens", "epochs", "tail_tokens", "read")
BIG = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """The domain of a source name: its trailing number modulo 4, d0 without one."""
    n = F.try_to_number(F.right(F.regexp_extract(source, "([0-9]+)$", 1), F.lit(9)), F.lit("999999999"))
    return F.concat(F.lit("d"), F.coalesce(n.cast("int") % 4, F.lit(0)).cast("string"))


def word_count(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(text_of(text), f"[{WS}]+"), "")).cast("long")


def whole_weights(weights: dict) -> tuple[dict[str, int], int]:
    """A level's weights times their common denominator, and that number, the weight of names that aren't listed.

    A float counts as the decimal it is written as. ValueError if one is no finite number or the denominator is beyond MAX_UNIT.
    """
    exact = {}
    for name, w in weights.items():
        if isinstance(w, float) and not math.isfinite(w):
            raise ValueError(f"the weight of {name} is not a number")
        exact[name] = Fraction(str(w))
    unit = math.lcm(*(w.denominator for w in exact.values()))
    if unit > MAX_UNIT:
        raise ValueError(f"weights need a common denominator of at most {MAX_UNIT}")
    return {name: int(w * unit) for name, w in exact.items()}, unit


def weight_of(level: str, weights: dict) -> Column:
    known, unit = whole_weights(weights.get(level, {}))
    out = F.lit(unit)
    for name, w in sorted(known.items()):
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast(BIG)


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """One level: children with parent's budget (b), their weight (w) and capacity (c) get `alloc`.

    Sorted by capacity per weight, the children that fill up form a prefix: one is full if its
    capacity is below its share of what the fuller ones before it leave. The others split the
    rest; cumulative floors, by name, make the parts sum to it.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy((F.col("c").cast("double") / F.col("w").cast("double")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    live = children.filter("w > 0")
    x = live.withColumns({"c0": F.coalesce(F.sum("c").over(before), F.lit(0)).cast(BIG), "w0": (F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast(BIG)})
    x = x.withColumn("meets", F.col("c") * F.col("w0") <= (F.col("b") - F.col("c0")) * F.col("w"))
    # once one child isn't full, no later one is
    x = x.withColumn("full", F.min(F.col("meets").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rest = F.greatest(F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(by), F.lit(0)), F.lit(0)).cast(BIG)
    open_w = F.when(F.col("full"), F.lit(0)).otherwise(F.col("w")).cast(BIG)
    x = x.withColumns({"rest": rest, "ow": open_w})
    upto = F.sum("ow").over(by.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)).cast(BIG)
    x = x.withColumns({"upto": upto, "all_w": F.sum("ow").over(by).cast(BIG)})
    part = lambda u: F.expr(f"CAST((rest * {u}) DIV greatest(all_w, 1) AS {BIG})")
    got = F.when(F.col("full"), F.col("c")).otherwise(part("upto") - part("(upto - ow)"))
    return x.withColumn("alloc", got.cast("long")).drop("c0", "w0", "meets", "full", "rest", "ow", "upto", "all_w", "b", "w", "c")


def allocate(leaves: DataFrame, weights: dict, budget: Column, max_epochs: int) -> DataFrame:
    """leaves: LEVELS and n (tokens, long). Returns them with alloc (tokens to read)."""
    capacity = leaves.withColumn("c", (F.col("n") * max_epochs).cast(BIG))
    total = capacity.agg(F.coalesce(F.sum("n"), F.lit(0)).cast(BIG).alias("n"))
    above = total.select(budget.cast(BIG).alias("b"))
    parent: list[str] = []
    for depth, name in enumerate(LEVELS):
        here = list(LEVELS[: depth + 1])
        kids = capacity.groupBy(*here).agg(F.sum("c").cast(BIG).alias("c")).withColumn("w", weight_of(name, weights))
        if parent:
            kids = kids.join(above.withColumnRenamed("alloc", "b").withColumn("b", F.col("b").cast(BIG)), parent)
        else:
            kids = kids.crossJoin(F.broadcast(above))  # one row
        above = cut(share(kids, parent, name))
        parent = here
    return leaves.join(above, list(LEVELS))


def mix(docs: DataFrame, weights: dict = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """docs: key, LEVELS (strings), n_tokens (long). One row per selected row, with
    epochs (whole epochs it is read in) and tail_tokens (its tokens in the last, partial epoch).
    """
    # the key is called `id` until the end, so that it may have any name
    rows = docs.select(F.col(key).alias("id"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in LEVELS], F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    rows = cut(rows)
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")))
    plan = allocate(leaves, weights, F.expr(f"(n * {int(budget_percent)}) DIV 100"), max_epochs)
    plan = plan.select(*LEVELS, F.expr("IF(n > 0, alloc DIV n, 0)").alias("epochs"), F.expr("IF(n > 0, alloc % n, 0)").alias("rest"))
    plan = cut(plan)
    n_leaves = plan.count()
    small = F.broadcast if n_leaves <= MAX_BROADCAST_LEAVES else (lambda x: x)
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    keyed = rows.join(small(plan), list(LEVELS)).withColumn("k", drawn)
    keyed = keyed.withColumns({f"k{d}": F.substring("k", 1, d) for d in DIGITS})

    # the group that holds the cut, first by few digits, then by more: tokens of the groups before it stay below rest
    found = plan.withColumn("base", F.lit(0).cast("long"))
    held = keyed
    for at, d in enumerate(DIGITS):
        group = [*LEVELS, f"k{d}"]
        sums = held.groupBy(*group).agg(F.sum("n_tokens").alias("s"), F.first("rest").alias("rest"))
        before = Window.partitionBy(*LEVELS).orderBy(f"k{d}").rowsBetween(Window.unboundedPreceding, -1)
        if at:
            sums = sums.join(small(found.select(*LEVELS, "base")), list(LEVELS))
        else:
            sums = sums.withColumn("base", F.lit(0).cast("long"))
        sums = sums.withColumn("base", F.col("base") + F.coalesce(F.sum("s").over(before), F.lit(0)))
        found = cut(sums.filter("base < rest AND base + s >= rest").select(*LEVELS, F.col(f"k{d}").alias(f"at{d}"), "base"))
        held = held.join(small(found.select(*LEVELS, f"at{d}")), list(LEVELS)).filter(f"k{d} = at{d}").drop(f"at{d}")
    last = DIGITS[-1]
    tail_of = F.greatest(F.least("n_tokens", F.col("rest") - F.col("start")), F.lit(0)).cast("long")
    # copies of a row follow each other, so they are placed as one and dealt out again, a block of copies at a time
    same = held.groupBy(*LEVELS, "k", "id", "n_tokens", "epochs", "rest").agg(F.count(F.lit(1)).alias("copies"))
    one = Window.partitionBy(*LEVELS).orderBy("k", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    border = same.join(small(found.select(*LEVELS, "base")), list(LEVELS)).withColumn("start", F.col("base") + F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")).over(one), F.lit(0)))
    border = border.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) DIV {COPIES}")))).repartition(*LEVELS, "id", "block")
    border = border.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("block") * COPIES) - 1)))
    border = border.withColumn("start", F.col("start") + (F.col("block") * COPIES + F.col("copy")) * F.col("n_tokens"))
    border = border.select("id", *LEVELS, "n_tokens", "epochs", tail_of.alias("tail_tokens"), (F.col("start") < F.col("rest")).alias("read"))
    cuts = found.select(*LEVELS, F.col(f"at{last}").alias("at"))
    rest = keyed.join(small(cuts), list(LEVELS), "left").filter(f"at IS NULL OR k{last} <> at")
    read = F.coalesce(F.col(f"k{last}") < F.col("at"), F.lit(False))
    rest = rest.select("id", *LEVELS, "n_tokens", "epochs", F.when(read, F.col("n_tokens")).otherwise(F.lit(0)).cast("long").alias("tail_tokens"), read.alias("read"))
    out = rest.unionByName(border).filter("epochs > 0 OR read").withColumn("epochs", F.col("epochs").cast("long"))
    return out.withColumnRenamed("id", "key" if key in RESULT else key)


def leveled(docs: DataFrame) -> DataFrame:
    """documents with domain and n_tokens (words)."""
    return docs.withColumn("domain", domain_of(F.col("source"))).withColumn("n_tokens", word_count())


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(leveled(docs.select("doc_id", "text", "lang", "source")))
    return out.select("doc_id", *LEVELS, "n_tokens", "epochs", "tail_tokens", F.col("read").alias("in_tail"))


def _level_sql(depth: int) -> str:
    name, here, parent = LEVELS[depth], ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
    weight = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in sorted(WEIGHTS[name].items())) + " ELSE 1 END"
    part = f"PARTITION BY {parent}" if parent else ""
    budget = f"(SELECT any_value(p.alloc) FROM l{depth - 1} p WHERE " + " AND ".join(f"p.{x} = k.{x}" for x in LEVELS[:depth]) + ")" if depth else f"(SELECT (sum(n)::HUGEINT * {BUDGET_PERCENT}) // 100 FROM leaf)"
    return f"""
k{depth} AS (SELECT {here}, (sum(n) * {MAX_EPOCHS})::HUGEINT AS c, ({weight})::HUGEINT AS w FROM leaf GROUP BY {here}),
b{depth} AS (SELECT k.*, ({budget})::HUGEINT AS b FROM k{depth} k),
s{depth} AS (SELECT *, coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
  sum(w) OVER ({part}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0
  FROM b{depth} WINDOW o AS ({part} ORDER BY c::DOUBLE / w::DOUBLE, {name})),
m{depth} AS (SELECT *, min(CASE WHEN c * w0 <= (b - c0) * w THEN 1 ELSE 0 END) OVER ({part} ORDER BY c::DOUBLE / w::DOUBLE, {name} ROWS UNBOUNDED PRECEDING) AS f FROM s{depth}),
o{depth} AS (SELECT *, greatest(b - coalesce(sum(CASE WHEN f = 1 THEN c END) OVER ({part}), 0), 0) AS rest, CASE WHEN f = 1 THEN 0 ELSE w END AS ow FROM m{depth}),
u{depth} AS (SELECT *, sum(ow) OVER ({part} ORDER BY {name} ROWS UNBOUNDED PRECEDING) AS upto, greatest(sum(ow) OVER ({part}), 1) AS aw FROM o{depth}),
l{depth} AS (SELECT {here}, (CASE WHEN f = 1 THEN c ELSE (rest * upto)::HUGEINT // aw::HUGEINT - (rest * (upto - ow))::HUGEINT // aw::HUGEINT END)::HUGEINT AS alloc FROM u{depth})"""


SQL = rf"""
WITH d AS (SELECT doc_id, 'd' || (coalesce(try_cast(right(regexp_extract(source, '([0-9]+)$', 1), 9) AS INTEGER), 0) % 4) AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS n FROM d GROUP BY ALL),
{_level_sql(0)},
{_level_sql(1)},
{_level_sql(2)},
p AS (SELECT leaf.domain, leaf.lang, leaf.source, CASE WHEN n > 0 THEN alloc // n ELSE 0 END AS epochs, CASE WHEN n > 0 THEN alloc % n ELSE 0 END AS rest
  FROM leaf JOIN l2 ON leaf.domain = l2.domain AND leaf.lang = l2.lang AND leaf.source = l2.source),
r AS (SELECT d.*, p.epochs, p.rest, md5('{SEED}:' || p.epochs || ':' || doc_id) AS k
  FROM d JOIN p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source),
q AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r)
SELECT doc_id, domain, lang, source, n_tokens, epochs::BIGINT AS epochs, greatest(least(n_tokens, rest - start), 0)::BIGINT AS tail_tokens, start < rest AS in_tail
FROM q WHERE epochs > 0 OR start < rest
"""
