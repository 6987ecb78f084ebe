"""Quality rules as a ledger of failure bits [native].

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per
failed rule. A policy is a version with the mask of bits that reject. Policies and ablations
read the ledger's bits alone, so a new policy never reads a text again.

Edge cases: a null text has no words and fails the base rule; an empty table gives an empty
ledger; texts of any length are read whole; repeated rows each give a row; columns of the input other
than the text are kept as they are, whatever their names, but columns that clash with a ledger column
are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, fresh_name, text_of

#: Bit of each rule.
RULES = {"few_words": 0, "repeated_words": 1, "symbols": 2, "repeated_lines": 3, "word_length": 4, "symbol_share": 5}
#: Version -> names of rules that reject. v1 is the base; v2 adds the method's rules; v3 has the narrow limit of symbols.
POLICIES = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length"),
    "v3": ("few_words", "repeated_words", "symbol_share", "repeated_lines", "word_length"),
}
#: The query and its SQL are v3. v2's limit of symbols is too wide: a lone symbol is a word too, so text of
#: which every second word is a symbol stays inside it.
CURRENT = "v3"
#: Limits of the method's rules.
MAX_SYMBOLS_PER_WORD = 0.5
#: The usual published limit of symbols a word, of the rule symbol_share.
MAX_SYMBOL_SHARE = 0.1
MAX_DUP_LINE_SHARE = 0.9
MIN_LINES = 10
WORD_LENGTH = (1.5, 20.0)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def mask(names) -> int:
    return sum(1 << RULES[n] for n in names)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of MEASURES (long)."""
    t = text_of(text)
    p = fresh_name(docs, "__")
    stage = docs.drop(*[m for m in MEASURES if m != text]).withColumn(f"{p}t", t)
    stage = stage.withColumn(f"{p}w", F.array_remove(F.split(f"{p}t", f"[{WS}]+"), ""))
    stage = stage.withColumn(f"{p}l", F.filter(F.split(f"{p}t", "\n"), lambda x: x.rlike(f"[^{WS}]")))
    stage = stage.withColumn("n_words", F.size(f"{p}w").cast("long"))
    # Windows whose short hash meets an equal one are candidates; only those are compared as strings.
    # A long holds 36 bits of hash and 28 of the position, so that the sort is over primitives.
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.size(f"{p}w") - 3)).otherwise(F.array().cast("array<int>"))
    part = lambda i: F.get(f"{p}w", i)
    packed = lambda i: F.shiftleft(F.xxhash64(part(i), part(i + 1), part(i + 2)), 28).bitwiseOR(i.cast("long"))
    stage = stage.withColumn(f"{p}q", F.sort_array(F.transform(starts, packed)))
    top = lambda x: F.shiftrightunsigned(x, 28)
    q = lambda k: F.get(f"{p}q", k)
    pairs = F.when(F.size(f"{p}q") >= 2, F.sequence(F.lit(0), F.size(f"{p}q") - 2)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(pairs, lambda k: F.shiftrightunsigned(q(k).bitwiseXOR(q(k + 1)), 28) == 0)
    stage = stage.withColumn(f"{p}c", F.array_distinct(F.flatten(F.transform(hits, lambda k: F.array(q(k), q(k + 1))))))
    at = lambda x: x.bitwiseAND(F.lit((1 << 28) - 1)).cast("int")
    gram = lambda i: F.concat_ws(" ", part(i), part(i + 1), part(i + 2))
    stage = stage.withColumn(f"{p}g", F.sort_array(F.transform(f"{p}c", lambda x: F.struct(top(x).alias("h"), gram(at(x)).alias("g"), at(x).alias("i")))))

    def again(x: Column, k: Column) -> Column:
        same = lambda j: (F.get(f"{p}g", j)["h"] == x["h"]) & (F.get(f"{p}g", j)["g"] == x["g"])
        return F.coalesce(same(k - 1), F.lit(False)) | F.coalesce(same(k + 1), F.lit(False))

    stage = stage.withColumn(f"{p}r", F.transform(F.filter(f"{p}g", again), lambda x: x["i"]))
    covered = F.array_distinct(F.flatten(F.transform(f"{p}r", lambda i: F.array(i, i + 1, i + 2))))
    found = F.struct(
        F.col("n_words"),
        F.char_length(F.array_join(f"{p}w", "")).cast("long").alias("word_chars"),
        F.regexp_count(f"{p}t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size(f"{p}l").cast("long").alias("n_lines"),
    )
    # a generator ends the projections: a later filter on measures would else be pushed down as one nested expression
    rest = [c for c in stage.columns if c not in (f"{p}t", f"{p}w", f"{p}l", f"{p}q", f"{p}c", f"{p}g", f"{p}r", *MEASURES)]
    return stage.select(*[F.col(f"`{c}`") for c in rest], F.inline(F.array(found)))


def conditions() -> dict[str, Column]:
    """Rule -> condition that is true where it fails."""
    n, c = F.col, lambda x: F.lit(float(x))
    return {
        "few_words": n("n_words") < 50,
        "repeated_words": 100 * n("n_repeat_words") > 50 * n("n_words"),
        "symbols": n("n_symbols") > c(MAX_SYMBOLS_PER_WORD) * n("n_words"),
        "symbol_share": n("n_symbols") > c(MAX_SYMBOL_SHARE) * n("n_words"),
        "repeated_lines": (n("n_lines") >= MIN_LINES) & (n("n_dup_lines") > c(MAX_DUP_LINE_SHARE) * n("n_lines")),
        "word_length": (n("n_words") > 0) & ((n("word_chars") < c(WORD_LENGTH[0]) * n("n_words")) | (n("word_chars") > c(WORD_LENGTH[1]) * n("n_words"))),
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES and fail_bits (int)."""
    bits = F.lit(0)
    for name, failed in conditions().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << RULES[name])).otherwise(F.lit(0)))
    return measure(docs, text).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with kept (boolean) under one policy."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """One row per rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    Documents are first counted by bit pattern, at most 2**rules rows, with partial counts.
    The any_bits and all_bits columns are the OR and AND of the rejected documents' patterns.
    """
    m = mask(POLICIES[version])
    patterns = led.select(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).alias("bit")) for r in POLICIES[version]])
    rows = patterns.select("p", "n", F.explode(rules).alias("r")).select("p", "n", "r.rule", "r.bit")
    hit = F.col("p").bitwiseAND(F.col("bit")) != 0
    rest = F.col("p").bitwiseAND(F.lit(m).bitwiseXOR(F.col("bit")))
    zero = F.lit(0).cast("long")
    return rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(zero)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(zero)).alias("n_kept_without"),
        F.bit_or(F.when(hit, F.col("p")).otherwise(0)).alias("any_bits"),
        F.bit_and(F.when(hit, F.col("p")).otherwise(F.lit(m))).alias("all_bits"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = apply_policy(ledger(docs.select("doc_id", "text")))
    of = lambda version: F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (of("v1") != 0).alias("base_failed"), "kept", of(CURRENT).alias("fail_bits"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g2 AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM g),
g3 AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g2),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE c >= 2) GROUP BY k),
m AS (SELECT w.doc_id, len(w) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r ON w.k = r.k),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             | (CASE WHEN n_symbols > 0.5::DOUBLE * n_words THEN 4 ELSE 0 END) | (CASE WHEN n_symbols > 0.1::DOUBLE * n_words THEN 32 ELSE 0 END)
             | (CASE WHEN n_lines >= 10 AND n_dup_lines > 0.9::DOUBLE * n_lines THEN 8 ELSE 0 END)
             | (CASE WHEN n_words > 0 AND (word_chars < 1.5::DOUBLE * n_words OR word_chars > 20.0::DOUBLE * n_words) THEN 16 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 59) = 0 AS kept, (fail_bits & 59)::INTEGER AS fail_bits
FROM b
"""
