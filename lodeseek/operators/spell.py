"""Spelling: the nearest vocabulary word of about the same length.

A stored vocabulary has a second table by deletions: each word under what is left of it after up to two letters
have gone. Two words within two edits share such a key, so that near words are looked up; only for a word without
any the vocabulary of three lengths is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS


#: Unknown words that are broadcast at most, and parts of each length of the vocabulary beyond them.
MAX_WORDS, PARTS = 10_000, 64


#: Keys that a word has in the table of deletions, about, and letters of a misspelt word that is looked up there.
KEYS_A_WORD, MAX_LOOKUP = 46, 24


def deletions(words: DataFrame, tasks: int | None = None) -> DataFrame:
    """(key, word): each word and what is left of it without one or two of its letters, made in so many tasks."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = F.when(F.length("word") > 0, less(F.col("word"))).otherwise(F.array().cast("array<string>"))
    each = words.select("word").distinct()
    x = (each.repartition(tasks, "word") if tasks else each).withColumn("one", F.array_distinct(one))
    two = F.flatten(F.transform(F.filter("one", lambda w: w != ""), less))
    return x.select(F.explode(F.array_distinct(F.concat(F.array("word"), "one", two))).alias("key"), "word")


def keys_of(word: str) -> set[str]:
    """The same keys of one word."""
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word} | one | {w[:i] + w[i + 1 :] for w in one for i in range(len(w))}


def correct_stored(words: list[str], stored, stop_words=STOP_WORDS) -> tuple[list[str], int]:
    """The words after spelling, as correct() gives them, and how many had to be compared with whole lengths."""
    spark = stored.spark
    known = {r.word for r in stored.vocabulary(sorted({len(w) for w in words})).filter(F.col("word").isin(*set(words))).select("word").collect()}  # at most the words
    asked = sorted({w for w in words if w not in known and w not in stop_words})
    found: dict[str, str] = {}
    short = [w for w in asked if len(w) <= MAX_LOOKUP]
    if short:
        keys = {k: None for w in short for k in sorted(keys_of(w))}
        pairs = spark.createDataFrame([(w, k) for w in short for k in sorted(keys_of(w))], "word string, key string")
        near = stored.some("deletes", "key", list(keys)).select("key", F.col("word").alias("candidate")).join(F.broadcast(pairs), "key")  # keys of a request's words
        near = near.select("word", "candidate", (F.length("candidate") - F.length("word")).alias("more")).filter("abs(more) <= 1").distinct()
        near = near.withColumn("d", F.levenshtein("word", "candidate")).filter("d <= 2")
        best = near.groupBy("word").agg(F.min(F.struct("d", F.when(F.col("more") < 0, 2).otherwise(F.col("more")).alias("o"), "candidate")).alias("b"))
        found = {r.word: r.candidate for r in best.select("word", "b.candidate").collect()}
    far = [w for w in asked if w not in found]
    if far:
        lengths = sorted({len(w) + d for w in far for d in (-1, 0, 1)})
        rows = correct(spark.createDataFrame(list(enumerate(far)), "pos long, word string"), stored.vocabulary(lengths), ())
        found |= {r.word: r.corrected for r in rows.collect()}
    return [found.get(w, w) for w in words], len(far)


def correct(words: DataFrame, vocabulary: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """words: (pos, word). Adds corrected.

    Known words and stop words stay. Others become the vocabulary word with the least edit
    distance among those of the same length, then one longer, then one shorter, then by word;
    a word without candidates stays. Only unknown words are compared: up to MAX_WORDS of them go to
    wherever the vocabulary is; more are dealt out by length and a part of the vocabulary's hash, as
    there are few lengths.
    """
    known = words.join(vocabulary.select("word").distinct(), "word", "left_semi")
    unknown = words.join(known.select("pos"), "pos", "left_anti").filter(~F.col("word").isin(*stop_words) if stop_words else F.lit(True))
    n = F.length("word")
    lengths = F.array(*[F.struct(F.lit(i).alias("o"), (n + d).alias("len")) for i, d in enumerate((0, 1, -1))])
    wanted = unknown.select("pos", "word", F.explode(lengths).alias("l")).select("pos", "word", "l.o", "l.len")
    candidates = vocabulary.select(F.col("word").alias("candidate"), F.length("word").alias("len")).distinct()
    if unknown.count() <= MAX_WORDS:
        pairs = candidates.join(F.broadcast(wanted), "len")  # at most three rows a word
    else:
        part = F.pmod(F.xxhash64("candidate"), F.lit(PARTS)).cast("int")
        pairs = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).join(candidates.withColumn("part", part), ["len", "part"])
    best = pairs.groupBy("pos").agg(F.min(F.struct(F.levenshtein("word", "candidate").alias("d"), "o", "candidate")).alias("b"))
    return words.join(best.select("pos", F.col("b.candidate").alias("c")), "pos", "left").select("pos", "word", F.coalesce("c", "word").alias("corrected"))
