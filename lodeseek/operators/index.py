"""From pages or documents to the index tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..session import bounded_batches


def document_tokens(docs: DataFrame, key: str = "doc_id", column: str = "text", stop_words=text.STOP_WORDS) -> DataFrame:
    """(page_id, term, weight): the cleaned words of documents, each with weight 1. Words are sifted as rows, within generated code."""
    words = docs.select(F.col(key).alias("page_id"), F.explode(F.split(F.lower(column), "[^a-z0-9]+")).alias("term"))
    return words.filter((F.length("term") >= 2) & ~F.col("term").isin(*stop_words)).withColumn("weight", F.lit(1.0))


def document_counts(docs: DataFrame, key: str = "doc_id", column: str = "text", stop_words=text.STOP_WORDS) -> DataFrame:
    """(page_id, word, weight, n, doc_length): how often each of those words stands in a row of docs, and how many the row has.

    A row's words are counted where the row is, so nothing is shuffled; rows with an equal id have counts of their own.
    """

    def run(batches):
        stop = pa.array(stop_words, pa.string())
        for b in batches:
            words = pc.split_pattern_regex(b.column("text"), "[^a-z0-9]+")
            row, word = pc.list_parent_indices(words), pc.list_flatten(words)
            keep = pc.and_(pc.greater_equal(pc.binary_length(word), 2), pc.invert(pc.is_in(word, value_set=stop)))
            got = pa.table({"row": row.filter(keep), "word": word.filter(keep)})
            length = pa.array(np.bincount(got["row"].to_numpy(), minlength=b.num_rows))
            got = got.group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            at = got["row"]
            out = {"page_id": b.column("page_id").take(at), "word": got["word"], "weight": pa.array(np.ones(got.num_rows)), "n": got["count_all"], "doc_length": length.take(at)}
            yield from pa.table(out).to_batches()

    rows = docs.select(F.col(key).alias("page_id"), F.lower(column).alias("text"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"page_id {kind}, word string, weight double, n long, doc_length long")


def tag_tokens_of(parsed: DataFrame) -> DataFrame:
    """(page_id, tag, token) of parsed pages (page_id, texts)."""
    parts = parsed.select("page_id", F.explode("texts").alias("t"))
    return parts.select("page_id", F.col("t.tag").alias("tag"), F.explode(text.tag_tokens(F.col("t.text"))).alias("token"))


def page_tag_tokens(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, tag, token): the raw tokens of every indexed tag, from trees without boilerplate."""
    return tag_tokens_of(html.with_tag_texts(pages, key).withColumnRenamed(key, "page_id"))


def page_word_counts(parsed: DataFrame, stop_words=text.STOP_WORDS) -> DataFrame:
    """(page_id, word, weight, n) of parsed pages (page_id, texts): how often a word stands in tags of a weight."""
    parts = parsed.select("page_id", F.explode("texts").alias("t"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in text.TAG_WEIGHTS.items() for x in kv]), F.col("t.tag"))
    words = parts.select("page_id", weight.alias("weight"), F.explode(F.split(F.lower("t.text"), "[^a-z0-9]+")).alias("word"))
    words = words.filter((F.col("word") != "") & ~F.col("word").isin(*stop_words))
    return words.groupBy("page_id", "word", "weight").agg(F.count(F.lit(1)).alias("n"))


def page_lengths(parsed: DataFrame) -> DataFrame:
    """(page_id, doc_length) of parsed pages that have a token: the raw tokens of all tags, counted within a row."""
    some = lambda t: F.size(F.filter(F.split(t["text"], " "), lambda x: x.rlike(r"(?U)\S")))
    n = F.aggregate(F.transform("texts", some), F.lit(0).cast("long"), lambda a, x: a + x)
    return parsed.select("page_id", n.alias("doc_length")).filter("doc_length > 0")


def postings(words: DataFrame, term: str = "term", *more: str) -> DataFrame:
    """(term, page_id, tf), and more columns of a page, from weighted words (with n: how often each occurs); sums of halves are exact in any order."""
    each = F.col("weight") * F.col("n") if "n" in words.columns else F.col("weight")
    return words.groupBy(F.col(term).alias("term"), "page_id", *more).agg(F.sum(each).cast("float").alias("tf"))


def terms(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def merged_terms(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Document frequencies after more pages."""
    return old.unionByName(delta).groupBy("term").agg(F.sum("df").alias("df"))


def vocabulary(words: DataFrame, term_table: DataFrame, min_df: int = 3) -> DataFrame:
    """(word, stem), from such rows, of words whose stem is in at least min_df pages."""
    return words.select("word", "stem").distinct().join(term_table.filter(F.col("df") >= min_df), F.col("stem") == F.col("term"), "left_semi")


def doc_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("page_id").agg(F.count(F.lit(1)).alias("doc_length"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row; zeros for an empty corpus."""
    return lengths.agg(F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length"))


def heading_of(texts) -> Column:
    """The tokens of h1, then of h2, in page order."""
    lists = [F.flatten(F.transform(F.filter(texts, _of(tag)), lambda x: text.tag_tokens(x["text"]))) for tag in ("h1", "h2")]
    return F.concat(*map(text.joined, lists))


def headings(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, heading)."""
    return html.with_tag_texts(pages, key).select(F.col(key).alias("page_id"), heading_of(F.col("texts")).alias("heading"))


def _of(tag: str):
    return lambda x: x["tag"] == tag


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest order of each key (an upsert of all rows in turn)."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def links_found(records: DataFrame) -> DataFrame:
    """(page_id, to_url) distinct: crawlable, normalised targets."""
    to = records.select("page_id", F.explode("links").alias("to"))
    return to.filter(urls.crawlable(F.col("to"))).select("page_id", urls.normalized(F.col("to")).alias("to_url")).distinct()


def blank_pages(targets: DataFrame, known: DataFrame) -> DataFrame:
    """Link targets (to_url) that no page (url) has yet."""
    return targets.select(F.col("to_url").alias("url")).distinct().join(known.select("url"), "url", "left_anti")


def blank_id(url) -> Column:
    """The id of a page that is known by links only: negative, from the hash of its URL, so that every batch gives the same one."""
    return -1 - F.conv(F.substring(F.md5(url.cast("binary")), 1, 15), 16, 10).cast("long")


def edges(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """(from_page_id, to_page_id) of targets that are pages."""
    return targets.join(pages.select(F.col("page_id").alias("to_page_id"), F.col("url").alias("to_url")), "to_url").select(F.col("page_id").alias("from_page_id"), "to_page_id").distinct()


def images(found: DataFrame) -> DataFrame:
    """(url, alt_text, url_hash) of (page_id, seq, url, alt): the last alt in a page, then the first page."""
    in_page = found.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "url").orderBy(F.desc("seq")))).filter("n = 1")
    first = in_page.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("page_id"))).filter("n = 1")
    return first.select("url", F.col("alt").alias("alt_text"), F.md5(F.col("url").cast("binary")).alias("url_hash"))
