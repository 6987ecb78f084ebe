"""Retrieval, fusion, boosts, pages of results, and the answers to requests."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, urls
from ..session import shared_folder


class BadRequest(ValueError):
    """A request that can't be answered (status 400)."""

    status = 400


class NotFound(LookupError):
    """A request without a result (status 404)."""

    status = 404


def query_words(q: str | None) -> list[str]:
    """The words of a query, stop words included; BadRequest without one."""
    if not q or not isinstance(q, str):
        raise BadRequest("no query")
    words = [w for w in re.sub("[^a-zA-Z0-9]+", " ", q.lower()).split(" ") if len(w) > 1]
    if not words:
        raise BadRequest("no words to search for")
    return words


def without_stop_words(words: list[str], stop_words=text.STOP_WORDS) -> list[str]:
    """The words that are searched; BadRequest if none is left."""
    left = [w for w in words if len(w) >= 2 and w not in stop_words]
    if not left:
        raise BadRequest("only stop words")
    return left


def check_query(q: str | None, stop_words=text.STOP_WORDS) -> list[str]:
    """The words of a query, stop words included; BadRequest if nothing to search for is left."""
    words = query_words(q)
    without_stop_words(words, stop_words)
    return words


def whole_number(value, name: str, default: int | None = None, least: int | None = 1) -> int:
    """A request's number: the digits (with a sign) that its text begins with. BadRequest where there are none or it is below the least."""
    if value is None and default is not None:
        return default
    m = re.match(r"\s*([+-]?[0-9]+)", str(value))
    if not m or (least is not None and int(m[1]) < least):
        raise BadRequest(f"{name} is not a valid number")
    return int(m[1])


def posting_scores(postings: DataFrame, terms: DataFrame, lengths: DataFrame | None, stats: DataFrame, query: list[str]) -> DataFrame:
    """(page_id, term, tf, df, doc_length, score) of the query's terms that are neither too rare nor too common.

    Stored postings carry doc_length; others are joined to lengths.
    """
    wanted = terms.filter(F.col("term").isin(*query) & (F.col("df") > scoring.MIN_DF) & (F.col("df") < scoring.MAX_DF)).select("term", "df")
    hits = postings.filter(F.col("term").isin(*query)).join(F.broadcast(wanted), "term")  # at most a row for each query word
    rows = (hits if "doc_length" in postings.columns else hits.join(lengths, "page_id")).crossJoin(F.broadcast(stats))  # one row
    score = scoring.bm25(F.col("tf"), F.col("df"), F.col("doc_length"), F.col("total_documents"), F.col("avg_doc_length"))
    return rows.select("page_id", "term", "tf", "df", "doc_length", score.alias("score"))


def bm25_top(scores: DataFrame, limit: int) -> DataFrame:
    """(page_id, bm25_score, terms), the best first.

    A page's scores (one a query word) are added in the order of terms, so that copies of a page score
    exactly alike and stand in the order of their ids.
    """
    got = scores.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("term", "df", "tf", "score"))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x["score"])
    got = got.select("page_id", total.alias("bm25_score"), F.transform("x", lambda x: x.dropFields("score")).alias("terms"))
    return got.orderBy(F.desc("bm25_score"), "page_id").limit(limit)


def nearest(vectors: DataFrame, query: DataFrame, limit: int, key: str = "vec_id") -> DataFrame:
    """(key, distance) of the nearest non-null vectors to the one row of query (q); stored vectors have their norm."""
    rows = vectors.filter("embedding IS NOT NULL").crossJoin(F.broadcast(query.select("q", scoring.norm(F.col("q")).alias("qn"))))  # one row
    own = F.col("norm") if "norm" in vectors.columns else None
    return rows.select(key, scoring.cosine_distance(F.col("embedding"), F.col("q"), own, F.col("qn")).alias("distance")).orderBy(F.col("distance").asc_nulls_last(), key).limit(limit)


def fuse(bm25: DataFrame, vector: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of (page_id, bm25_rank) and (page_id, vector_rank), ranks from 1."""
    both = bm25.join(vector, "page_id", "full_outer")
    zero = F.lit(0.0)
    kind = F.when(F.col("vector_rank").isNull(), "bm25").when(F.col("bm25_rank").isNull(), "embedding").otherwise("both")
    score = F.coalesce(scoring.rrf(F.col("bm25_rank")), zero) + F.coalesce(scoring.rrf(F.col("vector_rank")), zero)
    return both.withColumns({"rrf_score": score, "type": kind, "ord": F.coalesce(F.col("bm25_rank").cast("long"), F.col("vector_rank") + F.lit(10**9))})


def ranked(top: DataFrame, order: list, name: str) -> DataFrame:
    """Ranks from 1 of a list that a limit has bounded."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def limit_for(page: int, size: int) -> int:
    return max(100, page * size)


#: Up to this limit of candidates a request's list, at most twice as many narrow rows, is held on the driver.
MAX_HELD = 10_000


def held(rows: DataFrame, most: int) -> DataFrame:
    """Rows that are computed once: at most `most` of them, on the driver where they are few, else in the shared folder."""
    if most <= 2 * MAX_HELD:
        return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def looked_up(source, rows: DataFrame, most: int) -> DataFrame:
    """The rows of a table (page_id, ...) for the page ids of some held rows.

    source: a lookup by a list of ids, as a stored table has, or a DataFrame. Few ids are named in a filter that
    reaches the scan; the pages that a longer list names are met by a join.
    """
    if most <= 2 * MAX_HELD:
        ids = [r.page_id for r in rows.select("page_id").collect()]
        return source(ids) if callable(source) else source.filter(F.col("page_id").isin(*ids)) if ids else source.limit(0)
    return (source(None) if callable(source) else source).join(F.broadcast(rows.select("page_id")), "page_id", "left_semi")  # twice the request's limit


def fused_list(tables: dict, wanted: list[str], query_vector: DataFrame, limit: int) -> DataFrame:
    """All candidates (at most twice the limit), ranked narrow: with bm25_score, terms, rrf_score, type, backlinks and pos, the place after the first boost.

    The list is made once; backlinks are then looked up for its pages only.
    """
    scores = posting_scores(tables["postings"], tables["terms"], tables.get("lengths"), tables["stats"], wanted)
    bm = ranked(bm25_top(scores, limit), [F.desc("bm25_score"), "page_id"], "bm25_rank")
    vec = ranked(nearest(tables["vectors"], query_vector, limit, "page_id"), ["distance", "page_id"], "vector_rank")
    fused = held(fuse(bm, vec.drop("distance")), 2 * limit)
    if "backlinks" in tables:  # stored counts
        counts = looked_up(tables["backlinks"], fused, 2 * limit).select("page_id", "backlink_count")
    else:
        few = fused.select(F.col("page_id").alias("to_page_id"))
        counts = backlink_counts(tables["links"].join(F.broadcast(few), "to_page_id", "left_semi"))  # twice the limit
    x = fused.join(F.broadcast(counts), "page_id", "left").withColumn("backlink_count", F.coalesce("backlink_count", F.lit(0)).cast("long"))  # a row a candidate
    x = x.withColumn("backlink_boost", scoring.backlink_boost(F.col("backlink_count")))
    return x.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.col("backlink_boost") * F.col("rrf_score")), F.desc("rrf_score"), "ord")))


def shown_page(fused: DataFrame, pages, wanted: list[str], page: int, size: int) -> DataFrame:
    """One page of a fused list, whose pages are looked up only after it is cut out; the relevance boost reorders within it.

    pages: a lookup by ids, or a DataFrame.
    """
    cut = held(fused.filter((F.col("pos") > (page - 1) * size) & (F.col("pos") <= page * size)), size)
    own = looked_up(pages, cut, size).select("page_id", "url", "title", "heading")
    shown = cut.join(F.broadcast(own), "page_id", "left")  # at most size rows
    words = F.array(*[F.lit(w) for w in wanted]).cast("array<string>")
    fields = [text.normalized_words(c) for c in (urls.hostname(F.col("url")), F.col("title"), F.col("heading"))]
    shown = shown.withColumn("relevance_boost", scoring.relevance_boost(words, *fields))
    final = F.col("backlink_boost") * F.col("rrf_score") * F.col("relevance_boost")
    return shown.withColumn("final_score", final).orderBy(F.desc("final_score"), "pos")


def search(tables: dict, query: list[str], query_vector: DataFrame, page: int = 1, size: int = 10, stop_words=text.STOP_WORDS) -> DataFrame:
    """One page of results.

    tables: postings, terms, stats, vectors (page_id, embedding), pages (page_id, url, title, heading), links or
    backlinks (page_id, backlink_count), and lengths where postings carry none; pages and backlinks can be lookups by ids.
    """
    wanted = [w for w in query if w not in stop_words]
    return shown_page(fused_list(tables, wanted, query_vector, limit_for(page, size)), tables["pages"], wanted, page, size)


#: A text's vector: a function of a list of texts, and for one query a list of one.
Embed = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Response:
    """The answer to a search request."""

    corrected: bool
    q: list[str]
    full_q: list[str]
    total_results: int
    page: int
    page_size: int
    results: DataFrame

    def json(self) -> DataFrame:
        """One row: the answer as JSON. The results are one page."""
        keep = ["pos", "final_score", "page_id", "url", "heading", "title", "type", "bm25_score", "terms", "rrf_score", "backlink_count", "backlink_boost", "relevance_boost"]
        rows = self.results.agg(F.sort_array(F.collect_list(F.struct((-F.col("final_score")).alias("order"), *keep))).alias("r"))
        rows = rows.select(F.transform("r", lambda x: x.dropFields("order", "pos").withField("id", x["page_id"]).dropFields("page_id")).alias("r"))
        head = F.struct(F.lit(self.total_results).alias("totalResults"), F.lit(self.page).alias("page"), F.lit(self.page_size).alias("pageSize"))
        words = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        return rows.select(F.to_json(F.struct(F.lit(self.corrected).alias("corrected"), words(self.q).alias("q"), words(self.full_q).alias("fullQ"), head.alias("pagination"), F.col("r").alias("results"))).alias("response"))


def corrected_words(stored, words: list[str], stop_words=text.STOP_WORDS) -> tuple[list[str], dict[str, str]]:
    """The words after spelling, and the stem of each that the vocabulary has; few rows come to the driver, one a word."""
    from . import spell

    out, _ = spell.correct_stored(words, stored, stop_words)
    own = stored.vocabulary(sorted({len(w) for w in out})).filter(F.col("word").isin(*out)).select("word", "stem").collect()
    return out, {r.word: r.stem for r in own}


def answer(stored, q: str | None, embed: Embed | None = None, page=None, page_size=None, vector: DataFrame | None = None, stop_words=text.STOP_WORDS) -> Response:
    """The answer to a search request over a stored index: checked, corrected, stemmed, embedded, searched.

    The query's vector is that of the corrected words, stop words included, by embed; a given one (q) goes before.
    BadRequest and NotFound tell of requests without words, numbers or results.
    """
    words = query_words(q)
    page, size = whole_number(page, "page", 1), whole_number(page_size, "pageSize", 10)
    full, stems = corrected_words(stored, words, stop_words)
    wanted = without_stop_words(full, stop_words)
    if vector is None:
        if embed is None:
            raise ValueError("a search needs a function that embeds texts, or a vector")
        vector = stored.spark.createDataFrame([(list(map(float, embed([" ".join(full)])[0])),)], "q array<double>")
    terms = sorted({stems[w] for w in wanted if w in stems})
    limit = limit_for(page, size)
    tables = stored.tables(terms, limit)
    fused = held(fused_list(tables, terms, vector, limit), 2 * limit)
    total = fused.count()
    if not total:
        raise NotFound("no result")
    return Response(full != words, wanted, full, total, page, size, shown_page(fused, tables["pages"], wanted, page, size))


def image_answer(stored, q: str | None, embed: Embed, limit: int = 100, stop_words=text.STOP_WORDS) -> DataFrame:
    """(image_id, url, alt_text, distance) of the images nearest to a corrected query, over a stored table image_vectors."""
    full, _ = corrected_words(stored, query_words(q), stop_words)
    vector = stored.spark.createDataFrame([(list(map(float, embed([" ".join(full)])[0])),)], "q array<double>")
    images = stored.table("image_vectors")
    top = nearest(images, vector, limit, "image_id")
    if top.isEmpty():
        raise NotFound("no image")
    return images.select("image_id", "url", "alt_text").join(F.broadcast(top), "image_id").orderBy("distance", "image_id")  # at most limit rows


#: Images that a page of results shows above the list.
TOP_IMAGES = 6


def top_images(images: DataFrame, n: int = TOP_IMAGES) -> DataFrame:
    """The first few of an image answer."""
    return images.orderBy("distance", "image_id").limit(n)


def links_answer(stored, page_id) -> tuple[DataFrame, DataFrame]:
    """Back and forward links (page_id, url, title) of a page; BadRequest without a number, NotFound without a link."""
    from . import graph

    i = whole_number(page_id, "id", least=None)
    out, into, pages = stored.links_from(i), stored.links_to(i), stored.table("pages").select("page_id", "url", "title")
    back, forward = graph.back(into, pages, i), graph.forward(out, pages, i)
    if out.filter("to_page_id <> from_page_id").isEmpty() and into.filter("to_page_id <> from_page_id").isEmpty():
        raise NotFound("no link")
    return back, forward


def backlink_counts(links: DataFrame) -> DataFrame:
    """(page_id, backlink_count) without self-links."""
    return links.filter("from_page_id <> to_page_id").groupBy(F.col("to_page_id").alias("page_id")).agg(F.count(F.lit(1)).alias("backlink_count"))


def page_window(total, size, current):
    """Columns first, last and total pages of a window of ten around the current one."""
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("long")
    first = F.greatest(F.lit(1), F.least(current - 5, pages - 9)).cast("long")
    return first, F.least(pages, first + 9).cast("long"), pages
