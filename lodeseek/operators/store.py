"""The stored index: written once from words or pages, read by every search.

Tables that are looked up are partitioned by a hash of their key and sorted by it within a file, so that
a request reads the files of its keys only; a posting carries its page's length, so that scoring joins
nothing but the few rows of terms. How many partitions a table has follows from its counted rows, and
each table's own numbers stand in the folder's manifest, from which readers take them. Keys with more
rows than a partition should have are split by page ranges.

Pages are dealt out into ranges of ids. A block is a term's postings in one range; its least and greatest
tf and length bound the scores in it, whatever the statistics, so that a search can leave out
ranges that can't reach the best pages. Terms in few pages have no stored blocks: their postings are
as few.

The vocabulary is partitioned by word length, as spelling asks for three lengths, and stored a second time
by the words' deletions, where words within two edits of a misspelt one are found by key. Links are stored
by either end.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import scoring, stem, text, urls
from . import index, search

FORMAT = 2
#: Rows of a partition, about, and partitions of a table.
ROWS_A_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 2_000_000, 8, 16_384
#: Pages of a range at least, and ranges.
PAGES_A_RANGE, MAX_RANGES = 64, 4_096
#: Terms in so many pages have stored blocks.
BLOCK_DF = 256
MIN_WORD_DF = 3
#: Keys with many rows that are broadcast at most.
MAX_HEAVY = 100_000

#: Tables that don't depend on words.
SITE = ("parsed", "targets", "pages", "links", "links_from", "links_to", "backlinks", "images", "embed_texts", "vectors", "centroids", "image_vectors")


def bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def bucket_count(rows: int) -> int:
    """Partitions of a table with so many rows."""
    return max(MIN_BUCKETS, min(MAX_BUCKETS, math.ceil(rows / ROWS_A_BUCKET)))


def record(spark: SparkSession, folder: str, table: str, **facts) -> None:
    """Notes a table's facts in the manifest of its folder."""
    row = json.dumps({"table": table, "format": FORMAT, **facts})
    spark.range(1, numPartitions=1).select(F.lit(row).alias("value")).write.mode("overwrite").text(f"{folder}/manifest/{table}")


def manifest(spark: SparkSession, folder: str) -> dict[str, dict]:
    """What a folder's manifest says of its tables; ValueError without one or of another format."""
    try:
        rows = spark.read.option("recursiveFileLookup", "true").text(f"{folder}/manifest").collect()  # a row a table
    except AnalysisException:
        raise ValueError(f"{folder} has no manifest: it holds no index") from None
    out = {x["table"]: x for x in (json.loads(r.value) for r in rows)}
    if odd := [t for t, x in out.items() if x["format"] != FORMAT]:
        raise ValueError(f"{folder}: tables {odd} have another format than {FORMAT}")
    return out


@dataclass(frozen=True)
class Stored:
    """A stored index below a folder; some tables can stand below another one, that of a site."""

    spark: SparkSession
    folder: str
    site: str | None = None
    #: Tables that were opened (their files are listed once) and manifests that were read.
    opened: dict = field(default_factory=dict, repr=False, compare=False)
    #: What writes the tables that are still to be written, by their names.
    steps: dict = field(default_factory=dict, repr=False, compare=False)

    def later(self, step: Callable[[], None], *names: str) -> None:
        """Tables that a step will write when one of them is asked for."""

        def run() -> None:
            step()
            for n in names:
                self.steps.pop(n, None)

        self.steps.update(dict.fromkeys(names, run))

    def need(self, name: str) -> None:
        """Writes a table that is still to be written, and what it is made from."""
        if name in self.steps:
            self.steps[name]()

    def finish(self) -> Stored:
        """Writes all tables that are still to be written."""
        while self.steps:
            self.need(next(iter(self.steps)))
        return self

    def plain(self, name: str) -> DataFrame:
        """A table as its files say."""
        self.need(name)
        return self.spark.read.parquet(f"{self.home(name)}/{name}")

    def home(self, name: str) -> str:
        return self.site if self.site and name in SITE else self.folder

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            kind = self.facts(name).get("schema")  # an empty table has no file that tells it
            reader = self.spark.read.schema(T.StructType.fromJson(json.loads(kind))) if kind else self.spark.read
            self.opened[name] = reader.parquet(f"{self.home(name)}/{name}")
        return self.opened[name]

    def facts(self, name: str) -> dict:
        """What the manifest says of a table."""
        self.need(name)
        key = "manifest", self.home(name)
        if name not in self.opened.get(key, {}):
            self.opened[key] = {name: {}} | manifest(self.spark, self.home(name))
        return self.opened[key][name]

    def forget(self, *names: str) -> None:
        """Tables whose files have changed are opened anew."""
        for n in names:
            self.opened.pop(n, None)

    def some(self, name: str, column: str, values: list) -> DataFrame:
        """Rows of a table by its key."""
        if not values:
            return self.table(name).limit(0)
        # the hashes of literals are folded, so that both filters reach the scan
        n = self.facts(name)["buckets"]
        kind = self.table(name).schema[column].dataType
        hashes = [bucket(F.lit(v).cast(kind), n) for v in values]
        return self.table(name).filter(F.col("bucket").isin(*hashes) & F.col(column).isin(*values))

    def postings(self, words: list[str]) -> DataFrame:
        return self.some("postings", "term", words)

    def terms(self, words: list[str]) -> DataFrame:
        """(term, df) of some terms; rows of later insertions are added up."""
        return self.some("terms", "term", words).groupBy("term").agg(F.sum("df").alias("df"))

    def all_terms(self) -> DataFrame:
        return self.table("terms").groupBy("term").agg(F.sum("df").alias("df"))

    def vocabulary(self, lengths: list[int] | None = None) -> DataFrame:
        """(word, stem), of some lengths or of all."""
        v = self.table("vocab")
        return v if lengths is None else v.filter(F.col("len").isin(*lengths))

    def posting(self, term: str, page_id: int) -> DataFrame:
        """One posting, by what identifies it."""
        return self.postings([term]).filter(F.col("page_id") == page_id)

    def links_from(self, page_id: int) -> DataFrame:
        return self.some("links_from", "from_page_id", [page_id])

    def links_to(self, page_id: int) -> DataFrame:
        return self.some("links_to", "to_page_id", [page_id])

    def by_ids(self, name: str):
        """A lookup of rows by page_id; without ids, the whole table."""
        return lambda ids: self.table(name) if ids is None else self.some(name, "page_id", ids)

    def tables(self, words: list[str], limit: int | None = None) -> dict:
        """What search() reads for some words: postings, all or those of ranges that can hold one of the best pages, and the rest."""
        post = self.postings(words) if limit is None else best_postings(self, words, limit)[0]
        return {"postings": post, "terms": self.terms(words), "stats": self.table("stats"), "vectors": self.table("vectors"), "backlinks": self.by_ids("backlinks"), "pages": self.by_ids("pages")}


def write(df: DataFrame, folder: str, name: str, by: str | None = None, buckets: int | None = None, slices: Column | None = None, tasks: int | None = None, sort: tuple = (), **facts) -> None:
    """Writes a table below a folder; with a key, in partitions by its hash, and its facts into the manifest.

    slices: parts of a key's rows that go to different tasks. Without them each partition has a task of its own.
    """
    if by is None:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return
    out = df.withColumns({"bucket": bucket(F.col(by), buckets), **({"__slice": slices} if slices is not None else {})})
    out = out.repartitionById(buckets, "bucket") if slices is None else out.repartition(tasks or buckets, "bucket", "__slice")
    out = out.drop("__slice", "__part")
    out.sortWithinPartitions("bucket", by, *sort).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")
    record(df.sparkSession, folder, name, key=by, buckets=buckets, schema=schema_of(out, "bucket"), **facts)


def schema_of(df: DataFrame, last: str) -> str:
    """A table's schema as it is read again, the column of its partitions last."""
    return T.StructType([*(f for f in df.schema.fields if f.name != last), T.StructField(last, T.IntegerType())]).json()


def heavy_keys(counts: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, k) of keys with more than a partition's rows, k the parts they need, from (key, n); and all parts beyond the first."""
    many = counts.filter(F.col("n") > ROWS_A_BUCKET).select(key, F.ceil(F.col("n") / ROWS_A_BUCKET).cast("int").alias("k"))
    found = many.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("more")).first()
    return (F.broadcast(many) if found.keys <= MAX_HEAVY else many), int(found.more)


def build(counts: DataFrame, folder: str, lengths: DataFrame, stems: bool = True, buckets: int | None = None, min_df: int = MIN_WORD_DF, block_df: int = BLOCK_DF, site: Stored | None = None, lazy: bool = False) -> Stored:
    """Writes words, lengths, stats, postings, terms, blocks, vocab and deletes from stored counts (page_id, word, weight, n), a row for each page, word and weight.

    n is how often the word occurs with the weight; lengths: (page_id, doc_length). Counts with a doc_length, that of
    the page, have a row for each page and word, and no join brings it. With stems, a term is a
    stem, else a word. buckets: partitions of the tables by term instead of the number that the counts ask for.
    site: whose tables stand beside these. A lazy index writes each table when it is first asked for.
    """
    from . import spell

    spark = counts.sparkSession
    done = Stored(spark, folder, site.folder if site else None)
    for name in site.steps if site else ():
        done.later(lambda name=name: site.need(name), name)
    record(spark, folder, "index", stems=stems, min_df=min_df)
    rows = counts.count()
    buckets = buckets or bucket_count(rows)

    def postings() -> None:
        known, own = done.plain("words") if stems else None, done.plain("lengths")
        ids = own.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        lo = ids.lo or 0
        n_ranges = max(1, min(MAX_RANGES, ids.n // PAGES_A_RANGE))
        width = max(1, -(-((ids.hi or 0) - lo + 1) // n_ranges))
        base = max(1, math.ceil(rows / (buckets * ROWS_A_BUCKET)))
        uses = counts.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        uses = uses.join(known, "word").groupBy(F.col("stem").alias("term")).agg(F.sum("n").alias("n")) if stems else uses.withColumnRenamed("word", "term")
        heavy, more = heavy_keys(uses, "term")
        words = counts.join(known, "word") if stems else counts.withColumn("stem", F.col("word"))
        if "doc_length" not in counts.columns:
            post = index.postings(words, "stem").join(own, "page_id")
        elif stems:
            post = index.postings(words.filter("page_id IS NOT NULL"), "stem", "doc_length")
        else:
            post = words.filter("page_id IS NOT NULL").select(F.col("stem").alias("term"), "page_id", (F.col("weight") * F.col("n")).cast("float").alias("tf"), "doc_length")
        post = post.withColumn("range", F.expr(f"CAST((page_id - {lo}) DIV {width} AS INT)"))
        parts = F.lit(base)
        if more:
            post = post.join(heavy, "term", "left")
            parts = F.greatest(parts, F.coalesce("k", parts))
        slices = F.floor(F.col("range") * parts / n_ranges) if more or base > 1 else None
        keep = ("term", "page_id", "tf", "doc_length", "range")
        post = post.withColumn("__part", slices if slices is not None else F.lit(0)).select(*keep, "__part")
        write(post, folder, "postings", "term", buckets, F.col("__part") if slices is not None else None, buckets * base + more, ("range", "page_id"), lo=lo, width=width, ranges=n_ranges, rows=rows)

    def blocks() -> None:
        many = done.table("terms").filter(F.col("df") >= block_df).select("term")
        few = done.table("postings").join(many, "term", "left_semi").groupBy("term", "range").agg(F.count(F.lit(1)).alias("n"), *extremes())
        write(few, folder, "blocks", "term", buckets, sort=("range",), block_df=block_df)

    def vocab() -> None:
        terms = done.table("terms").filter(F.col("df") >= min_df).select("term")
        kept = done.plain("words").join(terms, F.col("stem") == F.col("term"), "left_semi").withColumn("len", F.length("word"))
        part = F.pmod(F.xxhash64("word"), F.lit(max(1, math.ceil(kept.count() / ROWS_A_BUCKET))))
        kept.repartition("len", part).sortWithinPartitions("len", "word").write.mode("overwrite").partitionBy("len").parquet(f"{folder}/vocab")
        record(spark, folder, "vocab", schema=schema_of(kept, "len"))

    def deletes() -> None:
        short = done.table("vocab").filter(F.col("len") <= spell.MAX_LOOKUP + 1)  # longer ones are near no word that is looked up
        n_keys = done.table("vocab").count() * spell.KEYS_A_WORD
        write(spell.deletions(short, spread(spark, n_keys)), folder, "deletes", "key", bucket_count(n_keys), sort=("word",))

    done.later(lambda: write(word_stems(counts, stems, spread(spark, rows)), folder, "words"), "words")
    done.later(lambda: write(lengths, folder, "lengths"), "lengths")
    done.later(lambda: write(index.corpus_stats(done.plain("lengths")), folder, "stats"), "stats")
    done.later(postings, "postings")
    done.later(lambda: write(done.table("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), *extremes()), folder, "terms", "term", buckets), "terms")
    done.later(blocks, "blocks")
    done.later(vocab, "vocab")
    done.later(deletes, "deletes")
    return done if lazy else done.finish()


def extremes() -> list[Column]:
    """Of postings: the least and greatest tf, and length for each use of the term. A score grows with the one and falls with the other."""
    thin = F.col("doc_length") / F.col("tf").cast("double")
    return [f(c).alias(f"{n}_{s}") for c, s in ((F.col("tf"), "tf"), (thin, "thin")) for f, n in ((F.min, "least"), (F.max, "most"))]


# Blocks -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Skipped:
    """What a search left out: ranges of pages, blocks and postings, each of how many."""

    ranges: tuple[int, int]
    blocks: tuple[int, int]
    postings: tuple[int, int]


def blocks_of(stored: Stored, words: list[str]) -> DataFrame:
    """(term, range, n, extremes) of terms: stored ones, and of terms in few pages what their postings say."""
    least = stored.facts("blocks")["block_df"]
    df = {r.term: r.df for r in stored.terms(words).collect()}  # a row a word
    many, few = [w for w in df if df[w] >= least], [w for w in df if df[w] < least]
    own = [F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("least_tf", "least_thin")), *(F.max(c).alias(c) for c in ("most_tf", "most_thin"))]
    big = stored.some("blocks", "term", many).groupBy("term", "range").agg(*own)
    small = stored.postings(few).groupBy("term", "range").agg(F.count(F.lit(1)).alias("n"), *extremes())
    return big.unionByName(small)  # columns in any order


def best_postings(stored: Stored, words: list[str], limit: int) -> tuple[DataFrame, Skipped]:
    """Postings of all ranges of pages that can hold one of the best `limit` pages, and what was left out.

    A range's bound is the sum over terms of the greatest score that its block's extremes allow. The
    ranges with the greatest bounds are scored first, until they hold more pages than asked for; the least
    score among the best of them is what another range must be able to reach. Ranges and words are few
    (MAX_RANGES a word), so their bounds are weighed on the driver.
    """
    words = sorted(set(words))
    stats, terms = stored.table("stats"), stored.terms(words)
    n, avg = F.col("total_documents"), F.col("avg_doc_length")
    usable = terms.filter((F.col("df") > scoring.MIN_DF) & (F.col("df") < scoring.MAX_DF))
    seen = blocks_of(stored, words).join(F.broadcast(usable), "term").crossJoin(F.broadcast(stats))  # a row a word, one row
    corner = lambda a, b: scoring.bm25(F.col(a), F.col("df"), F.col(a) * F.col(b), n, avg)
    bound = F.greatest(corner("most_tf", "least_thin"), corner("least_tf", "most_thin"))
    rows = seen.select("range", "n", bound.alias("bound")).collect()  # at most MAX_RANGES a word
    every = stored.postings(words)
    if not rows:
        return every, Skipped((0, 0), (0, 0), (0, 0))
    bounds: dict[int, list[float]] = {}
    sizes: dict[int, list[int]] = {}
    for r in rows:
        bounds.setdefault(r.range, []).append(math.inf if r.bound is None or math.isnan(r.bound) else r.bound)
        sizes.setdefault(r.range, []).append(r.n)
    most = {k: sum(x for x in v if x > 0) if max(v) > 0 else max(v) for k, v in bounds.items()}
    first, held = [], 0
    for k in sorted(most, key=lambda k: (-most[k], k)):
        first.append(k)
        held += max(sizes[k])  # its pages are at least so many
        if held >= limit:
            break
    kept = set(most)
    if len(first) < len(most):
        scores = search.bm25_top(search.posting_scores(every.filter(F.col("range").isin(*first)), terms, None, stats, words), limit)
        low = scores.agg(F.count("bm25_score").alias("n"), F.min("bm25_score").alias("low")).first()
        if low.n >= limit:  # bounds are computed as scores are, but added in another order
            kept = {k for k in most if most[k] >= low.low - 1e-9 * abs(low.low)}
    gone = set(most) - kept
    told = Skipped((len(gone), len(most)), (sum(len(sizes[k]) for k in gone), len(rows)), (sum(sum(sizes[k]) for k in gone), sum(map(sum, sizes.values()))))
    return (every.filter(F.col("range").isin(*sorted(kept))) if gone else every), told


def spread(spark: SparkSession, rows: int) -> int:
    """Tasks of a step whose rows are few bytes and much work, so that it isn't left to the one or two tasks that their bytes ask for."""
    return max(spark.sparkContext.defaultParallelism, bucket_count(rows))


def word_stems(counts: DataFrame, stems: bool = True, tasks: int | None = None) -> DataFrame:
    """(word, stem) of the distinct words of counts, each stemmed once, in so many tasks; words without a stem of two letters go."""
    words = counts.select("word").distinct()
    words = words.repartition(tasks, "word") if tasks and stems else words
    return words.withColumn("stem", stem.stem_once("word")).filter("length(stem) >= 2") if stems else words.withColumn("stem", F.col("word"))


def stemmed(counts: DataFrame, stems: bool = True) -> DataFrame:
    """counts (page_id, word, ...) with stem."""
    return counts.join(word_stems(counts), "word") if stems else counts.withColumn("stem", F.col("word"))


def count_documents(docs: DataFrame, folder: str, key: str = "doc_id", column: str = "text", stop_words=text.STOP_WORDS) -> DataFrame:
    """Writes the counted words of plain documents, whose texts are read once, and returns them."""
    counts = index.document_counts(docs, key, column, stop_words)
    if not docs.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():  # only then counts move
        counts = counts.groupBy("page_id", "word", "weight").agg(F.sum("n").alias("n"))
        whole = counts.groupBy(F.col("page_id").alias("__id")).agg(F.sum("n").alias("doc_length"))
        counts = counts.join(whole, F.col("page_id").eqNullSafe(F.col("__id"))).drop("__id")
    write(counts, folder, "counts")
    return docs.sparkSession.read.parquet(f"{folder}/counts")


def build_counted(counts: DataFrame, folder: str, stems: bool = False, **kw) -> Stored:
    """An index of counted documents; one over words and one over stems can come from the same counts."""
    return build(counts, folder, counts.groupBy("page_id").agg(F.sum("n").alias("doc_length")), stems, **kw)


def build_documents(docs: DataFrame, folder: str, stems: bool = False, key: str = "doc_id", column: str = "text", stop_words=text.STOP_WORDS, **kw) -> Stored:
    """An index of plain documents."""
    return build_counted(count_documents(docs, folder, key, column, stop_words), folder, stems, **kw)


def build_site(pages: DataFrame, folder: str, buckets: int | None = None, lazy: bool = False) -> Stored:
    """Writes parsed, targets, pages, links (by either end too), backlinks, images and embed_texts of HTML pages; every page's tree is built once.

    Of pages with the same normalised URL the last stays: it is chosen by URL and id alone, and only such pages
    are parsed. Link targets that are no page yet become blank pages. buckets: partitions of the tables by page.
    A lazy site writes each table when it is first asked for.
    """
    from ..functions import html

    done = Stored(pages.sparkSession, folder)

    def parsed() -> None:
        named = pages.select("page_id", "url", "html", urls.normalized(F.col("url")).alias("__url")).filter("__url IS NOT NULL")
        sizes = named.groupBy("__url", "page_id").agg(F.count(F.lit(1)).alias("__n"))
        last = sizes.groupBy("__url").agg(F.max(F.struct("page_id", "__n")).alias("x")).select("__url", "x.page_id", "x.__n")
        kept = named.join(last, ["__url", "page_id"])
        if not last.filter("__n > 1").isEmpty():  # only then whole pages are dealt out by their URL
            kept = kept.dropDuplicates(["__url"])
        write(html.parsed(kept.drop("__url", "__n")).withColumn("url", urls.normalized(F.col("url"))), folder, "parsed")

    known = lambda: done.plain("parsed").select("page_id", "url", "title", index.heading_of(F.col("texts")).alias("heading"))
    own = cache(lambda: buckets or bucket_count(done.plain("targets").count() + done.plain("parsed").count()))

    def named_pages() -> None:
        none = F.lit(None).cast("string")
        blank = index.blank_pages(done.plain("targets"), known()).select(index.blank_id(F.col("url")).alias("page_id"), "url", none.alias("title"), none.alias("heading"))
        write(known().unionByName(blank), folder, "pages", "page_id", own())

    def images() -> None:
        found = done.plain("parsed").select("page_id", F.posexplode(F.map_entries("images")).alias("seq", "i")).select("page_id", "seq", F.col("i.key").alias("url"), F.col("i.value").alias("alt"))
        write(index.images(found), folder, "images")

    done.later(parsed, "parsed")
    done.later(lambda: write(done.plain("parsed").select("page_id", text.embedding_text(F.col("texts")).alias("text")), folder, "embed_texts"), "embed_texts")
    done.later(lambda: write(index.links_found(done.plain("parsed")), folder, "targets"), "targets")
    done.later(named_pages, "pages")
    done.later(lambda: write(index.edges(done.plain("targets"), done.table("pages")), folder, "links"), "links")
    done.later(lambda: write_links(done.plain("links"), folder, buckets), "links_from", "links_to")
    done.later(lambda: write(search.backlink_counts(done.plain("links")), folder, "backlinks", "page_id", own()), "backlinks")
    done.later(images, "images")
    return done if lazy else done.finish()


def write_links(links: DataFrame, folder: str, buckets: int | None = None) -> None:
    """Edges by the page they leave and by the page they reach; those of hubs are dealt out by their other end."""
    n = buckets or bucket_count(links.count())
    for name, key, other in (("links_from", "from_page_id", "to_page_id"), ("links_to", "to_page_id", "from_page_id")):
        heavy, more = heavy_keys(links.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)
        rows = links.join(heavy, key, "left") if more else links.withColumn("k", F.lit(None).cast("int"))
        rows = rows.withColumn("__part", F.pmod(F.xxhash64(other), F.coalesce("k", F.lit(1)))).drop("k")
        out = rows.select(*links.columns, "__part")
        write(out, folder, name, key, n, F.col("__part") if more else None, n + more, (other,))


def build_pages(spark: SparkSession, site: str | Stored, folder: str, stop_words=text.STOP_WORDS, lazy: bool = False, **kw) -> Stored:
    """An index of the weighted, stemmed words of a site's pages; a lazy one counts them when they are first asked for."""
    site = Stored(spark, site) if isinstance(site, str) else site
    parsed = site.plain("parsed")
    write(index.page_word_counts(parsed, stop_words), folder, "counts")
    return build(spark.read.parquet(f"{folder}/counts"), folder, index.page_lengths(parsed), site=site, lazy=lazy, **kw)


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns and types of an index table."""
    fields = [f.strip().split(" ") for f in schemas.TABLES[name].split(",")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])


def full_scan(stored: Stored, name: str = "postings") -> DataFrame:
    """A whole table of the index, with its columns alone."""
    return conform(stored.table(name), name)


def insert_posting(stored: Stored, term: str, page_id: int, tf: float) -> DataFrame:
    """Adds one posting (a correction by hand; batches come through the stream) and returns it.

    There is one posting of a term and page: one that is there stays as it is and is returned. Terms, blocks
    and, once the term is in enough pages, the vocabulary get their share, so that searches find it.
    """
    spark = stored.spark
    old = stored.posting(term, page_id).select("term", "page_id", "tf")
    if not old.isEmpty():
        return old
    length = stored.table("lengths").filter(F.col("page_id") == page_id).select("doc_length").first()
    about = stored.facts("postings")
    df = stored.terms([term]).first()
    place = (page_id - about["lo"]) // about["width"]
    row = spark.createDataFrame([(term, page_id, tf, length.doc_length if length else 0, place)], "term string, page_id long, tf float, doc_length long, range int")

    def add(df: DataFrame, name: str, key: str) -> None:
        df.withColumn("bucket", bucket(F.col(key), stored.facts(name)["buckets"])).write.mode("append").partitionBy("bucket").parquet(f"{stored.folder}/{name}")
        stored.forget(name)

    bounds = row.groupBy("term", "range").agg(F.count(F.lit(1)).alias("df"), *extremes())
    add(row, "postings", "term")
    add(bounds.drop("range"), "terms", "term")
    count = (df.df if df else 0) + 1
    least = stored.facts("blocks")["block_df"]
    if count > least:
        add(bounds.withColumnRenamed("df", "n"), "blocks", "term")
    elif count == least:  # from now on it has blocks
        add(stored.postings([term]).groupBy("term", "range").agg(F.count(F.lit(1)).alias("n"), *extremes()), "blocks", "term")
    if count == stored.facts("index")["min_df"] and stored.vocabulary([len(term)]).filter(F.col("stem") == term).isEmpty():
        from . import spell

        word = spark.createDataFrame([(term, term, len(term))], "word string, stem string, len int")
        word.write.mode("append").partitionBy("len").parquet(f"{stored.folder}/vocab")
        add(spell.deletions(word), "deletes", "key")
        stored.forget("vocab")
    return row.select("term", "page_id", "tf")
