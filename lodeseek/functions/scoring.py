"""BM25, rank fusion, boosts and cosine distance as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranking constants (fixed values).
K1, B = 1.2, 0.7
RRF_OFFSET = 60
MAX_BACKLINKS = 1000
HOST_BOOST, TITLE_BOOST, HEADING_BOOST = 4.0, 2.0, 1.5
MIN_DF, MAX_DF = 1, 25000


def idf(n: Column, df: Column) -> Column:
    """Negative where a term is in more than half of the documents."""
    return F.log((n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, doc_length: Column, n: Column, avg_length: Column) -> Column:
    norm = (1 - B) + B * F.try_divide(doc_length.cast("double"), avg_length)
    t = tf.cast("double")
    return idf(n, df) * F.try_divide(t * (K1 + 1), t + K1 * norm)


def rrf(rank: Column) -> Column:
    """Of a rank that starts with 1; null without one."""
    return 1 / (rank - 1 + RRF_OFFSET).cast("double")


def backlink_boost(count: Column) -> Column:
    """1 without links, 1.5 from MAX_BACKLINKS on."""
    return 1 + 0.5 * F.log1p(F.least(count, F.lit(MAX_BACKLINKS)).cast("double")) / F.log1p(F.lit(float(MAX_BACKLINKS)))


def relevance_boost(words: Column, host_words: Column, title_words: Column, heading_words: Column) -> Column:
    """The product of the boosts of the fields that hold a query word."""
    out = F.lit(1.0)
    for field, boost in ((host_words, HOST_BOOST), (title_words, TITLE_BOOST), (heading_words, HEADING_BOOST)):
        out = out * F.when(F.coalesce(F.arrays_overlap(words, field), F.lit(False)), F.lit(boost)).otherwise(F.lit(1.0))
    return out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Null for zero vectors. Norms that are stored needn't be computed again."""
    return 1 - F.try_divide(_dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))
