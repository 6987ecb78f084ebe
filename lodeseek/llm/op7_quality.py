"""Quality by ordinal regression on graded ratings.

Grades 0 < 1 < 2 share one weight vector over hashed words; ordered thresholds cut the score:
P(grade > k) = sigmoid(score - threshold_k). A document's expected grade is the sum of these
tails and its selection uses the upper one. Ratings come from the labels: toxic documents are
grade 0, other low-quality ones grade 1, the rest grade 2.

The model is fitted on the driver on at most MAX_RATED rated documents, the first by a hash of
the id; it sees their hashed features, not their texts. Scoring covers every document whole.

A feature counts once a document, when the model is fitted as when it scores.

Edge cases: null and empty texts have only the shape features; texts of any length are read whole;
without any rated document all weights are zero and every document is kept; a document that is rated
several times counts with each rating, and repeated rows of it with each row, within the bound; ties of
the hash go by id, then grade; repeated rows are scored alike; an empty table gives no row; other columns are
left out, whatever their names; a key named like a result column is returned as `key`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import Memo, slices, text_batches

BUCKETS = 1 << 18
#: Bound of the rated sample, and of the rows a feature must occur in.
MAX_RATED = 9_000
MIN_ROWS = 3
EPOCHS = 8
BATCH = 128
L1, RATE = 0.4, 0.12
GRADES = 3
MIN_TAIL = 0.6
#: Characters stripped from a word's ends for its second feature.
EDGE = ".,;:!?\"'()[]"


def buckets_of(word: str) -> tuple[int, int]:
    """A word as it stands, and in lower case without marks at its ends."""
    plain = word.strip(EDGE).lower()
    one = lambda s: xxhash.xxh32_intdigest(s.encode("utf-8", "replace")) % BUCKETS
    return one("w:" + word), one("p:" + plain)


def shape_of(words: list[str], distinct: int, text: str) -> list[int]:
    """Features of a whole text: length, share of distinct words, marks."""
    n = len(words)
    share = 10 * distinct // n if n else 10
    marks = sum(map(text.count, "|#*$%&<>"))
    loud = text.count("!!")
    tags = (f"n:{min(n, 1 << 14).bit_length()}", f"d:{share}:{min(n.bit_length(), 8)}", f"m:{min(9, 10 * marks // max(n, 1))}", f"l:{min(9, 10 * loud // max(n, 1))}")
    return [xxhash.xxh32_intdigest(t.encode()) % BUCKETS for t in tags]


def features(text: str, memo: Memo) -> list[int]:
    words = text.split()
    seen = set(words)
    out = set(shape_of(words, len(seen), text))
    for pair in memo.all(list(seen)):
        out.update(pair)
    return sorted(out)


class OrdinalModel:
    """Weights by bucket and thresholds by grade."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) of each row and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def cuts_of(low: float, gaps: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the gaps between them."""
    return np.r_[low, low + np.cumsum(np.exp(gaps))]


def slopes(z: np.ndarray, y: np.ndarray, low: float, gaps: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Negative log-likelihood of grades y at scores z, and its derivatives by each score, by low and by the gaps."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    cuts = np.r_[-np.inf, cuts_of(low, gaps), np.inf]
    upper, lower = sigmoid(cuts[y + 1] - z), sigmoid(cuts[y] - z)  # P(grade <= y) and P(grade < y)
    p = np.maximum(upper - lower, 1e-9)
    du, dd = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_cut = np.zeros(GRADES + 1)  # of log p by each cut, the infinite ones included
    np.add.at(by_cut, y + 1, du)
    np.add.at(by_cut, y, -dd)
    inner = by_cut[1:-1]
    later = np.cumsum(inner[::-1])[::-1]
    return -float(np.log(p).sum()), du - dd, -float(inner.sum()), -later[1:] * np.exp(gaps)


def fit(rows: list[list[int]], grades: list[int]) -> OrdinalModel:
    """Proximal AdaGrad with an L1 penalty on the weights; thresholds as a first one and positive gaps."""
    w, acc = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    low, gaps = -3.0, np.zeros(GRADES - 2)
    if not rows:
        return OrdinalModel(w, cuts_of(low, gaps))
    lens = np.array([len(r) for r in rows])
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(lens.sum()))
    often = np.bincount(flat, minlength=BUCKETS) >= MIN_ROWS
    y_all, at = np.array(grades), np.r_[0, np.cumsum(lens)]
    order_of = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = order_of.permutation(len(rows))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            idx = np.concatenate([flat[at[i] : at[i + 1]] for i in pick])
            row = np.repeat(np.arange(len(pick)), lens[pick])
            keep = often[idx]
            idx, row = idx[keep], row[keep]
            z = np.bincount(row, w[idx], minlength=len(pick))
            _, g, by_low, by_gaps = slopes(z, y_all[pick], low, gaps)
            gw = np.bincount(idx, g[row], minlength=BUCKETS)
            hit = np.unique(idx)
            acc[hit] += gw[hit] ** 2
            step = RATE / np.sqrt(acc[hit])
            new = w[hit] - step * gw[hit]
            w[hit] = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
            low -= 0.05 * by_low / len(pick)
            gaps -= 0.05 * by_gaps / len(pick)
    return OrdinalModel(w, cuts_of(low, gaps))


def grade():
    return F.when(F.col("toxic") == 1, F.lit(0)).when(F.col("quality") == 0, F.lit(1)).when(F.col("quality") == 1, F.lit(2))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rated: int = MAX_RATED) -> OrdinalModel:
    """Fits on the first max_rated rated documents by a hash of the key."""
    rated = labels.select(F.col(key).alias("k"), grade().alias("g")).filter("g IS NOT NULL AND k IS NOT NULL").orderBy(F.xxhash64("k"), "k", "g").limit(max_rated)
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).join(F.broadcast(rated), "k")  # at most max_rated rows of two numbers

    def run(batches):
        memo = Memo(buckets_of)
        for batch in batches:
            for part, texts in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("g"), pa.array([features(t, memo) for t in texts], pa.list_(pa.int32()))], names=["k", "g", "f"])

    got = text_batches(rows).mapInArrow(run, "k long, g int, f array<int>").orderBy(F.xxhash64("k"), "k", "g").limit(max_rated).collect()
    return fit([r.f for r in got], [r.g for r in got])


@lru_cache(maxsize=1)
def _weights(blob: bytes) -> tuple[dict, Memo]:
    """Weight by bucket, and a memo of each word's buckets that have one."""
    n = len(blob) // 12
    weight = dict(zip(np.frombuffer(blob, "<i4", n).tolist(), np.frombuffer(blob, "<f8", n, 4 * n).tolist()))
    return weight, Memo(lambda word: tuple(b for b in buckets_of(word) if b in weight))


def score_of(text: str, weight: dict, memo: Memo) -> float:
    """The sum of the weights of a text's features, each once."""
    words = text.split()
    seen = set(words)
    out = {b for b in shape_of(words, len(seen), text) if b in weight}
    for buckets in memo.all(list(seen)):
        if buckets:
            out.update(buckets)
    return sum((weight[b] for b in sorted(out)), 0.0)  # in one order, whatever the worker


RESULT = ("score", "expected_grade", "tail_prob", "kept")


def score(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text", min_tail: float = MIN_TAIL) -> DataFrame:
    """key, score, expected_grade, tail_prob (of the top grade), kept."""
    at = np.flatnonzero(model.weights).astype("<i4")
    blob, cuts = at.tobytes() + model.weights[at].astype("<f8").tobytes(), model.thresholds
    kind, name = docs.schema[key].dataType.simpleString(), "key" if key in RESULT else key

    def run(batches):
        weight, memo = _weights(blob)
        m = OrdinalModel(np.zeros(0), cuts)
        for batch in batches:
            for part, texts in slices(batch, "t"):
                z = np.array([score_of(t, weight, memo) for t in texts], float)
                tails = m.tails(z)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(z), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= min_tail)], names=[name, *RESULT])

    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t"))
    return text_batches(rows).mapInArrow(run, f"`{name}` {kind}, score double, expected_grade double, tail_prob double, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
