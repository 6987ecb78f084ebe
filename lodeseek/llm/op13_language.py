"""Language identification by mixtures: which languages a document's words come from, and in what shares.

Each language has a model of words, trigrams of characters that back off to bigrams and single
characters. A document is a mixture of languages: expectation-maximisation estimates the shares
from the likelihoods of its words. The set of languages grows from the best single one as long as
another language raises the log likelihood by more than a penalty. The language with the largest
share is the prediction.

Models are fitted on a sample of about LEARN_ROWS labelled documents a language, of the MAX_LANGS
languages with the most of them, and hold at most MODEL_CELLS numbers. Predictions cover every word
of every text, and see nothing but the text.

Edge cases: a null text and one without a letter are `und` with score 0, as is every text where
nothing was learned; a label may be any text but null; documents without an id are neither learned
from nor held out; ties go to the language that sorts first; texts of any length are read whole;
repeated rows each give a row; empty tables give empty results; other columns stay, one named like
an output column is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import slices, text_batches

#: Documents of a language that its model is fitted on, about; languages; numbers of the models.
LEARN_ROWS, MAX_LANGS, MODEL_CELLS = 4_000, 256, 4_000_000
#: Weight of the next shorter context, in characters seen; the number of characters that a language could use.
BACK_OFF, ALPHABET = 4.0, 5_000
#: What another language must add to the log likelihood: so much, and so much more for each doubling of the words.
PENALTY, PENALTY_STEP = 6.0, 1.0
#: Rounds of expectation-maximisation, and the change of shares below which they end.
ROUNDS, SETTLED = 60, 1e-5
#: Numbers that a worker remembers of words.
MEMO_CELLS = 4_000_000

_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> Counter:
    """The words of a text in small letters. Numerals that aren't digits stand in no word."""
    words = Counter(_WORD.findall(text.lower()))
    for odd in [w for w in words if not w.isalpha()]:
        n = words.pop(odd)
        for part in "".join(c if c.isalpha() else " " for c in odd).split():
            words[part] += n
    return words


def grams_of(word: str) -> list[str]:
    """Each character, and the end, with the two before it."""
    w = f"\x02\x02{word}\x03"
    return [w[i : i + 3] for i in range(len(w) - 2)]


# Learning ---------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            words.setdefault(lang, Counter()).update(words_of(text))
    for lang, counts in words.items():
        grams: Counter = Counter()
        for w, n in counts.items():
            for g in grams_of(w):
                grams[g] += n
        keys = list(grams)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([grams[g] for g in part], pa.int64())], names=["lang", "gram", "n"])


@dataclass
class Model:
    """Languages, and log probabilities of grams: a row for each gram of three, two or one characters, the last one for any other."""

    langs: list[str]
    rows: dict[str, int]
    logs: np.ndarray
    memo: dict = field(default_factory=dict, repr=False)
    known: np.ndarray | None = field(default=None, repr=False)

    def row(self, gram: str) -> int:
        for g in (gram, gram[1:], gram[2:]):
            if (i := self.rows.get(g)) is not None:
                return i
        return len(self.logs) - 1

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of words, a column for each language."""
        grams = [grams_of(w) for w in words]
        at = np.cumsum([0, *map(len, grams)])[:-1]
        get, row = self.rows.get, self.row
        rows = np.array([i if (i := get(g)) is not None else row(g) for gs in grams for g in gs], np.int64)
        return np.add.reduceat(self.logs[rows], at, axis=0) if words else np.zeros((0, len(self.langs)))

    def recalled(self, docs: list[Counter]) -> None:
        """Sees to it that the words of some documents are in the memo."""
        new = list(dict.fromkeys(w for d in docs for w in d if w not in self.memo))
        if (len(self.memo) + len(new)) * len(self.langs) > MEMO_CELLS or self.known is None:
            self.memo, self.known = {}, np.zeros((0, len(self.langs)))
            new = list(dict.fromkeys(w for d in docs for w in d))
        self.memo.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        if new:
            self.known = np.concatenate([self.known, self.likelihoods(new)])

    def shares(self, words: Counter) -> list[tuple[str, float]]:
        """The languages of a document whose words are recalled, the largest share first."""
        ll = self.known[[self.memo[w] for w in words]]
        sets, shares = select(ll, np.fromiter(words.values(), float, len(words)))
        return sorted(zip([self.langs[i] for i in sets], map(float, shares)), key=lambda x: (-x[1], x[0]))


def fitted(langs: list[str], grams: dict[tuple[str, str], int]) -> Model:
    """The model of counts (language, gram of three) -> n."""
    column = {x: i for i, x in enumerate(langs)}
    sizes: dict[str, np.ndarray] = {}
    for (lang, g), n in grams.items():
        for part in (g, g[1:], g[2:]):
            if part not in sizes:
                sizes[part] = np.zeros(len(langs))
            sizes[part][column[lang]] += n
    contexts: dict[str, np.ndarray] = {}
    for g, n in sizes.items():
        contexts[g[:-1]] = contexts.get(g[:-1], 0) + n
    keys = sorted(sizes, key=len)
    chance: dict[str, np.ndarray] = {}
    for g in keys:
        lower = chance[g[1:]] if len(g) > 1 else 1 / ALPHABET
        chance[g] = (sizes[g] + BACK_OFF * lower) / (contexts[g[:-1]] + BACK_OFF)
    other = BACK_OFF / ALPHABET / (contexts.get("", np.zeros(len(langs))) + BACK_OFF)
    return Model(langs, {g: i for i, g in enumerate(keys)}, np.log(np.array([chance[g] for g in keys] + [other])).reshape(-1, len(langs)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", rows: int = LEARN_ROWS) -> Model:
    """Models of the languages of labelled documents; order: a column whose hash picks the sample."""
    docs = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = docs.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    there = {r.lang: r.n for r in sizes.collect()}  # at most MAX_LANGS rows
    if not there:
        return Model([], {}, np.zeros((1, 0)))
    share = F.create_map(*[x for k, n in there.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))])
    luck = F.pmod(F.xxhash64(F.col(order).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.filter(F.col(lang).isin(*there) & (luck < F.element_at(share, F.col(lang)))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    grams = text_batches(sample).mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    most = MODEL_CELLS // len(there)
    best = grams.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(most).select("gram")
    got = grams.join(best, "gram", "left_semi").toArrow().to_pydict()  # at most MODEL_CELLS rows
    return fitted(sorted(there), {(a, g): n for a, g, n in zip(got["lang"], got["gram"], got["n"])})


# Mixtures ---------------------------------------------------------------------------------------


def proportions(ll: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the columns by expectation-maximisation, and each word's log likelihood under the mixture.

    ll: log likelihoods of words by language, n: how often each word occurs.
    """
    top = ll.max(axis=1)
    like, total = np.exp(ll - top[:, None]), n.sum()
    shares = np.full(ll.shape[1], 1 / ll.shape[1])
    for _ in range(ROUNDS):
        mixed = like @ shares
        now = shares * ((n / mixed) @ like) / total
        done = np.abs(now - shares).max() < SETTLED
        shares = now
        if done:
            break
    return shares, np.log(like @ shares) + top


def select(ll: np.ndarray, n: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The columns of a document's languages and their shares.

    Another language can't add more than it would if each word took the better of the two, so
    most languages are turned down by that bound.
    """
    totals = n @ ll
    chosen, shares = [int(totals.argmax())], np.ones(1)
    now, score = ll[:, chosen[0]], totals.max()
    cost = PENALTY + PENALTY_STEP * np.log2(1 + n.sum())
    while len(chosen) < ll.shape[1]:
        bound = n @ np.maximum(ll - now[:, None], 0)
        found = None
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] <= max(cost, found[0] if found else 0):
                break
            if int(i) not in chosen:
                mine, each = proportions(ll[:, [*chosen, int(i)]], n)
                gain = float(n @ each) - score
                if gain > max(cost, found[0] if found else 0):
                    found = gain, int(i), mine, each
        if not found:
            break
        gain, i, shares, now = found
        chosen, score = [*chosen, i], score + gain
    return chosen, shares


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and languages (lang and share, the largest first).

    score: the share of lang_pred, drawn towards an even one as if there were a word more of each language.
    """
    model.memo, model.known = {}, None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_CELLS numbers
    one = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(one))]
    keep = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]

    def run(batches):
        m = shared.value
        for batch in batches:
            for part, texts in slices(batch, text):
                counted = [words_of(t) for t in texts] if m.langs else [Counter()] * len(texts)
                m.recalled(counted)
                said = [m.shares(c) if c else [] for c in counted]
                score = [(s[0][1] * (n := c.total()) + 1) / (n + len(m.langs)) if s else 0.0 for s, c in zip(said, counted)]
                cols = [pa.array([s[0][0] if s else UNKNOWN for s in said], pa.string()), pa.array(score, pa.float64()), pa.array([[{"lang": a, "share": b} for a, b in s] for s in said], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *cols], names=[*(f.name for f in keep), *(f.name for f in new)])

    return text_batches(docs).mapInArrow(run, T.StructType([*keep, *new]))


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids that is kept from learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "languages")
