"""Source divergence audit: how the word use of each source differs from others of its language.

Tasks count terms in radix tries over bytes, whose leaves hold how many documents have the term and a
counter for each source. A trie is given out by prefix range (the first PREFIX bytes), and the
parts of all tasks with the same language and prefix are merged. Merged leaves go out in UTF-8 order
in blocks of bounded size. A second traversal, which knows the totals, adds up the divergences of
all pairs of sources and keeps each source's best terms, the earlier one of equals.

Arithmetic is in integers and exact: in numpy while products stay below 2**63, else in Python's.

Edge cases: a null text, language or source is the empty one; a row is a document, so repeated rows
count each; a text of any length is counted whole, piece by piece; a source without a kept term
still has its pairs, with the value 0 where the language has none; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import text_batches

#: Documents that a kept term is in at least, its scale of shares, and ranks of terms.
MIN_DOCS, SCALE, RANKS = 3, 1_000_000_000, 200
#: Bytes of a prefix range.
PREFIX = 4
#: Entries that a task counts before they go into tries, and leaves before tries are given out.
COUNTED, LEAVES = 500_000, 400_000
#: Bytes of a text that are counted at once.
PIECE = 1 << 20
#: Leaves of a block, and sources of a language that are compared at once.
BLOCK, SOURCES = 4096, 256
#: Kept terms of a language that are compared together, about.
SHARE = 32_768

#: Letters A-Z become small; all other ASCII characters but letters end a term.
_TERM_BYTES = bytes(i + 32 if 0x41 <= i <= 0x5A else i if i >= 0x80 or 0x61 <= i <= 0x7A else 0x20 for i in range(256))


class _Node:
    __slots__ = ("children", "label", "leaf")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.leaf = label, None, None


class Trie:
    """A radix trie over bytes. A leaf is a dict: source -> occurrences, and None -> documents."""

    def __init__(self) -> None:
        self.root, self.size = _Node(b""), 0

    def leaf(self, term: bytes) -> dict:
        """The term's leaf, made if it isn't there."""
        node, i = self.root, 0
        while i < len(term):
            if node.children is None:
                node.children = {}
            child = node.children.get(term[i])
            if child is None:
                node.children[term[i]] = child = _Node(term[i:])
                node = child
                break
            label = child.label
            if not term.startswith(label, i):
                k = 1
                while i + k < len(term) and term[i + k] == label[k]:
                    k += 1
                upper = _Node(label[:k])
                upper.children = {label[k]: child}
                child.label = label[k:]
                node.children[term[i]] = child = upper
                label = upper.label
            node, i = child, i + len(label)
        if node.leaf is None:
            node.leaf = {}
            self.size += 1
        return node.leaf

    def add(self, term: bytes, counts: dict) -> None:
        leaf = self.leaf(term)
        if leaf:
            for k, n in counts.items():
                leaf[k] = leaf.get(k, 0) + n
        else:
            leaf.update(counts)

    def merge(self, other: Trie) -> None:
        for term, counts in other.walk():
            self.add(term, counts)

    def walk(self) -> Iterator[tuple[bytes, dict]]:
        """(term, leaf) in the order of the terms' bytes, which is that of their characters."""
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            if node.leaf is not None:
                yield path, node.leaf
            if node.children:
                stack += [(path + c.label, c) for _, c in sorted(node.children.items(), reverse=True)]


# Counting ---------------------------------------------------------------------------------------


def _pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length unless a single term is longer."""
    raw = text.encode().translate(_TERM_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE) if len(raw) - at > PIECE else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Counts:
    """A task's counts, and its tries by language."""

    def __init__(self) -> None:
        self.tries: dict[str, Trie] = {}
        self._new()

    def _new(self) -> None:
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.uses: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def add(self, lang: str, source: str, text: str) -> None:
        uses, seen = self.uses[lang][source], set()
        for terms in _pieces(text):
            uses.update(terms)
            seen.update(terms)
        self.docs[lang].update(seen)

    def entries(self) -> int:
        return sum(len(c) for by in self.uses.values() for c in by.values())

    def fold(self) -> None:
        """Counts go into the tries; a language's sources are noted at the empty term."""
        for lang, by in self.uses.items():
            trie = self.tries.setdefault(lang, Trie())
            trie.add(b"", dict.fromkeys(by, 0))
            sources = list(by.items())
            for term, n in self.docs[lang].items():
                leaf = trie.leaf(term)
                leaf[None] = leaf.get(None, 0) + n
                for source, uses in sources:
                    if term in uses:
                        leaf[source] = leaf.get(source, 0) + uses[term]
        self._new()

    def ranges(self) -> Iterator[tuple[str, bytes, bytes]]:
        """(language, prefix, leaves) of all tries, which end here."""
        self.fold()
        for lang, trie in self.tries.items():
            now, leaves = b"", []
            for term, leaf in trie.walk():
                if term[:PREFIX] != now:
                    if leaves:
                        yield lang, now, pickle.dumps(leaves)
                    now, leaves = term[:PREFIX], []
                leaves.append((term, leaf))
            yield lang, now, pickle.dumps(leaves)
        self.tries = {}

    def leaves(self) -> int:
        return sum(t.size for t in self.tries.values())


_RANGES = "lang string, prefix binary, leaves binary"


def _given(rows: Iterator[tuple[str, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    part: list = []
    for r in rows:
        part.append(r)
        if len(part) == 1000:
            yield _range_batch(part)
            part = []
    if part:
        yield _range_batch(part)


def _range_batch(rows: list) -> pa.RecordBatch:
    lang, prefix, leaves = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(prefix, pa.binary()), pa.array(leaves, pa.binary())], names=["lang", "prefix", "leaves"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            counts.add(lang or "", source or "", text or "")
        if counts.entries() >= COUNTED:
            counts.fold()
            if counts.leaves() >= LEAVES:
                yield from _given(counts.ranges())
    yield from _given(counts.ranges())


# Merging ----------------------------------------------------------------------------------------

_BLOCKS = "lang string, terms array<string>, sources array<string>, used array<long>, at array<int>, of array<int>, n array<long>"


def _block(lang: str, leaves: list[tuple[bytes, dict]]) -> pa.RecordBatch:
    """One row: terms in order, the sources and their totals, and the counters of term i at[i] to at[i + 1]: source and number."""
    sources: dict[str, int] = {}
    at, of, n = [0], [], []
    for _, leaf in leaves:
        for source, c in leaf.items():
            if source is not None:
                of.append(sources.setdefault(source, len(sources)))
                n.append(c)
        at.append(len(of))
    used = [0] * len(sources)
    for i, c in zip(of, n):
        used[i] += c
    terms = [t.decode() for t, _ in leaves if t]
    if leaves and not leaves[0][0]:  # the empty term only tells of sources
        first = at[1]
        at, of, n = [x - first for x in at[1:]], of[first:], n[first:]
    values = [(lang, pa.string()), (terms, pa.list_(pa.string())), (list(sources), pa.list_(pa.string())), (used, pa.list_(pa.int64())), (at, pa.list_(pa.int32())), (of, pa.list_(pa.int32())), (n, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["lang", "terms", "sources", "used", "at", "of", "n"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order of language and prefix, merged one prefix after the other; kept leaves in blocks."""
    key, trie, lang, block = None, Trie(), None, []

    def close():
        nonlocal block, lang
        for term, leaf in trie.walk():
            if not term or leaf[None] >= MIN_DOCS:
                if lang != key[0] or len(block) >= BLOCK:
                    if block:
                        yield _block(lang, block)
                    lang, block = key[0], []
                block.append((term, leaf))

    for b in batches:
        for here, prefix, leaves in zip(*(b.column(c).to_pylist() for c in ("lang", "prefix", "leaves"))):
            if (here, prefix) != key:
                if key is not None:
                    yield from close()
                key, trie = (here, prefix), Trie()
            for term, leaf in pickle.loads(leaves):
                trie.add(term, leaf)
    if key is not None:
        yield from close()
    if block:
        yield _block(lang, block)


def blocks(docs: DataFrame) -> DataFrame:
    """Kept terms of each language with their counters, in blocks of merged tries."""
    parts = text_batches(docs.select("lang", "source", "text")).mapInArrow(_counted, _RANGES)
    return parts.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(_merged, _BLOCKS)


# Comparing --------------------------------------------------------------------------------------


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total)."""
    if counts.size and (int(counts.max()) + 1) * SCALE >= 1 << 63:
        counts, total = counts.astype(object), np.asarray(total).astype(object)
    return (1 + SCALE * (counts + 1) // total).astype(np.int64)


def _dense(row: dict, names: list[str]) -> np.ndarray:
    """Counters of a block's terms, a column for each of some sources."""
    column = {s: i for i, s in enumerate(names)}
    to = np.array([column.get(s, -1) for s in row["sources"]], np.int64)
    at, of = np.array(row["at"]), np.array(row["of"], np.int64)
    out = np.zeros((len(row["terms"]), len(names)), np.int64)
    where = to[of] if len(of) else of
    which = np.repeat(np.arange(len(row["terms"])), np.diff(at))
    ok = where >= 0
    out[which[ok], where[ok]] = np.array(row["n"], np.int64)[ok]
    return out


_FOUND = "lang string, source string, part string, item string, value long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with two lists of sources of the language: sums of pairs of the lists, and best terms where the lists are the same."""
    pairs: dict = {}
    best: dict[tuple[str, str], list] = defaultdict(list)
    for b in batches:
        for row in b.to_pylist():
            lang, total = row["lang"], row["v"]
            names = [[s["source"] for s in row[c]] for c in ("left", "right")]
            sizes = [np.array([s["n"] + total for s in row[c]], np.int64) for c in ("left", "right")]
            left, right = (_dense(row, x) for x in names)
            p, q = (shares(c, n) for c, n in zip((left, right), sizes))
            key = lang, row["i"], row["j"]
            if key not in pairs:
                if len(pairs) >= 16:
                    yield from _said(pairs)
                    pairs = {}
                pairs[key] = names, np.zeros((len(names[0]), len(names[1])), np.int64)
            sums = pairs[key][1]
            for k in range(len(names[0])):
                d = p[:, k : k + 1] - q
                sums[k] += (d * d // q).sum(axis=0)
            if row["i"] == row["j"]:
                whole = np.zeros(len(row["terms"]), np.int64)
                np.add.at(whole, np.repeat(np.arange(len(whole)), np.diff(row["at"])), np.array(row["n"], np.int64))
                r = shares(whole, np.int64(row["whole"] + total))
                d = p - r[:, None]
                f = d * d // r[:, None]
                hot = (left > 0) & (d > 0)
                for k, source in enumerate(names[0]):
                    i = np.flatnonzero(hot[:, k])
                    i = i[np.argsort(-f[i, k], kind="stable")[:RANKS]]  # terms stand in order, so that the first of equals stays
                    if len(i):
                        mine = best[lang, source]
                        best[lang, source] = heapq.nsmallest(RANKS, mine + [(-int(f[x, k]), row["terms"][x]) for x in i])
            if len(best) > 4096:
                yield from _ranked(best)
                best.clear()
    yield from _said(pairs)
    yield from _ranked(best)


def _found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int64())], names=["lang", "source", "part", "item", "value"])


def _said(pairs: dict) -> Iterator[pa.RecordBatch]:
    for (lang, _, _), ((left, right), sums) in pairs.items():
        yield from _found([(lang, a, "pair", b, int(sums[i, j])) for i, a in enumerate(left) for j, b in enumerate(right) if a != b])


def _ranked(best: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), top in best.items():
        yield from _found([(lang, source, "term", term, -f) for f, term in top])


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of a source by their divergence, and its RANKS terms that stand out most."""
    rows = cut(blocks(docs))
    used = rows.select("lang", F.explode(F.arrays_zip("sources", "used")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.used").alias("n"))
    used = cut(used.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / SOURCES).cast("int")))
    whole = used.groupBy("lang").agg(F.sum("n").alias("whole"))
    terms = rows.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("v"))
    lists = used.groupBy("lang", "part").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("list"))  # at most SOURCES
    both = lists.select("lang", F.col("part").alias("i"), F.col("list").alias("left")).join(lists.select("lang", F.col("part").alias("j"), F.col("list").alias("right")), "lang")
    both = cut(both.join(whole, "lang").join(terms, "lang"))
    # blocks of a language are dealt out in shares by its terms, as each gives sums and best terms of all its sources; every share meets all lists
    n = max(1, -(-(both.agg(F.max("v")).first()[0] or 0) // SHARE))
    dealt = both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    full = rows.filter(F.size("terms") > 0).withColumn("salt", F.pmod(F.xxhash64(F.col("terms")[0]), F.lit(n)).cast("int")).repartition("lang", "salt")
    found = full.join(dealt, ["lang", "salt"]).mapInArrow(_compared, _FOUND)
    none = both.select("lang", F.explode("left.source").alias("source"), "right").select("lang", "source", F.lit("pair").alias("part"), F.explode("right.source").alias("item"), F.lit(0).cast("long").alias("value")).filter("source <> item")
    sums = found.unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return sums.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= RANKS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tok AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT i) AS df FROM tok GROUP BY ALL),
kept AS (SELECT lang, term FROM cnt GROUP BY ALL HAVING sum(df) >= {MIN_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM d),
kc AS (SELECT * FROM cnt SEMI JOIN kept USING (lang, term)),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
ns AS (SELECT lang, source, sum(c) AS n FROM kc GROUP BY ALL),
ls AS (SELECT lang, sum(n) AS n FROM ns GROUP BY lang),
p AS (SELECT kept.lang, kept.term, grp.source, coalesce(kc.c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(kc.c, 0) + 1)) // (coalesce(ns.n, 0) + v) AS p
  FROM kept JOIN grp USING (lang) JOIN vs USING (lang) LEFT JOIN kc ON kc.lang = kept.lang AND kc.term = kept.term AND kc.source = grp.source LEFT JOIN ns ON ns.lang = grp.lang AND ns.source = grp.source),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(c) + 1)) // (any_value(ls.n) + any_value(v)) AS q FROM kc JOIN ls USING (lang) JOIN vs USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}"""
