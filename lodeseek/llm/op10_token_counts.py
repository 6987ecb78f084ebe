"""Token counts by section of a document.

Each document is encoded once, as a whole; its tokens' character spans are joined to the
sections' spans. A token inside one section counts there. One that reaches over a boundary is
given by a rule to the section of its first character ("start"), of its last ("end"), or to the
one that holds most of its characters, the earlier of equals ("most"). A token whose deciding
character lies in no section counts in none. Spans are in code points, ends exclusive; a token
that begins or ends within a character's bytes covers that character.

Edge cases: null and empty texts have their sections with no tokens; texts of any length are encoded
whole; null sections, and those without a start or an end, give no row; sections that overlap are an error, empty ones get no token; repeated
rows each give their rows; an empty table gives no row; other columns are left out, whatever their names;
a key named like a result column is returned as `key`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .op1_bpe import vocabulary
from .tokens import codec, decoder, read_ranks, slices, text_batches
from .common import text_of

RULES = ("start", "end", "most")
RESULT = ("section", "char_start", "char_end", "n_tokens", "n_crossing")


def head_body_tail(text: str = "text") -> Column:
    """First line, middle and last line as array<struct<section,start,end>>; a newline belongs to the line it ends."""
    t = text_of(text)
    n = F.char_length(t)
    a = F.locate("\n", t)
    z = n - F.locate("\n", F.reverse(t)) + 1
    part = lambda name, s, e: F.struct(F.lit(name).alias("section"), s.cast("int").alias("start"), e.cast("int").alias("end"))
    zero = F.lit(0)
    return F.when(a == 0, F.array(part("head", zero, n))).otherwise(F.filter(F.array(part("head", zero, a), part("body", a, z), part("tail", z, n)), lambda x: x["start"] < x["end"]))


def spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character of each token."""
    ends = np.cumsum(lengths[ids])
    raw = text.encode("utf-8", "replace")
    if len(raw) == len(text):
        return ends - lengths[ids], ends
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1  # of each byte
    return char[ends - lengths[ids]], char[ends - 1] + 1


def allot(first: np.ndarray, stop: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; sections in order, none empty."""
    k = len(starts)
    at = lambda p: np.searchsorted(starts, p, side="right") - 1
    a, b = at(first), at(stop - 1)
    inside = lambda i, p: (i >= 0) & (p < ends[np.maximum(i, 0)])
    crossing = (a != b) | (inside(a, first) != inside(b, stop - 1))
    if rule == "start":
        got, ok = a, inside(a, first)
    elif rule == "end":
        got, ok = b, inside(b, stop - 1)
    else:
        got, ok = a.copy(), inside(a, first)
        for t in np.flatnonzero(crossing):
            s = range(max(a[t], 0), b[t] + 1)
            held = [min(stop[t], ends[i]) - max(first[t], starts[i]) for i in s]
            best = int(np.argmax(held)) if held else 0
            got[t], ok[t] = (s[best], held[best] > 0) if held else (0, False)
    got = got[ok]
    return np.bincount(got, minlength=k), np.bincount(got[crossing[ok]], minlength=k)


def count(docs: DataFrame, vocabulary: str, pattern: str, sections: Column, key: str = "doc_id", text: str = "text", rule: str = "start") -> DataFrame:
    """One row per document and section: key, section, char_start, char_end, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    raw = read_ranks(vocabulary)
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t"), sections.alias("s"))
    kind, name = docs.schema[key].dataType.simpleString(), "key" if key in RESULT else key

    def run(batches):
        enc, lengths = codec(raw, pattern), decoder(raw).lengths
        for batch in batches:
            for part, texts in slices(batch, "t"):
                out: list[tuple] = []
                keys = part.column("k").to_pylist()
                for k, t, found in zip(keys, texts, part.column("s").to_pylist()):
                    found = [x for x in found or () if x and x["start"] is not None and x["end"] is not None]
                    if not found:
                        continue
                    found = sorted(found, key=lambda x: (x["start"], x["end"]))
                    full = [x for x in found if x["start"] < x["end"]]
                    if any(x["end"] > y["start"] for x, y in zip(full, full[1:])):
                        raise ValueError("sections overlap")
                    first, stop = spans(t, np.frombuffer(enc.encode(t), "<i4"), lengths)
                    n, c = allot(first, stop, np.array([x["start"] for x in full], np.int64), np.array([x["end"] for x in full], np.int64), rule)
                    i = 0
                    for x in found:
                        if x["start"] < x["end"]:
                            out.append((k, x["section"], x["start"], x["end"], int(n[i]), int(c[i])))
                            i += 1
                        else:
                            out.append((k, x["section"], x["start"], x["end"], 0, 0))
                if out:
                    cols = list(zip(*out))
                    types = [part.schema.field("k").type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[name, *RESULT])

    return text_batches(rows).mapInArrow(run, f"`{name}` {kind}, section string, char_start long, char_end long, n_tokens long, n_crossing long")


def totals(counts: DataFrame, docs: DataFrame, key: str = "doc_id", by: str = "source") -> DataFrame:
    """Tokens by a column of the documents and section. Rows that repeat a key must agree in the column: each pair of key and value counts once."""
    return counts.join(docs.select(key, by).distinct(), key).groupBy(by, "section").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_crossing").alias("n_crossing"))


def query(spark, sf_dir: str) -> DataFrame:
    voc, pattern = vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count(docs, voc, pattern, head_body_tail())
