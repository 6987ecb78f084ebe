"""Personal data: patterns, and a character BiLSTM-CRF that adds spans the patterns miss.

The patterns give the base spans of each kind. The tagger reads every character of every text in
overlapping windows and decodes each text by one path (see tagger.py). Its spans that touch each
other become one and are widened to whole words; the part of a span that holds what its kind must
hold (an address with a host, four numbers up to 255, 13 to 19 digits passing Luhn, 10 to 15 digits
with separators) is added if it touches no base span.

Edge cases: null and empty texts have no span; repeated rows each give a row; texts of any
length are read whole, in memory that grows with the longest stretch of a text in which the
tagger isn't sure; offsets are code points, ends exclusive; a column named like the spans'
column is replaced; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .op1_bpe import _with
from .tagger import KINDS, Reader, Tagger, classes, luhn, trained
from .tokens import slices, text_batches

#: Characters of texts that are read at once (or one text).
READ_CHARS = 1 << 20
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is left or taken as a whole, so a long one costs one step
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = r"(?: ?@ ?| ?[\[({<]at[\])}>] ?| at )"
_DOT = r"(?: ?\. ?| ?[\[({<](?:dot|\.)[\])}>] ?| dot )"
_FORMS = {
    "email": re.compile(rf"[a-z0-9._%+-]+{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}", re.I),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.I),
    "card": re.compile(r"[0-9]{2,}(?:[ ./_-]?[0-9]{2,})*"),
    "phone": re.compile(r"[+(]?[0-9]+(?:[ ().\-/]+[0-9]+)+"),
}


def _ascii_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        host = _HOST.match(text, at + 1)
        if host:
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, host.end()))
                floor = host.end()
        at = text.find("@", max(at + 1, floor))
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _ascii_digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_ascii_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def held(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The part of a span, ending at whole words, that holds what the kind must hold."""
    m = _FORMS[kind].search(text, start, end)
    if not m or (m.start() > 0 and text[m.start() - 1].isalnum()) or (m.end() < len(text) and text[m.end()].isalnum()):
        return None
    d = _ascii_digits(m[0])
    if kind == "ip":
        ok = all(int(x) <= 255 for x in re.findall("[0-9]+", m[0]))
    elif kind == "card":
        ok = 13 <= len(d) <= 19 and luhn(d)
    else:
        ok = kind == "email" or 10 <= len(d) <= 15
    return m.span() if ok else None


def settle(text: str, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """The parts of the tagger's spans (touching ones joined, on whole words) that hold what a kind must hold."""
    joined: list[list] = []
    for kind, s, e in found:
        if joined and s <= joined[-1][2]:
            joined[-1][0].append(kind)
            joined[-1][2] = e
        else:
            joined.append([[kind], s, e])
    out: list[tuple[str, int, int]] = []
    for kinds, s, e in joined:
        while s > 0 and text[s].isalnum() and text[s - 1].isalnum():
            s -= 1
        while e < len(text) and text[e].isalnum() and text[e - 1].isalnum():
            e += 1
        for kind in dict.fromkeys(kinds):
            part = held(KINDS[kind], text, s, e)
            if part and (not out or out[-1][2] <= part[0]):
                out.append((KINDS[kind], *part))
                break
    return out


def added_spans(texts: list[str], bases: list[list], model: Tagger | Reader) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans of each text that touch no base span."""
    reader = model.reader() if isinstance(model, Tagger) else model
    out: list[list] = []
    at = 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= READ_CHARS):
            size += len(texts[stop])
            stop += 1
        for i, found in enumerate(reader.spans([classes(t) for t in texts[at:stop]]), at):
            out.append([x for x in settle(texts[i], found) if all(x[2] <= a or b <= x[1] for _, a, b in bases[i])])
        at = stop
    return out


def _order(span):
    return KINDS.index(span[0]), span[1], span[2]


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def masked(text: str, found: list[tuple]) -> str:
    """text with each (kind, start, end) replaced by its kind in brackets; spans that overlap become one."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text", spans: str = "pii_spans", model: Tagger | None = None, masks: bool = False) -> DataFrame:
    """docs with the spans of the whole text, by kind, then start; base marks those of the patterns.

    With masks, the text is returned with its spans masked (a null text stays null); offsets are those of the text read.
    """
    params = (model or trained()).p
    out = _with(docs.schema, T.StructField(spans, T.ArrayType(_SPAN)))
    keep = [f.name for f in out.fields[:-1]]

    def run(batches):
        reader = Reader(params)
        for batch in batches:
            for part, texts in slices(batch, text):
                bases = [base_spans(t) for t in texts]
                more = added_spans(texts, bases, reader)
                rows = [[{"kind": k, "start": s, "end": e, "base": (k, s, e) in known} for k, s, e in sorted([*b, *m], key=_order)] for b, m, known in ((b, m, set(b)) for b, m in zip(bases, more))]
                cols = {c: part.column(c) for c in keep}
                if masks:
                    valid = cols[text].is_valid().to_pylist()
                    cols[text] = pa.array([masked(t, [*b, *m]) if ok else None for t, b, m, ok in zip(texts, bases, more, valid)], cols[text].type)
                yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(rows, pa.list_(_ARROW_SPAN))], names=[*keep, spans])

    return text_batches(docs).mapInArrow(run, out)


def mask(docs: DataFrame, text: str = "text", spans: str = "pii_spans", model: Tagger | None = None) -> DataFrame:
    """docs with the spans masked in the text, found and masked in one pass, and with the spans that were masked."""
    return find(docs, text, spans, model, masks=True)


def query(spark, sf_dir: str) -> DataFrame:
    docs = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda x: x["base"])
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    return docs.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("pii_spans")).alias("spans"))
