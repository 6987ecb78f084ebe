import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lodeseek.llm import op1_bpe, op7_quality, op10_token_counts as op10
from lodeseek.llm.tokens import codec, read_ranks


def brute(tok, text, sections, rule):
    ids = tok.encode_ordinary(text)
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    n, cross, at = [0] * len(sections), [0] * len(sections), 0
    for t in ids:
        k = len(tok.decode_single_token_bytes(t))
        chars = range(owner[at], owner[at + k - 1] + 1)
        held = [sum(a <= c < b for c in chars) for _, a, b in sections]
        where = [next((i for i, (_, a, b) in enumerate(sections) if a <= c < b), -1) for c in chars]
        got = {"start": where[0], "end": where[-1], "most": int(np.argmax(held)) if max(held) else -1}[rule]
        if got >= 0:
            n[got] += 1
            cross[got] += where[0] != where[-1]
        at += k
    return n, cross


@pytest.mark.parametrize("rule", op10.RULES)
def test_op10_rules(spark, rule):
    voc, pattern = op1_bpe.vocabulary()
    tok = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec(read_ranks(voc), pattern).ranks, special_tokens={})
    texts = ["hello world", "a\nb\nc", "x\n", "\n\n\n", "straße 漢字 😀 naïve\nsecond line here\nlast", "one two  \n  three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op10.count(df, voc, pattern, op10.head_body_tail(), rule=rule).collect()
    for i, t in enumerate(texts):
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.char_start)
        secs = [(r.section, r.char_start, r.char_end) for r in rows]
        assert "".join(t[a:b] for _, a, b in secs) == t
        n, cross = brute(tok, t, secs, rule)
        assert [r.n_tokens for r in rows] == n and [r.n_crossing for r in rows] == cross


def test_op10_whole_table(spark, sf_dir):
    """Every document of the table by brute force, and all tokens by op1."""
    voc, pattern = op1_bpe.vocabulary()
    tok = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec(read_ranks(voc), pattern).ranks, special_tokens={})
    got: dict = {}
    for r in op10.query(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        rows = sorted(got[d.doc_id], key=lambda r: r.char_start)
        lines = d.text.split("\n")
        head, tail = len(lines[0]) + 1, len(lines[-1])
        want = [("head", 0, len(d.text))] if len(lines) == 1 else [x for x in (("head", 0, head), ("body", head, len(d.text) - tail), ("tail", len(d.text) - tail, len(d.text))) if x[1] < x[2]]
        assert [(r.section, r.char_start, r.char_end) for r in rows] == want
        n, cross = brute(tok, d.text, want, "start")
        assert [r.n_tokens for r in rows] == n and [r.n_crossing for r in rows] == cross
    tokens = {r.doc_id: r.n_tokens for r in op1_bpe.query(spark, sf_dir).collect()}
    assert {k: sum(r.n_tokens for r in v) for k, v in got.items()} == tokens


def test_op10_edges(spark):
    voc, pattern = op1_bpe.vocabulary()
    long = "ab cd " * 100000
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a", 5), (3, "a", 5), (4, long, 5)], "section long, text string, n_tokens int")
    out = sorted(tuple(r) for r in op10.count(df, voc, pattern, op10.head_body_tail(), key="section").collect())
    assert out == [(1, "head", 0, 0, 0, 0), (2, "head", 0, 0, 0, 0), (3, "head", 0, 1, 1, 0), (3, "head", 0, 1, 1, 0), (4, "head", 0, len(long), 200001, 0)]
    assert op10.count(df, voc, pattern, op10.head_body_tail(), key="section").columns[0] == "key"
    assert op10.count(df.limit(0), voc, pattern, op10.head_body_tail(), key="section").count() == 0


def test_op10_overlaps_and_totals(spark):
    voc, pattern = op1_bpe.vocabulary()
    df = spark.createDataFrame([(1, "ab cd ef", "s"), (1, "ab cd ef", "s"), (2, "ab", None)], "doc_id long, text string, source string")
    part = lambda n, a, b: F.struct(F.lit(n).alias("section"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    with pytest.raises(Exception, match="overlap"):
        op10.count(df, voc, pattern, F.array(part("x", 0, 5), part("y", 3, 8))).collect()
    none = F.lit(None).cast("array<struct<section:string,start:int,end:int>>")
    assert op10.count(df, voc, pattern, none).count() == 0
    part_null = none[0]
    holed = F.array(part_null, part("x", 0, 2), part_null, part("y", 2, 5), part("no start", None, 4), part("no end", 1, None))
    counts = op10.count(df, voc, pattern, F.array(part("x", 0, 2), part("y", 2, 5)))
    assert sorted(op10.count(df, voc, pattern, holed).collect()) == sorted(counts.collect())
    assert op10.count(df, voc, pattern, F.array(part_null)).count() == 0
    assert sorted((r.source, r.section, r.n_tokens) for r in op10.totals(counts, df).collect() if r.source) == [("s", "x", 2), ("s", "y", 2)]


def test_op7_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = op7_quality.train(docs, labels.filter("doc_id % 4 <> 0"))
    assert model.thresholds[0] < model.thresholds[1]
    held = labels.filter("doc_id % 4 = 0").select("doc_id", op7_quality.grade().alias("g"))
    rows = op7_quality.score(docs.join(held, "doc_id"), model).join(held, "doc_id").collect()
    clean = [r.kept for r in rows if r.g == 2]
    toxic = [r.kept for r in rows if r.g == 0]
    assert np.mean(clean) > 0.95 and np.mean(toxic) < 0.5
    grades = [np.mean([r.expected_grade for r in rows if r.g == g]) for g in range(3)]
    assert grades[0] < grades[1] < grades[2]


def test_op7_slopes():
    r = np.random.default_rng(3)
    z, y, low, gaps = r.normal(size=40), r.integers(0, 3, 40), -0.4, np.array([0.3])
    loss, by_z, by_low, by_gaps = op7_quality.slopes(z, y, low, gaps)
    cuts = [low, low + np.exp(gaps[0])]
    below = lambda k, s: 0.0 if k < 0 else 1.0 if k > 1 else 1 / (1 + np.exp(s - cuts[k]))
    assert abs(loss + sum(np.log(below(k, s) - below(k - 1, s)) for s, k in zip(z, y))) < 1e-9
    at = lambda *a: op7_quality.slopes(*a)[0]
    e = 1e-6
    for i in range(5):
        d = np.eye(40)[i] * e
        assert abs((at(z + d, y, low, gaps) - at(z - d, y, low, gaps)) / (2 * e) - by_z[i]) < 1e-4
    assert abs((at(z, y, low + e, gaps) - at(z, y, low - e, gaps)) / (2 * e) - by_low) < 1e-4
    assert abs((at(z, y, low, gaps + e) - at(z, y, low, gaps - e)) / (2 * e) - by_gaps[0]) < 1e-4


def plain_features(text):
    """Features of the model, written out."""
    words = text.split()
    names = {"w:" + w for w in words} | {"p:" + w.strip(".,;:!?\"'()[]").lower() for w in words}
    n, distinct = len(words), len(set(words))
    marks, loud = sum(text.count(c) for c in "|#*$%&<>"), text.count("!!")
    names |= {f"n:{min(n, 16384).bit_length()}", f"d:{10 * distinct // n if n else 10}:{min(n.bit_length(), 8)}", f"m:{min(9, 10 * marks // max(n, 1))}", f"l:{min(9, 10 * loud // max(n, 1))}"}
    return {xxhash.xxh32_intdigest(x.encode()) % op7_quality.BUCKETS for x in names}


def test_op7_on_whole_table_by_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = op7_quality.train(docs, labels)
    assert (model.weights != 0).sum() > 5
    got = {r.doc_id: r for r in op7_quality.query(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for d in rows:
        z = sum(model.weights[b] for b in plain_features(d.text))
        tails = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        r = got[d.doc_id]
        assert abs(r.score - z) < 1e-9 and abs(r.expected_grade - sum(tails)) < 1e-9 and abs(r.tail_prob - tails[-1]) < 1e-9
        assert r.kept == (r.tail_prob >= op7_quality.MIN_TAIL)


def test_op7_odd_rows(spark):
    long = "the word " * 200000
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (2, "", 1.0), (3, "The the THE cat, cat", 0.0), (4, long, 0.0), (None, "a", 0.0)], "kept long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (3, 0, 0), (4, 0, 1), (None, 1, 0), (9, None, None)], "kept long, quality int, toxic int")
    model = op7_quality.train(docs, labels, key="kept")
    out = op7_quality.score(docs, model, key="kept")
    assert out.columns == ["key", "score", "expected_grade", "tail_prob", "kept"]
    assert sorted(str(r.key) for r in out.collect()) == ["1", "2", "2", "3", "4", "None"]
    dense = op7_quality.OrdinalModel(np.random.default_rng(1).normal(size=op7_quality.BUCKETS), np.array([0.0, 1.0]))
    for r in op7_quality.score(docs, dense, key="kept").collect():
        text = {1: "", 2: "", 3: "The the THE cat, cat", 4: long}.get(r.key, "a")
        assert abs(r.score - sum(dense.weights[b] for b in plain_features(text))) < 1e-9


def test_op7_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    model = op7_quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.kept for r in op7_quality.score(docs, model).collect()] == [True] * 3
