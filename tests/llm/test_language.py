import collections
import zlib

import numpy as np

from lodeseek.llm import op13_language as op

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op.query(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    right = collections.Counter()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            right[docs[r.doc_id].lang == r.lang_pred] += 1
    assert right[True] > 0.99 * right.total() and right.total() > 150


def test_only_texts_are_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    model = op.learn(docs)
    one = {r.text: (r.lang_pred, r.score) for r in op.identify(docs, model).collect()}
    two = op.identify(docs.selectExpr("-doc_id AS doc_id", "text", "'xx' AS lang", "'y' AS source", "0 AS score"), model).collect()
    assert all(one[r.text] == (r.lang_pred, r.score) for r in two)


def sample(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return rows, op.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_mixtures_are_told(spark):
    rows, model = sample(spark)
    of = lambda lang, k: " ".join(" ".join(t.split()[:60]) for _, t, x in rows if x == lang and len(t.split()) > 100 and "$" not in t and "|" not in t and "#" not in t)[: 5000 * k]
    texts = [of("en", 1), of("en", 1) + " " + of("fr", 1), of("de", 3) + " " + of("es", 1), of("en", 1)[:300] + " " + of("fr", 1)[:300] + " " + of("de", 1)[:300]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(x.lang, x.share) for x in r.languages] for r in op.identify(df, model).collect()}
    assert [x for x, _ in got[0]] == ["en"]
    assert {x for x, _ in got[1]} == {"en", "fr"} and abs(got[1][0][1] - 0.5) < 0.1
    assert [x for x, _ in got[2]] == ["de", "es"] and 0.6 < got[2][0][1] < 0.9
    assert {x for x, _ in got[3]} == {"en", "fr", "de"}


def test_nulls_empty_long_and_other_texts(spark):
    rows, model = sample(spark)
    texts = [None, "", "123 456 !!", "²½ Ⅷ _", "the and of with", "THE AND OF WITH", rows[0][1] * 2000, "中文字", "é"]
    df = spark.createDataFrame([(None if i == 3 else i, t, "old", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, Score int").drop("Score")
    got = {r.text: r for r in op.identify(df, model).collect()}
    assert all((got[t].lang_pred, got[t].score, got[t].languages) == ("und", 0.0, []) for t in texts[:4])
    assert got[texts[4]].lang_pred == got[texts[5]].lang_pred == "en" and got[texts[4]].score == got[texts[5]].score
    assert got[texts[6]].lang_pred == rows[0][2] and got[texts[6]].score > 0.99
    assert all(got[t].lang_pred in model.langs for t in texts[7:])
    none = op.learn(spark.createDataFrame([(1, "a", None), (2, None, "en")], "doc_id long, text string, lang string"))
    assert {(r.lang_pred, r.score) for r in op.identify(df, none).collect()} == {("und", 0.0)}
    assert op.identify(df.limit(0), model).count() == 0


def test_shares_are_the_likeliest():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        ll, n = rnd.normal(-10, 3, (30, 2)), rnd.integers(1, 5, 30).astype(float)
        shares, each = op.proportions(ll, n)
        grid = np.linspace(1e-6, 1 - 1e-6, 2001)
        values = [n @ np.log(np.exp(ll) @ np.array([g, 1 - g])) for g in grid]
        assert n @ each >= max(values) - 1e-2 and abs(grid[int(np.argmax(values))] - shares[0]) < 0.02


def test_one_language_is_enough_unless_another_pays():
    n = np.full(50, 1.0)
    ll = np.stack([np.full(50, -10.0), np.full(50, -10.05)], axis=1)
    assert op.select(ll, n)[0] == [0]
    ll[:25, 1], ll[25:, 1] = -4.0, -14.0
    chosen, shares = op.select(ll, n)
    assert sorted(chosen) == [0, 1] and abs(shares.sum() - 1) < 1e-9


def test_model_is_a_distribution():
    grams = collections.Counter(g for w in ("abba", "abb", "ba") for g in op.grams_of(w))
    m = op.fitted(["x"], {("x", g): n for g, n in grams.items()})
    seen = {g[-1] for g in grams}
    for context in ("\x02\x02", "ab", "zz"):
        total = sum(np.exp(m.logs[m.row(context + c)][0]) for c in seen)
        other = (op.ALPHABET - len(seen)) * np.exp(m.logs[m.row(context + "?")][0])
        assert total + other > 0.98
