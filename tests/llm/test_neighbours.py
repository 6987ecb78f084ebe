import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodeseek.llm import op2_simhash as op2
from lodeseek.llm import op6_embedding as op6
from lodeseek.llm.common import connected_components


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 460)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(500, pairs)
    assert got == {x: want[x] for p in pairs for x in p}


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in ["", " \n", "A", "a b", "a b c", "É a\xa0b c d e", "x y z w " * 9, "\x1cq r\x1ds t u", "one two three four five six seven"]:
        assert op2.fingerprint(t) == plain_fingerprint(t), repr(t)


def brute_simhash(rows):
    fp = [plain_fingerprint(t or "") for _, t in rows]
    a = np.array(fp, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    ids = np.array([i for i, _ in rows])
    order = np.argsort(ids, kind="stable")
    rank = roots(len(rows), [(int(x), int(y)) for x, y in zip(*np.nonzero(near[np.ix_(order, order)]))])
    comp = {int(order[k]): int(ids[order[r]]) for k, r in enumerate(rank)}
    return sorted((int(ids[k]), f"{fp[k]:016x}", comp[k]) for k in range(len(rows)))


def test_op2_on_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op2.query(spark, sf_dir).collect()) == brute_simhash(rows)


def test_op2_components_brute(spark, monkeypatch):
    monkeypatch.setattr(op2, "BLOCK", 40)  # so that shards are dealt out
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(25)]
    fp = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(700)}
    fp = sorted(fp)
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    nodes = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "node long, fp long")
    got = {r.node: r.component for r in op2.components(nodes).collect()}
    a = np.array(fp, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    want = roots(len(fp), [(int(x), int(y)) for x, y in zip(*np.nonzero(near))])
    assert [got.get(i, i) for i in range(len(fp))] == want


@pytest.mark.parametrize("kind", ["random", "balls"])
def test_vantage_point_tree(kind):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)]
    a, b = (np.array([rng.getrandbits(64) if kind == "random" else rng.choice(centres) ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for _ in range(n)], np.uint64) for n in (900, 700))
    for leaf in (1, 16, 128):
        assert (op2.linked(a, b, 4, leaf) == (np.bitwise_count(a[:, None] ^ b[None, :]) <= 4)).all()


def test_tables_lose_no_pair():
    rng = random.Random(6)
    for n in (10, 10**6 * 2, 10**9, 10**12):
        masks = op2.tables(n)
        for _ in range(300):
            d = sum(1 << x for x in rng.sample(range(64), 4))
            assert any(d & m == 0 for m in masks)


def test_op2_more_tables(spark, monkeypatch):
    monkeypatch.setattr(op2, "SHARD_ROWS", 0)  # as for many rows
    test_op2_components_brute(spark, monkeypatch)


def test_op2_long_text_and_null_keys(spark):
    long = "word " * 300000 + "end"
    df = spark.createDataFrame([(7, long), (None, long), (8, "a b"), (None, "only here twice")], "doc_id long, text string").withColumn("fp", F.lit(1))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in op2.dedup(df).collect()}
    fp = lambda t: f"{plain_fingerprint(t):016x}"
    assert got == {(7, fp(long)): 7, (None, fp(long)): 7, (8, fp("a b")): 8, (None, fp("only here twice")): None}


def test_op2_first_of_groups(spark):
    same, other = "one two three four five six", "quite another text of some words here"
    rows = [(3, same, "a"), (2, same, "b"), (2, same, "b"), (2, other, "c"), (None, same, "d"), (None, "a lone text without a key at all", "e"), (None, "a lone text without a key at all", "e"), (9, None, "f"), (8, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, FP string").withColumn("tie", F.lit(1))
    got = sorted((str(r.doc_id), r.FP) for r in op2.first_of_groups(df).collect())
    assert got == [("2", "b"), ("2", "c"), ("8", "g"), ("None", "e")]
    assert op2.first_of_groups(df).columns == df.columns
    assert op2.first_of_groups(df.limit(0)).count() == 0
    assert {(r.doc_id, r.component_id) for r in op2.dedup(df.filter("doc_id IN (2, 3)")).collect()} == {(2, 2), (3, 2)}


def test_op2_edges(spark):
    df = spark.createDataFrame([(4, None, "x"), (2, "", "y"), (2, "", "y"), (9, "a b", None)], "doc_id long, text string, fp string")
    got = sorted(tuple(r) for r in op2.dedup(df).collect())
    assert [g[2] for g in got] == [2, 2, 2, 9] and got[0][1] == "0" * 16
    assert op2.dedup(df.limit(0)).count() == 0


def brute_embedding(vecs, ids):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v) for v in vecs]
    n = len(vecs)
    pairs, links = [], [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]):
                a, b = np.array(vecs[i], float), np.array(vecs[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    pairs.append((i, j))
                    links[i] += 1
                    links[j] += 1
    comp = roots(n, pairs)
    return sorted((ids[i], links[i], ids[comp[i]], ids[i] == ids[comp[i]]) for i in range(n))


def test_op6_small(spark, monkeypatch):
    monkeypatch.setattr(op6, "BLOCK", 30)
    r = np.random.default_rng(2)
    base = r.normal(size=(12, 20))
    vecs = [(base[i % 12] + r.normal(size=20) * 0.05).tolist() for i in range(150)] + [base[0].tolist()] * 40
    vecs += [None, [], [0.0] * 20, [float("nan")] * 20, [None] + [1.0] * 19, [1.0, 2.0], [1.0, 2.01], [3.0]]
    rows = list(enumerate(vecs))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(x) for x in op6.dedup(df).collect())
    want = brute_embedding([None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vecs], list(range(len(vecs))))
    assert sum(a != b for a, b in zip(got, want)) <= 0.02 * len(want)
    assert op6.dedup(df.limit(0)).count() == 0


def test_op6_on_whole_table_with_planted_pairs(spark, sf_dir, tmp_path):
    """The table itself holds no pair at 0.9, so near copies of a tenth of its rows are added."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    r, top = np.random.default_rng(8), max(v.vec_id for v in rows) + 1
    more = [(top + k, [float(y) for y in np.array(v.embedding) + r.normal(size=len(v.embedding)) * 0.03 * np.linalg.norm(v.embedding)]) for k, v in enumerate(rows[::10])]
    table = [(v.vec_id, v.embedding) for v in rows] + more
    spark.createDataFrame(table, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    table = [(v.vec_id, v.embedding) for v in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    want = brute_embedding([v for _, v in sorted(table)], [i for i, _ in sorted(table)])
    got = sorted(tuple(v) for v in op6.query(spark, str(tmp_path)).collect())
    assert sum(w[1] for w in want) >= 90
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))


def partners(r, x, n, cosine=0.9):
    z = r.normal(size=(n, len(x)))
    z = op6.even(z - np.outer(z @ x, x))
    return cosine * x + np.sqrt(1 - cosine**2) * z


def shared(f, g):
    return len(np.intersect1d(f, g)) > 0


@pytest.mark.parametrize("dim,n", [(10, 10**4), (10, 10**9), (16, 10**6), (32, 10**5), (64, 10**4), (64, 10**7), (384, 10**5), (768, 10**4)])
def test_filter_recall(dim, n):
    r = np.random.default_rng(0)
    size = op6.codewords(n, dim)
    x = op6.even(r.normal(size=(600, dim)))
    y = np.vstack([partners(r, v, 1) for v in x])
    f, g = op6.filters_of(x, size), op6.filters_of(op6.even(y), size)
    assert np.mean([shared(a, b) for a, b in zip(f, g)]) > 0.98
    assert np.mean([len(a) for a in f]) < 170  # places of a vector
    bits = np.bitwise_count((op6.sketches(x) ^ op6.sketches(op6.even(y))).view(np.uint64)).sum(1)
    assert (bits <= op6.most_bits(0.9)).mean() > 0.99


@pytest.mark.parametrize("dim", [10, 64])
def test_filter_recall_of_weak_directions(dim):
    r = np.random.default_rng(4)
    size = op6.codewords(10**5, dim)
    x = op6.even(r.normal(size=(3000, dim)))
    best = np.max([op6.best_sums(x @ c[0][:, : dim // 2] @ c[1].T, x @ c[0][:, dim // 2 :] @ c[2].T, 1)[:, 0] for c in op6.codes(dim, size)], axis=0)
    for i in np.argsort(best)[:10]:
        own, *others = op6.filters_of(np.vstack([x[i][None], partners(r, x[i], 100)]), size)
        assert np.mean([shared(own, f) for f in others]) > 0.95


@pytest.mark.parametrize("dim", [2, 3, 5, 8, 9, 12, 33, 64, 256, 768])
def test_op6_planted_pairs(spark, dim):
    r = np.random.default_rng(dim)
    x = op6.even(r.normal(size=(300 if dim > 8 else 60, dim)))[:, :dim]
    pairs = np.vstack([partners(r, v if dim % 2 == 0 else np.r_[v, 0.0], 1, c)[:, :dim] for v, c in zip(x[:200], np.linspace(0.9001, 0.999, 200))])
    vecs = np.vstack([x, pairs]).tolist()
    want = brute_embedding(vecs, list(range(len(vecs))))
    assert sum(w[1] for w in want) >= 100
    got = sorted(tuple(v) for v in op6.dedup(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")).collect())
    assert sum(g[1] for g in got) >= (1 if dim <= op6.FEW_DIMS else 0.98) * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert dim > op6.FEW_DIMS or got == want


def test_op6_null_keys_and_clashes(spark):
    rows = [(1, [1.0, 2.0], "a"), (None, [1.0, 2.0], "b"), (1, [1.0, 2.0], "c"), (3, None, "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string").withColumn("node", F.lit("x"))
    got = sorted((tuple(r) for r in op6.dedup(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (3, 0, 3, True), (None, 0, None, True)], key=str)


def test_op6_few_dimensions_and_planted_clusters(spark):
    r = np.random.default_rng(6)
    vecs = [v.tolist() for d, n in ((1, 6), (2, 60), (3, 90), (4, 150), (5, 150), (8, 60)) for v in r.normal(size=(n, d))]
    vecs += [v.tolist() for d in (5, 8) for c in op6.even(r.normal(size=(8, d)))[:, :d] for v in c + r.normal(size=(15, d)) * 0.14]
    vecs += np.eye(8).tolist() + (np.eye(8) + 0.4 * np.roll(np.eye(8), 1, 0)).tolist()
    x = op6.even(r.normal(size=(4000, 64)))
    for i in np.argsort([len(f) for f in op6.filters_of(x, 16)], kind="stable")[:3]:
        vecs += partners(r, x[i], 60, 0.95).tolist()
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    want = brute_embedding(vecs, list(range(len(vecs))))
    assert sum(w[1] for w in want[-180:]) > 1000
    assert sorted(tuple(v) for v in op6.dedup(df).collect()) == want
