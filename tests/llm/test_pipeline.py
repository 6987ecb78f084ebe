import collections

import tiktoken

import corpus_pipeline as cp
from lodeseek.llm import op1_bpe, op8_mixing, op9_quality_rules
from lodeseek.llm.op5_pii import base_spans
from lodeseek.llm.tokens import codec, read_ranks
from test_neighbours import brute_simhash


def test_stages_against_brute_force(spark, sf_dir, tmp_path, duck):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = docs.collect()
    assert all(set(at[n][0].asDict()) == set(cp.COLUMNS) for n in list(at)[:-1])
    good = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({op9_quality_rules.SQL}) WHERE kept").fetchall()}
    assert {r.doc_id for r in at["quality_rules"]} == good
    first = {i for i, _, c in brute_simhash([(r.doc_id, r.text) for r in at["quality_rules"]]) if i == c}
    assert sorted(r.doc_id for r in at["simhash_dedup"]) == sorted(first)
    assert {r.doc_id for r in at["pii"]} == first
    assert not any(base_spans(r.text) for r in at["pii"])
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in at["pii"]]))
    sql = op8_mixing.SQL.replace(f"* {op8_mixing.BUDGET_PERCENT})", f"* {cp.MIX_PERCENT})")
    want = collections.Counter({i: e + t for i, e, t in con.execute(f"SELECT doc_id, epochs, in_tail::INT FROM ({sql})").fetchall()})
    assert collections.Counter(r.doc_id for r in at["mixing"]) == want
    voc, pattern = op1_bpe.vocabulary()
    tok = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec(read_ranks(voc), pattern).ranks, special_tokens={})
    text = {r.doc_id: r.text for r in at["mixing"]}
    assert len(at["bpe"]) == len(at["mixing"])
    for r in at["bpe"]:
        assert r.ids == tok.encode_ordinary(text[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids)


ODD = [
    (1, None, "en", "s", 0), (2, "", None, None, None), (None, "a b " * 60, "x", "y", 1), (3, "w " * 5, "en", "s1", 2),
    (4, " ".join(f"word{i}" for i in range(60)), "en", "src1", 5), (4, " ".join(f"other{i}" for i in range(60)), "en", "src1", 5),
    (5, " ".join(f"word{i}" for i in range(60)), "de", "src2", 5), (None, " ".join(f"third{i}" for i in range(70)), "de", None, 5), (None, " ".join(f"third{i}" for i in range(70)), "de", None, 5),
    (6, " ".join(f"mail a{i}.b@c.de" for i in range(20000)), "en", "src3", 1),
]


def test_stages_on_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", docs_extra())
    stage = dict(cp.STAGES)
    ids = lambda df: collections.Counter(r.doc_id for r in df.collect())
    assert ids(stage["quality_rules"](spark, docs, sf_dir)) == {4: 2, 5: 1, None: 2, 6: 1}
    # copies go, texts that only share an id stay, of rows without an id one stays
    assert ids(stage["simhash_dedup"](spark, docs, sf_dir)) == {1: 1, None: 2, 3: 1, 4: 2, 6: 1}
    found = stage["pii"](spark, docs, sf_dir)
    assert ids(found) == ids(docs) and not any("@" in (r.text or "") for r in found.collect())
    mixed = ids(stage["mixing"](spark, docs, sf_dir))
    assert mixed[None] == 3 and mixed[4] % 2 == 0  # rows of one id are read together
    coded = stage["bpe"](spark, docs, sf_dir).collect()
    assert len(coded) == len(ODD) and all(r.round_trip for r in coded)
    for _, f in cp.STAGES:
        assert f(spark, docs.limit(0), sf_dir).count() == 0


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")
