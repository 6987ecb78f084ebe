import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeseek.llm import op3_token_files as op3
from lodeseek.session import fresh_folder


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(values):
    values.sort()
    e = op3.EliasFano.load(op3.EliasFano.build(np.array(values, dtype=np.uint64)).dump())
    assert e.values().tolist() == values
    for i in range(0, len(values), 7):
        assert e.select(i) == values[i]


def test_elias_fano_is_small():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 100_000))
    assert len(op3.EliasFano.build(v).dump()) * 8 / len(v) < 2.6 + np.log2((1 << 30) / len(v))


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_str(op3.tokenizer_spec())


def test_pieces_same_ids(tok):
    rng = random.Random(2)
    p = op3.HuggingPieces(op3.tokenizer_spec(), "<u2")
    al = " \n\t  \x1c'aAz09é漢٣!?.,-sŚİΣ😀​̀é"
    texts = ["".join(rng.choices(al, k=rng.randint(0, 20))) for _ in range(2000)] + ["<|endoftext|> a", "it's <|endoftext|>x"]
    for t, b in zip(texts, p.encode(texts)):
        assert np.frombuffer(b, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_op3_on_whole_table(spark, sf_dir, tok):
    got = {r.doc_id: r for r in op3.query(spark, sf_dir).collect()}
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(docs)
    base = 0
    for d in docs:
        ids = [*tok.encode(d.text, add_special_tokens=False).ids, 2]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        base += len(ids)


def test_op3_edges(spark, tok):
    df = spark.createDataFrame([(5, "b c"), (5, "b c"), (None, "a"), (-3, None), (2, "")], "doc_id long, text string")
    folder = fresh_folder(spark, "t")
    man = op3.write(df, op3.tokenizer_spec(), folder)
    rows = sorted(op3.read(spark, folder, man, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -3, 2, 5, 5]
    assert [r.n_tokens for r in rows] == [2, 1, 1, 3, 3]
    assert rows[3].ids == [*tok.encode("b c", add_special_tokens=False).ids, 2]
    f = op3.TokenFile(op3.qualified(spark, folder), man[-1]["name"])
    assert f.document(len(f) - 1).tolist() == rows[-1].ids and f.key(len(f) - 1) == 5
    assert op3.read(spark, folder, op3.write(df.limit(0), op3.tokenizer_spec(), folder)).count() == 0


def test_special_tokens_in_capitals_are_none(tok):
    h = op3.HuggingPieces(tok.to_str(), "<u4")
    texts = ["<|ENDOFTEXT|>'s", "A <|EndOfText|>\u4e2d B", "<|EndOfText|> It's <|endoftext|>x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in h.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_op3_long_text_repeats_and_clashes(spark, tok):
    long = "one two\nthree, " * 60000
    df = spark.createDataFrame([(1, long, "a", 1)] + [(7, "same text", "b", 2)] * 500, "doc_id long, text string, k string, place int").repartition(7)
    folder = fresh_folder(spark, "t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        man = op3.write(df, op3.tokenizer_spec(), folder)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(man) > 1 and sum(m["n_docs"] for m in man) == 501  # rows of one id and text are split
    rows = sorted(op3.read(spark, folder, man, with_ids=True).collect(), key=lambda r: r.start)
    assert rows[0].ids == [*tok.encode(long, add_special_tokens=False).ids, 2]
    same = [*tok.encode("same text", add_special_tokens=False).ids, 2]
    assert all(r.ids == same for r in rows[1:]) and rows[-1].start == rows[0].n_tokens + 499 * len(same)
    store, path = op3.filesystem(op3.qualified(spark, folder))
    with store.open_output_stream(f"{path}/other") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        op3.TokenFile(op3.qualified(spark, folder), "other")


def test_folders_have_a_store(spark, tmp_path):
    assert op3.qualified(spark, str(tmp_path)) == op3.qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"
