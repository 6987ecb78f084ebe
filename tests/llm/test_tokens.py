import hashlib
import random

import numpy as np
import pytest
import tiktoken

from lodeseek.llm import op1_bpe
from lodeseek.llm.tokens import NEWER, Memo, PerfectHash, codec, decoder, read_ranks


@pytest.fixture(scope="module")
def tools():
    voc, pattern = op1_bpe.vocabulary()
    c = codec(read_ranks(voc), pattern)
    c.decode = decoder(read_ranks(voc))
    return c, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})


def ids(c, text):
    return np.frombuffer(c.encode(text), "<i4").tolist()


def test_perfect_hash():
    keys = [b"", *(str(i).encode() for i in range(500))]
    h = PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(501))
    assert h.slot(b"no such key") == -1
    assert PerfectHash([]).slot(b"a") == -1


def test_same_ids_as_tiktoken(tools):
    c, t = tools
    rng = random.Random(5)
    alphabet = " \n\t\r\x0b\x85  \x1c'aAz09é漢٣!?.,-sŚ😀​"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 15))) for _ in range(4000)]
    texts += ["", " ", "\n\n", "a" * 5000, " " * 3000, "<|endoftext|>", "it's  we'll\n x"]
    for x in texts:
        assert ids(c, x) == t.encode_ordinary(x), repr(x)
        assert c.decode(np.array(ids(c, x), np.int32)) == x.encode()


def test_same_ids_over_all_of_unicode(tools):
    c, t = tools
    rng = random.Random(9)
    newer = [chr(int(x, 16)) for part in NEWER.split() for x in part.split("-")]
    anything = lambda: chr(rng.choice((rng.randrange(0xD800), rng.randrange(0xE000, 0x110000))))
    texts = ["\U0001094d's", "\U00018fb4't"]
    texts += ["".join(rng.choice((anything, lambda: rng.choice(newer), lambda: rng.choice("a's't \n.A9  \t")))() for _ in range(rng.randrange(10))) for _ in range(20000)]
    for x in texts:
        assert ids(c, x) == t.encode_ordinary(x), repr(x)


def test_lines_and_long_texts(tools):
    c, t = tools
    rng = random.Random(2)
    for x in ["a\nb", "one two\nthree. Four\n5", "a\tb\nc d", "\nx", "x\n", "a\r\nb", "word " * 60000 + "end", "\n".join(["ab cd"] * 20000), "".join(rng.choices("ab \n", k=5000))]:
        assert ids(c, x) == t.encode_ordinary(x), repr(x[:50])


def test_decoding_refuses_other_ids(spark, tools):
    c, _ = tools
    for bad in ([-1], [10**6], [0, -5]):
        with pytest.raises(ValueError):
            c.decode(np.array(bad, np.int32))
    voc, _ = op1_bpe.vocabulary()
    ok = op1_bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "k long, ids array<int>"), voc).collect()
    assert sorted((r.k, bytes(r.decoded)) for r in ok) == [(1, b""), (2, b""), (3, b"!\"")]
    for bad in ([None], [-1], [10**6]):
        with pytest.raises(Exception, match="an id is"):
            op1_bpe.decode(spark.createDataFrame([(bad,)], "ids array<int>"), voc).collect()


def test_memo_is_bounded_and_right():
    m = Memo(lambda k: k.upper().encode(), entries=3)
    for k in "abcdefgabc":
        assert m(k) == k.upper().encode()
    assert m.all(["a", "z", "a"]) == [b"A", b"Z", b"A"]
    assert len(m.young) <= 3 and len(m.old) <= 3


def test_op1_on_whole_table(spark, sf_dir, tools):
    _, t = tools
    got = {r.doc_id: r for r in op1_bpe.query(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = t.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_op1_edges(spark):
    voc, pattern = op1_bpe.vocabulary()
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "hi there", None)], "doc_id long, text string, ids string")
    out = op1_bpe.decode(op1_bpe.encode(df, voc, pattern), voc)
    assert sorted(map(str, out.collect())) == sorted(map(str, op1_bpe.round_trip(df, voc, pattern).collect()))
    rows = sorted((r.doc_id, len(r.ids), bytes(r.decoded)) for r in out.collect())
    assert rows == [(1, 0, b""), (2, 0, b""), (2, 0, b""), (3, 2, b"hi there")]
    assert op1_bpe.encode(df.limit(0), voc, pattern).count() == 0
