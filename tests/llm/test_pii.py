import contextlib
import random
import re
import sys

import numpy as np
import pytest

from lodeseek.llm import op5_pii as op5
from lodeseek.llm import tagger


def plain_base(text):
    """The patterns as they are written."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@contextlib.contextmanager
def digits_unbounded():
    before = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        yield
    finally:
        sys.set_int_max_str_digits(before)


def test_base_spans():
    rng = random.Random(4)
    for _ in range(20000):
        t = "".join(rng.choices("a.b@-c0123 (+)é\n", k=rng.randint(0, 40)))
        assert op5.base_spans(t) == plain_base(t), repr(t)
    with digits_unbounded():
        for t in ("0" * 5000 + ".1.1.1", "1.1.1." + "0" * 4400 + "7", "1." + "9" * 5000 + ".1.1", "0" * 4400 + "256.1.1.1"):
            assert op5.base_spans(t) == plain_base(t)
    for t in ("0" * 30000, "1." * 20000, "a" * 50000 + "@", "4111 1111 1111 1111 x +1 (555) 010-9999", "x.y@a.b@c.d"):
        assert op5.base_spans(t) == plain_base(t) if len(t) < 100 else op5.base_spans(t) is not None


@pytest.fixture(scope="module")
def model():
    return tagger.trained()


def test_gradients():
    m = tagger.Tagger.fresh(1)
    ids, tags = tagger.labelled(3, 3)
    ids, tags = ids[:, :10], tags[:, :10]
    _, g = m.loss(ids, tags)
    rng = np.random.default_rng(0)
    for k, v in m.p.items():
        i = tuple(int(rng.integers(0, s)) for s in v.shape)
        i = (int(ids[0, 3]), *i[1:]) if k in ("tf", "tb") else i
        v[i] += 1e-5
        a = m.loss(ids, tags)[0]
        v[i] -= 2e-5
        b = m.loss(ids, tags)[0]
        v[i] += 1e-5
        assert abs((a - b) / 2e-5 - g[k][i]) < 1e-5


def test_held_out(model):
    ids, tags = tagger.labelled(99, 300)
    tp = fp = fn = 0
    for a, b in zip(model.decode(ids), tags):
        x, y = set(tagger.spans_of(a)), set(tagger.spans_of(b))
        tp, fp, fn = tp + len(x & y), fp + len(x - y), fn + len(y - x)
    assert tp / (tp + fp) > 0.93 and tp / (tp + fn) > 0.93


#: Written by hand, not by the generator: text, and the personal data in it that the patterns don't see.
PLANTED = [
    ("You can mail jane_smith (at) mail (dot) org now, she answers soon.", "jane_smith (at) mail (dot) org"),
    ("The server 192[.]168[.]10[.]1 is down since Monday.", "192[.]168[.]10[.]1"),
    ("His card 4111.1111.1111.1111 has expired.", "4111.1111.1111.1111"),
    ("Ring (415) 555-2671 before noon, said the clerk.", "(415) 555-2671"),
    ("Please write to alice.w [at] corp-mail [dot] io, thanks", "alice.w [at] corp-mail [dot] io"),
    ("bob AT site DOT net is what the card says", "bob AT site DOT net"),
    ("reach me: mary99 (at) uni.edu", "mary99 (at) uni.edu"),
    ("connection from 10(.)0(.)12(.)254 refused", "10(.)0(.)12(.)254"),
    ("toll free 1-800-555-0199 all day", "1-800-555-0199"),
    ("Bitte rufen Sie 0044 20 7946 0958 an, danke", "0044 20 7946 0958"),
]
CLEAN = [
    "He lives at home, and the dot on the map is the end of it all.",
    "On 2019-05-12 the price was $12.50, 30% less than in 1999; see page 12 of v1.4.5 at 10:30.",
    "look at the door. nothing at all happened at night; the host at table 4 had a dot of paint",
    'token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" and password=abc123',
    "The quick brown fox jumps over the lazy dog. Der schnelle braune Fuchs springt. Le renard brun saute, el zorro salta.",
]


def test_forms_outside_the_generator(model):
    texts = [t for t, _ in PLANTED]
    assert not any(op5.base_spans(t) for t in texts)
    got = op5.added_spans(texts, [[] for _ in texts], model)
    hit = sum(want in [t[a:b] for _, a, b in g] for (t, want), g in zip(PLANTED, got))
    assert hit >= 0.8 * len(PLANTED) and sum(map(len, got)) <= hit + 1
    assert not any(op5.added_spans(CLEAN, [[] for _ in CLEAN], model))


def one_by_one(reader, seq):
    """The best path over a whole text, by the plain recursion over all its places."""
    most, reader.most = reader.most, np.full_like(reader.most, np.inf)
    place, em = reader.unsure([seq])
    reader.most = most
    assert place.tolist() == list(range(len(seq)))
    best, back = em[0].astype(float), []
    for row in em[1:]:
        x = best[:, None] + reader.tr
        back.append(x.argmax(0))
        best = row + x.max(0)
    tags = [int(best.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tagger.spans_of(np.array(tags[::-1]))


def test_whole_texts_by_brute_force(model, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    texts += [" ".join(t for t, _ in PLANTED) * 3, "x", "1", "a@b.cd", "(555) 867-5309", "7" * 900, ""]
    reader = model.reader()
    seqs = [tagger.classes(t) for t in texts]
    together = reader.spans(seqs)
    assert [one_by_one(reader, s) for s in seqs[:-1]] == together[:-1] and together[-1] == []
    # emissions are those of the double-precision model
    ids, _ = tagger.labelled(5, 20)
    em = reader.emissions(ids.T.astype(np.intp), np.full(20, tagger.WINDOW))
    assert np.abs(em.transpose(0, 2, 1) - model.emissions(ids)[0]).max() < 1e-3


def test_reader_takes_few_exponentials(model, monkeypatch):
    """They are what reading costs most: 24 a character (one a cell), where each gate took one too."""
    taken = 0

    def counted(f):
        def run(x, *args, **kwargs):
            nonlocal taken
            taken += np.size(x)
            return f(x, *args, **kwargs)

        return run

    ids = np.random.default_rng(2).integers(0, tagger.N_CLASSES, (tagger.SPAN, 2))
    for name in ("exp", "tanh"):
        monkeypatch.setattr(np, name, counted(getattr(np, name)))
    model.reader().emissions(ids, np.full(2, tagger.SPAN))
    assert 0 < taken <= 2 * tagger.HIDDEN * ids.size


def test_reader_is_close_to_double_precision(model):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, tagger.N_CLASSES, (30, tagger.SPAN))
    lengths = np.sort(rng.integers(1, tagger.SPAN, 30))
    em = model.reader().emissions(ids.T, lengths)
    for k, n in enumerate(lengths):
        assert np.abs(em[:n, :, k] - model.emissions(ids[k : k + 1, :n])[0][:, 0]).max() < 1e-3
    # weights so large that gates are shut or open; short, as such a net is chaotic
    wild = tagger.Tagger({k: v * 9 for k, v in model.p.items()})
    em = wild.reader().emissions(ids[:, :2].T, np.full(30, 2))
    assert np.abs(em.transpose(0, 2, 1) - wild.emissions(ids[:, :2])[0]).max() < 0.05


def test_windows_are_read_in_even_groups(model, monkeypatch):
    seqs = [tagger.classes(t) for t in ["Call (555) 867-5309 now. " * 40, "", "x", *[w for w, _ in PLANTED]]]
    whole = model.reader().spans(seqs)
    monkeypatch.setattr(tagger, "BATCH", 4)
    assert model.reader().spans(seqs) == whole and any(whole)


def test_long_text_is_reconciled(model):
    text = " ".join(["Call (555) 867-5309 now, the thing ended"] * 4000)
    got = op5.added_spans([text], [[]], model)[0]
    want = [(m.start(), m.end()) for m in re.finditer(r"\(555\) 867-5309", text)]
    assert len(set(want) & {(s, e) for k, s, e in got if k == "phone"}) >= 0.9 * len(want)


def test_op5_query(spark, sf_dir):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in base) for k in op5.KINDS]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_op5_edges_and_mask(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "mail a.b@c.de or é +1 (555) 010-9999!"), (3, "mail a.b@c.de or é +1 (555) 010-9999!")], "doc_id long, text string")
    df = df.selectExpr("*", "'old' AS pii_spans")
    found = sorted(((r.doc_id, r.text, len(r.pii_spans)) for r in op5.find(df).collect()), key=str)
    assert [f[2] for f in found] == [0, 0, 2, 2] and found[2][1].startswith("mail a.b@")
    out = sorted(((r.doc_id, r.text, len(r.pii_spans)) for r in op5.mask(df).collect()), key=str)
    assert out == [(1, None, 0), (2, "", 0)] + 2 * [(3, "mail [EMAIL] or é [PHONE]!", 2)]
    assert op5.find(df.limit(0)).count() == 0


def test_op5_added_spans_come_through_the_query(spark, tmp_path):
    rows = [(i, t) for i, (t, _) in enumerate(PLANTED)] + [(100 + i, t) for i, t in enumerate(CLEAN)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op5.query(spark, str(tmp_path)).collect()}
    want = [f"{t.find(w)}:{t.find(w) + len(w)}" for t, w in PLANTED]
    assert sum(want[i] in got[i].spans for i in range(len(PLANTED))) >= 0.8 * len(PLANTED)
    assert not any(got[100 + i].spans for i in range(len(CLEAN)))
