import collections
import random
import re

from lodeseek.llm import op11_divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows, by the definition."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, uses = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(lower))
        uses[lang or "", source or ""].update(terms)
        docs.update((lang or "", t) for t in set(terms))
    out = []
    for lang in {g[0] for g in uses}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= 3]
        sources = [s for x, s in uses if x == lang]
        total = {s: sum(uses[lang, s][t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        for s in sources:
            found = []
            for o in sources:
                if o != s:
                    v = 0
                    for t in kept:
                        p, q = share(uses[lang, s][t], total[s]), share(uses[lang, o][t], total[o])
                        v += (p - q) ** 2 // q
                    found.append(("pair", o, v))
            for t in kept:
                p, q = share(uses[lang, s][t], total[s]), share(sum(uses[lang, o][t] for o in sources), sum(total.values()))
                if uses[lang, s][t] and p > q:
                    found.append(("term", t, (p - q) ** 2 // q))
            for part in ("pair", "term"):
                mine = sorted((-v, i.encode(), i) for k, i, v in found if k == part)
                out += [(lang, s, part, i, -v, r) for r, (v, _, i) in enumerate(mine, 1) if part == "pair" or r <= 200]
    return sorted(out)


def of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query_is_the_sql(spark, sf_dir, duck, same):
    same(op.query(spark, sf_dir), duck, op.SQL)


def odd_rows():
    rnd = random.Random(11)
    words = ["a", "Ab", "abc", "É", "é", "Ünder", "x\x80y", "中文", "中", "it's", "😀", "zz-top", "A_B", "\x00nul"]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(30))), rnd.choice([None, "", "en", "de"]), rnd.choice([None, "s1", "s2", "S1"])) for _ in range(150)]
    many = [(" ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)} " * (i % 4 + 1) for i in range(650) if (i + j) % 3), "many", f"s{j % 2}") for j in range(6)]
    return rows + rows[:20] + many + [(None, "fr", None), ("once", "fr", "s1"), ("ab" * 700_000 + " a", "en", "s2")] * 2


def test_brute_force_nulls_ties_and_odd_texts(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, rank string, n int")
    want = brute(rows)
    assert any(r[5] == 200 for r in want if r[2] == "term")
    assert of(op.audit(df)) == want
    monkeypatch.setattr(op, "SOURCES", 2)  # lists of two sources
    assert of(op.audit(df)) == want


def test_tasks_of_any_cut_give_the_same_leaves(monkeypatch):
    import pyarrow as pa

    def leaves(rows, tasks, **small):
        with monkeypatch.context() as m:
            for k, v in small.items():
                m.setattr(op, k, v)
            batch = lambda r: pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), x)) for x in r], schema=pa.schema([(c, pa.string()) for c in ("text", "lang", "source")]))
            parts = [r for t in range(tasks) for b in op._counted([batch(rows[t::tasks][:50]), batch(rows[t::tasks][50:])]) for r in b.to_pylist()]
            parts.sort(key=lambda r: (r["lang"], r["prefix"]))
            out = []
            for b in op._merged([pa.RecordBatch.from_pylist(parts, schema=pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("leaves", pa.binary())]))]):
                for r in b.to_pylist():
                    assert len(r["terms"]) <= op.BLOCK and r["at"][0] == 0
                    for i, term in enumerate(r["terms"]):
                        out.append((r["lang"], term, sorted((r["sources"][r["of"][k]], r["n"][k]) for k in range(r["at"][i], r["at"][i + 1]))))
            return out

    rows = odd_rows()
    want = leaves(rows, 1)
    assert want == sorted(want) and len(want) > 200
    assert leaves(rows, 5, COUNTED=1, LEAVES=1, PIECE=16, BLOCK=3) == want


def test_no_documents(spark):
    assert op.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_tries_merge_like_counters():
    rnd = random.Random(5)
    word = lambda: bytes(rnd.choice(b"ab\xc3\xff") for _ in range(rnd.randrange(6)))
    tries, want = [op.Trie() for _ in range(3)], collections.Counter()
    for _ in range(2000):
        w, s, n = word(), rnd.choice("xy"), rnd.randrange(1, 5)
        rnd.choice(tries).add(w, {s: n})
        want[w, s] += n
    for t in tries[1:]:
        tries[0].merge(t)
    got = list(tries[0].walk())
    assert [w for w, _ in got] == sorted({w for w, _ in want}) and tries[0].size == len(got)
    assert {(w, s): n for w, leaf in got for s, n in leaf.items()} == want


def test_shares_beyond_longs():
    import numpy as np

    big = 20_000_000_000
    assert op.shares(np.array([big, 0]), np.int64(3 * big)).tolist() == [1 + 10**9 * (big + 1) // (3 * big), 1]
