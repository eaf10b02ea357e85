import collections
import hashlib
import random

import duckdb
import pytest

from lambertlake.llm import mixing


def fill(budget, children):
    """Naive: hand out by weight, take back what is too much, again among the rest."""
    out, left = {}, dict(children)
    while left:
        weight = sum(w for _, w in left.values())
        used = sum(out.values())
        full = [n for n, (cap, w) in left.items() if cap <= w * (budget - used) // weight]
        if not full:
            return out | {n: w * (budget - used) // weight for n, (cap, w) in left.items()}
        first = min(full, key=lambda n: (left[n][0] / left[n][1], n))
        out[first] = left.pop(first)[0]
    return out


def brute(rows, share, epochs, seed=mixing.SEED):
    weight = lambda level, n: mixing.WEIGHTS[level].get(n, mixing.WEIGHTS[level]["other"])
    tokens = collections.Counter()
    for _, d, lang, s, n in rows:
        tokens[d, lang, s] += n
    tokens = {k: n for k, n in tokens.items() if n}
    cap = lambda *k: sum(n * epochs for x, n in tokens.items() if x[: len(k)] == k)
    budgets = {}
    top = fill(sum(tokens.values()) * share[0] // share[1], {d: (cap(d), weight("domain", d)) for d in {k[0] for k in tokens}})
    for d, b in top.items():
        for lang, c in fill(b, {x: (cap(d, x), weight("lang", x)) for x in {k[1] for k in tokens if k[0] == d}}).items():
            own = {k[2] for k in tokens if k[:2] == (d, lang)}
            for s, e in fill(c, {x: (cap(d, lang, x), weight("source", x)) for x in own}).items():
                budgets[d, lang, s] = e
    out = []
    for leaf, b in budgets.items():
        whole, rest = divmod(b, tokens[leaf])
        own = [r for r in rows if r[1:4] == leaf]
        key = lambda r: (hashlib.md5(f"{seed}:{whole}:{r[0]}".encode()).hexdigest(), r[4])
        at = 0
        for r in sorted(own, key=key):
            at += r[4]
            out += [(*r, e) for e in range(whole + (at <= rest))]
    return sorted(out)


@pytest.mark.parametrize("share,epochs", [((9, 10), 2), ((3, 1), 2), ((1, 100), 1), ((2, 1), 4)])
def test_is_the_naive_mix(spark, share, epochs):
    rng = random.Random(epochs)
    rows = []
    for i in range(400):
        hot = rng.random() < 0.4
        rows.append((i, "d0" if hot else rng.choice(["d0", "d1", "d2", "x"]), "en" if hot else rng.choice(["en", "de", "xx"]), "s" if hot else f"s{rng.randrange(4)}", rng.choice([0, 1, 5, 40, 300])))
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, domain string, lang string, source string, n_tokens long, epoch string")
    got = sorted(tuple(r) for r in mixing.mix(df, share, epochs).collect())
    assert got == brute(rows, share, epochs)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "a b"), (1, None, None, "a b"), (None, "en", "x1", None), (3, "en", "x1", "")], "doc_id long, lang string, source string, text string")
    got = mixing.mix(mixing.measured(df), (1, 1), 1).collect()
    assert [(r.doc_id, r.domain, r.lang, r.source, r.n_tokens, r.epoch) for r in got] == [(1, "other", "", "", 2, 0)] * 2
    assert mixing.mix(mixing.measured(df.limit(0))).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = mixing.op3_mixing(spark, sf)
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(f"SELECT {columns} FROM ({mixing.OP3_SQL})").fetchall())


def test_rows_alike(spark):
    rows = [(7, "d0", "en", "s", 3)] * 5000 + [(None, "d0", "en", "s", 2)] * 700 + [(i, "d0", "en", "s", 5) for i in range(40)] + [(9, "d1", "de", "t", 0)] * 3 + [(8, "d1", "de", "t", 4)] * 2
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    named = [("" if r[0] is None else str(r[0]), *r[1:]) for r in rows]
    for share in ((1, 3), (9, 10), (3, 2)):
        got = sorted(("" if r.doc_id is None else str(r.doc_id), *tuple(r)[1:]) for r in mixing.mix(df, share).collect())
        assert got == brute(named, share, 2)
