import random
import re

import duckdb
import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from lambertlake.llm import divergence as dv

SF = "/root/testdata/sf0.01"
PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_terms_are_those_of_the_pattern(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert [t.decode() for t in dv.terms(text.encode())] == PATTERN.findall(lowered)


@given(st.integers(0, 9 * 10**12), st.integers(0, 9 * 10**12))
def test_share_is_exact(count, more):
    total = count + more + 5
    assert int(dv.share(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 5) // total


def brute(rows, least, top):
    docs = [(lang or "", source or "", PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for lang, source, t in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        vocabulary = {t for _, _, w in own for t in w}
        kept = [t for t in vocabulary if sum(t in w for _, _, w in own) >= least]
        sources = {s for _, s, _ in own}
        count = {s: {t: sum(w.count(t) for _, x, w in own if x == s) for t in kept} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in count.items()}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            own_terms = sorted((p[None][t] - p[s][t], t.encode(), t) for t in kept if count[s][t] > 0 and p[s][t] > p[None][t])[:top]
            for part, found in (("pair", pairs), ("term", own_terms)):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


def made(seed, n=150, sources=6):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzäß𝔸é"]
    rows = []
    for _ in range(n):
        source = rng.choice([None, "", *(f"s{k}" for k in range(sources))])
        # Few different counts, so that terms tie in every respect but their names.
        text = " ".join(rng.choice(words[: 10 + 8 * (len(source or "") % 3)]) for _ in range(rng.randint(0, 12)))
        rows.append((rng.choice([None, "", "en", "de"]), source, rng.choice([text, text.upper(), text + "1,2;" + text])))
    return rows + rows[:20]


def found(spark, rows, least=3, top=5):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, source string, text string, term string, count int, slot int")
    got = [tuple(r) for r in dv.divergence(df, least, top).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def test_ranks_are_those_of_all_terms_and_pairs(spark):
    rows = made(1)
    assert found(spark, rows) == brute(rows, 3, 5)


def test_small_batches_and_tables_of_few_cells(spark, monkeypatch):
    rows = made(2, 100)
    monkeypatch.setattr(dv, "HELD", 5)
    monkeypatch.setattr(dv, "CELLS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(spark, rows, 2, 3) == brute(rows, 2, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing_kept_single_source_and_empty(spark):
    rows = [("en", "a", "x y"), ("en", "b", None), ("fr", "a", "z z z")]
    assert found(spark, rows, 30) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert found(spark, [("fr", "a", "z z z")], 1) == brute([("fr", "a", "z z z")], 1, 5)
    assert found(spark, []) == set()


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(dv.OP13_SQL)
    got = dv.op13_divergence(spark, SF)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
