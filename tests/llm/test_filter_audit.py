import random
import re
from itertools import permutations

import duckdb
import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from lambertlake.llm import filter_audit as fa

SF = "/root/testdata/sf0.01"


@given(st.lists(st.sets(st.integers(0, 60)), min_size=1, max_size=7))
def test_regions_count_every_id_once(sets):
    want = np.zeros(1 << len(sets), int)
    for x in set().union(*sets):
        want[sum(1 << k for k, s in enumerate(sets) if x in s)] += 1
    assert fa.regions([np.array(sorted(s), int) for s in sets]).tolist() == want.tolist()


@given(st.lists(st.integers(0, 200), min_size=1).map(sorted), st.integers(0, 220), st.data())
def test_galloping_finds_the_first_beyond(ids, limit, data):
    at = data.draw(st.integers(0, len(ids) - 1))
    want = next((k for k in range(at, len(ids)) if ids[k] >= limit), len(ids))
    assert fa.beyond(np.array(ids), at, limit) == want


def brute(rows, labels):
    """The audit, order by order and document by document."""
    docs = [(i, t or "", p or "") for i, t, p in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        checks = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), bool(set(t) & set("#$%&*|")), smaller]
        return {f for f, x in zip("ABCDE", checks) if x}

    failed = [(i, p, fails(i, t)) for i, t, p in docs]
    out = {}
    for part in {p for _, _, p in docs}:
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in failed if p == part]
            own = [(i, f) for i, p, f in failed if p == part]
            for k, name in enumerate(order):
                go = [i for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                total[name] += len(go)
                out[part, "".join(order), k + 1] = [len(left), len(go), sum(name in f for _, f in own) - len(go), sum(f == {name} for _, f in own), sum(i in good for i in go), sum(i in bad for i in go)]
        for key, row in out.items():
            if key[0] == part:
                row.append(total[key[1][key[2] - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, row int, part string")
    known = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, list string")
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in fa.audit(docs, known).collect()}


def made(seed, n=80):
    rng = random.Random(seed)
    long = " ".join(f"w{k}" for k in range(250))
    texts = ["", None, long, long + " #", "A b c", "x " * 300, "B" * 40 + " " + "y " * 150, long.upper(), "a|b", " \t\n\x0b\x0c\r", " é " * 210, "c d e f"]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(n)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    return rows, labels


def test_audit_is_that_of_every_order(spark):
    rows, labels = made(4)
    rows += rows[:9]  # repeated rows count again
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_one_part_in_many_ranges_and_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows, labels = made(5, 200)
        rows = [(i, t, "en") for i, t, _ in rows]
        assert audited(spark, rows, labels) == brute(rows, labels)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents_that_pass_and_empty_tables(spark):
    good = " ".join(f"w{k}" for k in range(250))
    got = audited(spark, [(1, good, "en")], [])
    assert len(got) == 600 and all(r == [1, 0, 0, 0, 0, 0, 0] for r in got.values())
    assert audited(spark, [], [(1, 1, 1)]) == {}


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(fa.OP11_SQL)
    got = fa.op11_filter_audit(spark, SF)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
