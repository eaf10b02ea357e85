import math
import random
from collections import Counter

import numpy as np
import zstandard

from lambertlake.llm import near_dedup as nd


def all_links(sets):
    """All pairs of sets of similarity 0.8 or more, exactly.

    Of a set's shingles, rarest first, one of the first n - ceil(0.8 n) + 1 must be among those of its partner.
    """
    often = Counter(x for s in sets for x in s)
    index, out = {}, []
    for k, s in enumerate(sets):
        first = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(0.8 * len(s)) + 1]
        for other in {o for x in first for o in index.get(x, ())}:
            both = len(s & sets[other])
            if both >= 0.8 * (len(s) + len(sets[other]) - both):
                out.append((other, k))
        for x in first:
            index.setdefault(x, []).append(k)
    return out


def brute(rows):
    """Smallest doc_id of each row's component, over all pairs of texts and all texts of a doc_id."""
    texts = {t or "": None for i, t in rows if i is not None}
    sets = [nd._shingles(t) for t in texts]
    number = {t: k for k, t in enumerate(texts)}
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    links, of = all_links(sets), {}
    for i, t in rows:
        if i is not None:
            links.append((number[t or ""], of.setdefault(i, number[t or ""])))
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    least = {}
    for i, t in rows:
        if i is not None:
            least[root(number[t or ""])] = min(i, least.get(root(number[t or ""]), i))
    return {i: least[root(number[t or ""])] for i, t in rows if i is not None}


def made(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    rows, base = [], [rng.choice(words) for _ in range(200)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:  # a large group of near copies around the threshold
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(200)] = rng.choice(words)
        elif kind < 0.6:
            own = rows[rng.randrange(len(rows))][1].split() if rows else base
        else:
            own = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(own)))
    return rows


def test_classes_are_those_of_all_pairs(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    got = nd.classes(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_rows_of_one_document_with_different_texts(spark):
    # The texts of 5 are near those of 1 and of 2; 8 has an exact copy of 3 and a text of its own.
    words = [[f"{a}{k}" for k in range(60)] for a in "abcd"]
    near = lambda k: " ".join([*words[k][:-1], "other"])
    rows = [(1, " ".join(words[0])), (2, " ".join(words[1])), (5, near(0)), (5, near(1)), (3, " ".join(words[2])), (8, " ".join(words[2])), (8, "x"), (9, "y"), (None, near(2)), (None, "x")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, 1, "x") for r in order], "doc_id long, text string, rep int, label string").repartition(3)
        got = {(r.doc_id, r.class_id) for r in nd.classes(df).collect()}
        assert got == {(1, 1), (2, 1), (5, 1), (3, 3), (8, 3), (9, 9), (None, None)}
    rng = random.Random(4)
    rows = [(rng.randrange(60), t) for _, t in made(150, 9)]
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 150 and {r.doc_id: r.class_id for r in got} == brute(rows)


def test_repeated_shingles(spark):
    # The same sentences, some of them many times in one of the two texts: the sets are alike.
    rng = random.Random(6)
    rows = []
    for i in range(40):
        lines = [" ".join(f"w{rng.randrange(9000)}" for _ in range(12)) + " end of it now." for _ in range(12)]
        rows.append((2 * i, " ".join(lines)))
        rows.append((2 * i + 1, " ".join(lines + [lines[rng.randrange(12)]] * rng.choice([1, 8, 50]))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(rows)
    assert sum(wanted[2 * i + 1] == 2 * i for i in range(40)) > 30
    for weighted in (True, False):
        assert {r.doc_id: r.class_id for r in nd.classes(df, weighted=weighted).collect()} == wanted


def test_passages_repeated_up_to_two_hundred_times(spark):
    # A quarter of one text once more, 1 to 200 times: the sets stay alike, the weights don't.
    rng = random.Random(11)
    rows = []
    for i in range(80):
        words = [f"w{rng.randrange(9000)}" for _ in range(200)]
        start = rng.randrange(150)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + words[start : start + 50] * [1, 10, 50, 200][i % 4]))]
    wanted = brute(rows)
    assert all(wanted[2 * i + 1] == 2 * i for i in range(80))
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == wanted


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(3))
    agree, wanted = [], []
    for t in range(30):
        x, y = np.concatenate([shared, a[: 10 * t]]), np.concatenate([shared, b[: 10 * t]])
        wx, wy = rng.integers(1, 5, len(x)).astype(float), rng.integers(1, 5, len(y)).astype(float)
        values = nd.prob_min_hash(np.concatenate([x, y]) + np.uint64(t), np.concatenate([wx, wy]), np.repeat([0, 1], [len(x), len(y)]), 2)
        agree.append((values[0] == values[1]).mean())
        u, v = np.r_[wx, np.zeros(10 * t)], np.r_[wy[:300], np.zeros(10 * t), wy[300:]]
        wanted.append(sum(1 / np.maximum(u / u[d], v / v[d]).sum() for d in range(300)))
    assert abs(np.mean(agree) - np.mean(wanted)) < 0.015
    assert np.abs(np.array(agree) - wanted).max() < 0.17


def test_chance_agreement_of_bytes_hides_no_pair(spark):
    # Band 0 agrees in the bytes kept, but its keys differ: the pair's first bucket is that of band 3, or of band 1.
    pack = zstandard.ZstdCompressor().compress
    words = [f"w{k}" for k in range(100)]
    texts = {1: words, 2: [*words[:-1], "other"]}
    packed = spark.createDataFrame([(i, bytearray(pack(" ".join(t).encode()))) for i, t in texts.items()], "rep long, packed binary")
    labels = spark.createDataFrame([(1, 1), (2, 2)], "node long, label long")
    for same, found in (([3], [3]), ([1, 3], [1])):
        bands = {i: [7 + b if b in same else 100 * i + b for b in range(nd.BANDS) for _ in range(2)] for i in texts}
        nodes = spark.createDataFrame([(i, b, bytearray(2 * nd.REGISTERS)) for i, b in bands.items()], "rep long, bands array<long>, registers binary")
        for band in same:
            members = spark.createDataFrame([(7 + band, band, i) for i in texts], "key long, band int, rep long")
            got = {tuple(sorted(r)) for r in nd._rest(members, labels, nodes, packed, 0.8).collect()}
            assert got == ({(1, 2)} if band in found else set())


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, "  "), (8, "one two"), (9, "one two"), (9, "one two"), (10, "one  two"), (11, "two one"), (None, "one two"), (3, "x " * 50000), (2, "x " * 49000)]
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == [
        (2, 2), (3, 2), (5, 5), (6, 5), (7, 7), (8, 8), (9, 8), (9, 8), (10, 8), (11, 11)
    ]
    assert nd.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in nd.op8_near_dedup(spark, sf).collect()} == brute(rows)


def test_every_class_of_ten_thousand_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in nd.op8_near_dedup(spark, sf).collect()}
    wanted = brute(rows)
    linked = [i for i, c in wanted.items() if i != c]
    assert len(linked) > 500 and sum(got[i] == wanted[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == i for i, c in wanted.items() if got[i] != c)  # none too many
