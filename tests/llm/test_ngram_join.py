import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lambertlake.llm import ngram_join as nj
from tests.llm.test_near_dedup import all_links

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """doc_id, size, component over all pairs of sets."""
    sets = [shingle_set(t) for _, t in rows]
    nodes = list({s: None for s, (i, _) in zip(sets, rows) if s and i is not None})
    number = {s: k for k, s in enumerate(nodes)}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in all_links(nodes):
        up[root(a)] = root(b)
    for s, (i, _) in zip(sets, rows):
        if i is not None:
            up[root(("doc", i))] = root(number[s]) if s else root(("doc", i))
    least = {}
    for i, _ in rows:
        if i is not None:
            least[root(("doc", i))] = min(i, least.get(root(("doc", i)), i))
    return sorted(((i, len(s), None if i is None else least[root(("doc", i))]) for s, (i, _) in zip(sets, rows)), key=str)


def joined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, key string").repartition(parts)
    return sorted(map(tuple, nj.join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@given(st.lists(st.text(st.sampled_from("aAbB\u00e4 \t\n\x0b\x0c\r\x1c\u00a0\u2003")), max_size=5), st.integers(1, 40))
def test_hashes_are_of_the_words(texts, piece):
    texts = [t.encode() for t in texts]
    was, nj.PIECE = nj.PIECE, piece
    nj._powers.cache_clear()
    try:
        got = nj.hashed(texts)
    finally:
        nj.PIECE = was
        nj._powers.cache_clear()
    sets = [nj.shingles(nj.words(t)) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in sets]
    for a, x in zip(got, sets):
        for b, y in zip(got, sets):
            assert len(np.intersect1d(a, b)) == len(x & y)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.data())
def test_sets_that_link_share_a_key(size, data):
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    a = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
    # The most that two sets may differ in, removed from one and added to the other in any share.
    gone = rng.randint(0, max(0, size - -(-4 * size // 5)))
    more = 0
    while 100 * (size - gone) >= 80 * (size + more + 1) and rng.random() < 0.97:
        more += 1
    b = np.unique(np.concatenate([np.array(rng.sample(a.tolist(), size - gone), np.uint64), np.array([rng.getrandbits(64) for _ in range(more)], np.uint64)]))
    signer = nj.Signer()
    for _ in range(rng.randint(0, 3)):  # what was met before changes what is dropped
        signer.sign([a])
    if np.array_equal(a, b):
        return
    keys, owner, _ = signer.sign([a, b])
    assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1), st.sets(st.integers(0, 2**64 - 1), min_size=1))
def test_bitmaps_never_rule_out_a_link(a, b):
    b = b | set(sorted(a)[: len(a) * 9 // 10])
    maps = [np.packbits(np.bincount(np.array([x % nj.BITS for x in s]), minlength=nj.BITS).astype(np.uint8) & 1).view(np.uint64) for s in (a, b)]
    if nj.linked(a, b):
        assert nj.near(np.int64(len(a)), np.int64(len(b)), *maps)


@given(st.sets(st.integers(0, 2**64 - 1)))
def test_finer_bitmaps_fold_to_coarser_ones(own):
    own = np.array(sorted(own), np.uint64)
    for bits in (nj.BITS, 2 * nj.BITS, 8 * nj.BITS):
        assert (nj.folded(nj.parity(own, bits), nj.BITS // 64) == nj.parity(own)).all()
    assert [len(nj.fine(np.arange(n, dtype=np.uint64))) * 64 // nj.BITS for n in (1, 512, 513, 1024, 1025, 4096, 4097)] == [1, 1, 2, 2, 4, 8, 16]


def made(seed, n=150, length=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, length))] for _ in range(6)]
    passage = [rng.choice(vocabulary) for _ in range(20)]
    rows = []
    for i in range(n):
        kind = rng.random()
        own = list(rng.choice(base)) if kind < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        if kind < 0.55:
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        own += passage if rng.random() < 0.3 else []
        text = rng.choice([" ", "  ", "\t", "\x0b\n"]).join(own)
        rows.append((rng.randrange(n) if rng.random() < 0.95 else None, rng.choice([text, text.upper(), text]) if rng.random() < 0.97 else None))
    return rows + rows[:10]


@pytest.mark.parametrize("seed,length", [(1, 60), (2, 10)])
def test_components_are_those_of_all_pairs(spark, seed, length):
    rows = made(seed, length=length)
    assert joined(spark, rows) == brute(rows)


def test_chains_whose_pivots_do_not_link(spark):
    rng = random.Random(8)
    own, rows = [f"u{k}" for k in range(120)], []
    for i in range(24):  # each text links with its neighbours only
        for _ in range(2):
            own[rng.randrange(120)] = f"v{rng.random()}"
        rows.append((i, " ".join(own)))
    rng.shuffle(rows)
    assert joined(spark, rows) == brute(rows)


def test_hot_keys_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "FEW", 2)
    monkeypatch.setattr(nj, "MANY", 3)
    rows = made(6, 120)
    assert joined(spark, rows, 1) == brute(rows)
    rng = random.Random(9)
    base = [f"u{k}" for k in range(80)]
    rows = []
    for i in range(400):  # one group that takes all of a task's sets
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(80)] = rng.choice(base)
        rows.append((i, " ".join(own)))
    assert joined(spark, rows, 2) == brute(rows)


def test_empty_null_long_and_short(spark):
    rows = [(1, ""), (2, None), (3, " \t"), (4, "a b"), (5, "A  B"), (6, "a b c"), (None, "a b"), (7, "x" * 200_000), (8, " ".join(f"q{k}" for k in range(30_000)))]
    rows += [(9, rows[-1][1] + " end")]
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, []) == []


def test_whole_table(spark):
    got = nj.op12_ngram_join(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == want
    assert sum(i != c for i, _, c in want) > 20
