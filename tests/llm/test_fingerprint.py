import hashlib
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lambertlake.llm import fingerprint as fp


@settings(max_examples=200, deadline=None)
@given(st.text("ab. \n!é", max_size=80), st.text("ab. \n!é", max_size=80))
def test_trees(a, b):
    x, y = fp.tree(a), fp.tree(b)
    assert fp.parse(fp.spell(x)) == x
    assert sum(s[1] for s in x[2]) == len(a)
    assert fp.spell(x) == plain_spell(plain_tree(a))
    # The root is the hash of its sections' hashes, not of the text.
    assert x[0] == xxhash.xxh3_128_hexdigest(b"".join(h.to_bytes(8, "little") + n.to_bytes(8, "little") for h, n, _ in x[2]))
    assert (fp.spell(x) == fp.spell(y)) == (a == b)
    assert (fp.likeness(x, y) == 1) == (a == b) and 0 <= fp.likeness(x, y) <= 1
    assert fp.likeness(x, y) == pytest.approx(fp.likeness(y, x))


def test_edits_are_located():
    lines = [f"Line {i} says this. And more of it here!" for i in range(60)]
    a = "\n".join(lines)
    b = a.replace("Line 30 says this.", "Line 30 says that.")
    (start, stop), *rest = fp.edits(fp.tree(a), fp.tree(b))
    assert not rest and "Line 30" in a[start:stop] and stop - start < 60
    assert fp.likeness(fp.tree(a), fp.tree(b)) > 0.95


def plain_tree(text):
    """The tree by its definition, read character by character: (hash, length, children) or a leaf (hash, length)."""

    def parent(children, digest):
        packed = b"".join(h.to_bytes(8, "little") + n.to_bytes(8, "little") for h, n, *_ in children)
        return digest(packed), sum(c[1] for c in children), children

    lines = [x for x in re.split(r"(?<=\n)", text) if x]
    sections, open_ = [], []
    for line in lines:
        pieces, piece, ended = [], "", False
        for c in line:
            starts = c not in ".!?" and (ended and not c.isspace() or len(piece) == 96 and not ended)
            again = c in ".!?" and ended and piece[-1].isspace()
            if piece and (starts or again):
                pieces.append(piece)
                piece, ended = "", False
            piece += c
            ended = ended or c in ".!?"
        pieces.append(piece)
        leaves = [(xxhash.xxh3_64_intdigest(p.encode()), len(p)) for p in pieces]
        open_.append(parent(leaves, xxhash.xxh3_64_intdigest))
        if not line.strip() or open_[-1][0] % 4 == 0:
            sections.append(parent(open_, xxhash.xxh3_64_intdigest))
            open_ = []
    if open_:
        sections.append(parent(open_, xxhash.xxh3_64_intdigest))
    return parent(sections, xxhash.xxh3_128_hexdigest)


def plain_spell(t):
    root, size, sections = t
    inner = [f"{h:x}[" + ",".join(f"{p:x}:" + " ".join(f"{x:x}.{n:x}" for x, n in leaves) for p, _, leaves in paragraphs) + "]" for h, _, paragraphs in sections]
    return f"{root}-{size:x}-{';'.join(inner)}"


def plain_likeness(a, b, x, y):
    if a == b:
        return 1.0
    left, right, same = x[2], y[2], 0
    for level in range(3):
        right, rest = list(right), []
        for node in left:
            at = next((i for i, other in enumerate(right) if other[:2] == node[:2]), None)
            if at is None:
                rest.append(node)
            else:
                same += node[1]
                del right[at]
        left, right = ([c for n in side for c in (n[2] if level < 2 else [])] for side in (rest, right))
    return min(2 * same / max(1, len(a) + len(b)), 1 - 1e-9)


def brute(rows):
    tie = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + 2**63) % 2**64  # noqa: E731  as a signed number
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1]))
    out = []
    for k, (i, a) in enumerate(order):
        b = order[(k + 1) % len(order)][1]
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        trees = {t: plain_tree(t) for t in (a, b, edited)}
        near = [plain_likeness(a, t, trees[a], trees[t]) for t in (edited, b)]
        out.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), plain_spell(trees[a]), plain_spell(trees[edited]), *near))
    return sorted(out, key=str)


def found(df):
    names = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "only")],
        [(i * 7 % 101, f"text {i} " * (i % 9)) for i in range(101)],
        [(5, "same")] * 7 + [(-(2**63), "least"), (2**63 - 1, "most")] + [(4, None), (None, "none"), (None, None), (9, "é😀" * 9000), (9, ""), (1, "same")],
        [],
    ],
)
def test_next_documents(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    assert found(fp.with_next(docs)) == brute(rows)


def test_a_hot_identifier_is_cut(spark):
    rows = [(7, f"row {i} of it. And more!") for i in range(400)] + [(None, f"none {i}") for i in range(400)] + [(i, f"own {i}\n\nb") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(fp.with_next(docs)) == brute(rows)
    dealt = fp.in_order(docs)
    for held in ("doc_id = 7", "doc_id IS NULL"):
        assert dealt.where(held).select("_bucket").distinct().count() > 3


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = fp.op2_fingerprints(spark, sf)
    assert found(got) == brute(rows)
    assert got.agg({"near_edited": "avg"}).first()[0] > 0.5
