import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lambertlake.llm import bpe_codec, token_counts, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "aaabcdehlinorst éßñ'sİΣ12=-_😀中文é\n\t"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return [*made, None, "", "", "a<|endoftext|>B don'T <|startoftext|><|endoftext|>", "ab" * 4000, "=-" * 4000, "   "]


@pytest.fixture(scope="module")
def wanted(texts):
    library = Tokenizer.from_file(PATH)
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids, [library.decode(i, skip_special_tokens=False) for i in ids]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_counts_are_those_of_the_library(docs, wanted):
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert got == {i: len(x) for i, x in enumerate(wanted[0])}


def test_codec_is_that_of_the_library(docs, wanted):
    got = {r.doc_id: r for r in bpe_codec.decode(bpe_codec.encode(docs)).collect()}
    both = {r.doc_id: r for r in bpe_codec.encode(docs, decoded="decoded").collect()}
    for i, (ids, decoded) in enumerate(zip(*wanted)):
        assert got[i].ids == both[i].ids == ids
        assert got[i].decoded == both[i].decoded == decoded


def test_words_are_those_of_the_library_for_every_character():
    library, bpe = Tokenizer.from_file(PATH), wordbpe.load(PATH)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 512):
        text = "".join(f"a{chr(c)}B {chr(c)}" for c in codes[at : at + 512])
        pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        assert ["".join(bpe.byte[b] for b in w.encode()) for w in bpe.words(text)] == [p for p, _ in pieces], hex(codes[at])


def test_characters_newer_than_pythons_tables(docs):
    rng = random.Random(3)
    odd = "\u0558\u058b\u1c89\ua7cb\ua7dc\U00011382\U000113c9\U000105c9\u0307\U00010d50"
    texts = ["".join(rng.choice(odd + "aÉ 1<") for _ in range(rng.randint(1, 40))) + rng.choice(["", "<|endoftext|>B"]) for _ in range(300)]
    library = Tokenizer.from_file(PATH)
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    df = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()} == {i: len(x) for i, x in enumerate(ids)}
    assert {r.doc_id: r.ids for r in bpe_codec.encode(df).collect()} == dict(enumerate(ids))


def test_long_words_are_not_remembered():
    bpe = wordbpe.load(PATH)
    counts, codec = token_counts._Counts(bpe), bpe_codec.TrieCodec(bpe)
    before = len(counts)
    assert counts["ab" * 500] == len(codec.encode(["ab" * 500])[0])
    assert len(counts) == before and max(map(len, codec.found)) <= 64


def test_digests(docs, wanted):
    got = {r.doc_id: r for r in bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(docs))).collect()}
    for i, (ids, decoded) in enumerate(zip(*wanted)):
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_empty_table(docs):
    assert bpe_codec.decode(bpe_codec.encode(docs.limit(0))).count() == 0
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_whole_table(spark):
    from lambertlake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op5_token_counts"](spark, sf).collect():
        n = len(library.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 2048)
