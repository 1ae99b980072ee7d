import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm.packing import OpenBins, pack_texts
from tessella.llm.tokenizer import VOCABULARY, Encoder, encode_texts, merge_heap, merge_scan

ENCODER = Encoder(open(VOCABULARY, "rb").read())
tiktoken = pytest.importorskip("tiktoken")
REFERENCE = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ENCODER.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_a_reference_implementation(text):
    assert list(ENCODER.encode(text)) == REFERENCE.encode_ordinary(text)
    assert ENCODER.count(text) == len(REFERENCE.encode_ordinary(text))


@pytest.mark.parametrize("letters", [b"ab", b"aAbB", bytes(range(97, 123))])
def test_heap_equals_scan(letters):
    rng = random.Random(4)
    for n in (2, 97, 700):
        word = bytes(rng.choice(letters) for _ in range(n))
        assert merge_heap(word, ENCODER.ranks) == merge_scan(word, ENCODER.ranks)


def test_operator_edge_cases(spark):
    long = "word " * 300_000
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> a"), (5, long), (5, long), (6, "naïve 🌾\r\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as key")
    out = encode_texts(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == REFERENCE.encode_ordinary(dict(rows)[r.doc_id] or "")
    assert encode_texts(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=300), st.integers(1, 9))
def test_bins_never_overflow(sizes, limit):
    bins, filled = OpenBins(64, limit), {}
    for size in sizes:
        n = bins.put(size)
        filled[n] = filled.get(n, 0) + size
        assert filled[n] <= 64 and bins.count <= limit
    for n, used in bins.left().items():
        assert filled[n] == used


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(0, 60)) for i in range(1500)] + [(2000, None), (2001, ""), (2002, "word " * 1000), (7, "word " * 5)]
    profiles = spark.createDataFrame([("p", 100), ("q", 64), ("none", None), ("zero", 0)], "profile_name string, max_size int")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as bin", "'y' as profile")
    out = pack_texts(df, profiles, open_bins=16).toPandas()
    for name, most in (("p", 100), ("q", 64)):
        own = out[out.profile_name == name]
        assert own.groupby("container_id").n_tokens.sum().max() <= most
        total = sum(ENCODER.count(t) for _, t in rows)
        assert own.n_tokens.sum() == total
        assert set(own.doc_id) == {i for i, _ in rows}
        whole = own[own.doc_id.map(dict(rows)).map(lambda t: ENCODER.count(t) <= most)]
        assert (whole.piece_no == 0).all()
        assert total / (own.container_id.nunique() * most) > 0.93
        cut = own[own.doc_id == 2002].sort_values("piece_no")
        assert (cut.token_start.diff().dropna() == most).all() and cut.n_tokens.sum() == ENCODER.count("word " * 1000)
    assert set(out.profile_name) == {"p", "q"}
    assert pack_texts(df.limit(0), profiles).count() == 0
    assert pack_texts(df, profiles.limit(0)).count() == 0
