from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm.splitting import cut, pieces_of, prefix_sizes, split_oversized

UNITS = {"bytes": lambda t: len(t.encode()), "characters": len, "words": lambda t: len(t.split())}
TEXT = st.lists(st.sampled_from([*"abé я\n.,|", "́", "🌾", " | ", ". "]), max_size=300).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.sampled_from(sorted(UNITS)), st.integers(8, 60), st.integers(0, 20))
def test_pieces_fit_and_cover(text, unit, most, overlap):
    size = UNITS[unit]
    assert int(prefix_sizes(text, unit)[-1]) == size(text)
    at = 0
    for start, end, _ in cut(text, [(0, len(text), "text", ["b"], "")], unit, most, overlap):
        assert start <= at < end and size(text[start:end]) <= most
        assert size(text[start:at]) <= max(overlap, 0) + (unit == "words")
        at = end
    assert at == len(text)


def test_boundaries_before_hard_cuts():
    text = "One two three. Four five six. " * 20
    pieces = pieces_of(text, [(0, len(text), "text", ["b"], "")], "characters", 100, 20)
    assert all(p["text"].rstrip().endswith(".") for p in pieces)
    assert pieces[1]["overlap_block_ids"] == ["b"] and pieces[0]["overlap_block_ids"] == []
    solid = pieces_of("x" * 250, [(0, 250, "text", ["b"], "")], "characters", 100, 0)
    assert [p["size"] for p in solid] == [100, 100, 50]


def test_table_pieces_have_the_header():
    rows = ["code | label"] + [f"Q{i} | some label {i}" for i in range(60)]
    text = "\n".join(rows)
    pieces = pieces_of(text, [(0, len(text), "table", ["t"], rows[0])], "bytes", 200, 40)
    assert all(p["text"].startswith(rows[0]) and p["size"] <= 200 for p in pieces)
    assert all(line in rows for p in pieces for line in p["text"].split("\n"))
    assert {line for p in pieces for line in p["text"].split("\n")} == set(rows)


def test_operator_edge_cases(spark):
    part = "struct<id:string,block_id:string,part_index:int,part_count:int,kind:string,text:string,table_id:string,table_rows:array<array<string>>>"
    long = "Some words here. " * 400
    rows = [
        (1, None, long, [("b1:p", "b1", 1, 1, "text", long, None, None)], ["b1"]),
        (2, "small", "short", [("b1:p", "b1", 1, 1, "text", "short", None, None)], ["b1"]),
        (3, "small", None, None, None),
        (4, "small", "", [], []),
        (5, "unknown", long, [None, ("x", None, 1, 1, "text", None, None, None)], None),
        (6, "small", "a b c d e f", [("b1:p", "b1", 1, 1, "text", "a b c", None, None), ("b2:p", "b2", 1, 1, "text", "d e f", None, None)], ["b1", "b2"]),
        (6, "small", "a b c d e f", [("b1:p", "b1", 1, 1, "text", "a b c", None, None), ("b2:p", "b2", 1, 1, "text", "d e f", None, None)], ["b1", "b2"]),
        (7, "tok", "aa bb cc dd", [("b1:p", "b1", 1, 1, "text", "aa bb cc dd", None, None)], ["b1"]),
    ]
    chunks = spark.createDataFrame(rows, f"chunk_key long, profile_name string, text string, parts array<{part}>, block_ids array<string>").selectExpr("*", "'x' as unit", "1 as most", "null as token_count")
    limits = spark.createDataFrame([("std", "chunking", "bytes", 1000, 100, True), ("small", "chunking", "words", 5, 1, False), ("tok", "chunking", "tokens", 3, 0, False), ("pack", "packing", "tokens", 9, 0, True)], "profile_name string, used_for string, size_unit string, max_size int, overlap_size int, is_default boolean")
    out = split_oversized(chunks, limits).toPandas()
    assert set(zip(out.chunk_key, out.part_id)) == {(1, ""), (1, "b1:p"), (6, ""), (7, ""), (7, "b1:p")}
    assert (out["size"] <= out.max_size).all()
    assert len(out[out.chunk_key == 6]) == 2 * len(out[out.chunk_key == 6].drop_duplicates("piece_no"))
    assert split_oversized(chunks.limit(0), limits).count() == 0
    assert split_oversized(chunks, limits.limit(0)).count() == 0
