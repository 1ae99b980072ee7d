import pytest

from tessella.llm.lookalikes import Canonicaliser, LookAlikeTrie, by_table, canonical_texts, survey_texts

VOCABULARY = [(1, "No"), (2, "Нет"), (3, "Café or stall"), (4, "Area in m2"), (5, "Area in m²"), (6, "À quel âge : le puits ?"), (7, "Office staff")]


@pytest.mark.parametrize(
    "text, std_id",
    [
        ("Nо", 1), ("  No ", 1), ("N​o", 1), ("Ｎｏ", 1), ("Heт", 2), ("Café or  stall", 3), ("Caf‍e​́ or stall", 3), ("Area in m2", 4), ("Area　in m²", 5),
        ("À quel âge : le puits ?", 6), ("Oﬃce staﬀ", 7),
        ("no", None), ("NO", None), ("Cafe or stall", None), ("No.", None), ("No²", None), ("Area in m", None), ("Area in m22", None), ("Noo", None), ("", None), ("  ​ ", None), ("Officestaff", None),
    ],
)
def test_match(text, std_id):
    found = Canonicaliser(VOCABULARY).match(text)
    assert (found[0] if found else None) == std_id


def test_cost_allows_edits():
    trie = LookAlikeTrie([("Office staff", 7)])
    assert trie.find("Ofice staff") is None
    assert trie.find("Ofice staff", 1) == (7, 1)
    assert trie.find("Оffice staf", 1) == (7, 1)
    assert trie.find("fice staf", 2) is None and trie.find("fice staf", 4)[1] == 3


def test_first_of_alike_texts_wins():
    assert Canonicaliser([(9, "НОТ"), (3, "HOT")]).match("HОТ")[0] == 3


def test_unmatched_tokens_by_table():
    assert by_table("ｍаrket") == "market"
    assert by_table("рынoк") == "рынок"
    assert Canonicaliser(VOCABULARY)("Оffice of  ｒｅｃｏｒｄs", True) == (None, "Office of records")


def test_operator_edge_cases(spark):
    rows = [(1, "No", None), (2, None, []), (3, "", [("", None), (None, None)]), (4, "Nо", [("1", "No ")]), (4, "Nо", [("1", "No ")]), (5, "x" * 50_000, [("1", "Нет")])]
    records = spark.createDataFrame(rows, "record_id long, question_text string, categories array<struct<code string, label string>>").selectExpr("*", "'extra' as std_id", "1 as text")
    standard = spark.createDataFrame(VOCABULARY, "std_id long, std_text string").selectExpr("*", "'x' as canonical")
    out = canonical_texts(survey_texts(records), standard).collect()
    assert sorted((r.record_id, r.slot_no, r.std_id) for r in out if r.std_id) == [(1, 0, 1), (4, 0, 1), (4, 0, 1), (4, 1, 1), (4, 1, 1), (5, 1, 2)]
    assert canonical_texts(survey_texts(records.limit(0)), standard).count() == 0
    assert canonical_texts(survey_texts(records), standard.limit(0)).filter("std_id is not null").count() == 0


def test_letters_of_further_scripts():
    from tessella.llm import lookalikes as L

    trie = L.LookAlikeTrie([("Total", 1), ("Age", 2), ("Yes", 3)])
    found = [trie.find(text) for text in ("Tоtɑl", "Аɡe", "Totaⅼ", "Ꭺge", "ꓬes")]
    assert [f[0] if isinstance(f, tuple) else f for f in found] == [1, 2, 1, 2, 3]
