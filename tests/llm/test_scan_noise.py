from tessella.llm.scan_noise import anagram_hash, confusable_variants, explains, find_noise


def test_explains():
    assert explains("household", "hou5ehold")[0] == 1
    assert explains("kilómetros", "ki1ómetr0s")[0] == 2
    assert explains("déclaré", "dédaré")[0] == 1
    assert explains("household", "household") is None and explains("household", "householb") is None


def test_hashes_are_additive(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("teacher",), ("taecher",), ("tcacher",)], "w string").select("w", anagram_hash(F.col("w")).alias("h")).collect()
    h = {r.w: r.h for r in rows}
    assert h["teacher"] == h["taecher"] and h["teacher"] - h["tcacher"] == ord("e") ** 5 - ord("c") ** 5
    assert {r.word for r in confusable_variants(spark, ["teacher", "year"]).filter(f"hash = {h['tcacher']}").collect()} == {"teacher"}


WORDS = ["the", "teacher", "answer", "question", "is", "asked", "self-employed", "of", "owner", "field", "report"]


def blocks_of(pages, doc="d1"):
    return [(n + 1, doc, n, text, n + 1, [n + 1], None, None) for n, text in enumerate(pages)]


def test_kinds(spark):
    pages = [
        "ZUDOR FIELD REPORT\nthe teacher of the owner, quest-\nion asked of the self-\nemployed owner is the ans-\n1",
        "ZUDOR FIELD REP0RT\nwer of the tcacher. The 0wner is\nasked. (ZUDOR FIELD REPORT, Q12)\n2",
        "ZUDOR FIELD REPORT\r\n1.2 Field report\r\nthe owner of Zudo-\r\nrim is asked que5t¬\r\nion of the owner\r\n- 3 -",
        "ZUDOR FIELD REPORT\nthe owner\n4",
    ]
    schema = "block_key long, doc_id string, ord int, text string, page int, pages array<int>, table_rows array<array<string>>, section_path array<string>"
    rows = blocks_of(pages) + [(50, "d1", 4, None, None, None, [["a"]], None), (51, "d1", 5, "  ", 5, [5], None, None), (52, None, None, "the te4cher of the quest-", None, None, None, None), (2, "d1", 1, pages[1], 2, [2], None, None)]
    blocks = spark.createDataFrame(rows, schema).selectExpr("*", "1 as line_no", "2 as shape")
    words = spark.createDataFrame([(w, "en", True) for w in WORDS] + [(None, "en", True)], "word string, lang string, is_common boolean")
    noise = find_noise(blocks, words)
    furniture = {(r.block_key, r.line_no) for r in noise["furniture"].collect()}
    assert furniture == {(1, 1), (1, 5), (2, 1), (2, 4), (3, 1), (3, 6), (4, 1), (4, 3)}
    hyphen = {(r.block_key, r.line_no) for r in noise["divided"].filter("is_hyphen and block_key is not null").collect()}
    assert hyphen == {(1, 2), (1, 4), (3, 4)}
    misread = {(r.block_key, r.line_no, r.word) for r in noise["misread"].collect()}
    assert misread == {(2, 2, "teacher"), (2, 2, "owner"), (3, 4, "question"), (52, 1, "teacher")}
    empty = find_noise(blocks.limit(0), words)
    assert all(df.count() == 0 for df in empty.values())




def test_paragraphs_go_on_over_pages(spark):
    from tessella.llm.scan_noise import repaired_paragraphs

    pages = [
        "ZUDOR FIELD REPORT\nThe teacher is asked, quest-\nion of the self-\nemployed owner is the ans-\n1",
        "ZUDOR FIELD REPORT\nwer of the tcacher.\n\nThe 0wner is\n2",
        "ZUDOR FIELD REPORT\nasked of Zudo-\nrim.\n3",
    ]
    schema = "block_key long, doc_id string, ord int, text string, page int, pages array<int>, table_rows array<array<string>>, section_path array<string>"
    blocks = spark.createDataFrame(blocks_of(pages) + [(9, "d1", 0, pages[0], 1, [1], None, None), (10, None, 7, "the owner", 1, [1], None, None)], schema)
    words = spark.createDataFrame([(w, "en", True) for w in WORDS], "word string, lang string, is_common boolean")
    out = repaired_paragraphs(blocks, words).orderBy("paragraph_no").collect()
    assert [r.text for r in out] == ["The teacher is asked, question of the self-employed owner is the answer of the teacher.", "The owner is asked of Zudo- rim."]
    assert repaired_paragraphs(blocks.limit(0), words).count() == 0


def test_roman_page_numbers_beside_titles(spark):
    from tessella.llm.scan_noise import furniture_lines

    pages = ["Zudor Field Report\nthe owner", "ii   Zudor Field Report\nthe owner", "Zudor Field Report   iii\nthe owner", "Zudor Field Report\nthe owner", "1v  Zudor Field Rep0rt\r\nthe owner", "Zudor Field Report   xviii\nthe owner", "Zudor Field Report\ndid  the owner"]
    schema = "block_key long, doc_id string, ord int, text string, page int, pages array<int>, table_rows array<array<string>>, section_path array<string>"
    found = furniture_lines(spark.createDataFrame(blocks_of(pages), schema))
    assert {(r.block_key, r.line_no) for r in found.collect()} == {(n, 1) for n in range(1, 8)}


def test_page_numbers_after_lower_case_words(spark):
    from tessella.llm.scan_noise import furniture_lines

    pages = ["the owner\npágina 104", "page 12 of 340\nthe owner", "the owner\nzud_1998_lfsq | ii", "the owner of a field\nasked the teacher"]
    schema = "block_key long, doc_id string, ord int, text string, page int, pages array<int>, table_rows array<array<string>>, section_path array<string>"
    found = furniture_lines(spark.createDataFrame(blocks_of(pages), schema))
    assert {(r.block_key, r.line_no) for r in found.collect()} == {(1, 2), (2, 1), (3, 2)}
