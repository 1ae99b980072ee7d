"""Repair of text from scanned pages: furniture, divided words, misread words, paragraphs.

Furniture is found by edge-line evidence: a title is a short line that stands at the edges of several blocks of a
document (or shares its ending or beginning with such titles of other documents); every line of the document that equals
one but for a misread character is furniture, as are lines at block edges that are only a page number.

Misread words are found by anagram hashes, in SQL. A word's hash is the sum of the fifth powers of its characters, so
each confusion (a character or pair read as another) is one fixed difference of hashes, wherever it stands. The hashes of
the word list under one to MOST_CONFUSIONS confusions are a small fixed table, which is joined with the hashes of the
corpus's rare (unlisted) words; matches are checked character by character and ranked by confusions and word frequency.

A word divided at a line end is told by hyphen evidence: the two halves joined are a listed word, as they stand or after
correction, while the halves with the hyphen are none.

Cases: blocks with null or blank text have no lines, but don't end a document's text; null doc_id or ord leaves a block
without a following one; blocks delivered twice give each row twice, under their own block_key; \\r before \\n is no part
of a line; one line may be of several kinds; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessella.operators.ordered import ordered_fold
from tessella.runtime import cut_lineage, read_table, spread

MAX_WORDS = 1_000_000
MOST_CONFUSIONS = 3
#: Characters of a title that may be misread: one, or one in twelve, and no more than these.
MOST_MISREAD = 3
TITLE_LENGTH = 60
TITLE_WORDS = 6
#: A page number without a word before it; also the blanks that may part a number from a title.
PAGE_LENGTH = 8
#: Documents in which an ending or a beginning of titles must be seen to vouch for a title seen once.
VOUCHERS = 3
#: Blocks at whose edges a line must stand to be a title by itself.
OFTEN = 3
BUCKET = 1024

#: Characters as printed and as misread, in lower case; the rank is the place in the list.
CONFUSIONS = (
    ("e", "c"), ("o", "0"), ("s", "5"), ("i", "1"), ("l", "1"), ("d", "cl"), ("u", "ii"), ("l", "i"), ("m", "rn"),
    ("о", "0"), ("g", "9"), ("h", "b"), ("é", "6"), ("и", "н"), ("b", "6"), ("п", "н"), ("л", "п"), ("w", "vv"),
    ("ti", "d"), ("з", "3"), ("ч", "4"), ("cl", "d"), ("li", "h"), ("rn", "m"), ("б", "6"), ("ш", "щ"), ("nn", "rm"), ("ñ", "fi"),
    ("i", "l"), ("t", "7"), ("z", "2"), ("a", "4"), ("q", "9"),
)
#: Characters that divide a word at a line end; punctuation around words; roman numerals and digits as misread.
DIVIDERS = "-‐¬­"
AROUND = ".,;:()[]{}¿?¡!«»\"“”„…–—|"
NUMBER = r"(?:[0-9IlOoSBZ|]{1,5}|[ivxlcdmIVXLCDM1l]{1,7})"
#: A page number beside a title: digits as misread, or a roman numeral in lower case (i and l are also misread as 1 and l).
BESIDE = r"(?:[0-9IlOoSBZ|.~]{1,5}|[ivxlcdm1l]{1,7})"
PAGE_LINE = rf"(?U)^\W*(?:\p{{L}}+\.?\s+)?{NUMBER}(?:\s+\p{{L}}+\s+{NUMBER}|\s*/\s*{NUMBER})?\W*$"
CODED_PAGE_LINE = rf"(?U)^(?=\S*[0-9_])[\p{{L}}0-9_.~-]{{4,}}\s+\|\s+{NUMBER}$"
SENTENCE_END = ".!?…:;"


def collect_words(word_list: DataFrame) -> list[str]:
    """The listed words: a fixed table, its size checked before it is shipped."""
    rows = word_list.select(F.lower("word").alias("word")).filter("length(word) > 0").distinct().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} listed words")
    return sorted(r[0] for r in rows)


def anagram_hash(word: Column) -> Column:
    """Sum of the fifth powers of the characters (modulo 2**64): equal for anagrams, additive for confusions."""
    def fifth(c: Column) -> Column:
        n = F.ascii(c).cast("long")
        return n * n * n * n * n

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, c: total + fifth(c))


def _hash(text: str) -> int:
    return sum(ord(c) ** 5 for c in text)


def explains(word: str, read: str, most: int = MOST_CONFUSIONS) -> tuple[int, int] | None:
    """(confusions, sum of their ranks) that turn ``word`` into ``read``, the fewest first; None if there are none."""
    best: dict[tuple[int, int], tuple[int, int]] = {(0, 0): (0, 0)}
    for i in range(len(word) + 1):
        for j in range(len(read) + 1):
            here = best.get((i, j))
            if here is None:
                continue
            steps = []
            if i < len(word) and j < len(read) and word[i] == read[j]:
                steps.append((i + 1, j + 1, here))
            if here[0] < most:
                for rank, (a, b) in enumerate(CONFUSIONS):
                    if word.startswith(a, i) and read.startswith(b, j):
                        steps.append((i + len(a), j + len(b), (here[0] + 1, here[1] + rank)))
            for x, y, cost in steps:
                if cost < best.get((x, y), (most + 1, 0)):
                    best[x, y] = cost
    found = best.get((len(word), len(read)))
    return found if found and found[0] else None


def confusable_variants(spark: SparkSession, words: list[str]) -> DataFrame:
    """``hash, word``: the hashes that the listed words take under up to MOST_CONFUSIONS confusions. A fixed-size table."""
    lexicon = spark.createDataFrame([(w,) for w in words], "word string").select("word", anagram_hash(F.col("word")).alias("hash"))
    table = [(a, _hash(a) - _hash(b), k) for k, (a, b) in enumerate(CONFUSIONS)]
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(d).cast("long").alias("d"), F.lit(k).alias("k")) for a, d, k in table])
    level = lexicon.withColumn("from", F.lit(0))
    levels = []
    for _ in range(MOST_CONFUSIONS):
        level = (
            level.select("word", "hash", "from", F.explode(moves).alias("m"))
            .filter((F.col("m.k") >= F.col("from")) & (F.locate("\u0000", F.replace(F.col("word"), F.col("m.a"), F.lit("\u0000"))) > 0))
            .select("word", (F.col("hash") - F.col("m.d")).alias("hash"), F.col("m.k").alias("from"))
        )
        levels.append(level.select("hash", "word"))
    return reduce(DataFrame.unionAll, levels).distinct()


#: Rows of the table of variants that is shipped to all tasks.
MOST_VARIANTS = 20_000_000


def corrections(rare: DataFrame, frequent: DataFrame, words: list[str]) -> DataFrame:
    """``token, word``: the best explanation of each rare word; ``frequent`` has word and n, the counts of listed words.

    The variants of the word list are shipped to the rare words if they are few enough, else joined by hash.
    """
    variants = confusable_variants(rare.sparkSession, words)
    # A word of 30 characters has some 30 places for a confusion; the bound is checked, not guessed, where it may be passed.
    if len(words) <= 5_000 or variants.count() <= MOST_VARIANTS:
        variants = F.broadcast(variants)

    @F.pandas_udf("edits int, rank int")
    def explain(listed: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([explains(w, t.lower()) or (0, 0) for w, t in zip(listed, tokens)], columns=["edits", "rank"])

    near = rare.withColumn("hash", anagram_hash(F.lower("token"))).join(variants, "hash").withColumn("why", explain("word", "token")).filter("why.edits > 0")
    # A capitalised word is taken for a name unless it begins like the listed word; capitals may only be misread as digits.
    first = F.substring("token", 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    shouting = (F.upper("token") == F.col("token")) & (F.lower("token") != F.col("token")) & (F.length("token") > 1)
    fits = F.when(shouting, F.col("token").rlike(r"[0-9]")).when(capital, (F.lower(first) == F.substring("word", 1, 1)) | (first == "I")).otherwise(F.lit(True))
    told = near.filter(fits).join(F.broadcast(frequent), "word", "left")
    best = F.struct("why.edits", (-F.coalesce("n", F.lit(0))).alias("seldom"), "why.rank", "word")
    return told.groupBy("token").agg(F.min(best)["word"].alias("word"))


# --- furniture ------------------------------------------------------------------------------------------------------


def _title_shape(line: Column) -> Column:
    """The line without a page number beside it, blanks made single."""
    bare = F.regexp_replace(line, rf"(?U)^\s*{BESIDE}\s{{2,}}|\s{{2,}}{BESIDE}\s*$", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def short_lines(blocks: DataFrame) -> DataFrame:
    """block_key, doc_id, ord, line_no, is_edge (first or last of the block), may_turn (block may hold a page's end), page, shape.

    Lines that may be a page number or a title; page tells a number, shape is the line without one beside it. A block's
    lines are told apart inside one array, so that each pattern is tried once a line, and most lines leave at a glance.
    """
    filled = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("no"), F.rtrim(F.regexp_replace(x, "\r$", "")).alias("line"))), lambda x: F.ltrim(x["line"]) != "")
    body = blocks.filter("text is not null").withColumn("body", filled)
    bare = lambda x: F.trim(x["line"])
    spaces = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" ")))
    head = lambda t: F.substring(t, 1, 1)
    page = lambda t: t.rlike(PAGE_LINE) | t.rlike(CODED_PAGE_LINE)
    placed = F.transform("body", lambda x, at: F.struct(x["no"].alias("no"), x["line"].alias("line"), bare(x).alias("bare"), ((at == 0) | (at == F.size("body") - 1)).alias("is_edge")))
    near = F.filter(placed, lambda x: (F.char_length(x["bare"]) <= TITLE_LENGTH + 10) & (spaces(x["bare"]) <= TITLE_WORDS + PAGE_LENGTH))
    # A title begins with a capital, no letter or a page number; other lines are kept only as page numbers.
    capital = lambda t: (F.lower(head(t)) != head(t)) | (F.upper(head(t)) == head(t))
    asked = F.filter(near, lambda x: (F.char_length(x["bare"]) <= PAGE_LENGTH) | capital(x["bare"]) | x["bare"].rlike(rf"(?U)^{BESIDE}\s{{2,}}") | page(x["bare"]))
    told = F.transform(asked, lambda x: F.struct(x["no"].alias("line_no"), x["is_edge"].alias("is_edge"), page(x["bare"]).alias("page"), _title_shape(x["line"]).alias("shape")))
    may_turn = (F.coalesce(F.size("pages"), F.lit(0)) != 1).alias("may_turn")
    return body.select("block_key", "doc_id", "ord", may_turn, F.explode(told).alias("l")).select("block_key", "doc_id", "ord", "may_turn", "l.*")


def furniture_lines(blocks: DataFrame) -> DataFrame:
    """``block_key, line_no`` of running titles and page numbers; a line may come twice."""
    # A line that can't be a title or a page number isn't kept: few titles are as long as body lines, and none ends like a sentence's end.
    words = F.size(F.split("shape", " "))
    head = F.substring("shape", 1, 1)
    title_like = (
        ~F.col("page")
        & F.char_length("shape").between(4, TITLE_LENGTH)
        & (words <= TITLE_WORDS)
        & ((F.lower(head) != head) | head.rlike(r"[0-9~.]"))
        & ~F.col("shape").rlike(r"[,;:!?)]$")
        & ~F.col("shape").rlike(r"^[0-9]+\.[0-9]+\s")
        & F.col("shape").rlike(r"\p{L}{3}")
    )
    kept = cut_lineage(short_lines(blocks).withColumn("titled", title_like).filter("page or titled"))
    numbers = kept.filter("page and (is_edge or may_turn)").select("block_key", "line_no")
    ends = kept.filter("titled and is_edge and not endswith(shape, '.')").groupBy("doc_id", "shape").agg(F.countDistinct("ord").alias("n"))
    # What vouches for a title seen seldom: its ending or beginning in titles of other documents, or its document's own
    # name beside it, an ending that begins with a dash and comes back in the document.
    tail, front = F.regexp_extract("shape", r"^\S+ (.*)$", 1), F.regexp_extract("shape", r"^(.*) \S+$", 1)
    sign = lambda side, words, own: F.struct(F.lit(side).alias("side"), words.alias("words"), own.alias("own"))
    signs = ends.select("doc_id", "shape", "n", F.explode(F.array(sign("t", tail, F.lit("")), sign("f", front, F.lit("")), sign("d", F.when(tail.rlike("^[–—-] "), tail).otherwise(""), F.col("doc_id")))).alias("s"))
    signs = cut_lineage(signs.filter("s.words != ''").select("doc_id", "shape", "n", "s.side", "s.words", "s.own"))
    seen = signs.filter("n >= 2 or side = 'd'").groupBy("side", "words", "own", "doc_id").agg(F.sum("n").alias("n")).groupBy("side", "words", "own").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_seen"))
    vouched = seen.filter((F.col("n_docs") >= F.when(F.col("side") == "d", 1).otherwise(VOUCHERS)) & (F.col("n_seen") >= 2)).select("side", "words", F.col("own").alias("whose"))
    known = signs.filter(F.col("n") < OFTEN).join(vouched, (signs.side == vouched.side) & (signs.words == vouched.words) & F.equal_null(signs.own, vouched.whose), "left_semi")
    titles = known.select("doc_id", "shape").unionAll(ends.filter(F.col("n") >= OFTEN).select("doc_id", "shape"))
    # Equal but for misread characters, which keep the length or nearly so: an equi-join on document and length.
    near = titles.select("doc_id", F.col("shape").alias("title"), F.explode(F.sequence(F.char_length("shape") - 1, F.char_length("shape") + 1)).alias("length"))
    matched = (
        kept.filter("titled").withColumn("length", F.char_length("shape")).join(near, ["doc_id", "length"])
        .filter(F.levenshtein(F.lower("shape"), F.lower("title"), MOST_MISREAD).between(F.lit(0), F.greatest(F.lit(1), F.floor(F.col("length") / 12))))
        .select("block_key", "line_no")
    )
    return numbers.unionAll(matched)


# --- words ----------------------------------------------------------------------------------------------------------

_UNITS = "block_key long, doc_id string, ord int, line_no int, role string, left string, right string, right_line int, n long"
_UNIT_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()]
_LETTER = re.compile(r"[^\W\d_]")


def _batch(rows: list[tuple], schema: str, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], [f.split(" ")[0] for f in schema.split(", ")])


def _units(words: frozenset):
    """Of each block: unlisted words, words divided at line ends, an open end, the first word; counts of listed words.

    The first word is given as such even if it is listed; its ``n`` is 1 if it is an unlisted word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()
        for batch in batches:
            rows = []
            for block_key, doc_id, ord_, text, skip in zip(*(c.to_pylist() for c in batch.columns)):
                skip = set(skip or ())
                body = [(no, w) for no, line in enumerate(text.split("\n"), 1) if no not in skip and (w := line.split())]
                divided = False
                for k, (no, tokens) in enumerate(body):
                    last = tokens[-1]
                    opens = len(last) > 1 and last[-1] in DIVIDERS and last[-2] not in DIVIDERS
                    for at, token in enumerate(tokens[: len(tokens) - 1] if opens else tokens):
                        if divided and not at:
                            continue
                        low = token.lower()
                        bare = token if low in words else token.strip(AROUND)
                        low = low if low in words else bare.lower()
                        unlisted = low not in words and bool(_LETTER.search(bare))
                        if low in words:
                            known[low] += 1
                        if not k and not at:
                            # Of the first word nothing is known yet: it may go on a divided word (told apart later).
                            rows.append((block_key, doc_id, ord_, no, "first", token.strip(AROUND), None, None, int(unlisted)))
                        elif unlisted:
                            rows.append((block_key, doc_id, ord_, no, "inner", bare, None, None, 1))
                    if opens:
                        if not k and len(tokens) == 1:
                            rows.append((block_key, doc_id, ord_, no, "first", last.strip(AROUND), None, None, 0))
                        left = last[:-1].lstrip(AROUND)
                        if k + 1 < len(body):
                            after_no, after = body[k + 1]
                            rows.append((block_key, doc_id, ord_, no, "divided", left, after[0].strip(AROUND), after_no, 1))
                        else:
                            rows.append((block_key, doc_id, ord_, no, "open", left, None, None, 1))
                    divided = opens
            if rows:
                yield _batch(rows, _UNITS, _UNIT_TYPES)
        if known:
            yield _batch([(None, None, None, None, "known", w, None, None, n) for w, n in known.items()], _UNITS, _UNIT_TYPES)

    return run


_HALVES = "block_key long, line_no int, left string, right string, right_key long, right_line int, plain string, compound string, plain_listed boolean, comp_listed boolean"
_HALF_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]


def _spelled(words: frozenset):
    """Both halves of divided words, whole and with a hyphen, and whether the list has these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                plain, compound = row[2] + row[3], f"{row[2]}-{row[3]}"
                rows.append((*row, plain, compound, plain.lower() in words, compound.lower() in words))
            if rows:
                yield _batch(rows, _HALVES, _HALF_TYPES)

    return run


def _onward(units: DataFrame) -> DataFrame:
    """``doc_id, ord, block_key, line_no, left, next_ord, next_word`` of open ends with a following block.

    Two levels of windows, so that a long document is no one task's: read backwards, an open end meets the first word of
    the block after it (of copies the smallest block_key's) in its own bucket of the document, else that of a later one.
    """
    placed = units.filter("role in ('first', 'open') and doc_id is not null and ord is not null").withColumn("bucket", F.floor(F.col("ord") / BUCKET))
    first = F.when(F.col("role") == "first", F.struct(F.col("ord").alias("ord"), F.col("block_key").alias("key"), F.col("left").alias("word")))
    # Of equal ord open ends come before first words, so no block follows itself.
    back = Window.partitionBy("doc_id", "bucket").orderBy(F.col("ord").desc(), F.col("role").desc(), F.col("block_key").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = placed.withColumn("next", F.last(first, ignorenulls=True).over(back)).filter("role = 'open'")
    starts = placed.groupBy("doc_id", "bucket").agg(F.min(first).alias("start"))
    later = starts.withColumn("later", F.first("start", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy(F.col("bucket")).rowsBetween(1, Window.unboundedFollowing))).select("doc_id", "bucket", "later")
    told = near.join(later, ["doc_id", "bucket"], "left").withColumn("next", F.coalesce("next", "later")).filter("next is not null")
    return told.select("doc_id", "ord", "block_key", "line_no", "left", F.col("next.ord").alias("next_ord"), F.col("next.word").alias("next_word"))


def find_noise(blocks: DataFrame, word_list: DataFrame) -> dict[str, DataFrame]:
    """furniture (block_key, line_no), skips (as arrays); divided (both halves, the listed word, is_hyphen); misread (block_key, line_no, token, word)."""
    words = collect_words(word_list)
    shipped = frozenset(words)
    slim = spread(blocks.select(F.col("block_key").cast("long").alias("block_key"), "doc_id", F.col("ord").cast("int").alias("ord"), "text", "pages"))
    # A block's furniture is no more than its lines.
    skips = cut_lineage(furniture_lines(slim).groupBy("block_key").agg(F.collect_set("line_no").alias("skip")))
    texts = slim.filter("length(trim(text)) > 0").select("block_key", "doc_id", "ord", "text").join(skips, "block_key", "left")
    units = cut_lineage(texts.select("block_key", "doc_id", "ord", "text", "skip").mapInArrow(_units(shipped), _UNITS))

    firsts = units.filter("role = 'first'")
    over = cut_lineage(_onward(units))
    # The half on the next page, in each copy of its block.
    first_lines = firsts.select("doc_id", F.col("ord").alias("next_ord"), F.col("block_key").alias("right_key"), F.col("line_no").alias("right_line"))
    onward = cut_lineage(over.select("doc_id", "next_ord", "left", F.col("next_word").alias("right")).distinct().join(first_lines, ["doc_id", "next_ord"]).select("left", "right", "right_key", "right_line"))
    none = lambda kind: F.lit(None).cast(kind)
    ends = ["block_key", "line_no", "left", "right", "right_key", "right_line"]
    halves = units.filter("role = 'divided'").withColumn("right_key", F.col("block_key")).select(*ends)
    halves = halves.unionByName(over.select("block_key", "line_no", "left", F.col("next_word").alias("right"), none("long").alias("right_key"), none("int").alias("right_line")))
    halves = halves.unionByName(onward.select(none("long").alias("block_key"), none("int").alias("line_no"), "left", "right", "right_key", "right_line"))
    halves = cut_lineage(halves.filter("right != ''").mapInArrow(_spelled(shipped), _HALVES))

    # First words of blocks that go on a divided word are no words of their own.
    going_on = onward.select(F.col("right_key").alias("block_key"), F.col("right_line").alias("line_no"), F.col("right").alias("left")).distinct()
    alone = firsts.filter("n = 1").join(going_on, ["block_key", "line_no", "left"], "left_anti")
    inner = units.filter("role = 'inner'").select("block_key", "line_no", F.col("left").alias("token")).unionByName(alone.select("block_key", "line_no", F.col("left").alias("token")))

    # Every spelling that the list doesn't have is looked up once, whoever asks; halves ask for both of theirs.
    unknown = halves.filter("not plain_listed and not comp_listed")
    spelling = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("token")) for k, c in (("plain", "plain"), ("compound", "compound"))))).alias("s")
    asked = inner.select(*(none(k).alias(c) if c not in inner.columns else c for c, k in zip(ends, ("long", "int", "string", "string", "long", "int"))), F.lit("inner").alias("kind"), "token")
    asked = cut_lineage(asked.unionByName(unknown.select(*ends, spelling).select(*ends, "s.kind", "s.token")))
    frequent = units.filter("role = 'known'").groupBy(F.col("left").alias("word")).agg(F.sum("n").alias("n"))
    answered = cut_lineage(asked.join(corrections(asked.select("token").distinct(), frequent, words), "token"))

    told = answered.filter("kind != 'inner'").groupBy(*ends).agg(F.max(F.when(F.col("kind") == "plain", F.col("word"))).alias("plain_word"), F.max(F.when(F.col("kind") == "compound", F.col("word"))).alias("comp_word"))
    guessed = cut_lineage(told.select(*ends, F.coalesce("plain_word", "comp_word").alias("word"), F.col("plain_word").isNotNull().alias("is_hyphen")))
    listed = halves.filter("plain_listed or comp_listed").select(*ends, F.lower(F.when(F.col("plain_listed"), F.col("plain")).otherwise(F.col("compound"))).alias("word"), F.col("plain_listed").alias("is_hyphen"))
    left_bad = ~F.col("word").startswith(F.lower("left"))
    right_bad = ~F.col("word").endswith(F.lower("right"))
    misread = (
        answered.filter("kind = 'inner'").select("block_key", "line_no", "token", "word")
        .unionByName(guessed.filter(left_bad).select("block_key", "line_no", F.col("left").alias("token"), "word"))
        .unionByName(guessed.filter(right_bad).select(F.col("right_key").alias("block_key"), F.col("right_line").alias("line_no"), F.col("right").alias("token"), "word"))
        .filter("block_key is not null")
    )
    furniture = skips.select("block_key", F.explode("skip").alias("line_no"))
    return {"furniture": furniture, "skips": skips, "divided": listed.unionByName(guessed), "misread": misread}


# --- paragraphs -----------------------------------------------------------------------------------------------------

_PIECES = "doc_id string, ord int, piece_no int, text string, opens boolean, closes boolean, joint string"
_PIECE_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
_SECTION = re.compile(r"^\d+(?:\.\d+)+\s+\S")


def _like(word: str, model: str) -> str:
    """``word`` with the capitals of ``model``."""
    if model.isupper() and len(model) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def _corrected(token: str, word: str) -> str:
    """A token with its punctuation around the corrected word."""
    bare = token.strip(AROUND)
    return token.replace(bare, _like(word, bare), 1) if bare else token


def repair(text: str, skip: set[int], fixes: dict[tuple[int, str], str], joins: dict[int, tuple[bool, str]]) -> list[tuple[str, bool, bool, str]]:
    """(text, opens a paragraph, closes one, joint) of a block's paragraphs without furniture, words joined and corrected.

    ``joins`` has, by line, whether the divider goes and the whole word. ``joint`` tells how the next block's text goes
    on: a blank, or nothing where the last word is divided.
    """
    paragraphs: list[tuple[list[str], bool]] = []
    pending: tuple[bool, str] | None = None
    fresh = False
    for no, raw in enumerate(text.split("\n"), 1):
        if no in skip:
            continue
        tokens = raw.split()
        if not tokens:
            fresh = True
            continue
        tokens = [_corrected(t, fixes[no, b]) if (b := t.strip(AROUND)) and (no, b) in fixes else t for t in tokens]
        section = bool(_SECTION.match(raw))
        new = not pending and (fresh or section or raw.startswith("  "))
        if not paragraphs or new:
            paragraphs.append(([], bool(new)))
        words = paragraphs[-1][0]
        if pending and words:
            gone, whole = pending
            left, right = words.pop(), tokens.pop(0)
            # The whole word, with what stands before the first half and after the second.
            head, tail = left[: len(left) - len(left.lstrip(AROUND))], right[len(right.rstrip(AROUND)) :]
            words.append(head + _like(whole, left.lstrip(AROUND)) + tail if whole else (left[:-1] if gone else left) + right)
        words += tokens
        pending = joins.get(no) if tokens and tokens[-1][-1] in DIVIDERS or no in joins else None
        fresh = section
    out = []
    for k, (words, new) in enumerate(paragraphs):
        line, last = " ".join(words), k == len(paragraphs) - 1
        joint = " "
        if last and pending:
            line, joint = (line[:-1] if pending[0] else line), ""
        out.append((line, new or k > 0, not last or fresh or line.endswith(tuple(SENTENCE_END)), joint))
    return out


def _repair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            fixes = {(f["line_no"], f["token"]): f["word"] for f in r["fixes"] or ()}
            joins = {j["line_no"]: (j["is_hyphen"], j["word"] if j["whole"] else "") for j in r["joins"] or ()}
            rows += [(r["doc_id"], r["ord"], n, *piece) for n, piece in enumerate(repair(r["text"], set(r["skip"] or ()), fixes, joins))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _PIECE_TYPES)], [f.split(" ")[0] for f in _PIECES.split(", ")])


def repaired_paragraphs(blocks: DataFrame, word_list: DataFrame) -> DataFrame:
    """``doc_id, paragraph_no, first_ord, text``: continuous paragraphs over pages and blocks, of each block once.

    A paragraph goes on in the next block unless its last line ends a sentence or a blank line or an indent follows.
    Blocks delivered twice count once (the smaller block_key); blocks without doc_id or ord are left out, as they have no
    place in a document.
    """
    noise = find_noise(blocks, word_list)
    fixes = noise["misread"].filter("block_key is not null").groupBy("block_key").agg(F.collect_set(F.struct("line_no", "token", "word")).alias("fixes"))
    joins = noise["divided"].filter("block_key is not null").groupBy("block_key").agg(F.collect_set(F.struct("line_no", "is_hyphen", "word", F.col("right_key").isNotNull().alias("whole"))).alias("joins"))
    once = blocks.filter("doc_id is not null and ord is not null and length(trim(text)) > 0").groupBy("doc_id", "ord").agg(F.min(F.struct(F.col("block_key").cast("long").alias("block_key"), "text")).alias("b"))
    texts = once.select("doc_id", F.col("ord").cast("int").alias("ord"), "b.block_key", "b.text")
    ready = texts.join(noise["skips"], "block_key", "left").join(fixes, "block_key", "left").join(joins, "block_key", "left")
    pieces = cut_lineage(ready.select("doc_id", "ord", "text", "skip", "fixes", "joins").mapInArrow(_repair_blocks, _PIECES))
    # A piece begins a paragraph if it says so or the piece before closes one; numbers are counted bucket by bucket.
    place = pieces.withColumn("bucket", F.floor(F.col("ord") / BUCKET))
    inner, outer = Window.partitionBy("doc_id", "bucket").orderBy("ord", "piece_no"), Window.partitionBy("doc_id").orderBy("bucket")
    ends = place.groupBy("doc_id", "bucket").agg(F.max(F.struct("ord", "piece_no", "closes"))["closes"].alias("closes")).withColumn("before", F.lag("closes").over(outer)).select("doc_id", "bucket", "before")
    told = place.join(ends, ["doc_id", "bucket"]).withColumn("starts", F.when(F.col("opens") | F.coalesce(F.lag("closes").over(inner), F.col("before"), F.lit(True)), 1).otherwise(0))
    counts = told.groupBy("doc_id", "bucket").agg(F.sum("starts").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("doc_id", "bucket", "base")
    numbered = told.join(counts, ["doc_id", "bucket"]).withColumn("paragraph_no", F.col("base") + F.sum("starts").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    schema = StructType([numbered.schema["doc_id"], numbered.schema["paragraph_no"], StructField("first_ord", IntegerType()), StructField("text", StringType())])

    def step(paragraph, row):
        paragraph.setdefault("first", (row["doc_id"], row["paragraph_no"], row["ord"]))
        paragraph.setdefault("text", []).extend((row["text"], row["joint"]))
        return []

    def finish(paragraph, key):
        return [(*paragraph["first"], "".join(paragraph["text"][:-1]))]

    return ordered_fold(numbered.select("doc_id", "paragraph_no", "ord", "piece_no", "text", "joint"), ["doc_id", "paragraph_no"], ["ord", "piece_no"], dict, step, finish, schema)


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_paragraphs(read_table(spark, sf_dir, "pdf_blocks"), read_table(spark, sf_dir, "word_list"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = find_noise(read_table(spark, sf_dir, "pdf_blocks"), read_table(spark, sf_dir, "word_list"))
    return (
        noise["furniture"].withColumn("noise_kind", F.lit("furniture"))
        .unionByName(noise["divided"].filter("is_hyphen and block_key is not null").select("block_key", "line_no", F.lit("hyphen").alias("noise_kind")))
        .unionByName(noise["misread"].select("block_key", "line_no", F.lit("ocr").alias("noise_kind")))
        .distinct().select("block_key", F.col("line_no").cast("int").alias("line_no"), "noise_kind")
    )


QUERIES = {"p4_found": p4_found, "p4_paragraphs": p4_paragraphs}
SQL: dict[str, str] = {}
