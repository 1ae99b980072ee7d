"""Visually identical text brought to one spelling.

A vocabulary of canonical texts is held as two tries, one of whole texts and one of their tokens, over decomposed
characters. A text is walked through a trie by a weighted edit automaton: its states are trie nodes with a cost. A
character that looks like the edge's (another width, another script, a joined letter taken apart, an accent written
apart) costs nothing, an ignorable character costs nothing and moves nowhere, a run of blanks is one blank; any other
substitution, insertion or deletion costs 1. States above ``max_cost`` die, so the walk of an unrelated text ends after
a few characters. A matched text takes the canonical spelling; otherwise each token takes the canonical spelling of a
token it looks like, and what is left is normalised by table, its look-alike letters going to the script that most
letters of the token have.

Cases: null gives null; empty and blank texts match nothing and normalise to an empty text; texts of any length are
walked whole; of canonical texts that look alike the one of the smallest ``std_id`` wins; repeated rows give repeated rows; extra
columns are ignored; an empty vocabulary matches nothing.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import read_table, spread

#: Letters of several scripts that look the same, one class a word; Latin, Greek, Cyrillic, Armenian, and the
#: capitals of Cherokee and Lisu.
LOOK_ALIKES = (
    "AΑАᎪꓮ BΒВᏴꓐ CСϹᏟꓚ DᎠꓓ EΕЕᎬꓰ FϜꓝ GԌᏀꓖ HΗНᎻꓧ IΙІӀꓲ JЈᎫꓙ KΚКᏦꓗ LᏞꓡ MΜМᎷꓟ NΝꓠ OΟОՕꓳ PΡРᏢꓑ QԚ SЅՏᏚꓢ TΤТᎢꓔ UՍꓴ VѴᏙꓦ WԜᎳꓪ XΧХꓫ YΥУҮꓬ ZΖᏃꓜ ГΓ ПΠ ФΦ "
    "aаαɑ cсϲ dԁ eе gցɡ hһհ iіι jјϳ lӏ nո oоοօ pрρ qԛ sѕ uυս vνѵ wԝ xх yуγү кκ"
)
#: Invisible characters that are not of the category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
JOINED = range(0xFB00, 0xFB07)
#: Signs of numerals that are drawn as letters.
NUMERALS = range(0x2160, 0x2180)
MAX_VOCABULARY = 1_000_000
CACHED_TEXTS = 100_000

_CLASS = {letter: group for group in LOOK_ALIKES.split() for letter in group}


@lru_cache(maxsize=65536)
def units_of(char: str) -> str:
    """The decomposed characters that look like ``char``: none if it is ignorable, one blank for any blank."""
    if char.isspace():
        return " "
    if unicodedata.category(char) == "Cf" or char in INVISIBLE:
        return ""
    kind = unicodedata.decomposition(char).partition(" ")[0]
    if kind in ("<wide>", "<narrow>") or ord(char) in JOINED or ord(char) in NUMERALS:
        char = unicodedata.normalize("NFKC", char)
    return unicodedata.normalize("NFD", char)


def decompose(text: str) -> str:
    """``text`` in decomposed characters, without ignorables, blanks made single and cut at the ends."""
    plain = "".join(map(units_of, unicodedata.normalize("NFD", text)))
    return " ".join(unicodedata.normalize("NFD", plain).split(" ")) if "  " not in plain else " ".join(unicodedata.normalize("NFD", plain).split())


class Node:
    __slots__ = ("edges", "value")

    def __init__(self):
        self.edges: dict[str, Node] = {}
        self.value = None


class LookAlikeTrie:
    """Canonical spellings; ``find`` gives the value of the spelling a text looks like, at the least cost."""

    def __init__(self, spellings: list[tuple[str, object]]):
        self.root = Node()
        self.order = {}
        for text, value in spellings:
            self.order.setdefault(value, len(self.order))
            node = self.root
            for unit in decompose(text).strip():
                node = node.edges.setdefault(unit, Node())
            if node is not self.root and node.value is None:
                node.value = value

    @staticmethod
    def _free(states: dict[Node, int], units: str) -> dict[Node, int]:
        for unit in units:
            nexts: dict[Node, int] = {}
            for node, cost in states.items():
                for same in _CLASS.get(unit, unit):
                    child = node.edges.get(same)
                    if child is not None and cost < nexts.get(child, 1 << 30):
                        nexts[child] = cost
            states = nexts
            if not states:
                break
        return states

    @staticmethod
    def _skips(states: dict[Node, int], most: int) -> dict[Node, int]:
        """Adds the nodes reached by leaving out edges, at 1 each."""
        queue = list(states)
        for node in queue:
            if (cost := states[node] + 1) <= most:
                for child in node.edges.values():
                    if cost < states.get(child, 1 << 30):
                        states[child] = cost
                        queue.append(child)
        return states

    def find(self, text: str, max_cost: int = 0):
        """(value, cost) of the spelling that ``text`` looks like, or None."""
        states, blank = {self.root: 0}, False
        if max_cost:
            states = self._skips(states, max_cost)
        for char in unicodedata.normalize("NFD", text):
            units = units_of(char)
            if not units:
                continue
            if units == " ":
                blank = True
                continue
            if blank and not (len(states) == 1 and self.root in states):
                units = " " + units
            blank = False
            moved = self._free(states, units)
            if max_cost:
                for node, cost in states.items():
                    if cost < max_cost:
                        moved[node] = min(moved.get(node, 1 << 30), cost + 1)
                        for child in node.edges.values():
                            moved[child] = min(moved.get(child, 1 << 30), cost + 1)
                moved = self._skips(moved, max_cost)
            states = moved
            if not states:
                return None
        ends = [(cost, self.order[node.value], node.value) for node, cost in states.items() if node.value is not None and cost <= max_cost]
        return (min(ends)[2], min(ends)[0]) if ends else None


#: Scripts as told apart by look-alike classes.
def _script(char: str) -> str:
    name = unicodedata.name(char, "")
    return name.split(" ")[0] if name else ""


def by_table(token: str) -> str:
    """A token in composed characters of ordinary width, its look-alike letters in the script most of its letters have."""
    units = decompose(token)
    scripts = Counter(s for u in units if u.isalpha() and u not in _CLASS and (s := _script(u)))
    scripts = scripts or Counter(s for u in units if u.isalpha() and (s := _script(u)))
    if scripts:
        main = max(scripts.items(), key=lambda x: (x[1], x[0] == "LATIN", x[0]))[0]
        units = "".join(next((v for v in _CLASS.get(u, "") if _script(v) == main), u) for u in units)
    return unicodedata.normalize("NFC", units)


class Canonicaliser:
    """The two tries of a vocabulary, with a bounded memory of texts seen."""

    def __init__(self, vocabulary: list[tuple[int, str]]):
        ordered = sorted((t, i) for i, t in vocabulary if t is not None and i is not None)
        by_id = sorted(((i, t) for t, i in ordered))
        self.texts = LookAlikeTrie([(t, (i, t)) for i, t in by_id])
        self.tokens = LookAlikeTrie([(w, w) for w in dict.fromkeys(w for _, t in by_id for w in t.split())])
        self.seen: dict[str, tuple[int | None, str]] = {}

    def match(self, text: str) -> tuple[int, str] | None:
        found = self.texts.find(text)
        return found[0] if found else None

    def __call__(self, text: str, spell: bool) -> tuple[int | None, str | None]:
        key = text if spell else "\0" + text
        known = self.seen.get(key)
        if known is None:
            match = self.match(text)
            if match:
                known = match
            elif spell:
                tokens = decompose(text).split()
                known = (None, " ".join(t[0] if (t := self.tokens.find(w)) else by_table(w) for w in tokens))
            else:
                known = (None, None)
            if len(self.seen) >= CACHED_TEXTS:
                self.seen.clear()
            self.seen[key] = known
        return known


def collect_vocabulary(standard: DataFrame, limit: int = MAX_VOCABULARY) -> list[tuple[int, str]]:
    """The canonical texts: a fixed table whose size is checked before it is shipped."""
    rows = standard.select("std_id", "std_text").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} canonical texts")
    return [(r[0], r[1]) for r in rows]


def canonical_texts(texts: DataFrame, standard: DataFrame, text: str = "text", spell: bool = True) -> DataFrame:
    """``texts`` with ``std_id`` (of the canonical text it looks like, else null) and ``canonical`` (its one spelling).

    One pass, no shuffle. With ``spell`` false, texts that match nothing get no spelling, which saves their tokens' walk.
    """
    spark = texts.sparkSession
    shipped = spark.sparkContext.broadcast(collect_vocabulary(standard))
    schema = "std_id long, canonical string"

    @F.pandas_udf(schema)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = Canonicaliser(shipped.value)
        for batch in batches:
            rows = [(None, None) if t is None else find(t, spell) for t in batch]
            yield pd.DataFrame({"std_id": pd.array([r[0] for r in rows], "Int64"), "canonical": [r[1] for r in rows]})

    return texts.withColumn("_look", look(F.col(text))).select(*texts.columns, "_look.std_id", "_look.canonical")


def survey_texts(records: DataFrame) -> DataFrame:
    """record_id, slot_no, text: question_text as slot 0, the k-th category's label as slot k; nulls left out."""
    slots = F.concat(F.array(F.col("question_text")), F.coalesce(F.transform("categories", lambda c: c["label"]), F.array().cast("array<string>")))
    return spread(records.select("record_id", "question_text", "categories")).select("record_id", F.posexplode(slots).alias("slot_no", "text")).filter("text is not null").select("record_id", "slot_no", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    standard = read_table(spark, sf_dir, "standard_texts")
    found = canonical_texts(survey_texts(read_table(spark, sf_dir, "variable_records")), standard, spell=False)
    return found.filter("std_id is not null and text != canonical").select("record_id", "slot_no", "std_id")


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    standard = read_table(spark, sf_dir, "standard_texts")
    return canonical_texts(survey_texts(read_table(spark, sf_dir, "variable_records")), standard).select("record_id", "slot_no", "std_id", "canonical")


QUERIES = {"p1_found": p1_found, "p1_canonical": p1_canonical}
SQL: dict[str, str] = {}
