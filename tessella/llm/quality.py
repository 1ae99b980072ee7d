"""Per-document text statistics and, from them, the form of a document: prose, list, table or junk.

Gradient-boosted trees (histogram splits, softmax over the forms) are trained on the statistics of a bounded sample of
SAMPLE_ROWS documents, labelled weakly by what kind of lines fills most of their characters. The trees don't see the
statistics that the weak label is made of (TOLD): they tell the form by the others, so that a document whose lines are
taken for the wrong kind can still be told right. Their scores are then calibrated on a holdout of at most HOLDOUT_ROWS
hand-checked documents (a scale and an offset a form). The bounds are parameters; statistics and forms are computed for
every document, over its whole text.

Cases: null, empty and blank texts have statistics of 0 and no form (null); documents of any length are taken whole;
labels that are null, unknown, or contradict another label of the document are no holdout; without any holdout the
scores stay uncalibrated; with fewer than LEAST_SAMPLE documents (a split needs two leaves) or two weak forms to train on
the line shares decide; repeated rows give repeated rows; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import read_table, spread

FORMS = ("prose", "list", "table", "junk")
SAMPLE_ROWS = 6_000
HOLDOUT_ROWS = 6_000
ROUNDS, DEPTH, RATE, BINS, LEAF = 40, 3, 0.25, 32, 8
LEAST_SAMPLE = 2 * LEAF
MAX_WORDS = 1_000_000
#: A lead-in of a sentence or two has at most so many characters, and what follows at least this share of all.
LEAD_CHARS, LEAST_AFTER_LEAD = 260, 0.25

#: What begins the line of a list or of a questionnaire printed item by item (a mark, a number, an item's
#: code, a word in capitals before a name, a word or two and a colon); what a line of prose ends with.
_MARKED = re.compile(
    r"(?:[-*•▪◦‣·+–—]\s+|\[[ xX]?\]\s*|[☐☑]\s*\w|\(?\d{1,3}[.)]\s*|\d{1,3}\s+[^\W\d_]|\d{1,3}[^\W\d_]|\(?[a-zа-я]\)\s*|[a-zа-я]\.\s"
    r"|[a-z]\d+[a-z]\d+\b|[^\W\d_]{1,2}\d+[a-z]?\b(?![;,\t]|\s{2})|[A-Z]{4,12}\s+[A-Z\d]|[^\W\d_]+(?:\s[^\W\d_]+)?\s?:\s)"
)
_END = tuple(".!?…。\"»”)")
_GAP = re.compile(r"\S\s{2,}\S")
_TIGHT = re.compile(r"[,;](?=\S|$)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CODE = re.compile(r"\b(?=[a-z0-9]*\d)(?=[a-z0-9]*[a-z])[a-f0-9]{4,}\b|\b\d{4,}\b")
_SENTENCE = re.compile(r"[.!?…]+(?:\s|$)")
_LINES = re.compile(r"\r\n|[\n\r\x85\u2028\u2029]")
#: Vowels; words of letters without them are no words.
_VOWELS = "aeiouyáéíóúàèùâêîôûëïüаеёиоуыэюя0123456789"
_MARKUP = re.compile(r"<\|?[^<>|\s]{1,30}\|?>")
#: Words and characters of a list's item without a mark, and such items in a row, at least.
ITEM_WORDS, ITEM_CHARS, ITEMS = 9, 75, 3


class _Classes(dict):
    """Character to class: letter a, capital A, digit 9, blank, line end, tab, sentence end ., comma, noise #, other symbol $, mojibake m."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code in (0xA, 0xD, 0x85, 0x2028, 0x2029):
            k = "\n"
        elif c == "\t":
            k = "\t"
        elif 0x80 <= code < 0xA0 or c in "ÐÑÃÂ":
            k = "m"
        elif c.isspace():
            k = " "
        elif c.isdigit():
            k = "9"
        elif c.isupper():
            k = "A"
        elif c.isalnum():
            k = "a"
        elif c in ".!?…":
            k = "."
        elif c in ",;:'\"()«»“”’‘¿¡-–—/%":
            k = ","
        elif c in "|~^#_=@\\<>{}\ufffd":
            k = "#"
        else:
            k = "$"
        self[code] = k
        return k


_CLASSES = _Classes()

STATISTICS = (
    "n_chars", "n_words", "n_lines", "mean_word_length", "mean_line_length", "symbol_ratio", "digit_ratio", "upper_ratio", "space_ratio",
    "ended_line_share", "common_word_share", "distinct_word_share", "longest_word", "sentences_per_100_words", "mojibake_ratio",
    "list_share", "table_share", "junk_share", "prose_share", "marked_line_share", "tight_delimiters_per_line", "letters_only_share", "short_line_share", "prose_sentences",
)

#: Statistics that the weak label is made of, and the places of the others, which the trees are grown on.
TOLD = ("list_share", "table_share", "junk_share", "prose_share", "prose_sentences")
FEATURES = [n for n, s in enumerate(STATISTICS) if s not in TOLD]


def line_kind(line: str, classes: str) -> int:
    """Index in FORMS of what a stripped, non-blank line looks like; ``classes`` are those of its characters."""
    n = len(line)
    ink = n - classes.count(" ") - classes.count("\t")
    alnum = ink - classes.count(".") - classes.count(",") - classes.count("#") - classes.count("$")
    pipes = line.count("|")
    framed = pipes and line[0] == "|" and line[-1] == "|" and pipes > 1
    if framed and alnum < 0.3 * ink and not line.strip("|-: "):
        return 2
    if classes.count("m") > 0.08 * n:
        return 3
    # Marks inside words, in the place of letters.
    noise = classes.count("#") - (pipes if framed else line.count(" | ") if pipes else 0)
    if "<" in line and noise:
        noise -= sum(m.count("<") + m.count(">") + m.count("|") + m.count("_") for m in _MARKUP.findall(line))
    noise += classes.count("a.a") + (classes.count("a,a") - line.count(",") - line.count(";") - line.count("-") - line.count("'") - line.count("’") - line.count("/") if ":" in line else 0)
    if noise > 0.07 * ink:
        return 3
    if (noise or pipes) and not framed and alnum > 8 and sum(map(line.lower().count, _VOWELS)) < 0.18 * alnum:
        return 3
    if framed or pipes and " | " in line:
        return 2
    if "\t" in line:
        return 2
    if line[-1] not in ".!?" and _GAP.search(line) and alnum >= 0.3 * ink:
        return 2
    tight = len(_TIGHT.findall(line))
    if tight and tight >= 0.7 * (line.count(",") + line.count(";")) and n <= 32 * (tight + 1) and not (tight == 1 and line[-1] in ",;"):
        return 2
    if alnum < 0.4 * ink and (not _MARKED.match(line) or alnum < 0.2 * ink):
        return 3
    if n > 30 and " " not in line:
        return 3
    if classes.count("9") > 0.2 * ink and sum(map(len, _CODE.findall(line))) > 0.5 * ink:
        return 3
    if _MARKED.match(line) and (not line[0].isdigit() or line[-1] not in ".!?" or n < 80):
        return 1
    return 0


def statistics(text: str | None, common: frozenset) -> list[float]:
    """STATISTICS of one text."""
    if text is None or not text.strip():
        return [float(len(text or ""))] + [0.0] * (len(STATISTICS) - 1)
    n = len(text)
    classes = text.translate(_CLASSES)
    words = _WORD.findall(text.lower())
    count = len(words)
    letters = sum(map(len, words))
    chars = [0, 0, 0, 0]
    n_lines = marked = tight = ended = short = sentences = 0
    previous = at = 0
    items = [0, 0]  # lines that may be items without a mark, in a row: how many, their characters

    def settle():
        if items[0] >= ITEMS:
            chars[0] -= items[1]
            chars[1] += items[1]
        items[:] = [0, 0]

    for raw in _LINES.split(text):
        line = raw.strip()
        size = len(line)
        if size:
            start = at + raw.index(line[0]) if raw[0] != line[0] else at
            kind = line_kind(line, classes[start : start + size])
            # The last, shorter line of an unbroken code block.
            if previous == 3 and kind != 3 and " " not in line and size > 8:
                kind = 3
            chars[kind] += size
            previous = kind
            if kind == 0:
                sentences += len(_SENTENCE.findall(line))
            if kind == 0 and size <= ITEM_CHARS and line[-1] not in ".!?…:,;" and line.count(" ") < ITEM_WORDS and ". " not in line:
                items[0] += 1
                items[1] += size
            elif items[0] and kind != 1:
                settle()
            n_lines += 1
            marked += kind == 1
            tight += line.count(",") + line.count(";") - line.count(", ") - line.count("; ")
            ended += line.endswith(_END)
            short += size < 60
        at += len(raw) + (2 if text.startswith("\r\n", at + len(raw)) else 1)
    settle()
    total = sum(chars)
    distinct = len(set(words))
    # The same few words over and over; of lines that look like a list's or a table's, even fewer.
    few = 14 if chars[1] + chars[2] < 0.5 * total or n_lines < 4 else 5
    if count >= 20 and distinct < 0.25 * count and distinct <= few:
        chars = [0, 0, 0, total]
    digits = classes.count("9")
    return [
        float(n), float(count), float(n_lines), letters / count if count else 0.0, total / n_lines, (classes.count("#") + classes.count("$")) / n,
        digits / n, classes.count("A") / n, classes.count(" ") / n, ended / n_lines, sum(map(common.__contains__, words)) / count if count else 0.0,
        distinct / count if count else 0.0, float(max(map(len, words), default=0)), 100.0 * len(_SENTENCE.findall(text)) / count if count else 0.0,
        classes.count("m") / n, chars[1] / total, chars[2] / total, chars[3] / total, chars[0] / total, marked / n_lines, tight / n_lines,
        letters / n, short / n_lines, float(sentences),
    ]


class Trees:
    """Softmax gradient boosting with histogram splits, and a scale and an offset a form once calibrated."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.rounds: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.scale, self.offset = np.ones(len(FORMS)), np.zeros(len(FORMS))
        self.prior = np.zeros(len(FORMS))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete tree of DEPTH levels: (feature, bin) of inner nodes, values of leaves."""
        inner = 2**DEPTH - 1
        feature, cut = np.zeros(inner, int), np.full(inner, BINS + 1)
        node = np.zeros(len(b), int)
        width = BINS + 1
        for level in range(DEPTH):
            start = 2**level - 1
            for k in range(start, 2 * start + 1):
                here = np.flatnonzero(node == k)
                if len(here) < 2 * LEAF:
                    continue
                flat = (b[here] + np.arange(b.shape[1]) * width).ravel()
                size = b.shape[1] * width
                sums = [np.bincount(flat, np.repeat(w[here], b.shape[1]), size).reshape(-1, width).cumsum(1) for w in (g, h, np.ones(len(b)))]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(nl < LEAF) | (nt - nl < LEAF)] = -1
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[k], cut[k] = divmod(best, width)
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - inner
        value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        return feature, cut, value

    @staticmethod
    def _leaves(b: np.ndarray, tree) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        rows = np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return value[node - (2**DEPTH - 1)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b, one = self._binned(x), np.eye(len(FORMS))[y]
        self.prior = np.log((one.sum(0) + 1) / (len(y) + len(FORMS)))
        score = np.tile(self.prior, (len(y), 1))
        for _ in range(ROUNDS):
            p = _softmax(score)
            trees = [self._grow(b, p[:, k] - one[:, k], p[:, k] * (1 - p[:, k])) for k in range(len(FORMS))]
            self.rounds.append(trees)
            for k, tree in enumerate(trees):
                score[:, k] += RATE * self._leaves(b, tree)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        score = np.tile(self.prior, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                score[:, k] += RATE * self._leaves(b, tree)
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Scale and offset of each form's score by gradient descent on the holdout's log loss, drawn towards (1, 0)."""
        s, one = self.scores(x), np.eye(len(FORMS))[y]
        for _ in range(400):
            d = (_softmax(s * self.scale + self.offset) - one) / len(y)
            self.scale = np.clip(self.scale - 0.3 * ((d * s).sum(0) + 0.01 * (self.scale - 1)), 0.05, 3)
            self.offset -= 0.3 * (d.sum(0) + 0.01 * self.offset)
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.scores(x) * self.scale + self.offset)


class LineShares:
    """Stands in for trees where a sample is too small to grow them: the weak form, and the shares."""

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        shares = _shares(x)
        return 0.6 * np.eye(len(FORMS))[weak_forms(x)] + 0.4 * shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-9)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _shares(x: np.ndarray) -> np.ndarray:
    at = [STATISTICS.index(f"{form}_share") for form in FORMS]
    return x[:, at]


def weak_forms(x: np.ndarray) -> np.ndarray:
    """What kind of lines fills most characters; a sentence or two that lead in a list or a table don't make it prose."""
    shares = _shares(x)
    sentences, chars = x[:, STATISTICS.index("prose_sentences")], x[:, 0] * shares[:, 0]
    lead = (sentences >= 1) & (sentences <= 2) & (chars <= LEAD_CHARS) & (1 - shares[:, 0] >= LEAST_AFTER_LEAD)
    return np.where(lead, shares[:, 1:].argmax(axis=1) + 1, shares.argmax(axis=1))


def collect_common(word_list: DataFrame) -> frozenset:
    """The common words: a fixed table, its size checked before it is shipped."""
    rows = word_list.filter("is_common").select(F.lower("word").alias("w")).distinct().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} common words")
    return frozenset(r[0] for r in rows if r[0])


def _map_statistics(common: frozenset, finish):
    """Arrow function: statistics of (key, text, ...), given to ``finish`` with the batch's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.array([statistics(t.as_py(), common) for t in batch.column(1)])
                yield finish(batch, x)

    return run


def text_statistics(documents: DataFrame, word_list: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and STATISTICS of every row."""
    kind = documents.schema[key].dataType.simpleString()

    def finish(batch, x):
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["key", *STATISTICS])

    source = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    out = source.mapInArrow(_map_statistics(collect_common(word_list), finish), f"key {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))
    return out.withColumnRenamed("key", key)


def train(documents: DataFrame, labels: DataFrame, common: frozenset, sample_rows: int = SAMPLE_ROWS, holdout_rows: int = HOLDOUT_ROWS):
    """Trees fitted on a sample of weakly labelled documents and calibrated on hand-checked ones."""
    checked = labels.filter(F.col("doc_form").isin(*FORMS)).groupBy("doc_id").agg(F.min("doc_form").alias("form"), F.max("doc_form").alias("other")).filter("form = other")
    checked = checked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(holdout_rows).select("doc_id", "form")
    total = max(documents.count(), 1)
    share = min(1.0, 1.3 * sample_rows / total + 20 / total)
    chosen = (
        documents.select("doc_id", "text").join(F.broadcast(checked), "doc_id", "left")
        .withColumn("draw", F.xxhash64("doc_id", F.lit(17)))
        .filter((F.col("form").isNotNull() | (F.pmod("draw", F.lit(1_000_000)) < int(share * 1_000_000))) & (F.length(F.trim("text")) > 0))
        .select("draw", "text", "form")
    )

    def finish(batch, x):
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat], ["draw", "form", "x"])

    rows = chosen.mapInArrow(_map_statistics(common, finish), "draw long, form string, x array<double>")
    rows = rows.orderBy(F.col("form").isNull(), "draw").limit(holdout_rows + sample_rows).collect()
    rows = [r for r in rows if not (all(v == 0 for v in r["x"][1:]))]
    weak = sorted((r for r in rows if r["form"] is None), key=lambda r: r["draw"])[:sample_rows]
    held = [r for r in rows if r["form"] is not None]
    x = np.array([r["x"] for r in weak] or np.zeros((0, len(STATISTICS))))
    if len(x) < LEAST_SAMPLE or len(set(weak_forms(x))) < 2:
        return LineShares()
    trees = Trees().fit(x[:, FEATURES], weak_forms(x))
    if held:
        trees.calibrate(np.array([r["x"] for r in held])[:, FEATURES], np.array([FORMS.index(r["form"]) for r in held]))
    return trees


def document_forms(documents: DataFrame, labels: DataFrame, word_list: DataFrame) -> DataFrame:
    """``doc_id, doc_form`` and the calibrated probability of each form, for every row."""
    common = collect_common(word_list)
    model = train(documents, labels, common)

    def finish(batch, x):
        p = model.probabilities(x if isinstance(model, LineShares) else x[:, FEATURES])
        blank = (x[:, 1:] == 0).all(axis=1)
        form = [None if b else FORMS[k] for k, b in zip(p.argmax(axis=1), blank)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.string()), *(pa.array(p[:, k], mask=blank) for k in range(len(FORMS)))], ["doc_id", "doc_form", *FORMS])

    kind = documents.schema["doc_id"].dataType.simpleString()
    source = spread(documents.select("doc_id", "text"))
    return source.mapInArrow(_map_statistics(common, finish), f"doc_id {kind}, doc_form string, " + ", ".join(f"{f} double" for f in FORMS))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "word_list"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = document_forms(*(read_table(spark, sf_dir, t) for t in ("documents", "doc_labels", "word_list")))
    return forms.filter("doc_form in ('list', 'table', 'junk')").select("doc_id", "doc_form")


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics}
SQL: dict[str, str] = {}
