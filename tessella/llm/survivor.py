"""One surviving record for each group of records that describe one variable.

Every field is voted for by the group's records. The texts of TEXTS are voted for token by token: the distinct values of a
group are aligned progressively (heaviest first) into columns, each column votes with the values' weights, and the
existing value closest to the winning tokens is emitted. A value that can't be parted (a record as best, a list of
categories, a page) stands as its record's id, a single token: ids are aligned into one column and voted for by the same
steps, a vote weighing its place in the order that the field is trusted in.

Ids are elected in shards of SHARD votes at most and about half of it, and those elected in turn, so a group that holds a third of
all rows is many tasks' work. Texts are aligned in
shards of SHARD values at most and about half of it, whose profiles (one row a shard, as long as a text) are aligned in
turn, level by level; a group of up to SHARD values is one shard. Each shard then gives its value closest to the
consensus, and the closest of these is chosen. No task collects an unbounded group. Texts of any length are aligned, long
ones in the memory of a table of the root of their length, with the same result.

Cases: rows without survey_id or with a raw_name that has none of a-z and 0-9 belong to no group; a field that is null in
all records stays null; ties go to the heavier, then the smaller text; null, NaN or outlying confidences weigh least;
null received_at is oldest; repeated rows count as further records; a group without usable categories or page has null
there (0 as the record's id); extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import cut_lineage, read_table

#: Fields that are voted for token by token, and those taken from the most trusted record that has them.
TEXTS = ("raw_name", "label", "question_text", "universe", "skip_condition_raw")
SINGLE = ("data_type", "module", "unit_of_analysis", "numeric_range")
SHARD = 48
#: A value's weight: its records' confidences plus this, so that values without confidence vote too.
BASE_WEIGHT = 0.5
#: Tokens of two texts whose table of token pairs is kept whole.
MOST_TOKENS = 4000
#: Fixed scores of an alignment: a column against a gap; two columns without and with all votes in common.
GAP, APART, TOGETHER = -0.4, -0.6, 1.0

KEYS = ["survey_id", "name_key"]
Profile = list[dict[str, float]]


def _shared_votes(profile: Profile, other: Profile):
    """A function of i: for each column of ``other``, the share of votes it has in common with column i of ``profile``."""
    total = np.array([sum(c.values()) for c in other])
    places: dict[str, tuple[list[int], list[float]]] = {}
    for j, column in enumerate(other):
        for token, votes in column.items():
            at, share = places.setdefault(token, ([], []))
            at.append(j)
            share.append(votes / total[j])
    index = {t: (np.array(at), np.array(share)) for t, (at, share) in places.items()}

    def row(i: int) -> np.ndarray:
        out = np.zeros(len(other))
        own = sum(profile[i].values())
        for token, votes in profile[i].items():
            if token in index:
                at, share = index[token]
                out[at] += votes / own * share
        return out

    return row


def align(profile: Profile, other: Profile) -> Profile:
    """Merges two profiles: global alignment in which two columns score the share of votes they have in common."""
    n, m = len(profile), len(other)
    if n == m and all(max(a, key=a.get) == max(b, key=b.get) for a, b in zip(profile, other)):
        pairs = [(i, i) for i in range(n)]
    else:
        common = _shared_votes(profile, other)
        ramp = GAP * np.arange(m + 1)
        # A table of long texts isn't kept: each step-th row is, and the rows between are made again on the way back.
        step = max(n, 1) if n * m <= MOST_TOKENS**2 else isqrt(n) + 1

        def below(i: int, above: np.ndarray) -> np.ndarray:
            """Row i of the table; gaps within a row run on at one rate, so their best start is a running maximum."""
            row = np.empty(m + 1)
            row[0] = i * GAP
            row[1:] = np.maximum(above[:-1] + APART + (TOGETHER - APART) * common(i - 1), above[1:] + GAP)
            return np.maximum.accumulate(row - ramp) + ramp

        row = ramp
        marks = [row]
        for i in range(1, (n - 1) // step * step + 1):
            row = below(i, row)
            if i % step == 0:
                marks.append(row)
        pairs, i, j, base, score = [], n, m, n, []
        seen, own = -1, None
        while i or j:
            if i and i <= base:
                base = (i - 1) // step * step
                score = [marks[base // step]]
                for k in range(base + 1, i + 1):
                    score.append(below(k, score[-1]))
            if i and j:
                if seen != i:
                    seen, own = i, common(i - 1)
                if abs(score[i - base][j] - (score[i - 1 - base][j - 1] + APART + (TOGETHER - APART) * own[j - 1])) < 1e-9:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
                    continue
            if i and abs(score[i - base][j] - (score[i - 1 - base][j] + GAP)) < 1e-9:
                i -= 1
                pairs.append((i, None))
            else:
                j -= 1
                pairs.append((None, j))
        pairs.reverse()
    total_a = max((sum(c.values()) for c in profile), default=0.0)
    total_b = max((sum(c.values()) for c in other), default=0.0)
    out: Profile = []
    for i, j in pairs:
        column: dict[str, float] = {}
        for source, k, total in ((profile, i, total_a), (other, j, total_b)):
            for token, weight in (source[k] if k is not None else {"": total}).items():
                column[token] = column.get(token, 0.0) + weight
        out.append(column)
    return out


def profile_of(value: str, weight: float) -> Profile:
    return [{token: weight} for token in value.split()]


def consensus(profile: Profile) -> list[str]:
    """The winning token of each column, columns in which the gap wins left out; ties to the smaller token."""
    winners = (min(c, key=lambda t: (-c[t], t)) for c in profile)
    return [t for t in winners if t]


def distance(value: str, tokens: list[str]) -> int:
    """Token edit distance."""
    a = value.split()
    if a == tokens:
        return 0
    known = {t: np.array([x == t for x in tokens]) for t in set(a)}
    ramp = np.arange(len(tokens) + 1)
    row = ramp
    for i, x in enumerate(a, 1):
        best = np.empty(len(tokens) + 1, np.int64)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + ~known[x])
        row = np.minimum.accumulate(best - ramp) + ramp
    return int(row[-1])


def least_distance(value: str, tokens: list[str]) -> int:
    """What the edit distance is at least: tokens that one side has more of."""
    a = value.split()
    left = dict.fromkeys(tokens, 0)
    for t in tokens:
        left[t] += 1
    both = 0
    for t in a:
        if left.get(t):
            left[t] -= 1
            both += 1
    return max(len(a), len(tokens)) - both


def _merged(profiles: list[Profile]) -> Profile:
    return reduce(align, profiles)


def merged_values(values: list[str], weights: list[float]) -> Profile:
    order = sorted(range(len(values)), key=lambda i: (-weights[i], values[i]))
    return _merged([profile_of(values[i], weights[i]) for i in order])


def nearest(values: list[str], weights: list[float], tokens: list[str]) -> tuple[int, float, str]:
    """(distance, -weight, value) of the value closest to the consensus; values that can't be closer aren't measured."""
    best = None
    for least, negative, value in sorted((least_distance(v, tokens), -w, v) for v, w in zip(values, weights)):
        if best is not None and (least, negative, value) > best:
            break
        mine = (distance(value, tokens), negative, value)
        if best is None or mine < best:
            best = mine
    return best


def closest(values: list[str], weights: list[float]) -> str:
    """The existing value closest to the consensus of a group that is one shard."""
    return nearest(values, weights, consensus(merged_values(values, weights)))[2]


def _votes(cell) -> tuple[list[str], list[float]]:
    return [v["value"] for v in cell], [v["weight"] for v in cell]


def _profiles_of_votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda cell: json.dumps(merged_values(*_votes(cell)), ensure_ascii=False))


def _profile_of_profiles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(cell):
        order = sorted(cell, key=lambda p: (-p["weight"], p["profile"]))
        return json.dumps(_merged([json.loads(p["profile"]) for p in order]), ensure_ascii=False)

    for batch in batches:
        yield batch.map(one)


def _nearest_of_shard(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for votes, profiles in batches:
        rows = [nearest(*_votes(cell), consensus(json.loads(p))) for cell, p in zip(votes, profiles)]
        yield pd.DataFrame(rows, columns=["d", "w", "value"])


def name_key(raw_name: Column) -> Column:
    return F.regexp_replace(F.lower(raw_name), "[^a-z0-9]", "")


def choose_values(values: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``chosen`` (the value closest to the group's consensus) and ``voters`` from distinct (keys, value, weight).

    Groups of all sizes go one way: shards by the value's hash, one for up to SHARD values; null values don't vote.
    """
    sizes = values.filter("value is not null").groupBy(*keys).agg(F.count("*").alias("n_values"))
    parts = F.when(F.col("n_values") <= SHARD, F.lit(1)).otherwise(F.ceil(F.col("n_values") / (SHARD // 2))).cast("long")
    placed = values.filter("value is not null").join(sizes.select(*keys, parts.alias("parts"), "n_values"), keys).withColumn("shard", F.pmod(F.xxhash64("value"), F.col("parts")))
    shards = cut_lineage(placed.groupBy(*keys, "parts", "n_values", "shard").agg(F.collect_list(F.struct("value", "weight")).alias("votes"), F.sum("weight").alias("total")))
    level = shards.select(*keys, "parts", "shard", F.col("total").alias("weight"), F.pandas_udf(_profiles_of_votes, "string")("votes").alias("profile"))
    most = shards.agg(F.max("parts")).first()[0] or 1
    done = level.filter("parts = 1").select(*keys, "profile")
    level = level.filter("parts > 1")
    while most > 1:
        level = level.withColumn("shard", F.floor(F.col("shard") / SHARD)).withColumn("parts", F.ceil(F.col("parts") / SHARD))
        packed = level.groupBy(*keys, "parts", "shard").agg(F.collect_list(F.struct("weight", "profile")).alias("profiles"), F.sum("weight").alias("weight"))
        level = cut_lineage(packed.select(*keys, "parts", "shard", "weight", F.pandas_udf(_profile_of_profiles, "string")("profiles").alias("profile")))
        done = done.unionByName(level.filter("parts = 1").select(*keys, "profile"))
        level = level.filter("parts > 1")
        most = -(-most // SHARD)
    near = F.pandas_udf(_nearest_of_shard, "d long, w double, value string")
    best = shards.join(done, keys).select(*keys, "n_values", near("votes", "profile").alias("n"))
    return best.groupBy(*keys).agg(F.min("n")["value"].alias("chosen"), F.max("n_values").cast("int").alias("voters"))


def usable_codes() -> Column:
    """Distinct codes of options that have a code and a label."""
    coded = F.filter("categories", lambda c: (F.length(c["code"]["s"]) > 0) & (F.length(F.trim(c["label"])) > 0))
    return F.coalesce(F.size(F.array_distinct(F.transform(coded, lambda c: c["code"]["s"]))), F.lit(0))


def keyed_records(records: DataFrame) -> DataFrame:
    """Records that belong to a group, with what their votes weigh: trust, n_codes, has_page."""
    confidence = F.col("extraction_confidence")
    trusted = F.when(~F.isnan(confidence) & confidence.between(0, 1), confidence)
    told = {
        "name_key": name_key(F.col("raw_name")),
        "record_id": F.col("record_id").cast("long"),
        "trust": F.coalesce(trusted, F.lit(-1.0)),
        "n_codes": usable_codes(),
        "has_page": F.coalesce(F.col("source_page"), F.lit(-1)) >= 0,
    }
    return records.filter("survey_id is not null").withColumns(told).filter("name_key != ''")


def elected(votes: list[dict], order: tuple[str, ...]) -> dict | None:
    """The vote whose record is chosen by the consensus of the records' ids.

    An id is a text of one token, so all ids align into one column; a vote weighs its place in ``order`` (null lowest, then
    the smaller id), the column's heaviest token is the consensus, and the existing id closest to it is emitted.
    """
    place = lambda v: (*((v[c] is not None, v[c]) for c in order), -v["id"])
    by_id: dict[str, dict] = {}
    for v in votes:
        if (own := str(v["id"])) not in by_id or place(by_id[own]) < place(v):
            by_id[own] = v
    if not by_id:
        return None
    values = sorted(by_id, key=lambda i: place(by_id[i]))
    return by_id[closest(values, [float(n) for n in range(1, len(values) + 1)])]


#: What decides each elected field, in order; the smaller record id is last.
ORDERS = {"best": ("trust", "received_at"), "categories": ("n_codes", "trust", "received_at"), "page": ("received_at",)}


def _elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard's votes (the last column), those elected for each field."""
    for batch in batches:
        votes = batch.column("votes")
        cells = votes.to_pylist()
        told = [pa.array([elected([v[f] for v in cell if v[f] is not None], order) for cell in cells], votes.type.value_type.field(f).type) for f, order in ORDERS.items()]
        keys = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *told], [*keys, *ORDERS])


def elected_records(records: DataFrame) -> DataFrame:
    """``survey_id, name_key, n_records, best_record_id, categories_record_id, page_record_id`` of groups of two or more.

    Ids are aligned and voted for in shards of about SHARD; those elected are the votes of the next level.
    """
    votes = keyed_records(records).select(*KEYS, "record_id", "trust", "received_at", "n_codes", "has_page")
    vote = lambda field: F.struct(*ORDERS[field], F.col("record_id").alias("id"))
    # A row for each record: rows that are repeated can't fill a shard.
    ids = votes.groupBy(*KEYS, "record_id").agg(
        F.count("*").alias("n"),
        F.max(vote("best")).alias("best"),
        F.max(F.when(F.col("n_codes") > 0, vote("categories"))).alias("categories"),
        F.max(F.when(F.col("has_page"), vote("page"))).alias("page"),
    )
    groups = ids.groupBy(*KEYS).agg(F.sum("n").alias("n_records"), F.count("*").alias("n_ids")).filter("n_records >= 2")
    parts = F.when(F.col("n_ids") <= SHARD, F.lit(1)).otherwise(F.ceil(F.col("n_ids") / (SHARD // 2))).cast("long")
    level = ids.drop("n").join(groups.hint("merge"), KEYS).withColumn("parts", parts).withColumn("shard", F.pmod(F.xxhash64("record_id"), F.col("parts")))
    shard = [*KEYS, "n_records", "parts", "shard"]
    done, most = [], None
    while most is None or most > 1:
        gathered = level.groupBy(*shard).agg(F.collect_list(F.struct(*ORDERS)).alias("votes"))
        kinds = dict(level.dtypes)
        voted = cut_lineage(gathered.mapInArrow(_elect, ", ".join(f"{c} {kinds[c]}" for c in [*shard, *ORDERS])))
        most = voted.agg(F.max("parts")).first()[0] or 1
        done.append(voted.filter("parts = 1"))
        level = voted.filter("parts > 1").withColumn("parts", F.ceil(F.col("parts") / SHARD)).withColumn("shard", F.pmod("shard", F.col("parts")))
    of = lambda field: F.coalesce(F.col(field)["id"], F.lit(0).cast("long")).alias(f"{field}_record_id")
    return reduce(DataFrame.unionAll, done).select(*KEYS, "n_records", *map(of, ORDERS))


def survivors(records: DataFrame) -> DataFrame:
    """One whole record for each (survey_id, name_key) of two or more records, filled field by field.

    TEXTS by consensus; categories and source_page of the records elected for them; extraction_confidence of the best
    record; SINGLE of the most trusted record that has a value; the latest received_at; needs_review if any record needs
    it; the review_reasons of all records, each once. Fields that the records don't have are left out.
    """
    groups = cut_lineage(elected_records(records))
    texts, single = ([f for f in fields if f in records.columns] for fields in (TEXTS, SINGLE))
    keyed = keyed_records(records).withColumn("order", F.struct("trust", "received_at", (-F.col("record_id")).alias("id"))).join(groups, KEYS)
    votes = (
        keyed.select(*KEYS, F.posexplode(F.array(*texts)).alias("field", "value"), (F.greatest("trust", F.lit(0.0)) + BASE_WEIGHT).alias("weight"))
        .groupBy(*KEYS, "field", "value")
        .agg(F.round(F.sum("weight"), 9).alias("weight"))
    )
    chosen = choose_values(votes, [*KEYS, "field"])
    parts = [chosen.groupBy(*KEYS).agg(*(F.max(F.when(F.col("field") == i, F.col("chosen"))).alias(f) for i, f in enumerate(texts)))]
    of = lambda elected, field: F.min(F.when(F.col("record_id") == F.col(elected), F.col(field))).alias(field)
    taken = [of("categories_record_id", "categories"), of("page_record_id", "source_page"), of("best_record_id", "extraction_confidence"), F.max("received_at").alias("received_at")]
    taken += [F.max(F.when(F.col(f).isNotNull(), F.struct("order", F.col(f).alias("v"))))["v"].alias(f) for f in single]
    if "needs_review" in records.columns:
        taken.append(F.bool_or("needs_review").alias("needs_review"))
    parts.append(keyed.groupBy(*KEYS).agg(*taken))
    if "review_reasons" in records.columns:
        # A few fixed codes, so a group's set is small whatever its size.
        parts.append(keyed.select(*KEYS, F.explode("review_reasons").alias("reason")).groupBy(*KEYS).agg(F.sort_array(F.collect_set("reason")).alias("review_reasons")))
    return reduce(lambda left, right: left.join(right, KEYS, "left"), parts, groups)


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(read_table(spark, sf_dir, "variable_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records elected by the consensus of their ids (see above)."""
    return elected_records(read_table(spark, sf_dir, "variable_records")).drop("n_records")


SQL = {
    "p5_found": """
with k as (
  select survey_id, regexp_replace(lower(raw_name), '[^a-z0-9]', '', 'g') as name_key, record_id, received_at,
    case when extraction_confidence between 0 and 1 and not isnan(extraction_confidence) then extraction_confidence else -1 end as trust,
    coalesce(len(list_distinct(list_transform(list_filter(categories, lambda c: length(c.code.s) > 0 and length(trim(c.label, ' ')) > 0), lambda c: c.code.s))), 0) as n_codes,
    coalesce(source_page >= 0, false) as has_page
  from variable_records where survey_id is not null and raw_name is not null),
r as (
  select *, row_number() over (partition by survey_id, name_key order by trust desc, received_at desc nulls last, record_id) as rb,
    row_number() over (partition by survey_id, name_key order by n_codes desc, trust desc, received_at desc nulls last, record_id) as rc,
    row_number() over (partition by survey_id, name_key order by has_page desc, received_at desc nulls last, record_id) as rp,
    count(*) over (partition by survey_id, name_key) as n
  from k where name_key <> '')
select survey_id, name_key, max(case when rb = 1 then record_id end) as best_record_id,
  max(case when rc = 1 then case when n_codes > 0 then record_id else 0 end end) as categories_record_id,
  max(case when rp = 1 then case when has_page then record_id else 0 end end) as page_record_id
from r where n >= 2 group by survey_id, name_key
"""
}
QUERIES = {"p5_found": p5_found, "p5_survivors": p5_survivors}
