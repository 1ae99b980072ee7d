import datetime
import random

from tessella.llm import survivor as S


def test_consensus_outvotes_edits():
    values = ["the owner of the big farm", "the owner of the big frm", "the owner of big farm", "an owner of the big farm too"]
    assert S.closest(values, [1.0, 1.0, 1.0, 1.0]) == values[0]
    assert S.closest(["a b", "c d"], [1.0, 2.0]) == "c d"
    assert S.closest(["b", "a"], [1.0, 1.0]) == "a"
    assert S.closest(["", "x"], [1.0, 1.0]) in ("", "x")


def test_profiles_merge_in_any_shape():
    p = S.align(S.profile_of("a b c", 1.0), S.profile_of("a c", 2.0))
    assert S.consensus(p) == ["a", "c"] and sum(map(len, p)) >= 3
    assert S.align([], S.profile_of("a", 1.0)) and S.align(S.profile_of("a", 1.0), [])


RECORD = "survey_id string, record_id long, raw_name string, extraction_confidence double, received_at timestamp, categories array<struct<code struct<t string, s string>, label string, is_missing boolean>>, source_page int, question_text string, label string"
DAY = datetime.datetime(2021, 1, 1)


def option(code, label):
    return (None if code is None else ("int", code), label, False)


def test_fields(spark):
    t = [DAY + datetime.timedelta(days=n) for n in range(4)]
    rows = [
        ("s", 1, "Q-01", 0.5, t[0], [option("1", "Yes"), option("1", "Yes"), option("2", "  ")], 3, "who owns it", None),
        ("s", 2, "q01", None, t[3], None, -1, "who owns it ?", None),
        ("s", 3, "Q01", 0.9, t[1], [option("1", "a"), option("2", "b"), option("", "c"), option(None, "d"), (None, "e", False)], 0, "who owns it", "lab"),
        ("s", 4, "q 01", 0.9, t[1], [option("1", "a"), option("3", "b")], 0, None, "lab"),
        ("s", 5, "q01", 7.0, None, [], None, "who owns it", "lab"),
        ("s", 6, "??", 0.9, t[1], [], 0, "x", None), ("s", 7, "??", 0.9, t[1], [], 0, "x", None), ("s", 8, None, 0.9, t[1], [], 0, "x", None),
        (None, 9, "q01", 0.9, t[1], [], 0, "x", None), ("u", 10, "only", 0.9, t[1], [], 0, "x", None),
        ("v", 12, "n", float("nan"), None, None, None, None, None), ("v", 11, "N", None, None, None, None, None, None),
    ]
    records = spark.createDataFrame(rows, RECORD).selectExpr("*", "1 as name_key", "2 as trust", "3 as value")
    out = {(r.survey_id, r.name_key): r for r in S.survivors(records).collect()}
    assert set(out) == {("s", "q01"), ("v", "n")}
    r = out["s", "q01"]
    assert (r.n_records, r.best_record_id, r.categories_record_id, r.page_record_id) == (5, 3, 3, 3)
    assert (r.question_text, r.label) == ("who owns it", "lab")
    r = out["v", "n"]
    assert (r.best_record_id, r.categories_record_id, r.page_record_id, r.question_text) == (11, 0, 0, None)
    assert S.survivors(records.limit(0)).count() == 0


def test_hot_group_is_sharded(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 6)
    rng = random.Random(2)
    base = "for how many hours was the owner of the farm paid by the head of the village".split()
    rows = []
    for n in range(300):
        words = list(base)
        words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        rows.append(("g", " ".join(words), 1.0))
    rows += [("g", " ".join(base), 1.0), ("h", "x y", 1.0), ("h", None, 9.0)]
    values = spark.createDataFrame(rows, "k string, value string, weight double").groupBy("k", "value").sum("weight").withColumnRenamed("sum(weight)", "weight")
    out = {r.k: r.chosen for r in S.choose_values(values, ["k"]).collect()}
    assert out == {"g": " ".join(base), "h": "x y"}


def test_long_texts_are_aligned_as_short_ones(monkeypatch):
    import random

    from tessella.llm import survivor

    draw = random.Random(5)
    cases = []
    for _ in range(40):
        base = [draw.choice("abcdefg") for _ in range(draw.randint(1, 25))]
        texts = sorted({" ".join(t for t in base if draw.random() > 0.15) + draw.choice(["", " x", " y z"]) for _ in range(5)})
        cases.append((texts, [draw.choice([0.5, 1.0, 1.25]) for _ in texts]))
    merged = lambda: [survivor._merged([survivor.profile_of(t, w) for t, w in zip(*c)]) for c in cases]
    whole, chosen = merged(), [survivor.closest(*c) for c in cases]
    monkeypatch.setattr(survivor, "MOST_TOKENS", 1)
    assert merged() == whole and [survivor.closest(*c) for c in cases] == chosen


def slow_choice(values, weights):
    """The consensus written out: whole tables, one cell at a time, every value measured."""
    order = sorted(range(len(values)), key=lambda i: (-weights[i], values[i]))
    profile = [{t: weights[order[0]]} for t in values[order[0]].split()]
    for i in order[1:]:
        other = [{t: weights[i]} for t in values[i].split()]
        n, m = len(profile), len(other)
        total = lambda c: sum(c.values())
        same = lambda a, b: sum(v / total(a) * b[t] / total(b) for t, v in a.items() if t in b)
        score = {(0, 0): 0.0}
        for x in range(n + 1):
            for y in range(m + 1):
                if x or y:
                    score[x, y] = max(
                        score[x - 1, y - 1] + 1.6 * same(profile[x - 1], other[y - 1]) - 0.6 if x and y else -1e9,
                        score[x - 1, y] - 0.4 if x else -1e9,
                        score[x, y - 1] - 0.4 if y else -1e9,
                    )
        x, y, columns = n, m, []
        if n == m and all(max(a, key=a.get) == max(b, key=b.get) for a, b in zip(profile, other)):
            columns = [(k, k) for k in reversed(range(n))]
            x = y = 0
        while x or y:
            if x and y and abs(score[x, y] - (score[x - 1, y - 1] + 1.6 * same(profile[x - 1], other[y - 1]) - 0.6)) < 1e-9:
                x, y = x - 1, y - 1
                columns.append((x, y))
            elif x and abs(score[x, y] - (score[x - 1, y] - 0.4)) < 1e-9:
                x -= 1
                columns.append((x, None))
            else:
                y -= 1
                columns.append((None, y))
        whole = [max(map(total, p), default=0.0) for p in (profile, other)]
        merged = []
        for a, b in reversed(columns):
            column = {}
            for source, k, full in ((profile, a, whole[0]), (other, b, whole[1])):
                for t, v in (source[k] if k is not None else {"": full}).items():
                    column[t] = column.get(t, 0.0) + v
            merged.append(column)
        profile = merged
    tokens = [t for t in (min(c, key=lambda t: (-c[t], t)) for c in profile) if t]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            row = _next(row, i, p, b)
        return row[-1]

    def _next(row, i, p, b):
        out = [i]
        for j, q in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (p != q)))
        return out

    return min((edits(v.split(), tokens), -w, v) for v, w in zip(values, weights))[2]


def test_choice_equals_the_consensus_written_out(spark):
    draw = random.Random(17)
    groups = {}
    for g in range(60):
        base = [draw.choice("abcdefgh") for _ in range(draw.randint(1, 14))]
        values = {" ".join(x for t in base if draw.random() > 0.15 for x in ([t] if draw.random() > 0.1 else [t, draw.choice("xyz")])) for _ in range(draw.randint(1, 9))}
        groups[g] = [(v, draw.choice([0.5, 1.0, 1.25, 2.0])) for v in sorted(values)]
    rows = [(g, v, w) for g, members in groups.items() for v, w in members] + [(0, None, 9.0)]
    out = {r.k: r.chosen for r in S.choose_values(spark.createDataFrame(rows, "k long, value string, weight double"), ["k"]).collect()}
    assert out == {g: slow_choice(*map(list, zip(*members))) for g, members in groups.items()}


def test_survivor_is_a_whole_record(spark):
    t = [DAY + datetime.timedelta(days=n) for n in range(3)]
    schema = RECORD + ", universe string, skip_condition_raw string, data_type string, module string, needs_review boolean, review_reasons array<string>"
    yes, both = [option("1", "Yes")], [option("1", "Yes"), option("2", "No")]
    rows = [
        ("s", 1, "Q1", 0.9, t[0], yes, 4, "who owns the farm", None, "all", None, "text", None, False, ["low_confidence"]),
        ("s", 2, "q1", 0.4, t[2], both, 7, "who owns the farm", "Owner", None, "if 2", "other", "Farm", True, None),
        ("s", 3, "q-1", None, t[1], None, None, "who own the farm", "Owner", "all", None, None, "Land", None, ["low_confidence", "model_flagged"]),
    ]
    (r,) = S.survivors(spark.createDataFrame(rows, schema)).collect()
    assert (r.best_record_id, r.categories_record_id, r.page_record_id) == (1, 2, 2)
    assert (r.extraction_confidence, r.source_page, [c.code.s for c in r.categories], r.received_at) == (0.9, 7, ["1", "2"], t[2])
    assert (r.question_text, r.label, r.universe, r.skip_condition_raw, r.data_type, r.module) == ("who owns the farm", "Owner", "all", "if 2", "text", "Farm")
    assert r.needs_review is True and r.review_reasons == ["low_confidence", "model_flagged"]


def test_ids_are_elected_by_the_consensus(monkeypatch):
    aligned = []
    align = S.align
    monkeypatch.setattr(S, "align", lambda x, y: aligned.append((x, y)) or align(x, y))
    rng = random.Random(4)
    day = datetime.datetime(2024, 1, 1)
    for n in (1, 2, 3, 48, 100):
        votes = [{"trust": rng.choice((-1.0, 0.5, 0.9)), "received_at": rng.choice((None, day, day + datetime.timedelta(1))), "id": i} for i in range(90, 90 + n)]
        best = max(votes, key=lambda v: (v["trust"], v["received_at"] or datetime.datetime.min, -v["id"]))
        assert S.elected(votes, S.ORDERS["best"]) == best
    assert len(aligned) == 0 + 1 + 2 + 47 + 99
    assert S.elected([], S.ORDERS["page"]) is None


def test_ids_of_a_hot_group_are_elected_in_levels(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 4)
    rng = random.Random(9)
    rows = [("s", i, "q" if i < 400 else "r", rng.choice((None, 0.2, 0.8)), rng.choice((None, 1, 2)), i % 7 if i % 3 else None, i % 5) for i in (*range(403), 5, 5, 401)]
    records = spark.createDataFrame(rows, "survey_id string, record_id long, raw_name string, extraction_confidence double, day int, source_page int, n int").selectExpr(
        "*", "timestamp_micros(day * 1000000) as received_at", "transform(sequence(0, n), i -> named_struct('code', named_struct('s', string(i)), 'label', if(n = 0, '', 'x'))) as categories"
    )
    trust = lambda r: (r[3] if r[3] is not None else -1, r[4] or 0, -r[1])
    expected = set()
    for name in "qr":
        own = [r for r in rows if r[2] == name]
        coded, paged = [r for r in own if r[6]], [r for r in own if r[5] is not None]
        expected.add(("s", name, len(own), max(own, key=trust)[1], max(coded, key=lambda r: (r[6], *trust(r)))[1], max(paged, key=lambda r: (r[4] or 0, -r[1]))[1]))
    assert {tuple(r) for r in S.elected_records(records).collect()} == expected
