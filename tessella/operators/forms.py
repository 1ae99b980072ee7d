"""Native form definitions (survey, choices and settings sheets) as tables: records, items, transitions, variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import conditions as C
from tessella.functions import text as X
from tessella.operators.ordered import ordered_fold

#: Form types by what becomes of them, functions that expressions may use, and columns a record may have.
TYPES = {
    "integer": "numeric", "decimal": "numeric", "range": "numeric", "text": "text",
    "date": "date", "time": "date", "datetime": "date", "start": "date", "end": "date", "today": "date",
    "select_one": "categorical_single", "select_one_from_file": "categorical_single", "select_multiple": "categorical_multi", "select_multiple_from_file": "categorical_multi",
    "acknowledge": "other", "audio": "other", "barcode": "other", "calculate": "other", "file": "other", "geopoint": "other", "geoshape": "other", "geotrace": "other",
    "hidden": "other", "image": "other", "username": "other", "video": "other",
}
GROUPS = ("group", "repeat")
FUNCTIONS = ("selected", "not", "true", "false")
LOGIC = ("constraint", "calculation", "choice_filter", "repeat_count")
#: Other columns in which a logic column's text may stand.
BOUND = {"constraint": "bind::constraint", "calculation": "bind::calculate"}
CHOICE_BASES = ("select_one", "select_one_from_file", "select_multiple", "select_multiple_from_file")
SHEETS = ("survey", "choices", "settings")
#: What marks the choices of a file; characters of a row that its source span quotes.
FILE, MOST_QUOTE = "file:", 2_000


def header_name(header: Column) -> Column:
    """A sheet's header in one form: trimmed, lower-cased before the language, blanks and hyphens underscores."""
    plain = F.regexp_replace(F.trim(header), r"\s*::\s*", "::")
    key = F.regexp_replace(F.lower(F.substring_index(plain, "::", 1)), r"[\s-]+", "_")
    return F.when(F.contains(plain, F.lit("::")), F.concat(key, F.lit("::"), F.regexp_replace(plain, r"^.*?::", ""))).otherwise(key)


def sheet_records(rows: DataFrame) -> DataFrame:
    """``form_id, sheet, row_no, record`` (a map) from (form_id, sheet, row_no, cells): the first row is the header, blank rows drop."""
    w = Window.partitionBy("form_id", "sheet").orderBy("row_no")
    head = rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("form_id", "sheet", F.transform("cells", header_name).alias("header"), F.col("row_no").alias("header_row"))
    body = rows.join(head, ["form_id", "sheet"]).filter(F.col("row_no") > F.col("header_row")).filter(F.exists("cells", lambda c: F.length(F.trim(c)) > 0))
    pairs = F.filter(F.transform(F.arrays_zip("header", "cells"), lambda p: F.struct(p["header"].alias("k"), F.trim(p["cells"]).alias("v"))), lambda p: F.coalesce(p["k"] != "", F.lit(False)) & F.coalesce(p["v"] != "", F.lit(False)))
    return body.select("form_id", "sheet", "row_no", F.map_from_entries(pairs).alias("record"))


def header_faults(rows: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """``form_id, sheet, fault``: headers that repeat or are missing."""
    w = Window.partitionBy("form_id", "sheet").orderBy("row_no")
    head = rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("form_id", "sheet", F.filter(F.transform("cells", header_name), lambda h: h != "").alias("h"))
    needs = F.create_map(*(x for sheet, names in required.items() for x in (F.lit(sheet), F.array(*map(F.lit, names)))))
    missing = F.transform(F.array_except(F.coalesce(needs[F.col("sheet")], F.array().cast("array<string>")), "h"), lambda n: F.concat(F.lit("missing:"), n))
    repeated = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array(F.lit("repeated_header"))).otherwise(F.array().cast("array<string>"))
    return head.select("form_id", "sheet", F.explode(F.concat(missing, repeated)).alias("fault"))


def preferred_label(record: Column, language: Column, entries: Column | None = None) -> Column:
    """The label in the form's language, else the plain label, else the first label of any language."""
    labels = F.filter(F.map_keys(record), lambda k: F.startswith(k, F.lit("label::")))
    return F.coalesce(record[F.concat(F.lit("label::"), language)], record["label"], F.when(F.size(labels) > 0, record[F.element_at(F.sort_array(labels), 1)]))


def typed_rows(survey: DataFrame) -> DataFrame:
    """Survey records with base type, list or file name, and whether they open or close a group."""
    kind = F.regexp_replace(F.lower(F.trim(F.col("record")["type"])), r"\s+", " ")
    kind = F.regexp_replace(kind, r"^(begin|end)_(group|repeat)", "$1 $2")
    return survey.select(
        "form_id", "row_no", "record", F.substring_index(kind, " ", 1).alias("base"), F.regexp_extract(F.trim(F.col("record")["type"]), r"^\S+\s+(\S+)", 1).alias("list_name"),
        F.when(kind.rlike("^begin (group|repeat)"), "begin").when(kind.rlike("^end (group|repeat)"), "end").alias("turn"), F.regexp_extract(kind, "^(?:begin|end) (group|repeat)", 1).alias("group_kind"), F.col("record")["name"].alias("name"),
    )


ITEM = T.StructType(
    [
        T.StructField("form_id", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("row_no", T.IntegerType()), T.StructField("item", T.StringType()),
        T.StructField("kind", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("repeat_group", T.StringType()), T.StructField("section_path", T.ArrayType(T.StringType())),
        T.StructField("is_entry", T.BooleanType()), T.StructField("fault", T.StringType()),
    ]
)


def form_items(typed: DataFrame) -> DataFrame:
    """Items in order: an entry, the questions, sections and repeat groups, a terminal; faults of nesting and names as rows.

    The stack of open groups gives parent, path and nearest repeat; a group's first child is its entry. Calculations take
    a name but are no items.
    """

    def start():
        return {"stack": [], "n": 0, "names": set()}

    def row_of(s, form, row_no, item, kind, fault=None, entry=False):
        out = (form, s["n"], row_no, item, kind, s["stack"][-1]["item"] if s["stack"] else None, next((g["item"] for g in reversed(s["stack"]) if g["kind"] == "repeat"), None), [g["label"] for g in s["stack"]], entry, fault)
        s["n"] += 1
        return out

    def step(s, row):
        out, form = [], row["form_id"]
        if s["n"] == 0:
            out.append(row_of(s, form, None, "ENTRY", "entry"))
        name = row["name"]
        if row["turn"] == "end":
            if not s["stack"]:
                return [*out, row_of(s, form, row["row_no"], None, None, "end_without_begin")]
            group = s["stack"].pop()
            if group["kind"] != row["group_kind"]:
                out.append(row_of(s, form, row["row_no"], group["item"], None, "end_of_other_kind"))
            if not group["children"]:
                out.append(row_of(s, form, row["row_no"], group["item"], None, "empty_group"))
            return out
        if not name:
            return [*out, row_of(s, form, row["row_no"], None, None, "missing_name")]
        if name in s["names"]:
            return [*out, row_of(s, form, row["row_no"], name, None, "repeated_name")]
        s["names"].add(name)
        if row["base"] == "calculate":
            return out
        entry = bool(s["stack"]) and not s["stack"][-1]["children"]
        if s["stack"]:
            s["stack"][-1]["children"] += 1
        kind = {"group": "section", "repeat": "repeat_group"}.get(row["group_kind"] or "", "question")
        out.append(row_of(s, form, row["row_no"], name, kind, None, entry))
        if row["turn"] == "begin":
            s["stack"].append({"item": name, "kind": row["group_kind"], "label": row["record"].get("label") or name if isinstance(row["record"], dict) else dict(row["record"]).get("label") or name, "children": 0})
        return out

    def finish(s, key):
        open_ = [row_of(s, key[0], None, g["item"], None, "begin_without_end") for g in reversed(s["stack"])]
        s["stack"] = []
        return [*open_, row_of(s, key[0], None, "END", "terminal")]

    return ordered_fold(typed, ["form_id"], ["row_no"], start, step, finish, ITEM)


def form_transitions(items: DataFrame) -> DataFrame:
    """``form_id, source, target, kind``: entry to first item, container to first child, others to the next logical item.

    The next logical item is the next sibling, else that of the nearest ancestor which has one, else the terminal: in
    order, it is the next item that isn't deeper, told by one fold from the end with a stack of open depths.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("form_id", "source", "target", "kind")])
    sound = items.filter("fault is null and item is not null").select("form_id", "item", "kind", F.size("section_path").alias("depth"), (-F.col("ord")).alias("back"))

    def step(s, row):
        following = s["last"]
        while s["stack"] and s["stack"][-1][0] > row["depth"]:
            s["stack"].pop()
        beyond = s["stack"][-1][1] if s["stack"] else None
        s["stack"].append((row["depth"], row["item"]))
        s["last"] = row["item"]
        if row["kind"] == "terminal":
            return []
        inward = row["kind"] in ("entry", "section", "repeat_group")
        return [(row["form_id"], row["item"], following if inward else beyond, "unconditional" if row["kind"] in ("section", "repeat_group") else "sequential")]

    return ordered_fold(sound, ["form_id"], ["back"], lambda: {"stack": [], "last": None}, step, lambda s, key: [], schema)


def form_activations(typed: DataFrame) -> DataFrame:
    """``form_id, row_no, item, expression, condition``: relevance as it stands and as a condition over known names."""
    names = typed.filter("name is not null").groupBy("form_id").agg(F.collect_set("name").alias("known"))
    expression = F.coalesce(F.nullif(F.trim(F.col("record")["relevant"]), F.lit("")), F.nullif(F.trim(F.col("record")["bind::relevant"]), F.lit("")))
    told = typed.withColumn("expression", expression).filter("expression is not null and name is not null").join(names, "form_id")
    return told.select("form_id", "row_no", F.col("name").alias("item"), "expression", C.parsed(F.col("expression"), F.col("known")).alias("condition"))


def feature_diagnostics(typed: DataFrame) -> DataFrame:
    """``form_id, row_no, code``: types, functions and arithmetic that can't be told."""
    supported = F.col("base").isin(*TYPES, "begin", "end", "note") | F.col("turn").isNotNull()
    texts = F.concat_ws(" ", *(F.col("record")[c] for c in ("relevant", "bind::relevant", *LOGIC, *BOUND.values())))
    called = F.regexp_extract_all(texts, F.lit(r"([A-Za-z_][\w-]*)\s*\("), F.lit(1))
    bare = F.regexp_replace(F.regexp_replace(texts, r"'[^']*'|\"[^\"]*\"|\$\{[^}]*\}", "x"), r"\b\d{4}-\d{2}-\d{2}\b", "x")
    codes = F.array_compact(
        F.array(
            F.when(~supported, F.lit("unsupported_type")),
            F.when(F.exists(called, lambda f: ~F.lower(f).isin(*FUNCTIONS, "and", "or")), F.lit("unsupported_function")),
            F.when(bare.rlike(r"[\w)]\s*(\+|\*|\bdiv\b|\bmod\b|\s-\s)\s*[\w($]"), F.lit("unsupported_arithmetic")),
        )
    )
    return typed.select("form_id", "row_no", F.explode(codes).alias("code")).distinct()


def choice_lists(choices: DataFrame, language: DataFrame) -> DataFrame:
    """``form_id, list_name, categories``: options in order, code and preferred label."""
    told = choices.join(language, "form_id", "left").select("form_id", "row_no", F.col("record")["list_name"].alias("list_name"), F.col("record")["name"].alias("code"), preferred_label(F.col("record"), F.col("language")).alias("label"))
    options = F.transform(F.sort_array(F.collect_list(F.struct("row_no", "code", "label"))), lambda o: F.struct(o["code"].alias("code"), F.coalesce(o["label"], o["code"]).alias("label")))
    return told.filter("list_name is not null and code is not null").groupBy("form_id", "list_name").agg(options.alias("categories"))


def choice_faults(typed: DataFrame, choices: DataFrame) -> DataFrame:
    """``form_id, list_name, fault``: lists asked for that don't exist, codes that come twice in a list."""
    lists = choices.select("form_id", F.col("record")["list_name"].alias("list_name"), F.col("record")["name"].alias("code"))
    asked = typed.filter(F.col("base").isin("select_one", "select_multiple") & (F.col("list_name") != "")).select("form_id", "list_name").distinct()
    missing = asked.join(lists.select("form_id", "list_name").distinct(), ["form_id", "list_name"], "left_anti").withColumn("fault", F.lit("missing_list"))
    twice = lists.groupBy("form_id", "list_name", "code").agg(F.count("*").alias("n")).filter("n > 1").select("form_id", "list_name", F.lit("repeated_code").alias("fault")).distinct()
    return missing.unionByName(twice)


def choices_of() -> Column:
    """The name under which a row's choices are found: a list's, or a file's behind FILE."""
    return F.when(F.endswith("base", F.lit("_from_file")), F.concat(F.lit(FILE), F.regexp_replace("list_name", r"\\", "/"))).otherwise(F.col("list_name"))


def external_choices(typed: DataFrame, files: DataFrame, language: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lists, faults)`` of choices kept in files beside a form: form_id, list_name, categories; form_id, list_name, fault.

    ``files``: form_id, path (below the form's folder), row_no, cells. A path that leaves the folder or names a place on a
    network is refused, one without a file is missing, a code given twice in a file is a fault.
    """
    asked = typed.filter(F.endswith("base", F.lit("_from_file"))).select("form_id", choices_of().alias("list_name")).distinct()
    path = F.substring("list_name", len(FILE) + 1, 1 << 30)
    unsafe = (path == "") | F.startswith(path, F.lit("/")) | path.rlike(r"(^|/)\.\.(/|$)|^[A-Za-z][A-Za-z0-9+.-]*:")
    sheets = files.select("form_id", F.concat(F.lit(FILE), "path").alias("sheet"), "row_no", "cells")
    sound = asked.filter(~unsafe)
    records = sheet_records(sheets.join(sound.select("form_id", F.col("list_name").alias("sheet")), ["form_id", "sheet"], "left_semi"))
    told = records.withColumn("record", F.map_concat(F.map_filter("record", lambda k, v: k != "list_name"), F.create_map(F.lit("list_name"), F.col("sheet"))))
    missing = sound.join(sheets.select("form_id", F.col("sheet").alias("list_name")).distinct(), ["form_id", "list_name"], "left_anti")
    twice = told.groupBy("form_id", F.col("sheet").alias("list_name"), F.col("record")["name"].alias("code")).agg(F.count("*").alias("n")).filter("n > 1 and code is not null").select("form_id", "list_name").distinct()
    faults = [asked.filter(unsafe).withColumn("fault", F.lit("unsafe_path")), missing.withColumn("fault", F.lit("missing_file")), twice.withColumn("fault", F.lit("repeated_code"))]
    return choice_lists(told, language), reduce(DataFrame.unionByName, faults)


def workbook_rows(blocks: DataFrame) -> DataFrame:
    """``form_id, sheet, row_no, cells, block_id`` of the workbooks among parsed documents that are forms: those with a survey sheet."""
    sheets = blocks.filter("kind = 'table' and sheet is not null").withColumn("name", F.lower(F.trim("sheet"))).filter(F.col("name").isin(*SHEETS))
    forms = sheets.filter("name = 'survey'").select("doc_id").distinct()
    rows = sheets.join(forms, "doc_id", "left_semi").select(F.col("doc_id").alias("form_id"), F.col("name").alias("sheet"), "block_id", F.posexplode("table_rows").alias("at", "cells"))
    return rows.select("form_id", "sheet", (F.col("at") + 1).alias("row_no"), "cells", "block_id")


def row_spans(rows: DataFrame) -> DataFrame:
    """``form_id, sheet, row_no, block_id, quote``: where each row of a form stands, and what its source says there."""
    return rows.select("form_id", "sheet", "row_no", "block_id", F.substring(X.render_row(F.col("cells")), 1, MOST_QUOTE).alias("quote"))


def first_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """``form_id, code, row_no``: each finding of a form once, at the first row that shows it."""
    return diagnostics.groupBy("form_id", "code").agg(F.min("row_no").alias("row_no"))


def form_variables(typed: DataFrame, lists: DataFrame, items: DataFrame, language: DataFrame) -> DataFrame:
    """Typed variables: notes and group rows are none, calculations are of type other; a module is the innermost group."""
    base = F.col("base")
    data_type = F.create_map(*(x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))))[base]
    filled = lambda c: F.nullif(F.trim(F.col("record")[c]), F.lit(""))
    logic = {c: F.coalesce(filled(c), filled(BOUND[c])) if c in BOUND else filled(c) for c in LOGIC}
    notes = F.nullif(F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), text) for c, text in logic.items())), F.lit(""))
    own = items.filter("fault is null and item is not null").select("form_id", F.col("item").alias("name"), F.col("parent").alias("module"))
    asked = typed.withColumn("list_name", choices_of()).filter("turn is null and base != 'note' and name is not null")
    told = asked.join(own, ["form_id", "name"], "left").join(lists, ["form_id", "list_name"], "left").join(language, "form_id", "left")
    asks = base.isin(*CHOICE_BASES)
    reasons = F.array_compact(F.array(F.when(data_type.isNull(), F.lit("unsupported_type")), F.when(asks & (F.coalesce(F.size("categories"), F.lit(0)) <= 0), F.lit("missing_categories"))))
    return told.select(
        "form_id", "row_no", F.col("name").alias("raw_name"), preferred_label(F.col("record"), F.col("language")).alias("label"), F.coalesce(data_type, F.lit("other")).alias("data_type"),
        "module", F.when(asks, F.col("categories")).alias("categories"), notes.alias("notes"), F.lit(1.0).alias("extraction_confidence"), reasons.alias("review_reasons"),
    )


def form_header(settings: DataFrame, forms: DataFrame, extracted: Column) -> DataFrame:
    """``form_id, survey_id, title, language, survey_year``: the settings with fallbacks; two settings rows are a fault, the first counts."""
    first = settings.groupBy("form_id").agg(F.min_by("record", "row_no").alias("record"), F.count("*").alias("n_settings"))
    record = F.col("record")
    year = F.when(record["year"].rlike(r"^\d{4}$"), record["year"].cast("int"))
    return forms.select("form_id").distinct().join(first, "form_id", "left").select(
        "form_id", F.coalesce(F.nullif(record["form_id"], F.lit("")), F.col("form_id")).alias("survey_id"), F.coalesce(F.nullif(record["form_title"], F.lit("")), F.col("form_id")).alias("title"),
        record["default_language"].alias("language"), F.coalesce(record["country_code"], F.lit("UNK")).alias("country_code"), F.coalesce(year, F.year(extracted)).alias("survey_year"), (F.coalesce("n_settings", F.lit(0)) > 1).alias("repeated_settings"),
    )


def form_tables(rows: DataFrame, extracted: Column, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything a form's sheets hold, from (form_id, sheet, row_no, cells), and its choice files (form_id, path, row_no, cells)."""
    records = sheet_records(rows)
    sheet = lambda name: records.filter(F.col("sheet") == name)
    header = form_header(sheet("settings"), rows, extracted)
    language = header.select("form_id", "language")
    typed = typed_rows(sheet("survey"))
    items = form_items(typed)
    lists = choice_lists(sheet("choices"), language)
    beside = None
    if files is not None:
        external, beside = external_choices(typed, files, language)
        lists = lists.unionByName(external)
    codes = feature_diagnostics(typed)
    found = [items.filter("fault is not null").select("form_id", F.col("row_no").cast("string").alias("at"), "fault"), codes.select("form_id", F.col("row_no").cast("string").alias("at"), F.col("code").alias("fault"))]
    found += [df.select("form_id", F.col("list_name").alias("at"), "fault") for df in (choice_faults(typed, sheet("choices")), beside) if df is not None]
    return {
        "header": header, "items": items.filter("fault is null"), "transitions": form_transitions(items), "activations": form_activations(typed), "variables": form_variables(typed, lists, items, language),
        "faults": reduce(DataFrame.unionByName, found), "diagnostics": first_diagnostics(codes),
    }
