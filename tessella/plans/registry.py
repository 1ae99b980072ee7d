"""Named queries over the data directory and the SQL they are compared with. Every query reads its whole tables."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import identity as I
from tessella.functions import prompts
from tessella.functions import redact as R
from tessella.functions import text as T
from tessella.operators import blocks as B
from tessella.operators import chunking as K
from tessella.operators import claims as C
from tessella.operators import evaluate as E
from tessella.operators import forms, graph, provider, quality, regions, resolve, review, validate
from tessella.operators.components import connected_components
from tessella.runtime import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (tables) under its name, with its SQL."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(partial(read_table, spark, sf_dir))

        QUERIES[function.__name__] = run
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


_BLANK = "[ \\t\\n\\r\\f\\x0b]"
_PARAGRAPHS = f"""
with raw as (select doc_id, unnest(list_transform(regexp_split_to_array(text, '\\r?\\n{_BLANK}*\\r?\\n'), lambda p: regexp_replace(p, '^{_BLANK}+|{_BLANK}+$', '', 'g'))) as text,
  generate_subscripts(regexp_split_to_array(text, '\\r?\\n{_BLANK}*\\r?\\n'), 1) as i from documents),
p as (select doc_id, text, (row_number() over (partition by doc_id order by i) - 1)::int as ord from raw where text <> '')
"""
_HEADING = "(not contains(text, chr(10)) and length(text) <= 120 and (regexp_matches(text, '(?i)^(section|module)\\b') or (upper(text) = text and lower(text) <> text and len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), ' ')) <= 12)))"


@query(_PARAGRAPHS + "select doc_id, ord, printf('block-%06d', ord + 1) as block_id, text from p")
def text_blocks(table):
    return B.paragraphs(table("documents"))


@query(_PARAGRAPHS + f"select doc_id, ord, {_HEADING} as is_heading from p")
def heading_flags(table):
    return B.paragraphs(table("documents")).select("doc_id", "ord", T.is_heading(F.col("text")).alias("is_heading"))


@query(_PARAGRAPHS + f", h as (select *, case when {_HEADING} then text end as h from p) select doc_id, ord, last_value(h ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and current row) as section from h")
def section_forward_fill(table):
    return B.sections(B.paragraphs(table("documents")), "doc_id", "ord", T.is_heading(F.col("text"))).select("doc_id", "ord", "section")


@query("select doc_id, coalesce(strlen(text), 0) as n_bytes from documents")
def token_estimate(table):
    return table("documents").select("doc_id", T.byte_estimate(F.col("text")).cast("long").alias("n_bytes"))


@query(f"select doc_id, trim(regexp_replace(text, '{_BLANK}+', ' ', 'g'), ' ') as text from documents")
def whitespace_norm(table):
    return table("documents").select("doc_id", T.squeeze_ascii(F.col("text")).alias("text"))


@query("select record_id, trim(regexp_replace(lower(coalesce(nullif(question_text, ''), nullif(label, ''), '')), '[^a-z0-9]+', ' ', 'g'), ' ') as text from variable_records")
def similarity_text(table):
    return table("variable_records").select("record_id", T.similarity_text(T.first_filled(F.col("question_text"), F.col("label"))).alias("text"))


_CELL = "replace(replace(replace(replace(coalesce(c, ''), chr(92), chr(92) || chr(92)), chr(13), chr(92) || 'r'), chr(10), chr(92) || 'n'), '|', chr(92) || '|')"


@query(f"select block_key, array_to_string(list_transform(table_rows, lambda r: array_to_string(list_transform(r, lambda c: {_CELL}), ' | ')), chr(10)) as text from pdf_blocks where table_rows is not null")
def render_tables(table):
    return table("pdf_blocks").filter("table_rows is not null").select("block_key", T.render_table(F.col("table_rows")).alias("text"))


_ROWS = "r as (select block_key, unnest(table_rows) as cells, generate_subscripts(table_rows, 1) as row_no from pdf_blocks)"


@query(f"with {_ROWS} select block_key, row_no, coalesce(list_max(list_transform(cells, lambda c, i: case when length(trim(coalesce(c, ''))) > 0 then i else 0 end)), 0) as n_cells from r")
def trailing_cells(table):
    rows = table("pdf_blocks").select("block_key", F.posexplode("table_rows").alias("at", "cells"))
    return rows.select("block_key", (F.col("at") + 1).cast("long").alias("row_no"), F.size(T.trim_trailing_cells(F.col("cells"))).cast("long").alias("n_cells"))


_LINES = f"""l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents),
n as (select doc_id, ord, trim(regexp_replace(line, '{_BLANK}+', ' ', 'g'), ' ') as row_text from l)"""


@query(f"with {_LINES} select doc_id, row_text, count(*) as n, min(ord) as first_ord from n where row_text <> '' group by doc_id, row_text having count(*) > 1")
def repeated_rows(table):
    lines = table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return K.repeated_rows(lines, "doc_id", ["ord"], "line").select("doc_id", "row_text", "n", F.col("first.ord").cast("long").alias("first_ord"))


@query(f"with {_LINES}, g as (select doc_id, row_text, count(*) as n from n where row_text <> '' group by all having count(*) > 1) select doc_id, count(*) as n_rows, sum(n)::bigint as n_total from g group by doc_id")
def repeated_summary(table):
    lines = table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return K.repeated_summary(K.repeated_rows(lines, "doc_id", ["ord"], "line"), "doc_id").select("doc_id", "n_rows", "n_total")


_PARTS = "p as (select chunk_key, doc_id, ord, unnest(parts) as p, generate_subscripts(parts, 1) as part_no from source_chunks)"


@query(f"with {_PARTS} select chunk_key, p.block_id as block_id, count(*) as n_parts, count(distinct split_part(p.text, chr(10), 1)) as n_headers from p group by all having count(*) >= 2")
def split_tables(table):
    parts = table("source_chunks").select("chunk_key", F.explode("parts").alias("p")).select("chunk_key", "p.block_id", F.substring_index("p.text", "\n", 1).alias("header"))
    return K.split_table_summary(parts)


@query(
    """
with recursive d as (select doc_id, block_key, ord, coalesce(strlen(text), 0) as size, row_number() over (partition by doc_id order by ord, block_key) as i from pdf_blocks),
f as (select doc_id, i, 0 as chunk_ord, size as total from d where i = 1
  union all select d.doc_id, d.i, case when f.total + 2 + d.size > 6000 then f.chunk_ord + 1 else f.chunk_ord end, case when f.total + 2 + d.size > 6000 then d.size else f.total + 2 + d.size end
  from f join d on d.doc_id = f.doc_id and d.i = f.i + 1)
select doc_id, chunk_ord, count(*) as n_items, max(total)::bigint as total from f group by doc_id, chunk_ord
"""
)
def pack_chunks(table):
    sizes = table("pdf_blocks").withColumn("place", F.struct("ord", "block_key")).select("doc_id", "place", T.byte_estimate(F.col("text")).alias("size"))
    return K.pack_sizes(sizes, "doc_id", "place", "size", 6000)


def _pdf_blocks(table):
    return table("pdf_blocks").select("doc_id", "ord", F.col("block_key").cast("string").alias("block_id"), F.when(F.col("table_rows").isNotNull(), "table").otherwise("text").alias("kind"), "text", "table_rows")


@query()
def chunk_plan(table):
    return K.chunk_blocks(_pdf_blocks(table), 8_000, 400)


@query("select doc_id, string_agg(block_key::varchar, ',' order by ord, block_key::varchar) as block_ids, true as fits, true as overlaps_fit from pdf_blocks group by doc_id")
def chunk_cover(table):
    """Of each document's chunks: the blocks that are new in one, in order, and whether all chunks and overlaps keep to their limits."""
    chunks = K.chunk_blocks(_pdf_blocks(table), 8_000, 400)
    new = F.transform(F.sort_array(F.collect_list(F.struct("chunk_ord", "new_block_ids"))), lambda c: c["new_block_ids"])
    sizes = table("pdf_blocks").select("doc_id", F.col("block_key").cast("string").alias("block_id"), T.byte_estimate(F.col("text")).alias("n"))
    laps = chunks.select("doc_id", "chunk_ord", F.explode("overlap_block_ids").alias("block_id")).join(sizes, ["doc_id", "block_id"]).groupBy("doc_id", "chunk_ord").agg(F.sum("n").alias("lap"))
    told = chunks.join(laps, ["doc_id", "chunk_ord"], "left").withColumn("lap_fits", (F.size("overlap_block_ids") < 2) | (F.coalesce("lap", F.lit(0)) <= 8_000))
    return told.groupBy("doc_id").agg(F.array_join(F.array_distinct(F.flatten(new)), ",").alias("block_ids"), F.bool_and(F.col("size") <= 8_000).alias("fits"), F.bool_and("lap_fits").alias("overlaps_fit"))


@query("select doc_id, text as whole, true as fits from documents where text is not null")
def text_pieces(table):
    """Texts cut at blanks into pieces of 1,000 bytes and put together again."""

    def cut_all(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: K.split_text(t, 1_000))

    pieces = F.pandas_udf(cut_all, "array<string>")
    cut = table("documents").filter("text is not null").select("doc_id", pieces("text").alias("p"))
    return cut.select("doc_id", F.array_join("p", "").alias("whole"), F.forall("p", lambda x: F.octet_length(x) <= 1_000).alias("fits"))


@query(
    """with recursive v as (select survey_id, record_id, coalesce(module, '') as m, row_number() over (partition by survey_id order by source_order, record_id) as i from variable_records),
r as (select *, case when lag(m) over w is distinct from m or i = 1 then 1 else 0 end as starts from v window w as (partition by survey_id order by i)),
g as (select *, sum(starts) over (partition by survey_id order by i) as run from r),
p as (select *, (row_number() over (partition by survey_id, run order by i) - 1) // 20 as part from g),
s as (select survey_id, run, part, count(*) as n, row_number() over (partition by survey_id order by run, part) as k from p group by survey_id, run, part),
f as (select survey_id, run, part, k, n as filled, 0 as chunk_no from s where k = 1
  union all select s.survey_id, s.run, s.part, s.k, case when f.filled + s.n > 20 then s.n else f.filled + s.n end, case when f.filled + s.n > 20 then f.chunk_no + 1 else f.chunk_no end
  from f join s on s.survey_id = f.survey_id and s.k = f.k + 1)
select p.record_id, f.chunk_no from p join f using (survey_id, run, part)"""
)
def region_chunks(table):
    """Each survey's records in order, runs of one module kept together, in chunks of at most twenty."""
    items = table("variable_records").select("survey_id", "source_order", "record_id", F.coalesce("module", F.lit("")).alias("section"), F.lit(None).cast("string").alias("repeat_group"))
    return regions.region_chunks(items, ["survey_id"], 20, node="record_id").select("record_id", "chunk_no")


@query(f"with {_LINES}, g as (select doc_id, row_text, count(*) as n from n where row_text <> '' group by all having count(*) > 1), s as (select doc_id, count(*) as n_rows, sum(n)::bigint as n_total from g group by doc_id) select d.doc_id, coalesce(strlen(text), 0) as n_bytes, coalesce(n_rows, 0) as n_repeated, coalesce(n_total, 0) as n_occurrences from documents d left join s using (doc_id)")
def chunk_inventory(table):
    """Documents with their size and the inventory of what repeats in them."""
    documents = table("documents")
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    summary = K.repeated_summary(K.repeated_rows(lines, "doc_id", ["ord"], "line"), "doc_id")
    return documents.select("doc_id", T.byte_estimate(F.col("text")).cast("long").alias("n_bytes")).join(summary, "doc_id", "left").select("doc_id", "n_bytes", F.coalesce("n_rows", F.lit(0)).alias("n_repeated"), F.coalesce("n_total", F.lit(0)).alias("n_occurrences"))


@query("select chunk_key, lag(chunk_key) over (partition by doc_id order by ord, chunk_key) as previous, lead(chunk_key) over (partition by doc_id order by ord, chunk_key) as following from source_chunks")
def chunk_neighbours(table):
    return K.neighbours(table("source_chunks").withColumn("place", F.struct("ord", "chunk_key")), "doc_id", "place", "chunk_key").select("chunk_key", "previous", "following")


@query(
    """
with c as (select doc_id, unit_kind, total_units, coalesce(converted_units, []) as c, coalesce(failed_units, []) as f from coverage),
b as (select *, list_concat(c, f) as b, case when total_units >= 1 then range(1, total_units + 1)::int[] else []::int[] end as u from c),
x as (select doc_id, unnest([case when unit_kind not in ('document', 'page', 'sheet') then 'unit_kind' end, case when coalesce(total_units, 0) < 1 then 'total_units' end,
  case when len(list_intersect(c, f)) > 0 then 'overlap' end, case when len(list_distinct(b)) <> len(b) then 'repeated' end,
  case when len(list_filter(u, lambda i: not list_contains(b, i))) > 0 then 'missing' end, case when len(list_filter(b, lambda i: not list_contains(u, i))) > 0 then 'outside' end]) as fault from b)
select doc_id, fault from x where fault is not null
"""
)
def coverage_faults(table):
    return B.coverage_faults(table("coverage"))


@query("with x as (select doc_id, unit_kind, unnest(failed_units) as unit_index from coverage) select doc_id, unit_index, printf('%s %d could not be converted', unit_kind, unit_index) as message from x")
def failed_units(table):
    return B.failed_units(table("coverage"))


@query(
    """
with x as (select block_key, unnest([case when len(pages) > 0 and pages[1] is distinct from page then 'page' end, case when list_sort(list_distinct(pages)) <> pages then 'pages' end,
  case when len(list_filter(section_path, lambda p: trim(p) = '')) > 0 then 'section_path' end, case when len(list_filter(pages, lambda p: p < 1)) > 0 then 'range' end,
  case when table_rows is null and length(coalesce(text, '')) = 0 then 'empty' end]) as fault from pdf_blocks)
select block_key, fault from x where fault is not null
"""
)
def provenance_faults(table):
    return B.provenance_faults(table("pdf_blocks"))


_TOKENS = "trim(regexp_replace(lower(coalesce(nullif(question_text, ''), nullif(label, ''), '')), '[^a-z0-9]+', ' ', 'g'), ' ')"
_QUALITY = f"""
base as (select *, {_TOKENS} as qtext, coalesce(numeric_range.min_value > numeric_range.max_value, false) as inverted from variable_records),
g as (select *, row_number() over (partition by survey_id, coalesce(lower(raw_name), ''), qtext, data_type order by source_order, record_id) as i from base where not inverted),
fold as (
  select survey_id, coalesce(lower(raw_name), '') as nm, qtext, data_type, i, record_id, false as dropped, coalesce(source_block_ids, []) as kept from g where i = 1
  union all
  select g.survey_id, fold.nm, g.qtext, g.data_type, g.i, g.record_id, list_has_any(fold.kept, coalesce(g.overlap_block_ids, [])),
    case when list_has_any(fold.kept, coalesce(g.overlap_block_ids, [])) then fold.kept else list_concat(fold.kept, coalesce(g.source_block_ids, [])) end
  from fold join g on g.survey_id is not distinct from fold.survey_id and coalesce(lower(g.raw_name), '') = fold.nm and g.qtext = fold.qtext and g.data_type is not distinct from fold.data_type and g.i = fold.i + 1),
kept as (select b.* from base b join fold f using (record_id) where not f.dropped),
names as (select survey_id, lower(raw_name) as nm, count(*) as n, min(source_order) as first_order from kept where raw_name is not null group by all having count(*) > 1),
sets as (select survey_id, record_id, list_sort(list_distinct(string_split(qtext, ' '))) as toks from kept where qtext <> ''),
classes as (select survey_id, toks, min(record_id) as rep from sets group by all),
pairs as (select a.survey_id, least(a.rep, b.rep) as a, greatest(a.rep, b.rep) as b, len(list_intersect(a.toks, b.toks)) as common, len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)) as either
  from classes a join classes b on a.survey_id = b.survey_id and a.rep < b.rep and least(len(a.toks), len(b.toks)) >= 0.8 * greatest(len(a.toks), len(b.toks)) where len(list_intersect(a.toks, b.toks)) * 10 >= 8 * (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))))
"""


@query(f"with recursive {_QUALITY} select record_id from fold where dropped")
def overlap_dedup(table):
    records = table("variable_records")
    return quality.overlap_duplicates(records.filter(~quality.range_is_inverted(F.col("numeric_range"))))


@query(f"with recursive {_QUALITY} select survey_id, a, b, common, either from pairs")
def possible_duplicates(table):
    records = table("variable_records").filter(~quality.range_is_inverted(F.col("numeric_range")))
    kept = records.join(quality.overlap_duplicates(records), "record_id", "left_anti")
    return quality.similar_questions(kept).select("survey_id", "a", "b", F.col("common").cast("long").alias("common"), F.col("either").cast("long").alias("either"))


@query("select survey_id, lower(raw_name) as name, count(*) as n, min(source_order) as first_order from variable_records where raw_name is not null group by all having count(*) > 1")
def duplicate_names(table):
    return quality.repeated_names(table("variable_records"))


@query(
    f"""with recursive {_QUALITY},
alike as (select distinct s.record_id from sets s join classes c on c.survey_id = s.survey_id and c.toks = s.toks join (select survey_id, a as rep from pairs union select survey_id, b from pairs) p on p.survey_id = c.survey_id and p.rep = c.rep),
o as (select b.*, case when b.inverted then 'excluded' when f.dropped then 'duplicate' else 'kept' end as status, n.n is not null as repeats, s.record_id is not null as is_alike,
  nullif(coalesce(case when len(b.prov.section_path) > 0 then b.prov.section_path[-1] end, b.prov.sheet), '') as source_module
  from base b left join fold f using (record_id) left join names n on n.survey_id = b.survey_id and n.nm = lower(b.raw_name) left join alike s on s.record_id = b.record_id),
r as (select *, case when status = 'kept' then array_to_string(list_filter([case when needs_review then 'model_flagged' end, case when extraction_confidence < 0.7 then 'low_confidence' end,
  case when data_type in ('categorical_single', 'categorical_multi') and coalesce(len(categories), 0) = 0 then 'missing_categories' end, case when repeats then 'duplicate_raw_name' end, case when is_alike then 'possible_duplicate' end], lambda x: x is not null), ',') else '' end as reasons from o)
select survey_id, record_id, source_order, status, reasons <> '' as needs_review, reasons, case when status = 'kept' then coalesce(source_module, module) else module end as module from r"""
)
def quality_policy(table):
    return quality.apply_policy(table("variable_records"))


@query(
    f"""with recursive {_QUALITY},
k as (select *, coalesce(case when len(prov.section_path) > 0 then prov.section_path[-1] end, prov.sheet) as sm from kept)
select survey_id, 1 as phase, source_order as position, 0 as seq, 'validation_failed' as code, record_id::varchar as subject from base where inverted
union all select b.survey_id, 1, b.source_order, 1, 'overlap_deduped', b.record_id::varchar from base b join fold f using (record_id) where f.dropped
union all select survey_id, 1, source_order, 2, 'low_confidence', record_id::varchar from k where extraction_confidence < 0.7
union all select survey_id, 1, source_order, 3, 'missing_categories', record_id::varchar from k where data_type in ('categorical_single', 'categorical_multi') and coalesce(len(categories), 0) = 0
union all select survey_id, 1, source_order, 4, 'module_reconciled', record_id::varchar from k where nullif(sm, '') is not null and sm is distinct from module
union all select survey_id, 2, first_order, 5, 'duplicate_raw_name', nm from names
union all select survey_id, 3, a::int, 6, 'possible_duplicate', a || ':' || b from pairs"""
)
def quality_diagnostics(table):
    return quality.policy_diagnostics(table("variable_records"))


@query("select survey_id, arg_min(snapshot_sha256, doc_id) filter (snapshot_sha256 is not null) as snapshot_sha256, count(distinct snapshot_sha256) > 1 or count(*) filter (snapshot_sha256 is null) > 0 as is_incomplete from source_documents group by survey_id")
def metadata_first_wins(table):
    return E.first_success(table("source_documents"), "survey_id", "doc_id", "snapshot_sha256")


@query(
    """with r as (select survey_id, bool_or(not coalesce(numeric_range.min_value > numeric_range.max_value, false)) as any_output, count(*) filter (coalesce(numeric_range.min_value > numeric_range.max_value, false)) as n_failed,
count(*) filter (extraction_confidence < 0.7) as n_low from variable_records group by survey_id)
select survey_id, case when not any_output then 'failed' when n_failed + n_low > 0 then 'partial' else 'success' end as status from r"""
)
def status_rollup(table):
    flagged = quality.record_flags(table("variable_records"))
    rows = flagged.select("survey_id", (~F.col("is_inverted")).alias("has_output"), F.col("is_inverted").cast("int").alias("n_failed"), F.col("low_confidence").cast("int").alias("n_partial_codes"), F.lit(0).alias("n_errors"))
    return E.result_status(rows, "survey_id")


@query("select event_type, count(*) as n_calls, sum(1 + user_id % 3)::bigint as n_tries, sum(event_id % 1000)::bigint as input_tokens, sum(user_id)::bigint as output_tokens, count(*) filter (not value >= 20) as n_failed from events group by event_type")
def usage_rollup(table):
    """Events read as calls: their usage by kind."""
    calls = table("events").select("event_type", (F.col("value") >= 20).alias("ok"), (1 + F.col("user_id") % 3).alias("tries"), (F.col("event_id") % 1000).alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return provider.usage(calls, ["event_type"])


@query("select doc_id, 'UNK_2024_SURVEY' as survey_id, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(regexp_replace(source_name, '^.*[/\\\\]', ''), '\\.[^.]*$', ''), '[_-]+', ' ', 'g'), ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as survey_name from source_documents")
def fallback_names(table):
    survey_id, name = T.fallback_survey(F.col("source_name"), F.lit("2024-05-01").cast("date"))
    return table("source_documents").select("doc_id", survey_id.alias("survey_id"), name.alias("survey_name"))


@query(f"select doc_id, trim(regexp_replace(text, '[\\t\\n\\x0b\\f\\r \\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ') as text from documents")
def whitespace_unicode(table):
    return table("documents").select("doc_id", T.squeeze(F.col("text")).alias("text"))


@query(f"select doc_id, substring(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '[\\t\\n\\x0b\\f\\r \\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' '), 1, 200) as text from documents")
def excerpts(table):
    return table("documents").select("doc_id", T.excerpt(F.col("text"), 200).alias("text"))


_REQUEST = "'" + prompts.EXTRACT.template.replace("'", "''").replace("{{chunk_id}}", "' || coalesce(chunk_id, '') || '").replace("{{inventory}}", "[]").replace("{{text}}", "' || coalesce(text, '') || '") + "'"


def _requests(table):
    message = prompts.EXTRACT.render(chunk_id=F.col("chunk_id"), inventory=F.lit("[]"), text=F.col("text"))
    return table("source_chunks").select("chunk_key", message.alias("message"))


@query(f"select chunk_key, sha256({_REQUEST}) as message_sha from source_chunks")
def prompt_messages(table):
    return _requests(table).select("chunk_key", F.sha2("message", 256).alias("message_sha"))


@query(f"select chunk_key from source_chunks where strlen({_REQUEST}) + 4 > 2000")
def oversized_requests(table):
    return provider.capacity_faults(_requests(table), 2_000).select("chunk_key")


@query("with m as (select survey_id, module, min((source_order, record_id)) as f from variable_records where module is not null group by all) select survey_id, module, (row_number() over (partition by survey_id order by f, module) - 1)::int as place from m")
def modules_in_order(table):
    records = table("variable_records").withColumn("at", F.struct("source_order", "record_id"))
    return validate.ordered_unique(records, "survey_id", "at", "module")


@query("select survey_id, coalesce(module, '') as issue, count(*) as n, bool_or(extraction_confidence < 0.5) as needs_human from variable_records where needs_review group by survey_id, coalesce(module, '')")
def open_issues(table):
    told = table("variable_records").select("survey_id", F.coalesce("module", F.lit("")).alias("issue"), (~F.col("needs_review")).alias("is_resolved"), (F.col("extraction_confidence") < 0.5).alias("needs_human"))
    return validate.unresolved_rollup(told, "survey_id")


@query("select record_id, lead(record_id) over (partition by survey_id, coalesce(module, ''), data_type order by source_order, record_id) as successor from variable_records where not needs_review")
def successors(table):
    items = table("variable_records").select("survey_id", F.coalesce("module", F.lit("")).alias("section"), F.col("data_type").alias("parent"), F.struct("source_order", "record_id").alias("source_order"), F.col("record_id").alias("node_id"), F.when(F.col("needs_review"), "entry").otherwise("question").alias("kind"))
    return C.expected_successors(items, ["survey_id"]).select(F.col("node_id").alias("record_id"), "successor")


@query(
    """with v as (select survey_id, record_id, lower(trim(raw_name, ' ')) as name, needs_review from variable_records where raw_name is not null),
i as (select survey_id, name, min(record_id) as node_id from v where needs_review group by all having count(*) = 1)
select survey_id, node_id, count(*) as n_linked, min(record_id) as first_index from i join v using (survey_id, name) where not needs_review group by survey_id, node_id"""
)
def linked_items(table):
    named = table("variable_records").filter("raw_name is not null").select("survey_id", "record_id", "needs_review", F.lower(F.trim("raw_name")).alias("name"))
    return resolve.linked_variables(named.filter("needs_review").withColumnRenamed("record_id", "node_id"), named.filter("not needs_review").withColumnRenamed("record_id", "index"), ["survey_id"])


@query("select c_custkey, 'customer:' || sha256('{\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}') as stable_id from customer")
def customer_ids(table):
    fields = {"key": F.col("c_custkey").cast("string"), "name": I.json_string(F.col("c_name")), "nation": F.col("c_nationkey").cast("string")}
    return table("customer").select("c_custkey", I.stable_id_of("customer", I.canonical_object(**fields)).alias("stable_id"))


@query("select l_orderkey, l_linenumber, 'edge:' || sha256('{\"condition\":\"' || l_linestatus || '\",\"kind\":\"' || l_returnflag || '\",\"priority\":' || case when l_linenumber < 5 then l_linenumber::varchar else 'null' end || ',\"source\":\"' || l_orderkey || '\",\"target\":\"' || l_partkey || '\"}') as edge_id from lineitem")
def edge_ids(table):
    li = table("lineitem")
    return li.select("l_orderkey", "l_linenumber", C.edge_id(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"), F.when(F.col("l_linenumber") < 5, F.col("l_linenumber"))).alias("edge_id"))


@query("select o_orderkey, ((1 + o_custkey % 26) * 26 + 1 + o_orderkey % 26)::int as col, (1 + o_orderkey % 1000)::int as row from orders")
def cell_places(table):
    letter = lambda c: F.chr((65 + F.col(c) % 26).cast("int"))
    column, row = T.cell_reference(F.concat(letter("o_custkey"), letter("o_orderkey"), (1 + F.col("o_orderkey") % 1000).cast("string")))
    return table("orders").select("o_orderkey", column.cast("int").alias("col"), row.alias("row"))


@query(
    """with c as (select record_id, unnest(categories).code.s as code, generate_subscripts(categories, 1) as n from variable_records)
select record_id, n, case when regexp_matches(trim(code, ' '), '^[-+]?[0-9]+$') then 'int' when regexp_matches(trim(code, ' '), '^[-+]?([0-9]+\\.[0-9]*|\\.[0-9]+)$') then 'float' when regexp_matches(trim(code, ' '), '^(true|false)\\(\\)$') then 'bool'
  when regexp_matches(trim(code, ' '), '^''[^'']*''$') or regexp_matches(trim(code, ' '), '^"[^"]*"$') then 'str' end as t from c"""
)
def code_types(table):
    options = table("variable_records").select("record_id", F.posexplode("categories").alias("at", "c"))
    return options.select("record_id", (F.col("at") + 1).cast("long").alias("n"), T.tagged_scalar(F.col("c.code.s"))["t"].alias("t"))


_ALIAS = """case when regexp_extract(regexp_replace({b}, '[ \\t._-]+', '', 'g'), '^(?:q|question)?0*([0-9]+)$', 1) <> '' then 'q' || regexp_extract(regexp_replace({b}, '[ \\t._-]+', '', 'g'), '^(?:q|question)?0*([0-9]+)$', 1)
else regexp_replace(regexp_replace({b}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') end""".format(b="regexp_replace(lower(trim(raw_name, ' ')), '^(column|col)[ ._:-]+([^ ._:-])', '\\2')")


@query(f"select record_id, {_ALIAS} as alias from variable_records")
def alias_norm(table):
    return table("variable_records").select("record_id", I.alias_ascii(F.col("raw_name")).alias("alias"))


_ITEMS = f"items as (select record_id, survey_id, source_order, coalesce(regexp_replace(regexp_replace(lower(trim(module, ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 'root') as section, {_ALIAS} as alias, sha256(coalesce(question_text, '')) as fb from variable_records)"


def _items(table):
    return table("variable_records").select(
        "record_id", "survey_id", "source_order", F.lit("question").alias("kind"), F.coalesce(I.slug_ascii(F.col("module")), F.lit("root")).alias("section"), I.alias_ascii(F.col("raw_name")).alias("alias"), F.sha2(F.coalesce("question_text", F.lit("")), 256).alias("fb")
    )


@query(
    f"with {_ITEMS}, b as (select *, case when coalesce(alias, '') <> '' then 'question:' || section || ':' || alias else 'question:fallback:' || fb end as base from items), n as (select *, count(*) over (partition by survey_id, base) as n, row_number() over (partition by survey_id, base order by source_order, record_id) as i from b) select record_id, case when n > 1 then base || ':duplicate-' || i else base end as node_id from n"
)
def node_ids(table):
    items = _items(table).withColumn("place", F.col("source_order")).withColumn("source_order", F.struct("place", "record_id"))
    return resolve.node_ids(items, ["survey_id"], F.col("kind"), F.col("section"), F.col("alias"), F.col("fb")).select("record_id", "node_id")


@query(
    f"""with {_ITEMS}, inv as (select * from items where coalesce(alias, '') <> ''), s as (select survey_id, alias, section, count(*) as n, arg_min(record_id, (source_order, record_id)) as node from inv group by all),
w as (select survey_id, alias, count(*) as n, arg_min(record_id, (source_order, record_id)) as node from inv group by all),
refs as (select r.record_id, i.survey_id, i.alias, case when r.needs_review then i.section end as section, case when not r.needs_review then i.section end as default_section from variable_records r join items i using (record_id)),
j as (select refs.record_id, coalesce(refs.section is not null or s.n is not null, false) as scoped, s.n as sn, s.node as snode, w.n as wn, w.node as wnode from refs left join s on s.survey_id = refs.survey_id and s.alias = refs.alias and s.section = coalesce(refs.section, refs.default_section)
  left join w on w.survey_id = refs.survey_id and w.alias = refs.alias),
k as (select record_id, coalesce(case when scoped then sn else wn end, 0) as n_candidates, case when scoped then snode else wnode end as node from j)
select record_id, n_candidates, case when n_candidates = 1 then node end as node_id, case when n_candidates = 1 then 'resolved' when n_candidates > 1 then 'ambiguous' else 'unresolved' end as resolution from k"""
)
def resolve_refs(table):
    items = _items(table)
    inventory = items.filter("coalesce(alias, '') != ''").withColumn("node_id", F.col("record_id")).withColumn("source_order", F.struct("source_order", "record_id"))
    flags = table("variable_records").select("record_id", "needs_review")
    references = items.join(flags, "record_id").select("record_id", "survey_id", "kind", "alias", F.when(F.col("needs_review"), F.col("section")).alias("section"), F.when(~F.col("needs_review"), F.col("section")).alias("default_section"))
    return resolve.resolve(references, inventory, ["survey_id"]).select("record_id", "n_candidates", "node_id", "resolution")


@query(f"with {_ITEMS} select survey_id, section, alias, count(*) as n, min(source_order) as first_order from items where coalesce(alias, '') <> '' group by all having count(*) > 1")
def printed_ambiguities(table):
    return resolve.printed_ambiguities(_items(table).filter("coalesce(alias, '') != ''"), ["survey_id"]).select("survey_id", "section", "alias", "n", "first_order")


@query(
    """with v as (select survey_id, record_id, lower(trim(raw_name, ' ')) as m, needs_review from variable_records where raw_name is not null),
l as (select survey_id, m, min(record_id) as line_id from v where needs_review group by all having count(*) = 1), r as (select survey_id, m, min(record_id) as variable_id from v where not needs_review group by all having count(*) = 1)
select l.survey_id, line_id, variable_id from l join r using (survey_id, m)"""
)
def link_variables(table):
    named = table("variable_records").filter("raw_name is not null").select("survey_id", "record_id", "needs_review", F.lower(F.trim("raw_name")).alias("match"))
    lines = named.filter("needs_review").select("survey_id", "match", F.col("record_id").alias("line_id"))
    return resolve.unique_matches(lines, named.filter("not needs_review").select("survey_id", "match", F.col("record_id").alias("variable_id")), ["survey_id"])


@query("""select n_nationkey, 'nation:' || sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') as stable_id from nation""")
def stable_ids(table):
    fields = {"key": F.col("n_nationkey").cast("string"), "name": I.json_string(F.col("n_name")), "region": F.col("n_regionkey").cast("string")}
    return table("nation").select("n_nationkey", I.stable_id_of("nation", I.canonical_object(**fields)).alias("stable_id"))


def _evidence(table):
    li = table("lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "default").when(F.col("l_returnflag") == "N", "conditional").otherwise("sequential")
    view = F.when(F.col("l_linenumber") % 3 == 0, "incoming").when(F.col("l_linenumber") % 3 == 1, "forward").otherwise("native")
    return li.select(
        F.col("l_orderkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), kind.alias("kind"), F.col("l_linestatus").alias("condition_key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"), F.col("l_discount").alias("confidence"), F.when(F.col("l_linenumber") < 5, F.col("l_linenumber") % 3).alias("priority"), view.alias("perspective"),
    )


_CLAIMS = """e as (select l_orderkey as source, l_partkey % 50 as target, case l_returnflag when 'A' then 'default' when 'N' then 'conditional' else 'sequential' end as kind, l_linestatus as condition_key, l_discount as confidence,
  case when l_linenumber < 5 then l_linenumber % 3 end as priority, l_linenumber, case l_linenumber % 3 when 0 then 'incoming' when 1 then 'forward' else 'native' end as view from lineitem),
c as (select source, target, kind, condition_key, count(*) as n_evidence, max(confidence) as confidence, min(l_linenumber) as first_line, case when min(priority) = max(priority) then min(priority) end as priority, coalesce(min(priority) <> max(priority), false) as differ,
  bool_or(view in ('forward', 'native')) as own, bool_or(view = 'incoming') as inc from e group by all)"""
_ISSUES = (
    _CLAIMS
    + """, fw as (select distinct source, kind, condition_key from c where own), iw as (select distinct source, kind, condition_key from c where inc and not own),
d as (select c.*, count(*) filter (kind = 'default') over (partition by source) as nd, case when priority is not null then count(*) over (partition by source, priority) else 0 end as np, fw.source is not null as hf, iw.source is not null as hi
  from c left join fw using (source, kind, condition_key) left join iw using (source, kind, condition_key)),
m as (select *, list_filter([case when case when inc and not own then hf else hi end then 'conflicting_target' end, case when kind = 'default' and nd > 1 then 'conflicting_default' end,
  case when differ or np > 1 then 'conflicting_priority' end, case when inc and not own and not hf then 'incoming_only' end], lambda x: x is not null) as issues from d)"""
)


@query(f"with {_CLAIMS} select source, target, kind, condition_key, n_evidence, confidence, first_line, priority from c")
def claims(table):
    return C.build_claims(_evidence(table), []).select("source", "target", "kind", "condition_key", "n_evidence", "confidence", F.col("first_pos.l_linenumber").alias("first_line"), "priority")


@query(f"with {_ISSUES} select source, target, kind, condition_key, array_to_string(issues, ',') as issues from m")
def claim_issues(table):
    return C.mark_issues(C.build_claims(_evidence(table), []), []).select("source", "target", "kind", "condition_key", F.array_join("issues", ",").alias("issues"))


@query(f"with {_ISSUES} select source, target, kind, condition_key, priority, confidence from m where len(issues) = 0 and own")
def accepted_edges(table):
    return C.accepted_edges(C.mark_issues(C.build_claims(_evidence(table), []), [])).select("source", "target", "kind", "condition_key", "priority", "confidence")


@query(f"with {_ISSUES} select source, target, kind, condition_key, case when list_has_any(issues, ['ambiguous_target', 'opaque_condition', 'conflicting_target', 'unclear_statement']) then 'needs_human_review' else 'needs_agent_review' end as status from m where len(issues) > 0")
def claim_candidates(table):
    return C.candidates(C.mark_issues(C.build_claims(_evidence(table), []), [])).select("source", "target", "kind", "condition_key", "status")


@query(f"with {_ISSUES}, x as (select source, first_line, unnest(issues) as issue from m) select source, issue, count(*) as n_claims, min(first_line) as first_line, issue = 'conflicting_target' as needs_human from x group by source, issue")
def discrepancies(table):
    marked = C.mark_issues(C.build_claims(_evidence(table), []), [])
    return C.discrepancies(marked, []).select("source", "issue", "n_claims", F.col("first_pos.l_linenumber").alias("first_line"), "needs_human")


@query("select l_orderkey as node, array_to_string(list(l_linenumber::varchar order by l_linenumber), ',') as edge_ids, count(distinct l_suppkey) as n_neighbours from lineitem group by l_orderkey")
def adjacency(table):
    edges = table("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("rank"), F.col("l_linenumber").cast("string").alias("edge_id"))
    return graph.adjacency(edges).select("node", F.array_join("edge_ids", ",").alias("edge_ids"), F.size("neighbours").cast("long").alias("n_neighbours"))


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_partkey, l_linenumber) as place from lineitem")
def numbered_edges(table):
    edges = table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("rank"), F.col("l_linenumber").alias("edge_id"))
    return graph.numbered_edges(edges).select("l_orderkey", "l_linenumber", "place")


def _order_graph(table):
    """A sparse directed graph: customers to places derived from their orders, some of which are customers again."""
    return table("orders").select(F.col("o_custkey").alias("source"), ((F.col("o_orderkey") * 37) % 10007).alias("target"))


_GRAPH = "g as (select distinct o_custkey as source, (o_orderkey * 37) % 10007 as target from orders), nodes as (select source as node from g union select target from g)"


@query(f"with recursive {_GRAPH}, r as (select c_custkey as node from customer where c_nationkey = 3 union select g.target from r join g on g.source = r.node) select node from r")
def reachable(table):
    starts = table("customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("node"))
    return graph.reachable(starts, _order_graph(table)).select("node")


@query(f"with recursive {_GRAPH}, r as (select c_custkey as node from customer where c_nationkey = 3 union select g.target from r join g on g.source = r.node) select node from nodes where node not in (select node from r)")
def unreachable(table):
    edges = _order_graph(table)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    return graph.unreachable(nodes, table("customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("node")), edges)


def _terminal_nodes(table):
    edges = _order_graph(table)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    ends = table("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("node"), F.lit(True).alias("end"))
    return nodes.join(ends, "node", "left").select("node", F.coalesce("end", F.lit(False)).alias("is_terminal")), edges


@query(f"with {_GRAPH} select node from nodes where node not in (select source from g) and node not in (select c_custkey from customer where c_acctbal < 0)")
def dead_ends(table):
    return graph.dead_ends(*_terminal_nodes(table)).select("node")


@query(f"with recursive {_GRAPH}, r as (select node from nodes where node in (select c_custkey from customer where c_acctbal < 0) union select g.source from r join g on g.target = r.node) select node from nodes where node not in (select node from r)")
def no_terminal_path(table):
    return graph.without_terminal_path(*_terminal_nodes(table)).select("node")


_REACH = f"{_GRAPH}, m as (select target as node from g union select source from g), w as (select source, target from g union select w.source, g.target from w join g on g.source = w.target), b as (select a.source as node, a.target as other from w a join w z on z.source = a.target and z.target = a.source), scc as (select n.node, coalesce(least(n.node, min(b.other)), n.node) as component from m n left join b on b.node = n.node group by n.node)"


@query(f"with recursive {_REACH} select node, component from scc")
def strong_components(table):
    edges = _order_graph(table)
    return graph.strong_components(edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct(), edges)


@query(
    f"""with recursive {_REACH}, cyc as (select component from scc left join g on g.source = scc.node and g.target = scc.node group by component having count(distinct node) > 1 or count(g.source) > 0),
s as (select scc.* from scc join cyc using (component)), e as (select g.source, g.target, a.component as c1, z.component as c2 from g left join s a on a.node = g.source left join s z on z.node = g.target)
select c1 as component, source, target, case when target <= source then 'return' else 'internal' end as role from e where c1 = c2
union all select c1, source, target, 'exit' from e where c1 is not null and c1 is distinct from c2 union all select c2, source, target, 'entry' from e where c2 is not null and c1 is distinct from c2"""
)
def loop_roles(table):
    edges = _order_graph(table).distinct()
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    return graph.loop_edge_roles(graph.strong_components(nodes, edges), edges, nodes.withColumn("ord", F.col("node")))


@query(
    """with recursive e as (select o_custkey as u, 1000000 + (o_orderkey * 37) % 10007 as v from orders), both_ways as (select u, v from e union select v, u from e),
n as (select distinct u as node from both_ways),
l(node, component) using key (node) as (select node, node from n
  union select b.v, min(l.component) from l join both_ways b on b.u = l.node join recurring.l as now on now.node = b.v where l.component < now.component group by b.v)
select node, component from l"""
)
def connected(table):
    return connected_components(table("orders").select(F.col("o_custkey").alias("u"), (1_000_000 + (F.col("o_orderkey") * 37) % 10007).alias("v")), "u", "v")


@query("with e as (select user_id as source, event_type as kind, count(*) as n from events group by all) select source, kind, n from e where n > 1")
def duplicate_edges(table):
    return graph.duplicate_edges(table("events").select(F.col("user_id").alias("source"), F.col("event_type").alias("kind")), ["source", "kind"])


@query("select l_orderkey as edge_order, l_linenumber as edge_line from lineitem where l_partkey not in (select p_partkey from part) or l_suppkey not in (select s_suppkey from supplier)")
def dangling_edges(table):
    edges = table("lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("edge_id"), F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 10_000_000).alias("target"))
    nodes = table("part").select(F.col("p_partkey").alias("node")).unionByName(table("supplier").select((F.col("s_suppkey") + 10_000_000).alias("node")))
    return graph.dangling_edges(edges, nodes).select(F.col("edge_id.l_orderkey").alias("edge_order"), F.col("edge_id.l_linenumber").alias("edge_line")).distinct()


@query(
    """with d as (select user_id as source, count(distinct event_type) as n_known from events group by all),
t as (select user_id as source, event_type as value, count(distinct extract(hour from ts)::int // 8) as n from events where value >= 20 group by all),
c as (select source, count(*) as n_covered, max(n) as most from t group by source)
select source, n_known, n_covered, n_covered = n_known as is_covered, most > 1 as has_overlap from d join c using (source)"""
)
def branch_coverage(table):
    """Of the event types that a user has at all, those that the user's branches (thirds of the day) take with a high value."""
    events = table("events")
    branches = events.filter("value >= 20").select(F.col("user_id").alias("source"), (F.hour("ts") / 8).cast("int").alias("branch"), F.col("event_type").alias("value")).distinct()
    return C.branch_coverage(branches, events.select(F.col("user_id").alias("source"), F.col("event_type").alias("value")), [])


@query("select user_id as node, count(distinct event_type) as n_conditions, count(distinct event_type) > 1 as is_conflict, case when count(distinct event_type) = 1 then min(event_type) end as condition from events group by user_id")
def activation_consensus(table):
    rows = table("events").select(F.col("user_id").alias("node"), F.col("event_type").alias("condition_key"), F.col("event_type").alias("condition"), F.col("event_id").alias("pos"))
    return C.activation_consensus(rows, []).select("node", "n_conditions", "is_conflict", "condition")


@query("with o as (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as supersedes from orders) select o_orderkey as decision_id from o where o_orderkey not in (select supersedes from o where supersedes is not null)")
def decision_active(table):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return review.active_decisions(table("orders").select(F.col("o_orderkey").alias("decision_id"), F.lag("o_orderkey").over(w).alias("supersedes"))).select("decision_id")


@query("select o_custkey, max(o_orderkey) as decision_id from orders group by o_custkey")
def decision_latest(table):
    rows = table("orders").select("o_custkey", F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("decision_id"))
    return review.latest_decision(rows, ["o_custkey"]).select("o_custkey", "decision_id")


_MULTI = """e as (select l_returnflag as grp, l_partkey, count(*) as e from lineitem group by all), a as (select l_returnflag as grp, l_partkey, count(*) as a from lineitem where l_discount < 0.05 group by all),
j as (select coalesce(e.grp, a.grp) as grp, coalesce(e, 0) as e, coalesce(a, 0) as a from e full join a on e.grp = a.grp and e.l_partkey = a.l_partkey),
m as (select grp, sum(e)::bigint as n_expected, sum(a)::bigint as n_actual, sum(least(e, a))::bigint as n_matched from j group by grp)"""


def _stages(table):
    li = table("lineitem").withColumnRenamed("l_returnflag", "grp")
    return E.multiset_metrics(li, li.filter("l_discount < 0.05"), ["grp"], ["l_partkey"])


@query(f"with {_MULTI} select grp, n_expected, n_actual, n_matched, n_matched / nullif(n_actual, 0) as precision, n_matched / nullif(n_expected, 0) as recall from m")
def eval_multiset(table):
    return _stages(table)


@query(f"with {_MULTI}, l as (select l_returnflag as grp, count(*) as n from lineitem group by all) select m.grp, l.n / nullif(l.n, 0) - n_matched / nullif(n_expected, 0) as recall_delta from m join l using (grp)")
def eval_deltas(table):
    li = table("lineitem").withColumnRenamed("l_returnflag", "grp")
    return E.deltas(E.multiset_metrics(li, li, ["grp"], ["l_partkey"]), _stages(table), ["grp"], ["recall"])


@query(
    """with e as (select record_id, unnest(['name', 'label', 'question']) as path, unnest([raw_name, label, question_text]) as value, survey_id from variable_records),
a as (select record_id, unnest(['name', 'label', 'question']) as path, unnest([lower(raw_name), label, trim(question_text, ' ')]) as value from variable_records)
select e.survey_id, count(*) as n_fields, count(*) filter (e.value is not distinct from a.value) as n_equal from e join a using (record_id, path) group by e.survey_id"""
)
def field_accuracy(table):
    names = F.array(F.lit("name"), F.lit("label"), F.lit("question"))

    def leaves(*values):
        return table("variable_records").select("survey_id", F.explode(F.arrays_zip(names.alias("p"), F.array(*values).alias("v"))).alias("x"), "record_id").select("survey_id", F.concat_ws("/", "record_id", "x.p").alias("path"), F.col("x.v").alias("value"))

    expected = leaves(F.col("raw_name"), F.col("label"), F.col("question_text"))
    actual = leaves(F.lower("raw_name"), F.col("label"), F.trim("question_text"))
    return E.field_accuracy(expected, actual, ["survey_id"]).select("survey_id", "n_fields", "n_equal")


@query("select event_id, json_extract_string(props, '/k')::bigint as k from events")
def json_pointer(table):
    return table("events").select("event_id", T.json_pointer(F.col("props"), "/k").cast("long").alias("k"))


@query("select doc_id, coalesce(nullif(lower(regexp_extract(source_name, '\\.([^./\\\\]+)$', 1)), ''), regexp_extract(media_type, '([^/]*)$', 1)) as source_format from source_documents")
def source_formats(table):
    return table("source_documents").select("doc_id", T.source_format(F.col("source_name"), F.col("media_type")).alias("source_format"))


@query("select s.survey_id, count(d.doc_id) as n_documents, coalesce(sum(len(c.failed_units)), 0)::bigint as n_failed_units from surveys s left join source_documents d using (survey_id) left join coverage c using (doc_id) group by s.survey_id")
def survey_sources(table):
    joined = table("surveys").select("survey_id").join(table("source_documents").select("survey_id", "doc_id"), "survey_id", "left").join(table("coverage").select("doc_id", F.size("failed_units").alias("f")), "doc_id", "left")
    return joined.groupBy("survey_id").agg(F.count("doc_id").alias("n_documents"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_failed_units"))


_REDACT = "regexp_replace(regexp_replace(text, '{}', '\\1[REDACTED]@', 'g'), '{}', '{}', 'g')".format(R.URL_USER, R.PATTERN.replace("'", "''"), R.replacement("\\"))


@query(f"select doc_id, {_REDACT} as text from documents")
def redacted_texts(table):
    return table("documents").select("doc_id", R.redacted(F.col("text")).alias("text"))


@query("""with j as (select doc_id, case when text is null then '{"doc_id":' || doc_id || '}' else '{"doc_id":' || doc_id || ',"text":' || to_json(text)::varchar || '}' end as json from documents)
select doc_id, array_to_string(list_transform(regexp_extract_all(json, '(?s).'), lambda c: case when not regexp_matches(c, '[\\p{Cc}\\p{Cf}\\p{Co}\\p{Zl}\\p{Zp}]') then c
  when unicode(c) < 65536 then printf('\\u%04x', unicode(c)) else printf('\\u%04x\\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) end), '') as json from j""")
def model_json(table):
    return table("documents").select("doc_id", T.escape_invisible(F.to_json(F.struct("doc_id", "text"))).alias("json"))


@query("select doc_id, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\p{Z}]+')))::bigint as result, count(*) as n_chunks, 0::bigint as n_failed, 'success' as status from source_chunks group by doc_id")
def provider_map_reduce(table):
    chunks = table("source_chunks").select("doc_id", "chunk_id", F.struct("ord", "chunk_key").alias("chunk_ord"), "text")
    rule = provider.rule_provider(_count_words)
    return provider.map_reduce(chunks, rule, "n_words long", lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x["n_words"]))


def _count_words(message: str) -> dict:
    import json

    return {"n_words": len((json.loads(message).get("text") or "").split())}


@query("""select survey_id as form_id, source_order + 2 as row_no, trim(raw_name || '_' || record_id, ' ') as raw_name, nullif(trim(label, ' '), '') as label,
case data_type when 'numeric' then 'numeric' when 'date' then 'date' when 'categorical_single' then 'categorical_single' when 'categorical_multi' then 'categorical_multi' else 'text' end as data_type,
case when data_type in ('categorical_single', 'categorical_multi') then 'missing_categories' else '' end as review_reasons from variable_records where raw_name is not null""")
def form_variables(table):
    """Records written as the sheets of a form, read back as typed variables."""
    records = table("variable_records").filter("raw_name is not null")
    kinds = F.create_map(*map(F.lit, ("numeric", "integer", "text", "text", "date", "date", "categorical_single", "select_one l", "categorical_multi", "select_multiple l")))
    rows = records.select(F.col("survey_id").alias("form_id"), F.lit("survey").alias("sheet"), (F.col("source_order") + 2).alias("row_no"), F.array(F.coalesce(kinds[F.col("data_type")], F.lit("text")), F.concat_ws("_", "raw_name", "record_id"), F.coalesce("label", F.lit("")), F.lit("")).alias("cells"))
    heads = records.select(F.col("survey_id").alias("form_id")).distinct().select("form_id", F.lit("survey").alias("sheet"), F.lit(1).alias("row_no"), F.array(*map(F.lit, ("type", "name", "label", "relevant"))).alias("cells"))
    tables = forms.form_tables(rows.unionByName(heads), F.lit("2021-01-01").cast("date"))
    return tables["variables"].select("form_id", "row_no", "raw_name", "label", "data_type", F.array_join("review_reasons", ",").alias("review_reasons"))
