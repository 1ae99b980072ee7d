"""Flow told by a model: a forward pass over a questionnaire's parts, a second look at risky items, and what both come to.

Each pass is one batch of calls whose answers are materialised before anything reads them. An answer counts as a whole: it
must name its part and pass, examine exactly the items asked for in their order, and quote its blocks; otherwise its part
fails and gives one row of failure.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import Config
from tessella.functions import conditions as C
from tessella.functions import identity as I
from tessella.operators import provider, regions, resolve, risks
from tessella.plans import routing
from tessella.runtime import cut_lineage

#: The passes and the views that their evidence gives; items of a part at most.
FORWARD, INCOMING = "forward", "incoming_activation"
VIEWS = {FORWARD: "forward", INCOMING: "incoming"}
MOST_ITEMS = 40
ANSWER = (
    "chunk_id string, pass_kind string, examined array<string>, unresolved array<string>, evidence array<struct<local_id string, source string, target string, target_section string, kind string, "
    "condition string, priority int, block_id string, quote string, confidence double>>"
)
KEYS = ["doc_id"]


def requests(items: DataFrame, inventory: DataFrame, blocks: DataFrame, pass_kind: str, most: int = MOST_ITEMS) -> DataFrame:
    """``doc_id, chunk_id, asked, section, message``: one request for each part of ``items``, which are rows of ``inventory``.

    ``inventory``: doc_id, node_id, kind, alias, section, source_order, block_id. A forward request has the items on both
    sides of its part; a request about incoming ways has what stands before each of its items instead.
    """
    asked = items.withColumn("repeat_group", F.lit(None).cast("string"))
    placed = items.join(regions.region_chunks(asked, KEYS, most), [*KEYS, "node_id"])
    by = [*KEYS, "chunk_no"]
    lists = placed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("source_order", "alias", "section"))).alias("i"))
    texts = regions.source_texts(placed.select(*KEYS, F.col("chunk_no").alias("slice_id"), F.array("block_id").alias("block_ids")), blocks, KEYS).withColumnRenamed("slice_id", "chunk_no")
    names = inventory.select(*KEYS, "node_id", "alias")
    if pass_kind == FORWARD:
        sides = regions.boundaries(placed, KEYS)
        beside = sides.select(*by, F.explode(F.array_compact(F.array("before", "after"))).alias("node_id"))
    else:
        near = regions.relevant_items(inventory, items, KEYS)
        beside = near.join(placed.select(*by, F.col("node_id").alias("target")), [*KEYS, "target"]).select(*by, "node_id").distinct()
    context = beside.join(names, [*KEYS, "node_id"]).groupBy(*by).agg(F.sort_array(F.collect_set("alias")).alias("context"))
    told = lists.join(texts, by, "left").join(context, by, "left")
    chunk_id = F.format_string(f"{pass_kind}-%06d", F.col("chunk_no") + 1)
    aliases = F.transform("i", lambda x: x["alias"])
    message = F.to_json(F.struct(chunk_id.alias("chunk_id"), F.lit(pass_kind).alias("pass_kind"), aliases.alias("items"), F.col("context"), F.coalesce("text", F.lit("")).alias("text")))
    return told.select(*KEYS, chunk_id.alias("chunk_id"), aliases.alias("asked"), F.element_at("i", 1)["section"].alias("section"), message.alias("message"))


def ask(asked: DataFrame, blocks: DataFrame, make_provider: Callable, config: Config, pass_kind: str) -> tuple[DataFrame, DataFrame]:
    """``(evidence, calls)`` of one pass: evidence of sound answers, and a row a part with why it failed, if it did."""
    digested = asked.withColumn("request_sha", provider.request_digest(F.lit(ANSWER), F.lit(pass_kind), F.col("message")))
    retry = provider.Retry(config.transport_tries, config.invalid_tries)
    told = provider.map_fitting(digested, make_provider, config.request_tokens, retry=retry, most_calls=config.concurrency).withColumn("answer", F.from_json("payload", ANSWER))
    own = (F.col("answer.chunk_id") == F.col("chunk_id")) & (F.col("answer.pass_kind") == pass_kind) & F.equal_null("answer.examined", "asked")
    calls = cut_lineage(told.withColumn("reason", F.when(F.col("ok") & F.coalesce(own, F.lit(False)), F.lit(None).cast("string")).otherwise(F.coalesce("reason", F.lit(provider.INVALID)))))
    said = calls.filter("reason is null").select(*KEYS, "chunk_id", "section", F.posexplode("answer.evidence").alias("place", "e")).select(*KEYS, "chunk_id", "section", "place", "e.*")
    spans = said.withColumns({"page": F.lit(None).cast("int"), "row_start": F.lit(None).cast("int"), "row_end": F.lit(None).cast("int")})
    checked = cut_lineage(resolve.check_quotes(spans, blocks))
    shapes = checked.filter("condition is not null").select(*KEYS, "chunk_id", F.explode(C.condition_faults(F.col("condition"))).alias("fault"))
    faults = shapes.unionByName(checked.filter("quote_fault is not null").select(*KEYS, "chunk_id", F.col("quote_fault").alias("fault")))
    broken = faults.groupBy(*KEYS, "chunk_id").agg(F.min("fault").alias("fault"))
    sound = checked.join(broken, [*KEYS, "chunk_id"], "left_anti")
    pos = F.struct(F.lit(list(VIEWS).index(pass_kind)).alias("pass"), "chunk_id", "place")
    evidence = sound.select(
        *KEYS, F.lower("source").alias("source_ref"), F.lower("target").alias("target_ref"), "section", "target_section", "kind", "condition", pos.alias("pos"), "priority", "confidence",
        F.concat_ws(":", "chunk_id", "local_id").alias("evidence_id"), F.lit(VIEWS[pass_kind]).alias("perspective"),
    )
    failed = F.coalesce("reason", "fault")
    return evidence, calls.join(broken, [*KEYS, "chunk_id"], "left").select(*KEYS, "chunk_id", failed.isNull().alias("ok"), failed.alias("reason"), "tries", F.col("answer.unresolved").alias("unresolved"), "asked")


def moves_of(evidence: DataFrame, inventory: DataFrame) -> DataFrame:
    """Evidence as ``risks`` reads it: its source's node, and all nodes that its target may be."""
    nodes = inventory.select(*KEYS, "node_id", "kind", "alias", "section", "source_order")
    source = evidence.select(*KEYS, "pos", F.lit("question").alias("kind"), F.col("source_ref").alias("alias"), F.lit(None).cast("string").alias("section"), F.col("section").alias("default_section"))
    sources = resolve.resolve(source, nodes, KEYS).select(*KEYS, "pos", F.col("node_id").alias("source"))
    told = evidence.join(sources, [*KEYS, "pos"]).join(nodes.select(*KEYS, F.col("node_id").alias("source"), F.col("section").alias("own")), [*KEYS, "source"], "left")
    wanted = told.select(*KEYS, "pos", F.col("target_ref").alias("alias"), F.coalesce("target_section", "own").alias("scope"), F.col("target_section").isNotNull().alias("explicit"))
    met = wanted.join(nodes.select(*KEYS, "alias", "section", "node_id"), [*KEYS, "alias"]).withColumn("inside", F.equal_null("section", "scope"))
    scoped = met.groupBy(*KEYS, "pos").agg(F.collect_set(F.when(F.col("inside"), F.col("node_id"))).alias("near"), F.collect_set("node_id").alias("all"), F.bool_or("explicit").alias("explicit"))
    targets = F.sort_array(F.when(F.col("explicit") | (F.size("near") > 0), F.col("near")).otherwise(F.col("all")))
    opaque = F.coalesce(F.contains("condition", F.lit('"opaque"')), F.lit(False))
    return told.join(scoped, [*KEYS, "pos"], "left").select(*KEYS, F.col("pos").alias("move_id"), "source", F.coalesce(targets, F.array().cast(f"array<{inventory.schema['node_id'].dataType.simpleString()}>")).alias("targets"), opaque.alias("is_opaque"), "confidence")


def extract_routing(inventory: DataFrame, blocks: DataFrame, make_provider: Callable, config: Config = Config(), most: int = MOST_ITEMS) -> dict[str, DataFrame]:
    """edges, candidates, discrepancies, targets (risky items and why) and calls of all documents.

    ``blocks``: doc_id, block_id, ord, text, page, pages, table_rows.
    """
    inventory = cut_lineage(inventory)
    questions = inventory.filter("kind = 'question'")
    first, calls = ask(requests(questions, inventory, blocks, FORWARD, most), blocks, make_provider, config, FORWARD)
    first = cut_lineage(first)
    lost = calls.filter(F.col("ok") & (F.size("unresolved") > 0)).select(*KEYS, F.explode("asked").alias("alias"))
    examined = questions.join(lost, [*KEYS, "alias"], "left_semi").select(*KEYS, F.col("node_id").alias("node"))
    targets = cut_lineage(risks.select_targets(moves_of(first, inventory), inventory, KEYS, examined))
    risky = questions.join(targets.select(*KEYS, F.col("node").alias("node_id")), [*KEYS, "node_id"], "left_semi")
    second, more = ask(requests(risky, inventory, blocks, INCOMING, most), blocks, make_provider, config, INCOMING)
    found = routing.reconcile(inventory, first.unionByName(cut_lineage(second)), KEYS)
    return found | {"targets": targets, "calls": reduce(DataFrame.unionByName, [calls, more])}


def question_inventory(blocks: DataFrame) -> DataFrame:
    """The printed questions of text blocks, with their nodes and blocks, as ``extract_routing`` reads them."""
    nodes = routing.inventory_nodes(routing.text_inventory(blocks))
    places = blocks.select("doc_id", F.col("ord").alias("block_ord"), "block_id")
    return nodes.withColumn("block_ord", F.when(F.col("kind") == "question", F.col("source_order.ord"))).join(places, ["doc_id", "block_ord"], "left").select("doc_id", "node_id", "kind", F.coalesce("alias", I.alias_ascii(F.col("printed"))).alias("alias"), "section", "source_order", "block_id")
