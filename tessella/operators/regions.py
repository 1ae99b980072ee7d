"""Inventories cut into stable parts, what surrounds a part, and the text and items that a request about it needs."""

from __future__ import annotations

from collections import OrderedDict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ordered import ordered_fold

#: Items just before a target that go with it, and items of all kinds that do at most.
BEFORE, MOST_RELEVANT = 3, 250


def region_chunks(inventory: DataFrame, keys: list[str], most: int, order: str = "source_order", node: str = "node_id") -> DataFrame:
    """``keys, node, chunk_no``: runs of one (section, repeat_group) stay together, packed in order up to ``most`` items.

    A run above ``most`` is cut into parts of ``most``; a part that doesn't fit what is begun opens the next chunk. The
    fold holds one part, so a document of any length streams.
    """
    schema = T.StructType([*(inventory.schema[k] for k in keys), T.StructField(node, inventory.schema[node].dataType), T.StructField("chunk_no", T.IntegerType())])

    def start():
        return {"run": None, "part": [], "filled": 0, "chunk": 0}

    def settle(s):
        part, s["part"] = s["part"], []
        if s["filled"] and s["filled"] + len(part) > most:
            s["chunk"], s["filled"] = s["chunk"] + 1, 0
        s["filled"] += len(part)
        return [(*row, s["chunk"]) for row in part]

    def step(s, row):
        out = []
        run = (row["section"], row["repeat_group"])
        if s["part"] and (run != s["run"] or len(s["part"]) == most):
            out = settle(s)
        s["run"] = run
        s["part"].append((*(row[k] for k in keys), row[node]))
        return out

    def finish(s, key):
        return settle(s) if s["part"] else []

    return ordered_fold(inventory.select(*keys, order, node, "section", "repeat_group"), keys, [order, node], start, step, finish, schema)


def boundaries(chunks: DataFrame, keys: list[str], order: str = "source_order", node: str = "node_id") -> DataFrame:
    """``keys, chunk_no, before, after``: the last item of the chunk before and the first of the chunk after."""
    ends = chunks.groupBy(*keys, "chunk_no").agg(F.min_by(node, order).alias("first"), F.max_by(node, order).alias("last"))
    other = lambda shift, end, name: ends.select(*keys, (F.col("chunk_no") + shift).alias("chunk_no"), F.col(end).alias(name))
    by = [*keys, "chunk_no"]
    return ends.select(*by).join(other(1, "last", "before"), by, "left").join(other(-1, "first", "after"), by, "left")


def source_texts(slices: DataFrame, blocks: DataFrame, keys: list[str], separator: str = "\n\n") -> DataFrame:
    """``keys, slice_id, text``: the texts of the blocks that a slice's items stand in, each once, in reading order.

    ``slices``: keys, slice_id, block_ids (of one item a row); ``blocks``: keys, block_id, ord, text. A slice is a request's
    worth of blocks, so its text is put together in one row.
    """
    wanted = slices.select(*keys, "slice_id", F.explode("block_ids").alias("block_id")).distinct()
    found = wanted.join(blocks.select(*keys, "block_id", "ord", "text"), [*keys, "block_id"])
    ordered = F.sort_array(F.collect_list(F.struct("ord", "block_id", "text")))
    return found.groupBy(*keys, "slice_id").agg(F.array_join(F.transform(ordered, lambda b: F.coalesce(b["text"], F.lit(""))), separator).alias("text"))


def relevant_items(inventory: DataFrame, targets: DataFrame, keys: list[str], most: int = MOST_RELEVANT, order: str = "source_order", node: str = "node_id") -> DataFrame:
    """``keys, target, node_id, why, place``: what goes with each target: the items just before it, then the latest item of
    each section before it, latest first, up to ``most`` of both.

    One fold in order: it holds the last items and the last item of each section seen, so nothing is paired that isn't given.
    """
    names = ["target", "node_id", "why", "place"]
    kind = inventory.schema[node].dataType
    schema = T.StructType([*(inventory.schema[k] for k in keys), T.StructField("target", kind), T.StructField("node_id", kind), T.StructField("why", T.StringType()), T.StructField("place", T.IntegerType())])
    marked = inventory.select(*keys, order, node, "section").join(targets.select(*keys, F.col(node), F.lit(True).alias("is_target")), [*keys, node], "left")

    def start():
        return {"near": deque(maxlen=BEFORE), "ends": OrderedDict()}

    def step(s, row):
        out = []
        if row["is_target"]:
            told = dict.fromkeys(reversed(s["near"]), "preceding")
            for item in reversed(s["ends"].values()):
                told.setdefault(item, "section_end")
            own = tuple(row[k] for k in keys)
            out = [(*own, row[node], item, why, n) for n, (item, why) in enumerate(list(told.items())[:most])]
        s["near"].append(row[node])
        s["ends"].pop(row["section"], None)
        s["ends"][row["section"]] = row[node]
        return out

    return ordered_fold(marked, keys, [order, node], start, step, lambda s, key: [], schema).select(*keys, *names)

