"""Model calls as a batch operator: a pluggable provider, retries with backoff, a request cache, map and reduce over chunks.

Requests are told apart by a digest of all that the answer depends on; equal requests are called once, and answers are
materialised before anything reads them, so a recomputed task never calls again for rows that are there.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import cut_lineage

#: Reasons of a failed call; the first two are tried again.
TRANSPORT, INVALID, TRUNCATED, REFUSED = "transport", "invalid_response", "truncated", "refused"
#: The reason of a request that is too large to be sent; tokens that a call takes besides its message.
CAPACITY, OVERHEAD = "input_limit", 4


class ProviderError(Exception):
    def __init__(self, reason: str, detail: str = ""):
        super().__init__(detail or reason)
        self.reason = reason


@dataclass(frozen=True)
class Retry:
    """Budgets of tries for transport and for invalid answers; waits of initial * 2**n up to most."""

    transport: int = 3
    invalid: int = 2
    initial: float = 0.5
    most: float = 8.0

    def wait(self, n: int) -> float:
        return min(self.most, self.initial * 2 ** (n - 1))


@dataclass
class Answer:
    payload: Any
    input_tokens: int = 0
    output_tokens: int = 0
    finish: str = "stop"


def call(generate: Callable[[str], Answer], message: str, validate: Callable[[Any], str | None], retry: Retry, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(ok, payload JSON, reason, tries, input tokens, output tokens); a truncated answer is never tried again."""
    left = {TRANSPORT: retry.transport, INVALID: retry.invalid}
    tries = used_in = used_out = 0
    while True:
        tries += 1
        try:
            answer = generate(message)
            used_in, used_out = used_in + answer.input_tokens, used_out + answer.output_tokens
            if answer.finish == "length":
                raise ProviderError(TRUNCATED)
            fault = validate(answer.payload)
            if fault:
                raise ProviderError(INVALID, fault)
            return True, json.dumps(answer.payload, ensure_ascii=False), None, tries, used_in, used_out
        except ProviderError as error:
            left[error.reason] = left.get(error.reason, 1) - 1
            if left[error.reason] <= 0:
                return False, None, error.reason, tries, used_in, used_out
            sleep(retry.wait(tries))


_CALLS = "request_sha string, ok boolean, payload string, reason string, tries int, input_tokens long, output_tokens long"


def request_digest(*fields: Column) -> Column:
    """A digest over all that an answer depends on, each field with its length, so that fields can't run together."""
    parts = [F.concat(F.length(F.coalesce(f.cast("string"), F.lit("")) ).cast("string"), F.lit(":"), F.coalesce(f.cast("string"), F.lit(""))) for f in fields]
    return F.sha2(F.concat_ws("|", *parts), 256)


def map_requests(requests: DataFrame, provider: Callable[[], Callable[[str], Answer]], validate: Callable[[Any], str | None] = lambda p: None, retry: Retry = Retry(), most_calls: int | None = None) -> DataFrame:
    """Answers joined to ``requests`` (with request_sha and message); each digest is called once.

    ``provider`` makes a client in each task; ``most_calls`` bounds tasks that call at one time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = provider()
        for batch in batches:
            rows = [(sha, *call(generate, message, validate, retry)) for sha, message in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            kinds = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split(" ")[0] for f in _CALLS.split(", ")])

    distinct = requests.groupBy("request_sha").agg(F.first("message").alias("message"))
    if most_calls:
        # Not coalesce, which would run the aggregate before it in as few tasks.
        distinct = distinct.repartition(most_calls)
    answers = cut_lineage(distinct.mapInArrow(run, _CALLS))
    return requests.join(answers, "request_sha")


def rule_provider(rule: Callable[[str], Any]) -> Callable[[], Callable[[str], Answer]]:
    """A deterministic provider without a network: the payload is ``rule(message)``; tokens are bytes."""

    def make():
        def generate(message: str) -> Answer:
            payload = rule(message)
            return Answer(payload, len(message.encode()), len(json.dumps(payload)))

        return generate

    return make


def scripted_provider(script: dict[str, list]) -> Callable[[], Callable[[str], Answer]]:
    """A provider that gives each message its answers in turn; an exception in the script is raised."""

    def make():
        left = {k: list(v) for k, v in script.items()}

        def generate(message: str) -> Answer:
            step = left[message].pop(0) if left.get(message) else ProviderError(TRANSPORT)
            if isinstance(step, Exception):
                raise step
            return step if isinstance(step, Answer) else Answer(step)

        return generate

    return make


def chunk_message(chunk_id: Column, text: Column, inventory: Column | None = None) -> Column:
    fields = [chunk_id.alias("chunk_id"), text.alias("text")]
    return F.to_json(F.struct(*fields, *([inventory.alias("inventory")] if inventory is not None else [])))


def capacity_faults(requests: DataFrame, most_tokens: int) -> DataFrame:
    """Requests whose bytes and overhead exceed what a call may hold."""
    return requests.filter(F.octet_length("message") + OVERHEAD > most_tokens)


def map_fitting(requests: DataFrame, provider: Callable[[], Callable[[str], Answer]], most_tokens: int, **options) -> DataFrame:
    """As ``map_requests``; a request that exceeds what a call may hold isn't sent and fails by itself."""
    told = map_requests(requests.filter(F.octet_length("message") + OVERHEAD <= most_tokens), provider, **options)
    over = capacity_faults(requests, most_tokens).withColumns({"ok": F.lit(False), "reason": F.lit(CAPACITY), "tries": F.lit(0)})
    return told.unionByName(over, allowMissingColumns=True)


def map_reduce(chunks: DataFrame, provider, schema: str, reduce_column: Callable[[Column], Column], strict: bool = False, told_by: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, result, n_chunks, n_failed, status``: a call a chunk, then a reducer over the ordered payloads of a document.

    A call is known by its message, the answer's schema and ``told_by`` (the model, the prompt's digest and whatever else
    its answer depends on).

    ``reduce_column`` gets the array of payload structs (parsed with ``schema``) in chunk order. Strict documents fail
    with any failed chunk, others are partial.
    """
    told = map_requests(chunks.withColumn("message", chunk_message(F.col("chunk_id"), F.col("text"))).withColumn("request_sha", request_digest(*map(F.lit, (schema, *told_by)), F.col("message"))), provider)
    parsed = told.withColumn("answer", F.from_json("payload", schema))
    docs = parsed.groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("chunk_ord", "answer")))), lambda x: x["answer"]).alias("answers"), F.count("*").alias("n_chunks"), F.count(F.when(~F.col("ok"), 1)).alias("n_failed")
    )
    failed = (F.size("answers") == 0) | (F.lit(strict) & (F.col("n_failed") > 0))
    return docs.select("doc_id", F.when(~failed, reduce_column(F.col("answers"))).alias("result"), "n_chunks", "n_failed", F.when(failed, "failed").when(F.col("n_failed") > 0, "partial").otherwise("success").alias("status"))


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.sum("tries").alias("n_tries"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.when(~F.col("ok"), 1)).alias("n_failed"))
