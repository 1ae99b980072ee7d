"""``python -m tessella.cli batch FOLDER --output DIR``: documents to published surveys; ``schema`` prints a table's schema."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import SparkSession

from tessella import config
from tessella.operators.provider import rule_provider
from tessella.plans.extraction import PAYLOAD, convert_folder
from tessella.sources.sink import publish


def _provider(name: str | None):
    """A provider factory given as module:function; without one, a rule that extracts nothing."""
    if name is None:
        return rule_provider(nothing)
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def nothing(message: str) -> dict:
    """The answer that no variable was found, naming the part that was asked for."""
    return {"chunk_id": message.split("\nPart: ", 1)[1].split("\n", 1)[0], "variables": []}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella")
    commands = parser.add_subparsers(dest="command", required=True)
    batch = commands.add_parser("batch", help="convert a folder of documents and publish the results")
    batch.add_argument("folder")
    batch.add_argument("--name", default="corpus")
    batch.add_argument("--config")
    batch.add_argument("--output")
    batch.add_argument("--provider", help="module:factory")
    batch.add_argument("--confidence-threshold", type=float)
    batch.add_argument("--overwrite", action="store_true")
    check = commands.add_parser("config", help="check a configuration")
    check.add_argument("--config")
    commands.add_parser("schema", help="the schema of what a provider answers")
    args = parser.parse_args(arguments)
    if args.command == "schema":
        print(PAYLOAD)
        return 0
    if args.command == "config":
        print(json.dumps(vars(config.resolve(args.config)), indent=2))
        return 0
    settings = config.resolve(args.config, output=args.output, confidence_threshold=args.confidence_threshold)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    tables = convert_folder(spark, args.folder, _provider(args.provider), settings)
    generation = publish(tables, settings.output, args.name, args.overwrite)
    counts = {r["status"]: r["count"] for r in tables["results"].groupBy("status").count().collect()}
    manifest = {"schema_version": 1, "name": args.name, "generation": generation, "documents": counts}
    with open(os.path.join(settings.output, f"{args.name.lower()}-batch.json"), "w") as file:
        json.dump(manifest, file, indent=2, sort_keys=True)
    print(json.dumps(manifest))
    return 0 if counts and not set(counts) - {"success", "partial"} else 1


if __name__ == "__main__":
    sys.exit(main())
