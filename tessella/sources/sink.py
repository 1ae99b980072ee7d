"""Versioned results on a shared file system: immutable generations, a manifest with digests, an atomic pointer."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that some file systems reserve.
RESERVED = frozenset(["con", "prn", "aux", "nul", *(f"com{n}" for n in range(1, 10)), *(f"lpt{n}" for n in range(1, 10))])
_PORTABLE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,119}")


class PublishError(RuntimeError):
    pass


def portable(name: str) -> str:
    """A name that every file system can hold, case folded for comparisons."""
    if not _PORTABLE.fullmatch(name) or name.endswith(".") or name.split(".")[0].lower() in RESERVED:
        raise PublishError(f"not a portable name: {name!r}")
    return name.lower()


def _write(path: str, content: bytes) -> None:
    """Whole or not at all: a temporary file, flushed, then renamed."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as file:
        file.write(content)
        file.flush()
        os.fsync(file.fileno())
    os.replace(part, path)


def _files(spark: SparkSession, folder: str) -> list[dict]:
    """Path, digest and size of each file of a generation; the tasks read and digest them, a row a file comes back."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = read.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")).collect()
    told = [{"path": r["path"].rpartition(f"/{os.path.basename(folder)}/")[2], "sha256": r["sha256"], "size": r["size"]} for r in rows]
    return sorted(told, key=lambda f: f["path"])


def publish(tables: dict[str, DataFrame], root: str, name: str, overwrite: bool = False) -> str:
    """Writes ``tables`` as a new generation of ``name`` and points to it; gives the generation's id.

    The executors write and digest the tables; the driver adds the manifest and moves the pointer last, by one
    rename, so readers see the old generation or the new one. A generation without a manifest was cut off and is
    swept by ``recover``. Names that differ only in case collide.
    """
    key = portable(name)
    home = os.path.join(root, key)
    os.makedirs(home, exist_ok=True)
    owner = os.path.join(home, "name.json")
    try:
        with open(owner, "x") as file:
            json.dump({"name": name}, file)
    except FileExistsError:
        with open(owner) as file:
            if json.load(file)["name"] != name:
                raise PublishError(f"{name!r} differs from a published name only in case") from None
    pointer = os.path.join(home, "active.json")
    if os.path.exists(pointer) and not overwrite:
        raise PublishError(f"{name!r} is published already")
    lock = os.path.join(home, "lock")
    try:
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        raise PublishError(f"{name!r} is being published") from None
    try:
        generation = uuid.uuid4().hex
        folder = os.path.join(home, generation)
        for table, df in tables.items():
            df.write.mode("errorifexists").parquet(os.path.join(folder, portable(table)))
        schemas = {table: json.loads(df.schema.json()) for table, df in tables.items()}
        manifest = {"schema_version": 2, "name": name, "generation": generation, "tables": schemas, "files": _files(next(iter(tables.values())).sparkSession, folder) if tables else []}
        _write(os.path.join(folder, "manifest.json"), json.dumps(manifest, indent=2, sort_keys=True).encode())
        _write(pointer, json.dumps({"generation": generation}).encode())
        return generation
    finally:
        os.unlink(lock)


def active(root: str, name: str) -> tuple[str, dict]:
    """(folder, manifest) of the active generation, its files checked for presence and size."""
    home = os.path.join(root, portable(name))
    with open(os.path.join(home, "active.json")) as file:
        folder = os.path.join(home, json.load(file)["generation"])
    with open(os.path.join(folder, "manifest.json")) as file:
        manifest = json.load(file)
    if manifest.get("schema_version") not in (1, 2):
        raise PublishError("unknown manifest version")
    for f in manifest["files"]:
        path = os.path.join(folder, f["path"])
        if not os.path.exists(path) or os.path.getsize(path) != f["size"]:
            raise PublishError(f"{f['path']} is missing or cut off")
    return folder, manifest


def recover(root: str, name: str) -> list[str]:
    """Removes what a crash left: the lock, parts, and generations without a manifest; gives the removed generations."""
    import shutil

    home = os.path.join(root, portable(name))
    gone = []
    for entry in os.listdir(home):
        path = os.path.join(home, entry)
        if entry == "lock" or entry.endswith(".part"):
            os.unlink(path)
        elif os.path.isdir(path) and not os.path.exists(os.path.join(path, "manifest.json")):
            shutil.rmtree(path)
            gone.append(entry)
    return gone


def operational_sidecar(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics without anything from the source: code, severity and a fixed text."""
    return diagnostics.select("code", "severity", F.lit("Details are withheld.").alias("message"))
