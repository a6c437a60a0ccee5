"""Folders of which readers see whole versions only.

A version's tables stand in a folder of its own; its manifest, one small JSON
file, is written last and named when it is complete. Until then readers have
the version before; what a failed writer left is no version and is removed by
the next writer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

MANIFESTS = "_manifests"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, where = _fs(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(where):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def latest(spark: SparkSession, path: str) -> dict | None:
    """The newest whole version's manifest, with its number as ``version`` and its folder as ``folder``; None without any."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    text = "".join(r.value for r in spark.read.text(f"{path}/{MANIFESTS}/{numbers[-1]:09d}.json", wholetext=True).collect())
    return {**json.loads(text), "version": numbers[-1]}


def new_folder(path: str) -> str:
    """The folder for the tables of a version to come."""
    return f"{path}/version-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, folder: str, manifest: dict, keep: int = 2) -> int:
    """Make ``folder`` the newest version. Of two writers of the same number one fails. Versions before the last ``keep`` go."""
    number = (_numbers(spark, path) or [0])[-1] + 1
    fs, draft = _fs(spark, f"{path}/{MANIFESTS}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps({**manifest, "folder": folder}).encode()))
    finally:
        out.close()
    _, final = _fs(spark, f"{path}/{MANIFESTS}/{number:09d}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} of {path} was written by another job")
    _clean(spark, path, keep)
    return number


def _clean(spark: SparkSession, path: str, keep: int) -> None:
    """Delete the folders that none of the last ``keep`` manifests names, and older manifests."""
    numbers = _numbers(spark, path)
    for number in numbers[:-keep]:
        fs, where = _fs(spark, f"{path}/{MANIFESTS}/{number:09d}.json")
        fs.delete(where, False)
    named = set()
    for number in numbers[-keep:]:
        text = "".join(r.value for r in spark.read.text(f"{path}/{MANIFESTS}/{number:09d}.json", wholetext=True).collect())
        named.add(json.loads(text)["folder"].rstrip("/").rpartition("/")[2])
    fs, where = _fs(spark, path)
    for x in fs.listStatus(where):
        if x.getPath().getName().startswith("version-") and x.getPath().getName() not in named:
            fs.delete(x.getPath(), True)
