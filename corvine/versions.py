"""Versions of a stored thing: one small JSON file per version names the folders that belong to it.

What a version names is never changed. A writer prepares new folders, then creates the next version's file; creating a file
that exists fails, so of two writers that started from one version the second one is told (``Conflict``) and nothing of
it is visible. Readers take one version and see nothing else. A job that fails leaves folders that no version names.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer published first."""


def _fs(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, root: str) -> list[int]:
    path, fs = _fs(spark, f"{root}/versions")
    if not fs.exists(path):
        return []
    return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the last version; (0, {}) where there is none."""
    known = numbers(spark, root)
    return (known[-1], read(spark, root, known[-1])) if known else (0, {})


def read(spark: SparkSession, root: str, number: int) -> dict:
    row = spark.read.text(f"{root}/versions/{number:010d}.json", wholetext=True).first()
    return json.loads(row[0])


def publish(spark: SparkSession, root: str, number: int, content: dict) -> int:
    """Make ``content`` the version after ``number``. The file is complete before it has its name."""
    path, fs = _fs(spark, f"{root}/versions/{number + 1:010d}.json")
    fs.mkdirs(path.getParent())
    if numbers(spark, root)[-1:] not in ([], [number]):
        raise Conflict(f"version {number + 1} of {root} exists")
    try:
        out = fs.create(path, False)
    except Exception as e:
        raise Conflict(f"version {number + 1} of {root} exists") from e
    try:
        out.write(bytearray(json.dumps(content), "utf-8"))
    finally:
        out.close()
    return number + 1
