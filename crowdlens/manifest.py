"""Numbered manifests: small files that make a set of written tables visible at once.

A folder holds data written under names of their own and files
``manifest-<number>.json`` that say which of them belong together.  A manifest is
written under another name and renamed, so it is there whole or not at all, and it
is written last: a reader that takes the newest one never sees a table that is half
written, and a writer that fails leaves the one before in force.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

PREFIX, SUFFIX = "manifest-", ".json"


def file_system(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as it names it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    fs, place = file_system(spark, path)
    fs.delete(place, True)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the manifests in ``folder``, ascending."""
    fs, place = file_system(spark, folder)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n[len(PREFIX):-len(SUFFIX)]) for n in names if n.startswith(PREFIX) and n.endswith(SUFFIX))


def _path(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/{PREFIX}{number:09d}{SUFFIX}"


def read(spark: SparkSession, folder: str, number: int | None = None) -> dict | None:
    """A manifest's content, by default the newest one's; None without any."""
    found = numbers(spark, folder)
    if not found:
        return None
    text = spark.read.text(_path(folder, found[-1] if number is None else number), wholetext=True).first()[0]
    return json.loads(text)


def write(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Publishes ``content`` under ``number``, which must be new: of two writers
    that race for it one fails."""
    fs, tmp = file_system(spark, f"{folder.rstrip('/')}/_{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    _, place = file_system(spark, _path(folder, number))
    if fs.exists(place) or not fs.rename(tmp, place):
        fs.delete(tmp, False)
        raise FileExistsError(f"manifest {number} of {folder} is already there")


def forget(spark: SparkSession, folder: str, number: int) -> None:
    """Deletes a manifest; its tables are no longer named by it."""
    delete(spark, _path(folder, number))


def listing(spark: SparkSession, paths: list[str]) -> tuple:
    """(path, bytes, time of change) of the files under ``paths``: changes when any
    of them does.  Paths that are not there are left out."""
    out = []

    def walk(fs, status) -> None:
        if status.isDirectory():
            for inner in fs.listStatus(status.getPath()):
                walk(fs, inner)
        else:
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))

    for path in paths:
        fs, place = file_system(spark, path)
        if fs.exists(place):
            walk(fs, fs.getFileStatus(place))
    return tuple(sorted(out))
