"""Versions of a set of tables in a folder: written apart, made current at once, readable by number, and expired.

A version's tables lie in data/<name>; it exists from the moment its numbered file is in commits, which is made in one step
and never replaced. A failed or killed write leaves data that no commit names; readers never see it, and expiry deletes it.
Readers that hold a version keep it while it is among the last ones.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Attempts to take the next number while other writers take it first.
TRIES = 50


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _read(spark: SparkSession, path: str) -> dict | None:
    """What a commit says; None if it isn't whole (yet)."""
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def versions(spark: SparkSession, path: str) -> list[dict]:
    """The versions of a folder, oldest first: number, data, written (seconds), and what the writer noted."""
    fs, where = _fs(spark, f"{path}/commits")
    if not fs.exists(where):
        return []
    names = sorted(n for f in fs.listStatus(where) if (n := f.getPath().getName()).endswith(".json") and n[0].isdigit())
    found = ((int(n.split(".")[0]), _read(spark, f"{path}/commits/{n}")) for n in names)
    return [{"number": k, **v} for k, v in found if v is not None]


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame], note: dict | None = None) -> int:
    """Writes tables as a new version and makes it the current one; its number. Of writers at one time each gets a number of its own."""
    data = f"data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{data}/{name}")
    body = bytearray(json.dumps({"data": data, "written": time.time()} | (note or {})).encode())
    for _ in range(TRIES):
        number = max((v["number"] for v in versions(spark, path)), default=0) + 1
        fs, where = _fs(spark, f"{path}/commits/{number:08d}.json")
        try:
            stream = fs.create(where, False)
        except Exception as e:  # noqa: BLE001  another writer has the number
            if not fs.exists(where):
                raise e
            time.sleep(0.05)
            continue
        try:
            stream.write(body)
        finally:
            stream.close()
        return number
    raise RuntimeError(f"no number free in {path}")


def folder(spark: SparkSession, path: str, number: int | None = None) -> str | None:
    """Where a version's tables lie (the last one's by default); None without any. A number that isn't there raises."""
    known = {v["number"]: v["data"] for v in versions(spark, path)}
    if number is not None and number not in known:
        raise ValueError(f"no version {number} in {path}")
    return f"{path}/{known[max(known) if number is None else number]}" if known else None


def expire(spark: SparkSession, path: str, keep: int = 2, unfinished_seconds: float = 86_400.0) -> list[str]:
    """Deletes all but the last versions, and data that no commit names and that is older than so many seconds (a write may be under way); the folders deleted."""
    known = versions(spark, path)
    stay = {v["data"].split("/")[-1] for v in known[-keep:]} if keep else set()
    named = {v["data"].split("/")[-1] for v in known}
    fs, where = _fs(spark, f"{path}/data")
    gone = []
    for v in known[: len(known) - keep]:
        fs.delete(_fs(spark, f"{path}/commits/{v['number']:08d}.json")[1], False)
    for f in fs.listStatus(where) if fs.exists(where) else []:
        name = f.getPath().getName()
        if name not in stay and (name in named or time.time() - f.getModificationTime() / 1000 >= unfinished_seconds):
            fs.delete(f.getPath(), True)
            gone.append(name)
    return sorted(gone)
