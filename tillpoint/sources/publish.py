"""Publish a set of tables so that readers see all of it or the set before.

A set is written to a folder of its own.  Its manifest, with the rows and a
fingerprint of every table as read back from the files, is written beside and
renamed last to the next number; readers follow the highest number.  A job
that fails half-way leaves a folder that no manifest names, and of two jobs
at once each gets a number of its own.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.sources.io import write_mart, write_metrics_json
from tillpoint.sources.staging import hadoop_path


@dataclass(frozen=True)
class Table:
    """A table to publish and how its files are written."""

    df: DataFrame
    fmt: str = "parquet"
    compression: str | None = None
    money_digits: int | None = None


def _load(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def digest(df: DataFrame) -> dict:
    """Rows, and a fingerprint that does not depend on their order.  A row is
    hashed over its values with their places, a NULL told from an empty text."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns]
    h = F.xxhash64(F.array(*cells)) if cells else F.lit(0)
    row = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("x"),
                                      F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s")).first()
    return {"rows": row["rows"], "fingerprint": f"{row['x']}:{row['s']}"}


def _numbers(spark: SparkSession, out: str) -> list[int]:
    path, fs = hadoop_path(spark, f"{out}/manifests")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _put(spark: SparkSession, path: str, text: str) -> None:
    target, fs = hadoop_path(spark, path)
    stream = fs.create(target, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def publish(spark: SparkSession, tables: dict[str, Table], out: str) -> int:
    """Write ``tables`` as the next set of the folder ``out``; its number."""
    out = out.rstrip("/")
    folder = f"sets/{uuid.uuid4().hex}"
    entries = {}
    for name, t in tables.items():
        path = f"{out}/{folder}/{name}"
        if t.fmt == "json":
            write_metrics_json(t.df, path)
        else:
            write_mart(t.df, path, fmt=t.fmt, compression=t.compression, money_digits=t.money_digits)
        entries[name] = {"path": f"{folder}/{name}", "format": t.fmt, **digest(_load(spark, path, t.fmt))}
    beside = f"{out}/manifests/{uuid.uuid4().hex}.tmp"
    _put(spark, beside, json.dumps({"tables": entries}))
    source, fs = hadoop_path(spark, beside)
    number = max(_numbers(spark, out), default=0)
    while True:
        number += 1
        target = hadoop_path(spark, f"{out}/manifests/{number:08d}.json")[0]
        # A rename onto a file is refused; then another job has that number.
        if not fs.exists(target) and fs.rename(source, target):
            return number


def manifest(spark: SparkSession, out: str, number: int | None = None) -> dict:
    """The manifest of one set, the latest by default."""
    out = out.rstrip("/")
    known = _numbers(spark, out)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"No published set {number or ''} in {out}")
    lines = spark.read.text(f"{out}/manifests/{number or known[-1]:08d}.json", wholetext=True).first()
    return json.loads(lines["value"])


def read_published(spark: SparkSession, out: str, name: str, number: int | None = None) -> DataFrame:
    """A table of a set, the latest by default."""
    entry = manifest(spark, out, number)["tables"][name]
    return _load(spark, f"{out.rstrip('/')}/{entry['path']}", entry["format"])


def verify(spark: SparkSession, out: str, number: int | None = None) -> None:
    """Refuse a set whose files no longer hold what its manifest says."""
    for name, entry in manifest(spark, out, number)["tables"].items():
        found = digest(read_published(spark, out, name, number))
        if found != {k: entry[k] for k in found}:
            raise ValueError(f"Published table {name} changed: {found} instead of {entry}")


def prune(spark: SparkSession, out: str, keep: int = 2) -> None:
    """Remove all but the last ``keep`` sets, and folders that no manifest names.
    Only to be run while nothing is published."""
    out = out.rstrip("/")
    numbers = _numbers(spark, out)
    for number in numbers[:-keep]:
        path, fs = hadoop_path(spark, f"{out}/manifests/{number:08d}.json")
        fs.delete(path, False)
    named = {e["path"].split("/")[1] for number in numbers[-keep:] for e in manifest(spark, out, number)["tables"].values()}
    path, fs = hadoop_path(spark, f"{out}/sets")
    for status in fs.listStatus(path):
        if status.getPath().getName() not in named:
            fs.delete(status.getPath(), True)
