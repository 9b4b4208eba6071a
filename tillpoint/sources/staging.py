"""Stage tables that many queries read, once per input.

The marts all start from the same extract.  Like loading the CSV into a
table before querying it, the adapter join (or CSV parse) runs once; every
query then scans the staged Parquet with column pruning and predicate
pushdown.  The tables live in a fixed folder under the cluster's shared
checkpoint folder, named by a fingerprint of the input files, so a later
application finds them and a changed input is staged again.  A table is
written beside its place and renamed into it when complete.

A table may be clustered by a column of few values (the extract: by month).
Its rows are then rebalanced by that column before they are written to one
folder for each value, so a filter on it prunes whole folders; a value that
holds a large share of the rows is split over several tasks and files, by size
and not by key, and small ones share a task.

The tables are deliberately *not* bucketed by invoice.  Bucketing would let
invoice-keyed aggregates skip their exchange, but a bucket is one scan
task: an invoice (or a group of exact copies) holding a third of all lines
would put a third of the extract into one task.  Unbucketed files are
split evenly across tasks, and every invoice-keyed aggregate combines
map-side before its exchange, so a hot invoice shrinks to one row per task.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.session import shared_folder

# Part of every staged name: raise it when the staged columns change.
LAYOUT = 3
TABLES = ("orders", "lineitem", "part", "customer", "nation")

_LOCKS: dict[tuple, threading.RLock] = defaultdict(threading.RLock)
_STAGED: dict[tuple, str] = {}
_SCHEMAS: dict[tuple, T.StructType] = {}
_SHARED: dict[tuple, object] = {}
_FINGERPRINTS: dict[tuple, str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Name of the input: its path plus each table's size and modification
    time, read through the Hadoop file system (any cluster storage).
    Listed once per application: the inputs are read-only while it runs."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCKS[key]:
        if key not in _FINGERPRINTS:
            h = hashlib.sha256(f"{LAYOUT}:{sf_dir.rstrip('/')}".encode())
            for t in TABLES:
                path, fs = hadoop_path(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")
                h.update(f"{t}:{fs.getContentSummary(path).getLength()}:{fs.getFileStatus(path).getModificationTime()}".encode())
            _FINGERPRINTS[key] = h.hexdigest()[:24]
        return _FINGERPRINTS[key]


def staging_enabled() -> bool:
    return os.environ.get("TILLPOINT_STAGE", "1") != "0"


def staged_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tillpoint-staged"


def clear_staged(spark: SparkSession) -> None:
    """Remove every staged table of this checkpoint folder."""
    path, fs = hadoop_path(spark, staged_folder(spark))
    fs.delete(path, True)
    _STAGED.clear()


def _write(df: DataFrame, path: str, clustered_by: str | None, rebalanced: bool) -> None:
    if clustered_by is None:
        df.write.parquet(path)
    else:
        dealt = df if rebalanced else df.hint("rebalance", F.col(clustered_by))
        dealt.write.partitionBy(clustered_by).parquet(path)


def staged(spark: SparkSession, sf_dir: str, build, name: str = "extract", check=None,
           clustered_by: str | None = None, rebalanced: bool = False) -> DataFrame:
    """The staged table ``name`` for ``sf_dir``; ``build()`` makes it unless
    this or an earlier application has.  ``check`` sees the written table
    before it takes its place and may refuse it by raising.  A filter on
    ``clustered_by`` reads only the folders it admits; ``build()`` may have
    ``rebalanced`` its rows by that column itself."""
    if not staging_enabled():
        return build()
    key = (spark.sparkContext.applicationId, fingerprint(spark, sf_dir), name)

    def read(path: str) -> DataFrame:
        # A clustered table without rows has no file that tells its columns.
        if clustered_by is None:
            return spark.read.parquet(path)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = build().schema
        return spark.read.schema(_SCHEMAS[key]).parquet(path).select(*_SCHEMAS[key].names)

    with _LOCKS[key]:
        if key not in _STAGED:
            place = f"{staged_folder(spark)}/{name}-{key[1]}"
            done, fs = hadoop_path(spark, f"{place}/_SUCCESS")
            if not fs.exists(done):
                beside = f"{place}.{uuid.uuid4().hex}"
                _write(build(), beside, clustered_by, rebalanced)
                if check is not None:
                    check(read(beside))
                source, target = hadoop_path(spark, beside)[0], hadoop_path(spark, place)[0]
                if not fs.rename(source, target) or fs.exists(hadoop_path(spark, f"{place}/{source.getName()}")[0]):
                    # Another application was first; its table is the same.
                    fs.delete(hadoop_path(spark, f"{place}/{source.getName()}")[0], True)
                    fs.delete(source, True)
            _STAGED[key] = place
        return read(_STAGED[key])


def shared(spark: SparkSession, sf_dir: str, name: str, build):
    """Memoise ``build()`` per application and input.

    For intermediates that depend only on the input (a checkpointed table
    or a few calendar dates): every query of the application that needs
    one reads the same materialisation instead of recomputing it.  The
    checkpoint files live in the shared checkpoint folder, so a lost
    executor does not lose them.  Off when staging is off.
    """
    if not staging_enabled():
        return build()
    key = (spark.sparkContext.applicationId, fingerprint(spark, sf_dir), f"shared:{name}")
    with _LOCKS[key]:
        if key not in _SHARED:
            _SHARED[key] = build()
        return _SHARED[key]
