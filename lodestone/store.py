"""Intermediate tables in the shared folder the cluster names, and helpers every operator needs.

A written Parquet table cuts lineage in a place all executors see, so a lost executor costs a re-read, never a
recomputation of what came before it.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_scopes: list["Scope"] = []
_named: set[str] = set()


def _forget(spark: SparkSession) -> None:
    """At the end of the driver no name of a table stays in the catalog."""
    for name in list(_named):
        with contextlib.suppress(Exception):  # the session may have ended before
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own if driver and executors are one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestone-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has; what is written there goes with the driver."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    return path


class Scope:
    """Owns the tables stored within a ``with`` block, until it is dropped."""

    def __init__(self):
        self.tables: list[Stored] = []

    def __enter__(self) -> Scope:
        _scopes.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self)

    def drop(self) -> None:
        while self.tables:
            self.tables.pop().drop()


class Stored:
    """A DataFrame written to the shared folder; ``df`` reads it back.

    With ``key`` it is an external table in as many buckets of that column as a shuffle has partitions, so that grouping by
    the column moves nothing.
    """

    def __init__(self, df: DataFrame, name: str, key: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.table = f"lodestone_{uuid.uuid4().hex}" if key else None
        if key:
            df.write.format("parquet").bucketBy(tasks(self.spark), key).option("path", self.path).saveAsTable(self.table)
            self.df = self.spark.table(self.table)
            if not _named:
                atexit.register(_forget, self.spark)
            _named.add(self.table)
        else:
            df.write.parquet(self.path)
            self.df = self.spark.read.schema(df.schema).parquet(self.path)
        where, fs = self._fs()
        fs.deleteOnExit(where)
        if _scopes:
            _scopes[-1].tables.append(self)

    def _fs(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            _named.discard(self.table)
        where, fs = self._fs()
        fs.delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Partitions of the next shuffle, for work that deals rows out by itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
