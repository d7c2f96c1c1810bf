"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Python's bytes.translate table for the same folding.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that to pure ASCII and is the faster of the two."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, mod folds; null ids get fold null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Unset, it is a new local folder in local mode, where there is one machine only, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpus-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scope:
    """What operators left behind while it was open: tables in the shared folder and broadcast values."""

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.values: list[Broadcast] = []

    def free(self) -> None:
        discard(*self.tables)
        for v in self.values:
            v.destroy()
        self.tables, self.values = [], []


_scopes: list[Scope] = []


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """Collects what is stored and sent inside. The caller frees it once nothing that was returned is still to be read."""
    own = Scope()
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)


def sent(spark: SparkSession, value) -> Broadcast:
    """value as a broadcast variable of the open scope."""
    out = spark.sparkContext.broadcast(value)
    if _scopes:
        _scopes[-1].values.append(out)
    return out


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, and lost executors lose nothing.

    The shuffle files of the job that wrote it go when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scopes:
        _scopes[-1].tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH = 8 << 20


def find_code(spark: SparkSession) -> None:
    """Prepare the session for Python workers: batches of BATCH bytes at most, and this package's folder on their path.

    Plans run later than they are made, so the setting of the batches stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def plain(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1, ..., so that whatever they were called clashes with nothing."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
