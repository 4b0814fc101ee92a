"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_once: dict[tuple[str, ...], DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, a session on one machine (tests, a laptop) gets a
    temporary one; on a cluster that is an error, as executors would not see it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelweave-"))
    return context.getCheckpointDir()


def settle(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut there,
    so a lost executor costs a file read instead of the work behind it. Filters on
    `by` read only the files of the values they keep. The table stays until
    `drop_settled` or whoever cleans the folder deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_once(spark: SparkSession, make: Callable[[], DataFrame], *key: str) -> DataFrame:
    """The settled table of `make`, made once for each key (such as a name and the
    folder it is made from) in a session, for what many queries begin with. Tables
    that were settled on the way are deleted, as nothing reads them any more."""
    known = (spark.sparkContext.applicationId, str(spark._jsparkSession.hashCode()), *key)
    if known not in _once:
        n = len(_written)
        _once[known] = settle(make(), key[0])
        _written.pop()  # it stays until `drop_settled` is told to take it too
        while len(_written) > n:
            _delete(spark, _written.pop())
    return _once[known]


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_settled(spark: SparkSession, once: bool = True) -> int:
    """Delete the tables that this process has settled, once results that read them
    are written; how many there were. `once=False` leaves those of `settle_once`."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    while once and _once:
        key, table = _once.popitem()
        if key[0] == spark.sparkContext.applicationId:
            drop(table)
            n += 1
    return n
