"""Tables written below the shared folder, and their removal.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``,
which every executor and the driver can reach. That cuts lineage and survives
the loss of an executor, unlike local checkpoints. A table that nothing reads
any more is deleted with ``drop``, and the shuffle files of a written table go
as soon as it is written. While a table is written, joins whose partitions all
turn out no larger than what one task should read are hash joins, which need no
sorting; others stay as they are.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ADVISED, _HASHED = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names; where none is named, a temporary one, which only a local master can share."""
    root = spark.conf.get(_KEY, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="waypost-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str, compression: str = "zstd", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to a new shared folder and return it as read from there; ``partition_by`` are its last columns."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _set(spark, {_CLEANUP: "true", _HASHED: spark.conf.get(_ADVISED)}):
        df.write.option("compression", compression).partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned; nothing may read them afterwards."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path is not None:
            context = table.sparkSession.sparkContext
            hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
