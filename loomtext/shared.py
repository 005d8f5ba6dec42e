"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder that ``spark.checkpoint.dir`` names.

    The setting is only replaced by a local temporary folder when it is unset
    and Spark runs in local mode; a cluster without it is an error, since a
    machine-local folder would lose files together with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomtext/{purpose}-{uuid.uuid4().hex}"


#: Rows and bytes of one Arrow batch, unless the session has other than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts are long, and JVM and Python hold a batch several times over."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)
        spark.conf.set(size, BATCH_BYTES)


#: Open scopes of this thread or task: what each has written, and whether it's kept.
_scopes: ContextVar[tuple[dict[str, bool], ...]] = ContextVar("scopes", default=())


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, purpose)
    if scopes := _scopes.get():
        scopes[-1][path] = False
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _path(df: DataFrame) -> str:
    """Where :func:`materialise` wrote ``df``, which must be the very frame that it returned."""
    return df.__dict__["_written"]


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A scope at whose end all that :func:`materialise` wrote in it is deleted, but for its frames passed to the given function.

    Whatever leaves the scope must be kept or rest on kept tables only.
    """
    written: dict[str, bool] = {}

    def keep(df: DataFrame) -> DataFrame:
        written[_path(df)] = True
        return df

    opened = _scopes.set((*_scopes.get(), written))
    try:
        yield keep
    finally:
        _scopes.reset(opened)
        for path, kept in written.items():
            if not kept:
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for ``df``, once nothing reads it any more."""
    delete(df.sparkSession, _path(df))
