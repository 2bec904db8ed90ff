"""Where intermediate tables go."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a temporary folder, and keeps it
    for the life of the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="pixelweft-")
    spark.sparkContext.setCheckpointDir(found)
    return found


#: Bytes of an Arrow batch that Spark sends to a Python task.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH`` bytes for the rest of the session. Spark's default counts rows, or
    tens of MB, and every running Python worker holds one in the JVM and one on its own side."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        spark.conf.set(name, f"{BATCH}b")
    except Exception as e:  # a Spark without the setting
        if "CANNOT_MODIFY_CONFIG" not in str(e):
            raise


#: The tables that the innermost ``scratch`` has seen.
_MADE: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("made", default=None)
#: Spark setting: remove the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and a lost
    executor costs a reread instead of a recomputation. What was shuffled to make it is not needed
    again, so those files go at once (where Spark has the setting). ``discard`` removes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pixelweft/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    made = _MADE.get()
    if made is not None:
        made.append(out)
    return out


def durable_split(df: DataFrame, by: str, values: list[int], name: str, bucket: tuple[str, int] | None = None) -> list[DataFrame]:
    """``df`` written once, as a table for each of the ``values`` of the int column ``by``, which they lose. Each can be discarded by itself.

    With ``bucket`` (column, number) rows are dealt out by the column and written so: a join on it moves the other side only, if that has as many partitions.
    """
    spark = df.sparkSession
    key = uuid.uuid4().hex
    root = f"{shared_dir(spark)}/pixelweft/{key}"
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        if bucket:
            column, n = bucket
            df.repartition(n, column).write.option("compression", "zstd").option("path", root).partitionBy(by).bucketBy(n, column).format("parquet").saveAsTable(f"pixelweft_{key}")
        else:
            df.write.option("compression", "zstd").partitionBy(by).parquet(root)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    schema, out = df.drop(by).schema, []
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for v in values:
        path = f"{root}/{by}={v}"
        if bucket:
            x = spark.table(f"pixelweft_{key}").where(f"{by} = {v}").drop(by)
        else:
            fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))  # no rows, no folder
            x = spark.read.schema(schema).parquet(path)
        x._durable_path = f"{path}/{name}"
        out.append(x)
        made = _MADE.get()
        if made is not None:
            made.append(x)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``durable`` wrote and nothing will read any more. Others are left alone."""
    for df in tables:
        path = getattr(df, "_durable_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(conf).delete(folder, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``durable`` writes inside go at the end, but for those passed to the function that is given: what
    the result still has to read."""
    made: list[DataFrame] = []
    outer = _MADE.get()
    token = _MADE.set(made)
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _MADE.reset(token)
        paths = {t._durable_path for t in kept}
        discard(*(t for t in made if t._durable_path not in paths))
        if outer is not None:
            outer.extend(kept)
