"""Tables that outlive an executor, and size-checked broadcasts.

Intermediate results are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; lost executors cost a re-read, never a re-computation of the lineage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (of the rows as JSON) that a broadcast side may have.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

#: Deletes an execution's shuffle files when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: dict[str, str] = {}
_tables: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this application; only a local master may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="weftgraph-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        base = _local[app]
    return f"{base.rstrip('/')}/weftgraph-{app}"


@contextmanager
def held_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while; what it was before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_table(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # what the table's own shuffles hold is not needed once it is written
    with held_setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path, compression=compression)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever Spark keeps it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete what ``write_table`` wrote; the frame and all that reads it end here."""
    path = getattr(df, "_weft_path", None)
    if path is not None:
        delete_path(df.sparkSession, path)


def written_tables() -> list[str]:
    """Paths of the tables that this process has written so far."""
    return list(_tables)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        if path in _tables:
            _tables.remove(path)
            delete_path(spark, path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is dealt out with the other one. A broadcast passes through the driver; in a loop that
    would be once or more a round, so that the sum grows with the input however small each side is."""
    return df.hint("merge")


#: Rows that a task groups at most, where keys repeat little.
TASK_ROWS = 1 << 20


def in_parts(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` into so many partitions that each has about TASK_ROWS rows, as it is if it has no more.

    For groups of nearly as many keys as rows: combining them before the shuffle only fills memory, and adaptive execution
    would put together all that packs well. The partitions grow with the input, a task does not."""
    n = -(-df.count() // TASK_ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, else as it is (a shuffle join).

    Only the sizes of at most ``rows`` + 1 rows are gathered to judge it."""
    sizes = df.select(F.octet_length(F.to_json(F.struct(*[df[c] for c in df.columns]))).cast("long").alias("n")).limit(rows + 1)
    found = sizes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["rows"] <= rows and found["size"] <= size else df
