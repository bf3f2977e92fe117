"""Helpers that the text operators share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z, everything else as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: list[str] = []
_WORKER: dict = {}  # what this worker process keeps from task to task: one operator's state


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is made if all runs on
    one machine (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[[^,\]]*(,\d+)?\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="assayloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table is removed when the Python driver ends, or by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assayloom/{label}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(release, spark)
    _STAGED.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what this write shuffles is done with when it ends
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # and what earlier steps shuffled, where nothing refers to it any more
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for f in frames:
        path = getattr(f, "_staged_at", None)
        if path in _STAGED:
            _delete(f.sparkSession, path)
            _STAGED.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete the tables that staged() has written."""
    try:
        while _STAGED:
            _delete(spark, _STAGED.pop())
    except Exception:  # the JVM may already be gone when Python ends
        _STAGED.clear()


def worker_state(key=None, make=None):
    """What make() gives, kept in this worker process for the tasks that ask for the same key.

    Workers are used again by other operators: there is one place, and whoever asks for another key empties it first.
    """
    if key not in _WORKER:
        _WORKER.clear()
        if make is None:
            return None
        _WORKER[key] = make()
    return _WORKER[key]


def thin_out(cache: dict, most: int) -> None:
    """Take the later half out of a cache that is too large: what is frequent was met, and put in, early."""
    if len(cache) > most:
        for key in list(islice(reversed(cache), len(cache) // 2)):
            del cache[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """The batch's columns that schema names, with the given ones put in their place."""
    arrays = []
    for f in schema:
        if f.name in columns:
            arrays.append(pa.array(columns[f.name], type=f.type))
        else:
            arrays.append(batch.column(batch.schema.get_field_index(f.name)).cast(f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def chunks(table_batch: pa.RecordBatch, text_index: int, limit: int = 8_000_000):
    """Slices of a batch whose texts hold about `limit` bytes at most, one row at least."""
    n = table_batch.num_rows
    if not n:
        return
    col = table_batch.column(text_index)
    start = size = 0
    for i in range(n):
        v = col[i]
        length = v.as_buffer().size if v.is_valid else 0
        if i > start and size + length > limit:
            yield table_batch.slice(start, i - start)
            start, size = i, 0
        size += length
    yield table_batch.slice(start, n - start)
