"""Session helpers and the Arrow plumbing that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text handled by one vectorised step; a longer document is one step of its own.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch, where the session has Spark's default: whole documents are long rows.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (tests, a laptop) a local temporary folder is set instead.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if path:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(path)
        return path
    held = context.getCheckpointDir()
    if held is None:
        held = tempfile.mkdtemp(prefix="tilewright-")
        context.setCheckpointDir(held)
        held = context.getCheckpointDir()
    return held


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; later stages don't depend on executors' disks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go as soon as it ends, and not when the driver happens to collect
    its garbage: a loop over cut tables holds one round's files only."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: columnar, so smaller than a
    checkpoint."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and the JVM hold of a batch of documents; a session's own setting
    stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive row ranges of a string column as ``(lo, hi, bytes, offsets)``; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


Kernel = Callable[[np.ndarray, np.ndarray], list[pa.Array]]


def per_text(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Kernel]) -> DataFrame:
    """``keep`` columns plus what a kernel computes for each row's UTF-8 bytes.

    ``make()`` runs once in a task and returns ``kernel(bytes, offsets) -> one array per field``.
    A kept column whose name is also a field's is dropped: the operator's own result stands.
    """
    names = {f.name for f in fields}
    keep = [k for k in keep if k not in names]
    source = df.select(*[df[f"`{k}`"] for k in keep], df[f"`{text}`"].alias("__text"))
    schema = T.StructType([source.schema[k] for k in keep] + fields)
    types = [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            column = batch.column(len(keep))
            for lo, hi, data, offsets in text_slices(column):
                made = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(kernel(data, offsets), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(keep))] + made, names=[*keep, *[f.name for f in fields]])

    return source.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, make: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """The rows of ``df``, columns as they are, for which the kernel's boolean is true."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(np.asarray(kernel(data, offsets), bool)))

    return df.mapInArrow(run, df.schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind])
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary()}[type(kind)]


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())
