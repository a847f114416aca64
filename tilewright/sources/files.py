"""Files in and out: recordings, list cells, arrays, archives, stages, result files."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMBS = ("right_arm", "right_leg", "left_leg", "left_arm")
RECORDING = T.StructType([T.StructField("sbj_id", T.IntegerType()), *[T.StructField(f"{limb}_acc_{axis}", T.DoubleType()) for limb in LIMBS for axis in "xyz"], T.StructField("label", T.StringType())])


def recordings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV recordings, one file each: the file's stem is the session, NaN becomes null."""
    df = spark.read.schema(RECORDING).option("header", "true").csv(path)
    name = F.element_at(F.split(F.col("_metadata.file_name"), r"\."), 1)
    df = df.select(name.alias("session"), *[F.nanvl(c, F.lit(None)).alias(c) if c not in ("sbj_id", "label") else F.col(c) for c in df.columns])
    return df.select("session", *columns) if columns else df


def encoded(df: DataFrame, label: str, names: list[str], null: str, strict: bool) -> DataFrame:
    """Adds ``label_id``: the place of the label in ``names``, null labels as ``null``. Unknown labels are
    an error (strict) or become ``null`` as well."""
    table = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    known = table[F.coalesce(F.col(label), F.lit(null))]
    other = F.raise_error(F.concat(F.lit("unknown label: "), F.col(label))).cast("int") if strict else F.lit(names.index(null))
    return df.withColumn("label_id", F.coalesce(known, other))


def plain_name(c):
    """Lower case, '-' and blanks as '_'."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def list_cells(spark: SparkSession, path: str, cells: list[str], schema: str) -> DataFrame:
    """CSV whose cells hold printed lists of numbers."""
    from ..functions.arrays import parse_list

    df = spark.read.schema(schema).option("header", "true").option("multiLine", "true").csv(path)
    return df.withColumns({c: parse_list(F.col(c)) for c in cells})


def npy(spark: SparkSession, path: str, flat: bool = True) -> DataFrame:
    """(file, row, v) from .npy files: one row per first index, the rest flattened to doubles. Rows leave
    a file in pieces; a file is one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.load(io.BytesIO(raw.as_py()), allow_pickle=False)
                yield from _rows(PurePosixPath(name).stem, x)

    return files.mapInArrow(run, "file string, row long, v array<double>")


def npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, v) for every named array of .npz files; file is 'stem/name'."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with np.load(io.BytesIO(raw.as_py()), allow_pickle=False) as arrays:
                    for key in arrays.files:
                        yield from _rows(f"{PurePosixPath(name).stem}/{key}", arrays[key])

    return files.mapInArrow(run, "file string, row long, v array<double>")


def _rows(name: str, x: np.ndarray, step: int = 1024):
    x = x.reshape(len(x), -1) if x.ndim else x.reshape(1, 1)
    for at in range(0, len(x), step):
        part = x[at : at + step].astype(np.float64)
        n, d = part.shape
        v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), v], names=["file", "row", "v"])


def zipped_csv(spark: SparkSession, path: str, member: str, schema: T.StructType) -> DataFrame:
    """Rows of one CSV member of zip archives."""
    import csv

    files = spark.read.format("binaryFile").load(path).select("content")
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z, z.open(member) as f:
                    rows = list(csv.DictReader(io.TextIOWrapper(f, "utf-8")))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) or None for r in rows], pa.string()) for n in names], names=names)

    text = files.mapInArrow(run, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], version: str = "1") -> DataFrame:
    """A stage's result, built once: written whole under ``path``/``version`` and read ever after. Spark's
    commit marker tells a complete result from a broken one, which is written again."""
    where = f"{path}/v={version}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def result(template: DataFrame, predictions: DataFrame, key: str, column: str, fill: object | None = None) -> DataFrame:
    """The template's ids with their predictions; without ``fill`` a missing one is an error."""
    joined = template.select(key).join(predictions.select(key, column), key, "left")
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))) if fill is None else F.lit(fill)
    kind = dict(predictions.dtypes)[column]
    return joined.withColumn(column, F.coalesce(F.col(column), missing.cast(kind)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def report(spark: SparkSession, path: str, **figures: object) -> None:
    """One JSON row of figures."""
    spark.createDataFrame([(json.dumps(figures, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def checked(df: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """One row: row count, repeated keys, and rows against each SQL rule."""
    n = df.groupBy(*key).agg(F.count("*").alias("k"), *[F.sum((~F.coalesce(F.expr(rule), F.lit(False))).cast("long")).alias(name) for name, rule in rules.items()])
    return n.agg(F.sum("k").alias("rows"), F.sum(F.col("k") - 1).alias("repeated"), *[F.sum(name).alias(name) for name in rules])


def roles(df: DataFrame, most_limbs: int = 8) -> dict[str, str]:
    """Which columns name the subject, the limb and the time, by name first and then by how many values
    they have: one row of counts reaches the driver."""
    names = {"subject": ("sbj", "subject", "user", "participant"), "limb": ("limb", "sensor", "location"), "time": ("ts", "time", "idx", "frame")}
    found: dict[str, str] = {}
    for role, words in names.items():
        hit = [c for c in df.columns if any(w in c.lower().split("_") for w in words)]
        if hit:
            found[role] = hit[0]
    left = [c for c, kind in df.dtypes if c not in found.values() and kind in ("int", "bigint", "string", "timestamp_ntz", "timestamp")]
    if left and len(found) < 3:
        n = df.agg(F.count("*").alias("__rows"), *[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in left]).first()
        order = sorted(left, key=lambda c: (n[c], c))
        if "limb" not in found:
            few = [c for c in order if 1 < n[c] <= most_limbs]
            found |= {"limb": few[0]} if few else {}
        if "time" not in found:
            many = [c for c in reversed(order) if c not in found.values()]
            found |= {"time": many[0]} if many else {}
        if "subject" not in found:
            some = [c for c in order if c not in found.values() and n[c] > 1]
            found |= {"subject": some[0]} if some else {}
    return found
