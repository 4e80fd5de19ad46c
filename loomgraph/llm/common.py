"""Helpers shared by the training-data operators.

Operators that return the rows of their input carry each row as one struct, so
no column of the input can clash with a column of their own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch handed to Python.  Texts may be long, so batches are short.
ARROW_ROWS = 256

#: The word pattern of every operator here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: list[str] = []


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the memory of Python workers by the rows they get at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where none is named and the master is this machine (tests, a laptop), a
    local one is made; on a cluster a folder of one machine would lose rows.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _LOCAL:
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL.append("file://" + folder)
    return _LOCAL[0]


def spill(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back.

    Lineage ends here and nothing above is computed twice; a lost executor
    costs no more than the tasks that read its share.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 5: rows with 0 are held out of all training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def as_row(df: DataFrame) -> Column:
    """All columns of df as one struct."""
    return F.struct(*[df[_quoted(c)] for c in df.columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_texts(docs: DataFrame, text: str, carry: tuple[str, ...], fn: Callable[[list], list], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """carry columns and those that fn makes of each batch's texts, as Arrow arrays."""
    small_batches(docs.sparkSession)
    picked = docs.select(*[docs[_quoted(c)] for c in carry], docs[_quoted(text)].alias("_body"))
    width, names = len(carry), [*carry, *[n for n, _ in fields]]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *fn(b.column(width).to_pylist())], names=names)

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:width], *[T.StructField(n, t) for n, t in fields]]))


def map_rows(docs: DataFrame, text: str, fn: Callable[[list], list], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """row, a struct of all columns of docs, and what fn makes of each batch's texts.  The text crosses once."""
    small_batches(docs.sparkSession)
    picked, at = docs.select(as_row(docs).alias("row")), docs.columns.index(text)
    names = ["row", *[n for n, _ in fields]]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *fn(b.column(0).field(at).to_pylist())], names=names)

    return picked.mapInArrow(run, T.StructType([picked.schema.fields[0], *[T.StructField(n, t) for n, t in fields]]))


#: A key is hot beyond this many rows, or beyond one row in HOT_SHARE.
HOT_ROWS, HOT_SHARE = 64, 500


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined to the one row that right has for a key, hot keys of left aside.

    rows is the number of rows of left, which is read twice.  A hot key has more
    than one in HOT_SHARE of them, so there are fewer than HOT_SHARE hot keys:
    their rows of right are broadcast, and no task gets all rows of a hot key.
    """
    least = max(HOT_ROWS, rows // HOT_SHARE)
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(key)
    hot_right = right.join(F.broadcast(hot), key, "left_semi").withColumn("_hot", F.lit(True))
    own = [F.col(c) for c in left.columns]
    added = [c for c in right.columns if c != key]
    told = left.join(F.broadcast(hot_right), key, "left")
    found = told.filter("_hot").select(*own, *added)
    rest = told.filter("_hot is null").select(*own).join(right, key, how).select(*own, *added)
    return found.unionByName(rest)
