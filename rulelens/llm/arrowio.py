"""Shared plumbing of the corpus operators: Arrow batches, sessions, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of what a function gets at once. Spark itself bounds the batches it sends to
#: a worker by bytes; they are sliced here, so no setting of the session is touched.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most `rows` rows and, where a part has more than one row, about `size` bytes."""
    a = 0
    while a < batch.num_rows:
        n = min(rows, batch.num_rows - a)
        while n > 1 and batch.slice(a, n).nbytes > size:
            n = (n + 1) // 2
        yield batch.slice(a, n)
        a += n


def map_arrow(df: DataFrame, fn, schema: str, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow whose function gets batches of a bounded number of rows and bytes.

    Python workers on this machine import the package from where the driver has it;
    on other machines it comes with --py-files, as usual.
    """
    home, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])

    def run(batches):
        return fn(part for batch in batches for part in slices(batch, rows, size))

    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, with one subfolder per application.

    It is spark.checkpoint.dir or what setCheckpointDir was given. A local master may do without
    (a temporary folder); elsewhere executors would not share one, so that is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        given = sc._jsc.sc().getCheckpointDir()
        if given.isDefined():
            path = given.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            path = tempfile.mkdtemp(prefix="shared-")
            sc.setCheckpointDir(path)
            path = sc._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    return f"{path.rstrip('/')}/{sc.applicationId}"


def store(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if codec:
        writer = writer.option("compression", codec)
    # shuffle files of the steps before are of no use once this is written
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more (what came of them is stored itself)."""
    for table in tables:
        folders = {os.path.dirname(f) for f in table.inputFiles()}
        root = os.path.basename(shared_dir(table.sparkSession))
        for folder in folders:
            if f"/{root}/" in folder:
                _delete(table.sparkSession, folder)


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that read them must have been written."""
    _delete(spark, shared_dir(spark))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, lengths) of a string or binary column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    if n:
        # a slice's own bytes, not those of the whole batch
        data = data[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], lengths


def texts(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def id_text(name: str = "doc_id"):
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
