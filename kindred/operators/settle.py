"""Results that several branches of a plan read again, written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def freed(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files (and checkpoints, where it is set to clean them) of results that nothing refers to any more; else they stay until the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*done: DataFrame) -> None:
    """Removes the files of results of ``settled`` that nothing will read again."""
    for df in done:
        sc = df.sparkSession.sparkContext
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for i in range(leaves.size()):
            at = leaves.apply(i).rdd().getCheckpointFile()
            if at.isDefined():
                path = sc._jvm.org.apache.hadoop.fs.Path(at.get())
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["rows"])


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("rows"):
            yield from pa.ipc.open_stream(x.as_buffer())


def settled(df: DataFrame, zipped: bool = False) -> DataFrame:
    """``df`` in ``spark.checkpoint.dir``, without the shuffle files that led to it; only a run on one machine may leave that unset, and gets a folder that goes with it.

    ``zipped``: as compressed columns, a few bytes for a short value instead of 16 or more; each read unpacks them.
    """
    spark = df.sparkSession
    freed(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="kindred-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    cleanup, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    with contextlib.suppress(Exception):  # not in every release
        before = spark.conf.get(cleanup)
        spark.conf.set(cleanup, "true")
    try:
        done = (df.mapInArrow(_zipped, "rows binary") if zipped else df.select("*")).checkpoint(eager=True)
    finally:
        if before is not None:
            spark.conf.set(cleanup, before)
    return done.mapInArrow(_unzipped, df.schema) if zipped else done
