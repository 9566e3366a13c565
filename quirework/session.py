"""Reading tables, cutting lineage and numbering rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SMALL_ROWS = 100_000  # rows up to which a table of a few short columns is broadcast


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else unchanged.

    ``df`` is read once to see its size, so it should be a saved table or the
    result of an aggregation that is small where it is asked for.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base``."""
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine gets a temporary
    folder, recorded in the session; a cluster gets an error, because executors
    would each write to a folder of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quirework.shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.quirework.shared", folder)
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables written to the shared folder.

    ``save`` writes a frame as Parquet and returns a frame over the files, so a
    lost executor costs a reread, not a recomputation of all earlier rounds.
    ``drop`` removes the files of a frame that no later step reads; whatever is
    not dropped stays until the folder's owner clears it, because the frames
    handed back to the caller are lazy and still read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path  # keeps the name with the frame
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def running_total(df: DataFrame, order: Sequence[str], value: Column, out: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before each row.

    The order is that of the columns ``order`` (nulls first), over the whole
    frame.  Rows are range-partitioned by those columns, so a key that holds a
    third of all rows spreads over many partitions as long as ``order`` tells
    its rows apart.  Each task sums its own sorted rows; one total per partition
    then visits the driver and returns as a table of as many rows.  ``value``
    must not be null.
    """
    ranged = (
        df.withColumn("__value", value.cast("long"))
        .repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
    )
    names = ranged.columns

    def add(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = 0
        for batch in batches:
            val = batch.column(names.index("__value")).to_numpy(zero_copy_only=False).astype(np.int64)
            run = held + np.cumsum(val)
            held = int(run[-1]) if len(run) else held
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run - val)], names=[*names, "__local"])

    parted = scratch.save(ranged.mapInArrow(add, ranged.withColumn("__local", F.lit(0).cast("long")).schema))
    ends = parted.groupBy("__part").agg(F.max(F.col("__local") + F.col("__value")).alias("t")).collect()
    start, before = 0, [(-1, 0)]
    for row in sorted(ends):
        before.append((row["__part"], start))
        start += row["t"]
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    return (
        parted.join(F.broadcast(offsets), "__part")  # a row per partition
        .withColumn(out, F.col("__before") + F.col("__local"))
        .drop("__part", "__value", "__local", "__before")
    )
