"""State of micro-batch jobs as append-only tables, one partition per batch.

A replayed batch overwrites exactly its own partition and reads only earlier ones, so a job restarted
after a lost executor or driver gives the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import shared_dir


class BatchTable:
    """A parquet table partitioned by ``batch`` under the shared folder."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def before(self, batch: int) -> DataFrame:
        """Rows of all earlier batches."""
        full = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(full).parquet(self.path)
        return rows.filter(F.col("batch") < batch).select(*self.schema.fieldNames())

    def write(self, df: DataFrame, batch: int) -> DataFrame:
        """Write this batch's rows and read them back, so later steps do not recompute them."""
        path = f"{self.path}/batch={batch}"
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.before(1 << 62)


def job_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, optionally a few files per micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


#: State with timers and several column families needs Spark's RocksDB store.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_end(stream: DataFrame, folder: str, on_batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str:
    """Process everything available, then stop; called again, it goes on where it stopped.  Returns the output folder."""
    out, spark = f"{folder}/out", stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if on_batch is not None:
        writer = writer.foreachBatch(on_batch)
    else:
        writer = writer.format("parquet").option("path", out)
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        writer.start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_STORE[0])
        else:
            spark.conf.set(_STORE[0], before)
    return out


def arrivals(df: DataFrame, number: Column, count: int, folder: str, run: Callable[[DataFrame], object]) -> None:
    """Let ``df`` arrive in ``count`` parts, by ``number`` from 0: each is written to a folder, then ``run`` on that folder's stream.

    A run finds only the files that came since the last one, as a scheduled job does.
    """
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.parquet(folder)
    for i in range(count):
        df.filter(number == i).write.mode("append").parquet(folder)
        run(spark.readStream.schema(df.schema).parquet(folder))
