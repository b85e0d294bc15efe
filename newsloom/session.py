"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Python tasks get rows by bytes, not by their number: a fixed number of whole texts can be any size.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
RUNTIME_CONF = {
    BATCH_BYTES: str(4 << 20),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on (time zone above all)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; local tests get their own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, label: str = "cut", compression: str | None = None) -> DataFrame:
    """End a lineage by writing the frame once to the shared folder and reading it back.

    A written table survives lost executors and, unlike ``checkpoint()``, is computed only once.  ``compression`` is the
    files' codec: "none" for rows that are packed already.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def cut_with(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`cut`, plus aggregate values of the frame gathered while it is written (no second job)."""
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    out = cut(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), label)
    return out, seen.get


def release(df: DataFrame | None) -> None:
    """Delete the table behind a frame that :func:`cut` returned, once no later step reads it."""
    path = getattr(df, "_newsloom_path", None)
    if not path:
        return
    sc = df.sparkSession.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
