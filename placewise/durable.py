"""Durable cuts of lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one with a local master and an error otherwise."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if where:
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(where)
        return where
    if context.getCheckpointDir().isEmpty():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="placewise-"))
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and forget its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table and read it back (smaller than ``cut``; removed when the application ends)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    hadoop, store = _place(spark, path)
    store.deleteOnExit(hadoop)
    out = spark.read.schema(schema).parquet(path)
    out._stash_path = path
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*stashes: DataFrame) -> None:
    """Remove the tables that ``stash`` gave; nothing that is still to be computed may read them."""
    for df in stashes:
        hadoop, store = _place(df.sparkSession, df._stash_path)
        store.delete(hadoop, True)
