"""What the operators of this subpackage share: reading, shipping, durable cuts of lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.durable import cut, discard, shared_dir, stash

__all__ = ["batch_of", "bounded", "cut", "discard", "held", "held_against", "let_go", "shared_dir", "ship", "stash", "table", "text_slices"]

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library from the same place as the driver."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    for name in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS", "OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        env.setdefault(name, "false" if name == "TOKENIZERS_PARALLELISM" else "1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker remembers between tasks, of the operator that it ran last.
_HELD: dict = {}


def held(kind: str, key=None, make=None):
    """What ``make`` gave for (kind, key) in this worker; things of other kinds are let go first, so that a worker that serves one operator after another holds the memory of one."""
    if any(k != kind for k, _ in _HELD):
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    if (kind, key) not in _HELD:
        _HELD[kind, key] = make() if make else None
    return _HELD[kind, key]


def let_go(spark: SparkSession) -> None:
    """Give back the memory of the driver that earlier steps have left: plans, broadcast tables, what was collected."""
    gc.collect()  # handles of the JVM's objects among it
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 20):
    """Split a batch into runs of rows of about ``size`` bytes of text, so that working memory doesn't follow the batch.

    Yields (first row, texts); null texts come as empty strings."""
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    first, held, n = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or "")
        n += len(held[-1])
        if n >= size:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def batch_of(fields, columns: dict) -> pa.RecordBatch:
    """A record batch of the given Arrow fields."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in fields], schema=pa.schema(fields))


#: Rows that are sent to every task at most; above that a join deals both sides out.
SMALL = 400_000
#: Members of one text that a task compares with it, about.
PER_TASK = 100


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, to be sent to every task if there are few."""
    return F.broadcast(df) if rows <= SMALL else df


def held_against(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (other_id, kind, doc_id, text), sorted within partitions: for each other_id of ``pairs`` (doc_id, other_id) its own text (kind 0), then those of its members (kind 1).

    Members of a crowded other_id are dealt out, its text goes to each of their tasks."""
    n_pairs = pairs.count()
    crowded = stash(pairs.groupBy("other_id").count().where(F.col("count") > PER_TASK).select("other_id", F.ceil(F.col("count") / float(PER_TASK)).cast("int").alias("salts")))
    salted = pairs.join(bounded(crowded, n_pairs // PER_TASK), "other_id", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    members = salted.select("doc_id", "other_id", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"))
    heads = salted.select("other_id", "salts").distinct().select(
        F.col("other_id").alias("doc_id"), "other_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind")
    )
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = docs.join(bounded(members.unionByName(heads), 2 * n_pairs), "doc_id")
    met = met.repartition(width, "other_id", "salt").sortWithinPartitions("other_id", "salt", "kind", "doc_id")
    return met.select("other_id", "kind", "doc_id", "text")
