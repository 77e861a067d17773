"""Writes: staged publication with gates, swaps and rollback; upserts; keyed rewrites (SNK01 to SNK09, BKF1).

A published table is a folder of versions and a ``CURRENT`` pointer. A version is written whole, its
gates are run on what was written, and only then the pointer moves. All paths go through the
session's file system, so that any store will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.operators.gates import require


class Store:
    """Versions of one table under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the pointers of a name, in order."""
        found = self.fs.globStatus(self._at(f"{name}.[0-9]*"))
        return sorted(int(s.getPath().getName().rsplit(".", 1)[-1]) for s in found) if found else []

    def _pointer(self, name: str) -> str | None:
        numbers = self._numbers(name)
        return self.spark.read.text(f"{self.path}/{name}.{numbers[-1]}").first()[0] if numbers else None

    def _point(self, name: str, version: str) -> None:
        temporary = self._at(f"_{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        # the largest number counts, so that there is no moment without a pointer; older ones go afterwards
        numbers = self._numbers(name)
        if not self.fs.rename(temporary, self._at(f"{name}.{numbers[-1] + 1 if numbers else 1}")):
            raise OSError("the pointer didn't move")
        for old in numbers[:-1]:
            self.fs.delete(self._at(f"{name}.{old}"), False)

    def current(self) -> str | None:
        return self._pointer("CURRENT")

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{version}")

    def publish(self, df: DataFrame, gates: Callable[[DataFrame], DataFrame] | None = None, partition_by: list[str] | None = None) -> str:
        """SNK01 to SNK03: write, check what was written, swap; the version before stays for ``rollback``. A failed gate leaves everything as it was."""
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{version}")
        try:
            if gates is not None:
                require(gates(self.spark.read.parquet(f"{self.path}/{version}")))
        except AssertionError:
            self.fs.delete(self._at(version), True)
            raise
        before = self.current()
        if before is not None:
            self._point("PREVIOUS", before)
        self._point("CURRENT", version)
        return version

    def rollback(self) -> str:
        """SNK03: back to the version before; again to undo it."""
        before, now = self._pointer("PREVIOUS"), self.current()
        if before is None or now is None:
            raise LookupError("no version to go back to")
        self._point("CURRENT", before)
        self._point("PREVIOUS", now)
        return before

    def finalize(self) -> None:
        """SNK03, CAS1: remove all versions but the two that are pointed at."""
        kept = {self.current(), self._pointer("PREVIOUS")}
        for status in self.fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.path)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in kept:
                self.fs.delete(status.getPath(), True)


def insert_ignore(table: DataFrame, staged: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """SNK05: the table with the first staged row of each new key; and one row (staged, inserted)."""
    first = staged.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    known = F.lit(False)
    for k in keys:
        known = known | F.col(k).isNull()
    fresh = first.where(~known).join(table.select(*keys), keys, "left_anti")
    counts = staged.agg(F.count(F.lit(1)).alias("staged")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("inserted")))
    return table.unionByName(fresh.select(*table.columns)), counts


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """SNK06: rows go ahead of the table's of the same key; of rows that share a key the greatest by all columns stays, null keys each."""
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    rows = rows.select(*table.columns)
    one = rows.where(known).groupBy(*keys).agg(F.max(F.struct(*table.columns)).alias("_row")).select("_row.*").unionByName(rows.where(~known))
    return table.join(one.select(*keys), keys, "left_anti").select(*table.columns).unionByName(one)


def replace_where(table: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """SNK07: rows of the values that ``rows`` has go, then these come: the same again changes nothing."""
    return table.join(rows.select(column).distinct(), column, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def update_from(table: DataFrame, changes: DataFrame, key: str, column: str, order: list[Column] | None = None) -> DataFrame:
    """SNK08, SNK09: a column's new values by key; of several changes of a key the first by ``order``."""
    new = changes.select(key, F.col(column).alias("_new"), *([] if order is None else [F.struct(*order).alias("_o")]))
    one = new.groupBy(key).agg((F.min("_new") if order is None else F.min_by("_new", "_o")).alias("_new"))
    return table.join(one, key, "left").withColumn(column, F.coalesce("_new", column)).select(*table.columns)


def backfill(table: DataFrame, todo: DataFrame, key: str, column: str, chunks: int, done: int = 0) -> tuple[DataFrame, DataFrame]:
    """BKF1: the rewrite of the chunks from ``done`` on, and their progress (chunk, rows); a key's chunk never changes, so that a stopped run goes on where it was."""
    part = todo.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")).where(F.col("chunk") >= done)
    return update_from(table, part, key, column), part.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))


def write_text_rows(df: DataFrame, path: str) -> None:
    """SNK04: separated values with missing ones as \\N and empty ones as empty; points as extended text."""
    point = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.concat(F.lit("SRID=4326;POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")))
    df.withColumn("geom", point).write.option("nullValue", "\\N").option("emptyValue", "").option("sep", "\t").csv(path)
