"""Readers of delimited text in the encodings that Korean open data comes in (SRC01 to SRC06, SRC14, SRC17, TXT21)."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings that are tried in this order (fixed values).
ENCODINGS = ["utf-8-sig", "cp949", "euc-kr", "utf-8"]


def fixed_positions(spark: SparkSession, path: str, names: dict[int, str], width: int, encoding: str = "CP949", separator: str = "|") -> tuple[DataFrame, DataFrame]:
    """SRC01, SRC17: header-less rows by position as text columns, with their file and line; and one row (rows, short). Rows with fewer than ``width`` fields are counted, not kept; bad bytes become U+FFFD.

    ``line`` orders the rows of a file."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    schema = T.StructType([T.StructField("line_text", T.StringType())])
    raw = spark.read.schema(schema).option("sep", "\u0001").option("quote", "").option("escape", "").option("encoding", encoding).csv(path)
    raw = raw.select("line_text", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    parts = raw.withColumn("f", F.split("line_text", "\\" + separator, -1))
    kept = parts.where(F.size("f") >= width).select(*(F.get("f", F.lit(i)).alias(n) for i, n in names.items()), "file", "line")
    counts = parts.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("f") < width).alias("short"))
    return kept, counts


def encoding_of(data: bytes) -> str:
    """SRC03: the first encoding that reads all the bytes."""
    for name in ENCODINGS:
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding")


def read_csv(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """SRC02 to SRC04: CSV files with a header, each in its own encoding, as text columns by name, with ``file`` and ``folder``.

    Encodings are told from all bytes of every file, on the executors (a file has to fit there); then there is one read for each encoding and header."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.csv").load(path)

    @F.udf("string")
    def told(content: bytes) -> str:
        return encoding_of(bytes(content))

    kinds: dict[str, list[str]] = {}
    for row in files.select("path", told("content").alias("encoding")).collect():  # one short row a file
        kinds.setdefault(row.encoding, []).append(row.path)
    out = None
    for encoding, paths in sorted(kinds.items()):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        for one in sorted(paths):
            # headers differ between files
            df = spark.read.option("header", True).option("encoding", {"utf-8-sig": "UTF-8", "cp949": "CP949"}.get(encoding, encoding)).option("multiLine", True).option("escape", '"').csv(one)
            df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns)).withColumn("file", F.lit(one.rsplit("/", 1)[-1])).withColumn("folder", F.lit(one.rsplit("/", 2)[-2]))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(path)
    return out


def code_table(spark: SparkSession, path: str, header: list[str], states: dict[str, bool], encoding: str = "cp949", separator: str = "\t") -> DataFrame:
    """SRC05, SRC06: a code table of known header, plain or zipped: (code, name, exist, sha256) for three columns with a state, else all columns and sha256.

    The file is a dictionary of some thousands of rows; anything that doesn't fit is an error."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    digest = hashlib.sha256(raw).hexdigest()
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            raw = z.read(z.namelist()[0])
    rows = list(csv.reader(io.StringIO(raw.decode(encoding)), delimiter=separator))
    if [c.strip() for c in rows[0]] != header:
        raise ValueError(f"unexpected header {rows[0]}")
    body = [[c.strip() for c in r] for r in rows[1:] if r]
    if any(len(r) != len(header) for r in body):
        raise ValueError("a row of another width")
    if states:
        unknown = {r[2] for r in body} - set(states)
        if unknown:
            raise ValueError(f"unknown state {sorted(unknown)}")
        return spark.createDataFrame([(r[0], r[1], states[r[2]], digest) for r in body], "code string, name string, exist boolean, sha256 string")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [*header, "sha256"]])
    return spark.createDataFrame([(*r, digest) for r in body], schema)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC14: JSON lines of a declared schema."""
    return spark.read.schema(schema).json(path)


def header_key(name: str) -> str:
    """TXT21: a header without marks, spaces and brackets, in lower case."""
    return re.sub(r"[\s_\-()\[\]﻿]", "", name or "").lower()


def find_column(columns: list[str], hints: list[str]) -> str | None:
    """TXT21: the first hint that a header equals; else the first that one contains."""
    keys = {header_key(c): c for c in reversed(columns)}
    for h in map(header_key, hints):
        if h in keys:
            return keys[h]
    return next((c for h in map(header_key, hints) for c in columns if h in header_key(c)), None)


def coordinate_column(df: DataFrame, hints: list[str], low: float, high: float, rows: int = 200) -> str | None:
    """TXT21: of the columns that a hint fits, the one whose first ``rows`` values are most often decimal numbers in range; whole degrees are decoys."""
    fits = [c for c in df.columns if any(header_key(h) in header_key(c) for h in hints)]
    if not fits:
        return None

    def share(c: str) -> Column:
        v = F.trim(F.col(f"`{c}`"))
        return F.coalesce(F.avg(F.when(v.rlike(r"^\d+\.\d+$") & v.try_cast("double").between(low, high), 1.0).otherwise(0.0)), F.lit(0.0))

    one = df.limit(rows).agg(*(share(c).alias(f"s{k}") for k, c in enumerate(fits))).first()
    best = max(range(len(fits)), key=lambda k: (one[k], -k))
    return fits[best] if one[best] > 0 else None


def sampled(df: DataFrame, share: float, n: int, key: str, seed: int) -> DataFrame:
    """SRC16: about ``share`` of the rows, of those ``n`` in a hash's order: the same for the same seed."""
    return df.sample(share, seed).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
