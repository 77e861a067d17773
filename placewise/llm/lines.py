"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, last_doc) of the 128-bit hashes of line keys, sorted by hash:
how many documents hold the key and the largest id among them. Each new batch is reduced to a run
of its own and put on level 0; when ``FAN`` runs stand on a level they are merged into one of the
next. The line hashes of all documents are joined with the runs once, after the last batch, since the
largest id that holds a key is known only then: hot keys (in at least ``min_docs`` documents) lose their lines except where ``last_doc`` holds them.

A key is the line without the whitespace ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower
case; keys under ``min_chars`` code points are never dropped. Text is split at line feeds only.

Edge cases: a null or empty text is one empty line; a document that repeats a key counts once;
rows of the same id are one document; rows without an id are one document that comes before all
others; ties have no influence; other columns are kept where documents are returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import batch_of, held, stash, text_slices

MIN_CHARS = 40
MIN_DOCS = 5
#: Runs of a level that are merged into one of the next.
FAN = 4
#: Batches that a whole table is taken in.
BATCHES = 4
#: Stands for a missing id.
NO_ID = -(2**63)
_BLANK = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes for a line's key; None if the key is too short to be dropped."""
    key = line.strip(_BLANK).lower()  # bytes: A-Z only
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (h1, h2, doc_id): the distinct droppable keys of each row."""
    fields = [pa.field("h1", pa.int64()), pa.field("h2", pa.int64()), pa.field("doc_id", pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("lines")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_slices(batch, size=4 << 20):
                keys, owner = [], []
                for i, text in enumerate(texts, first):
                    own = {h for line in text.encode().split(b"\n") if (h := line_hash(line, min_chars)) is not None}
                    keys += own
                    owner += [ids[i]] * len(own)
                both = np.frombuffer(b"".join(keys), ">i8").astype("<i8").reshape(-1, 2)
                yield batch_of(fields, {"h1": both[:, 0].copy(), "h2": both[:, 1].copy(), "doc_id": owner})

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "h1 long, h2 long, doc_id long")


class LineRuns:
    """Levels of sorted runs; ``add`` takes a batch of documents, ``hot`` reads across all runs."""

    def __init__(self, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, fan: int = FAN):
        self.min_chars, self.min_docs, self.fan = min_chars, min_docs, fan
        self.levels: list[list[DataFrame]] = []

    def _merge(self, runs: DataFrame) -> DataFrame:
        merged = runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return stash(merged.sortWithinPartitions("h1", "h2"))

    def add(self, seen: DataFrame) -> None:
        """Add a batch of ``line_hashes``; its documents must not have been added before."""
        run = seen.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        run, level = stash(run.sortWithinPartitions("h1", "h2")), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan:
                return
            runs, self.levels[level] = self.levels[level], []
            merged = runs[0]
            for other in runs[1:]:
                merged = merged.unionByName(other)
            run, level = self._merge(merged), level + 1

    def hot(self) -> DataFrame:
        """Keys (h1, h2, last_doc) in at least ``min_docs`` documents."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            raise ValueError("no batch was added")
        merged = runs[0]
        for other in runs[1:]:
            merged = merged.unionByName(other)
        if len(runs) > 1:
            merged = merged.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return merged.where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "last_doc")

    def drops(self, seen: DataFrame) -> DataFrame:
        """Rows (doc_id, drops): the keys that a document loses."""
        lost = seen.join(self.hot(), ["h1", "h2"]).where(F.col("doc_id") != F.col("last_doc"))
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def clean(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines that ``drops`` names taken out of ``text``; adds n_lines and n_dropped."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(*(F.col(f"`{c}`") for c in columns), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("_line_doc"))
    joined = keyed.join(drops.select(F.col("doc_id").alias("_line_doc"), F.col("drops").alias("_line_drops")), "_line_doc", "left").drop("_line_doc")
    schema = docs.select(*(F.col(f"`{c}`") for c in columns)).schema
    at = columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drop = batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()
            n_lines, n_dropped, out = [], [], []
            for text, gone in zip(texts, drop, strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if not gone:
                    n_dropped.append(0)
                    out.append(text)
                    continue
                gone = {(g["h1"], g["h2"]) for g in gone}
                kept = []
                for line in lines:
                    h = line_hash(line.encode(), min_chars)
                    if h is None or (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)) not in gone:
                        kept.append(line)
                n_dropped.append(len(lines) - len(kept))
                out.append("\n".join(kept))
            arrays = [pa.array(out, batch.column(k).type) if k == at else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return joined.select(*(F.col(f"`{c}`") for c in columns), "_line_drops").mapInArrow(run, f"{ddl}, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """All of ``docs``, taken in batches of whole documents: their columns with cleaned texts, and n_lines, n_dropped."""
    seen = stash(line_hashes(docs, min_chars))
    runs = LineRuns(min_chars, min_docs)
    for k in range(batches):
        runs.add(seen.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return clean(docs, runs.drops(seen), min_chars)


def digest(cleaned: DataFrame) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_sha256)."""
    return cleaned.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )

