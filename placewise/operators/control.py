"""The control plane: freshness, step runner, content-addressed sources (FRS1, PIPE1, CAS1). Small tables and files only."""

from __future__ import annotations

import hashlib
import shutil
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.durable import cut


def signatures(inputs: DataFrame) -> DataFrame:
    """FRS1: a signature of each target from its inputs (target, name, sha): the SHA-256 of their sorted lines."""
    line = F.concat_ws(":", "name", "sha")
    return inputs.groupBy("target").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))).cast("binary"), 256).alias("signature"))


def freshness(now: DataFrame, recorded: DataFrame, upstream: DataFrame) -> DataFrame:
    """FRS1: targets (target, signature) against recorded ones: fresh, stale or missing; stale too if any target that it needs (target, needs), directly or through others, isn't fresh."""
    state = F.when(F.col("was").isNull(), "missing").when(F.col("was") == F.col("signature"), "fresh").otherwise("stale")
    own = now.join(recorded.select("target", F.col("signature").alias("was")), "target", "left").select("target", state.alias("state"))
    # staleness goes on along the graph until nothing new turns stale; a graph of build targets is small
    bad = cut(own.where("state <> 'fresh'").select("target"))
    n = bad.count()
    while True:
        reached = upstream.join(bad.withColumnRenamed("target", "needs"), "needs", "left_semi").select("target")
        bad, before = cut(bad.unionByName(reached).distinct()), n
        n = bad.count()
        if n == before:
            break
    j = own.join(bad.withColumn("_bad", F.lit(True)), "target", "left")
    return j.select("target", F.when(F.col("_bad") & (F.col("state") == "fresh"), "stale").otherwise(F.col("state")).alias("state"))


def run_steps(spark: SparkSession, steps: list[tuple[str, list[str], Callable[[], int]]], wanted: set[str] | None = None) -> DataFrame:
    """PIPE1: steps (name, needs, function to a row count) in order; failures add up, and steps that need a failed one are left out. Rows (step, status, rows, error)."""
    done: list[tuple[str, str, int | None, str | None]] = []
    bad: set[str] = set()
    for name, needs, step in steps:
        if wanted is not None and name not in wanted:
            done.append((name, "not wanted", None, None))
        elif bad & set(needs):
            bad.add(name)
            done.append((name, "skipped", None, f"needs {', '.join(sorted(bad & set(needs)))}"))
        else:
            try:
                done.append((name, "ok", step(), None))
            except Exception as e:  # noqa: BLE001  every failure belongs in the table
                bad.add(name)
                done.append((name, "failed", None, str(e)[:500]))
    return spark.createDataFrame(done, "step string, status string, rows long, error string")


class Sources:
    """CAS1: files by the SHA-256 of their bytes, with manifests of names; for source files on the driver's own disk."""

    def __init__(self, root: str):
        self.blobs, self.manifests = Path(root) / "blobs", Path(root) / "manifests"
        self.blobs.mkdir(parents=True, exist_ok=True)
        self.manifests.mkdir(parents=True, exist_ok=True)

    @staticmethod
    def check(path: str) -> None:
        """Reject empty files and broken archives."""
        p = Path(path)
        if not p.stat().st_size:
            raise ValueError(f"{p.name} is empty")
        if p.suffix == ".zip" and (not zipfile.is_zipfile(p) or zipfile.ZipFile(p).testzip() is not None):
            raise ValueError(f"{p.name} is broken")

    def put(self, path: str) -> str:
        self.check(path)
        digest = hashlib.sha256(Path(path).read_bytes()).hexdigest()
        if not (self.blobs / digest).exists():
            part = self.blobs / f"{digest}.part"
            shutil.copyfile(path, part)
            part.rename(self.blobs / digest)
        return digest

    def snapshot(self, name: str, files: dict[str, str], listed: int) -> None:
        """A manifest of names and paths; as many as were listed must have come."""
        if len(files) != listed:
            raise ValueError(f"{len(files)} of {listed} files")
        lines = sorted(f"{self.put(path)} {file}" for file, path in files.items())
        part = self.manifests / f"{name}.part"
        part.write_text("\n".join(lines))
        part.rename(self.manifests / name)

    def collect_garbage(self) -> int:
        """Remove blobs that no manifest names; their number."""
        used = {line.split(" ", 1)[0] for m in self.manifests.iterdir() for line in m.read_text().splitlines()}
        gone = [b for b in self.blobs.iterdir() if b.name not in used]
        for b in gone:
            b.unlink()
        return len(gone)
