"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has a bit per place where over half of the 3-word shingle hashes have one. Distinct
fingerprints are linked at ``BITS`` = 3 or fewer differing bits, exactly:

* The 64 bits are four segments of 16. If two fingerprints differ in at most three bits, some
  segment is equal in both while the next one (in a ring) differs in at most one bit.
* A segment, padded with zeros to 23 bits, decodes under the perfect binary Golay code to the
  index of its nearest codeword. One side has one key for each segment: the equal segment and the
  index of the next. The other has several: the indices of all words within one bit of the next.
  Words that differ in one bit share an index, so no pair is missed.
* The rows of a key meet in blocks of bounded size and are verified by counting differing bits; a
  block gives a spanning forest of its links, never all pairs. A large key is several blocks, each
  pair of which is a task's work of its own.

Components come from the forests. Edge cases: null or empty texts have fingerprint zero and are
linked like any other; equal fingerprints are one node; rows without an id are linked but name
no component, and ``keep_one`` keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.common import batch_of, held, stash, text_slices
from placewise.operators.components import connected_components

BITS = 3
SEED = 42
WORDS = 3
#: Rows of a key that meet in one block.
BLOCK = 2048
#: Generator polynomial of the [23, 12, 7] Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GENERATOR = 0b110001110101




def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text."""
    parts = text.encode().lower().split()  # bytes: A-Z only, and [\x20\x09-\x0D] only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    digest = xxhash.xxh64_digest
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)])
    hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fp long): the fingerprint's 64 bits as a signed number."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("fp", pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_slices(batch):
                fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield batch_of(fields, {"doc_id": ids[first : first + len(texts)], "fp": fps})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def golay_table() -> np.ndarray:
    """Index (the 12 message bits) of the nearest codeword of every 16-bit segment, padded with zeros to 23 bits."""
    # syndromes of all errors of up to three bits: 1 + 23 + 253 + 1771 = 2048, each syndrome once
    def remainder(word: np.ndarray) -> np.ndarray:
        word = word.copy()
        for bit in range(22, 10, -1):
            word ^= np.where(word >> bit & 1, GENERATOR << (bit - 11), 0)
        return word

    one = 1 << np.arange(23, dtype=np.int64)
    errors = [0]
    for i in range(23):
        errors.append(int(one[i]))
        for j in range(i):
            errors.append(int(one[i] | one[j]))
            errors += [int(one[i] | one[j] | one[k]) for k in range(j)]
    errors = np.array(errors, np.int64)
    leader = np.zeros(2048, np.int64)
    leader[remainder(errors)] = errors
    words = np.arange(1 << 16, dtype=np.int64)
    return ((words ^ leader[remainder(words)]) >> 11).astype(np.int64)


_TABLE: list[np.ndarray] = []


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): (row, key, wide); narrow keys are one for each segment, wide ones all within a bit."""
    if not _TABLE:
        _TABLE.append(golay_table())
    table = _TABLE[0]
    flips = np.concatenate([[0], 1 << np.arange(16)]).astype(np.int64)
    rows, keys, wide = [], [], []
    each = np.arange(len(fps))
    for s in range(4):
        here = (fps >> np.uint64(16 * s) & np.uint64(0xFFFF)).astype(np.int64)
        after = (fps >> np.uint64(16 * ((s + 1) % 4)) & np.uint64(0xFFFF)).astype(np.int64)
        base = (np.int64(s) << 28) | (here << 12)
        around = np.sort(table[after[:, None] ^ flips[None, :]], axis=1)
        new = np.ones(around.shape, bool)
        new[:, 1:] = around[:, 1:] != around[:, :-1]
        r, c = np.nonzero(new)
        rows += [each, r]
        keys += [base | table[after], base[r] | around[r, c]]
        wide += [np.zeros(len(fps), bool), np.ones(len(r), bool)]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(wide)


def keys_of(fps: DataFrame) -> DataFrame:
    """Rows (key, fp, wide) of distinct fingerprints (fp)."""
    fields = [pa.field("key", pa.int64()), pa.field("fp", pa.int64()), pa.field("wide", pa.bool_())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64)
            for k in range(0, len(fp), 4096):
                part = fp[k : k + 4096]
                rows, keys, wide = segment_keys(part.view(np.uint64))
                yield batch_of(fields, {"key": keys, "fp": part[rows], "wide": wide})

    return fps.select("fp").mapInArrow(run, "key long, fp long, wide boolean")


def forest(left: np.ndarray, right: np.ndarray, bits: int = BITS, step: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most ``bits`` differing bits) between two sets of fingerprints (uint64)."""
    nodes, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    label = np.arange(len(nodes))
    edges = []
    a, b = where[: len(left)], where[len(left) :]
    for k in range(0, len(a), step):
        part = a[k : k + step]
        near = np.bitwise_count(nodes[part][:, None] ^ nodes[b][None, :]) <= bits
        i, j = np.nonzero(near)
        i, j = part[i], b[j]
        while len(i):  # only links between parts that aren't joined yet are of use
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            if not len(i):
                break
            hi, lo = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
            first = np.unique(hi, return_index=True)[1]
            edges += zip(nodes[i[first]].tolist(), nodes[j[first]].tolist(), strict=True)
            parent = np.arange(len(nodes))
            parent[hi[first]] = lo[first]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            label = parent[label]
    return edges


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within ``BITS`` bits."""
    keys = stash(keys_of(fps))
    # a key that only one fingerprint has links nothing; counted with map-side combining
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi")
    blocks = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    met = keys.join(counts.select("key", blocks.alias("n")), "key")
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    met = met.withColumn("mine", mine)
    dealt = met.where(~F.col("wide")).select("key", "mine", every.alias("other"), "fp", "wide").unionByName(
        met.where("wide").select("key", every.alias("mine"), F.col("mine").alias("other"), "fp", "wide")
    )
    fields = [pa.field("a", pa.int64()), pa.field("b", pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by group; a group may go over the end of a batch
        rest: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            cols = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if not len(cols[0]):
                continue
            starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)]))
            rest = [c[starts[-1] :] for c in cols]
            if len(starts) > 1:
                yield meet([c[: starts[-1]] for c in cols], starts)
        if rest is not None:
            yield meet(rest, np.array([0, len(rest[0])]))

    def meet(cols: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        fp, wide = cols[3].astype(np.int64).view(np.uint64), cols[4].astype(bool)
        out: list[tuple[int, int]] = []
        for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if y - x > 1:
                w = wide[x:y]
                out += forest(fp[x:y][~w], fp[x:y][w])
        both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return batch_of(fields, {"a": both[:, 0].copy(), "b": both[:, 1].copy()})

    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.repartition(width, "key", "mine", "other").sortWithinPartitions("key", "mine", "other")
    return spread.select("key", "mine", "other", "fp", "wide").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest id that links of at most ``BITS`` bits reach."""
    marked = stash(fingerprints(docs))
    nodes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    parts = connected_components(links(nodes, block))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_fp = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _joined(docs: DataFrame, also: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, component_id) of the ids: fingerprints' links and the edges ``also`` (a, b) of ids, as one graph."""
    marked = stash(fingerprints(docs))
    nodes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    near = links(nodes, block)
    if not nodes.where("first_doc is null").isEmpty():
        # such a fingerprint may join others and has no id to stand for it: its part of the graph comes first
        parts = connected_components(near).withColumnRenamed("node", "fp")
        named = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        least = named.groupBy("component").agg(F.min("first_doc").alias("first_doc"))
        nodes = stash(named.select("fp", "component").join(least, "component").select("fp", "first_doc"))
        between = None
    else:
        first = nodes.select(F.col("fp").alias("a"), F.col("first_doc").alias("x")), nodes.select(F.col("fp").alias("b"), F.col("first_doc").alias("y"))
        between = near.join(first[0], "a").join(first[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = marked.where("doc_id is not null").join(nodes, "fp").select(F.col("first_doc").alias("a"), F.col("doc_id").alias("b")).distinct().unionByName(also.select("a", "b"))
    edges = stash(edges if between is None else edges.unionByName(between))
    return connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def digest(found: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), the fingerprint as 16 hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """One document of each component, joined further by the edges ``also`` (a, b) of ids: the smallest id; of rows that share it the least by its atomic columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = near_duplicates(docs) if also is None else _joined(docs, also)
    leaders = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.withColumn("_id", F.col("doc_id").cast("long")).join(leaders.withColumnRenamed("doc_id", "_id"), "_id", "left_semi")
    atomic = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    one = kept.groupBy("_id").agg(F.min_by(F.struct(*columns), F.struct(*atomic)).alias("_row")).select("_row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
