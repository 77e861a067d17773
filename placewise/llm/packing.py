"""Best-fit packing of tokenized documents into fixed-length sequences.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt by hash to packers of
bounded size; each packer runs bounded-space online best fit over its pieces in the order of ids: open
bins stand in a bitset keyed by free space, a piece goes to the bin that it fills best as soon as it
comes, and when more than ``max_open`` bins are open the fullest closes. Bins that end half empty or
more are joined across packers by a second round of the same packer.

Edge cases: null or empty texts are one piece that holds the end token alone; a document of a
multiple of ``capacity`` tokens has no empty last piece; repeated rows are packed once each;
null ids are kept; columns other than the id and the text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import batch_of, held, stash, text_slices

CAPACITY = 2048
#: Bins that a packer keeps open, and the pieces that it is dealt on average.
MAX_OPEN = 256
PER_PACKER = 32_768
#: Chunks, and words within them, whose ids a worker remembers.
CACHE = 1_200_000
#: A control character that stands alone between chunks that are encoded together.
MARK = "\x01"
#: The last Latin letter before the modifiers; none up to it is taken apart in normal form C.
LATIN = "\u02af"

PIECES = [
    pa.field("doc_id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()),
    pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64()),
]
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkEncoder:
    """Ids of texts by a tokenizer whose pre-tokens never span spaces or line feeds: chunks between those are encoded once and remembered."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark = self._ids(MARK)
        # a word of a-z is one pre-token as it stands: its normal form and the pattern need not be looked at
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.normalizer = None
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        model = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in model["normalizer"]["normalizers"]], model["model"]["type"], model["model"]["dropout"]
        if steps != (["NFC", "Replace", "Lowercase"], "BPE", None):
            raise ValueError("not a lower-casing word BPE")
        # every pre-token ends with one token of these
        self.ends = np.zeros(max(model["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["model"]["vocab"].items() if t.endswith(model["model"]["end_of_word_suffix"])]] = True
        self.size = cache
        # two generations: what is not met again while the younger fills up is forgotten
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, chunks: list[str]) -> None:
        known = self.known
        # one pre-token each, unless one falls apart in lower case, which the count of ends tells
        words = [w for w in chunks if w.isalpha()]
        plain = [w for w in words if w.isascii() and w.islower()]
        others = [w for w in words if not (w.isascii() and w.islower()) and is_normalized("NFC", w)]
        for tokenizer, some in ((self.plain, plain), (self.tokenizer, others)):
            for k in range(0, len(some), 1000):
                part = some[k : k + 1000]
                ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(cuts) == len(part):
                    raw = ids.tobytes()
                    known.update(zip(part, [raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        chunks = [c for c in chunks if c not in known]
        alone = [c for c in chunks if MARK in c]
        together = [c for c in chunks if MARK not in c]
        if len(self.mark) != 1:
            alone, together = chunks, []
        for c in alone:
            known[c] = np.array(self._ids(c), "<u4").tobytes()
        for k in range(0, len(together), 2000):
            part = together[k : k + 2000]
            ids = np.array(self._ids(f" {MARK} ".join(part)), "<u4")
            ends = np.flatnonzero(ids == self.mark[0]).tolist()
            if len(ends) != len(part) - 1:
                raise ValueError("the tokenizer does not keep chunks apart")
            raw = ids.tobytes()
            for c, a, b in zip(part, [0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True):
                known[c] = raw[4 * a : 4 * b]

    @staticmethod
    def _apart(chunk: str) -> tuple[str, str]:
        """A chunk without the ASCII punctuation that follows its last Latin letter, in lower case if it is ASCII, and that punctuation: pre-tokens of their own."""
        base = chunk.rstrip(punctuation)
        if base != chunk and not (base and base[-1] <= LATIN and base[-1].lower().isalpha()):
            return chunk, ""
        return (base.lower() if base.isascii() else base), chunk[len(base) :]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.size // 2:
            self.older, self.known = self.known, {"": b""}
        known, older = self.known, self.older
        whole, unknown = [], set()
        for c in set().union(*split).difference(known):
            if (ids := older.get(c)) is not None:
                known[c] = ids
                continue
            base, tail = (c.lower(), "") if c.isalpha() and c.isascii() else self._apart(c)
            if base == c:
                unknown.add(c)
                continue
            whole.append((c, base, tail))
            for x in (base, tail):
                if x not in known:
                    if (ids := older.get(x)) is None:
                        unknown.add(x)
                    else:
                        known[x] = ids
        if unknown:
            self._learn(list(unknown))
        for c, base, tail in whole:
            known[c] = known[base] + known[tail]
        get = known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


def encoder(path: str) -> ChunkEncoder:
    return held("packing", path, lambda: ChunkEncoder(path))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then ``end_id``, cut at ``capacity``."""
    fields = PIECES + ([pa.field("ids", pa.list_(pa.int32()))] if with_ids else [])

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_slices(batch):
                out: dict[str, list] = {f.name: [] for f in fields}
                for i, raw in enumerate(enc.encode(texts), first):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[a : a + 4 * capacity]
                        out["doc_id"].append(ids[i])
                        out["piece"].append(k)
                        out["start"].append(a // 4)
                        out["length"].append(len(part) // 4)
                        out["ids_crc32"].append(zlib.crc32(part))
                        if with_ids:
                            out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                yield batch_of(fields, out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut_up, PIECES_DDL + (", ids array<int>" if with_ids else "")
    )


class Bins:
    """Bounded-space best fit; ``place`` gives (bin, offset)."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.free = 0  # bit f is set if a bin with f free places is open
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, f: int) -> int:
        bin_ = self.by_free[f].pop()
        self.open -= 1
        if not self.by_free[f]:
            self.free &= ~(1 << f)
        return bin_

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.free >> size
        if fitting:
            f = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(f)
        else:
            f, bin_ = self.capacity, self.made
            self.made += 1
        if f > size:
            self.by_free[f - size].append(bin_)
            self.free |= 1 << (f - size)
            self.open += 1
            if self.open > self.max_open:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
        return bin_, self.capacity - f


def best_fit(items: DataFrame, group: str, size: str, order: list[str], capacity: int, max_open: int, bin_: str, at: str) -> DataFrame:
    """Pack each group's rows apart, one by one in the given order; adds ``bin_`` (unique over groups) and ``at``."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        bins = Bins(capacity, max_open)
        placed = [bins.place(n) for n in rows.column(size).to_pylist()]
        base = key[0].as_py() << 32
        rows = rows.append_column(bin_, pa.array([base + b for b, _ in placed], pa.int64()))
        return rows.append_column(at, pa.array([o for _, o in placed], pa.int64()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.groupBy(group).applyInArrow(run, f"{ddl}, `{bin_}` long, `{at}` long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_open: int = MAX_OPEN, per_packer: int = PER_PACKER) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, any more); no row is dropped or split."""
    pieces = stash(pieces)
    packers = max(1, -(-pieces.count() // per_packer))
    dealt = pieces.withColumn("_packer", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(packers)))
    placed = stash(best_fit(dealt, "_packer", "length", ["doc_id", "piece", "start"], capacity, max_open, "_bin", "_at").drop("_packer"))
    # best fit opens a bin only for what fits nowhere: few of a packer's bins are half full or less; those are packed again
    half = placed.groupBy("_bin").agg(F.sum("length").alias("_used")).where(F.col("_used") <= capacity // 2)
    half = half.withColumn("_group", F.shiftright("_bin", 32 + 15))
    moved = best_fit(half, "_group", "_used", ["_bin"], capacity, max_open, "_to", "_base").select("_bin", (-1 - F.col("_to")).alias("_to"), "_base")
    joined = placed.join(moved, "_bin", "left")
    return joined.select(
        *pieces.columns,
        F.coalesce("_to", "_bin").alias("sequence_id"),
        (F.col("_at") + F.coalesce("_base", F.lit(0))).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, max_open: int = MAX_OPEN, per_packer: int = PER_PACKER) -> DataFrame:
    """Documents (doc_id, text) to packed pieces; with ``with_ids`` each carries its token ids."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity, max_open, per_packer)
