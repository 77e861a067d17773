"""Byte-level BPE by corpus-level merge replay, and its inverse.

The corpus that merges are replayed on is a slice of the table, half a megabyte of text: its distinct
pre-tokens that the worker doesn't remember from slices before are laid out as one long byte sequence.
(The distinct pre-tokens of a whole table grow with it, and joining their ids back to the texts would
shuffle every token; merges never cross pre-tokens, so slices give the same ids.) An inverted index goes from the rank of a token pair to the positions where that pair stands. Ranks
are replayed in ascending order; a merge touches only its two neighbours, whose new pairs are
added to the index. Within a word this is the order of the usual encoder: lowest rank first, the
leftmost of equal ranks first, and a lower rank that a merge brings about goes ahead of what is left.

Edge cases: null or empty texts have no ids; no text holds special tokens; repeated rows are
encoded each; a byte without a rank of its own is an error, as it is in the reference format.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import batch_of, held, text_slices

#: Pre-tokens whose ids a worker remembers.
CACHE = 400_000


class Merges:
    """Ranks of token pairs: for every token each way to put it together from two others."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= 1 << 17:
            raise ValueError("more than 2**17 ranks")
        self.pair: dict[int, int] = {}
        for whole, r in ranks.items():
            for k in range(1, len(whole)):
                a, b = ranks.get(whole[:k]), ranks.get(whole[k:])
                if a is not None and b is not None:
                    self.pair[a << 17 | b] = r
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.first = np.full((256, 256), -1, np.int64)  # ranks of pairs of single bytes
        for whole, r in ranks.items():
            if len(whole) == 2:
                self.first[whole[0], whole[1]] = r


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids of each word after all merges, as little-endian unsigned 32-bit numbers."""
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    single = merges.single[data]
    if n and single.min() < 0:
        raise ValueError("a byte has no rank")
    token = single.tolist()
    # a piece stands at its first byte; each word is a linked list of pieces
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    inside = ends[ends < n]
    before[inside] = -1
    after[ends[ends > 0] - 1] = -1
    found = np.zeros(0, np.int64)
    if n:
        found = np.where(after[:-1] >= 0, merges.first[data[:-1], data[1:]], -1)
    rank = [*found.tolist(), -1]  # of the pair that begins at a place now; an entry of the index that differs is stale
    places = np.flatnonzero(found >= 0)
    order = np.argsort(found[places], kind="stable")
    places, found = places[order], found[places[order]]
    starts = np.flatnonzero(np.diff(found, prepend=-1))
    index = dict(zip(found[starts].tolist(), (x.tolist() for x in np.split(places, starts[1:])), strict=True)) if len(starts) else {}
    queue = sorted(index)
    prev, nxt, get = before.tolist(), after.tolist(), merges.pair.get
    while queue:
        r = heappop(queue)
        stand = index.pop(r, None)
        if stand is None:
            continue
        if len(stand) > 1:
            stand.sort()
        for k, i in enumerate(stand):
            if rank[i] != r:
                continue
            j = nxt[i]
            token[i], token[j], rank[j], rank[i] = r, -1, -1, -1
            nxt[i] = z = nxt[j]
            lower = False
            if z >= 0:
                prev[z] = i
                r2 = get(r << 17 | token[z])
                if r2 is not None:
                    rank[i] = r2
                    if r2 in index:
                        index[r2].append(i)
                    else:
                        index[r2] = [i]
                        heappush(queue, r2)
                        lower = r2 < r
            a = prev[i]
            if a >= 0:
                r2 = get(token[a] << 17 | r)
                if r2 is None:
                    rank[a] = -1
                else:
                    rank[a] = r2
                    if r2 in index:
                        index[r2].append(a)
                    else:
                        index[r2] = [a]
                        heappush(queue, r2)
                        lower = lower or r2 < r
            if lower and k + 1 < len(stand):
                index[r] = stand[k + 1 :] + index.get(r, [])
                heappush(queue, r)
                break
    left = np.array(token, np.int64)
    kept = np.flatnonzero(left >= 0)
    cuts = (4 * np.searchsorted(kept, ends)).tolist()
    ids = left[kept].astype("<u4").tobytes()
    return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder over one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex

        self.ranks = load_ranks(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.merges = Merges(self.ranks)
        self.size = cache
        # two generations: what is not met again while the younger fills up is forgotten
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.find(t) for t in texts]
        if len(self.known) > self.size // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = []
        for w in set().union(*split).difference(known):
            if (ids := older.get(w)) is None:
                missing.append(w)
            else:
                known[w] = ids
        if missing:
            known.update(zip(missing, replay([w.encode() for w in missing], self.merges), strict=True))
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    return held("bpe", (path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids array<int>)."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("ids", pa.list_(pa.int32()))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in text_slices(batch, size=1 << 19):
                ids = [x.astype(np.int32) for x in c.encode(texts)]
                yield batch_of(fields, {"doc_id": keys[first : first + len(texts)], "ids": ids})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, data binary) from rows (doc_id, ids); null ids come as no bytes."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("data", pa.binary())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                yield batch_of(fields, {"doc_id": part.column(0).to_pylist(), "data": [c.decode(x or ()) for x in part.column(1).to_pylist()]})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes those ids, in one pass."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        decimal = [str(i) for i in range(max(c.bytes_of) + 1)].__getitem__
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in text_slices(batch, size=1 << 19):
                ids = [x.tolist() for x in c.encode(texts)]
                yield batch_of(fields, {
                    "doc_id": keys[first : first + len(texts)],
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(" ".join(map(decimal, x)).encode()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in ids],
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
