"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

The shingles of a text (``WORDS`` words, repeats once) are hashed once. The top bits of a hash name
its bin, and a bin keeps its least hash. An empty bin is filled by optimal densification: every bin
has its own random order of all bins (by a hash of both numbers) and takes the value of the first
full one in it. Of each value the low ``LOW_BITS`` bits are stored, packed into hex digits. Equal
bins of two fingerprints give a likeness, corrected for low bits that are equal by chance.

Edge cases: a text of fewer words is one shingle; texts without words (null, empty, blank) have
the fingerprint of the empty shingle; equal texts have equal fingerprints; repeated rows stay and
follow one another in ``next``; rows without an id come first; rows of one id (or of none) follow one
another by a hash of their texts; other columns don't matter.
"""

from __future__ import annotations

import json
from itertools import batched
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
#: Bins (a power of two) and stored bits of each.
BIN_BITS, LOW_BITS = 7, 8
BINS = 1 << BIN_BITS
#: Whitespace that parts words: [\x20\x09-\x0D].
_BLANK = "[ \\t\\n\\x0B\\f\\r]+"
#: Rows that a block of the order of ids has on average; blocks at most (their bounds, two numbers each, come to the driver and go to every task).
PER_BLOCK, BLOCKS = 2_000, 16_384
#: Probes of an empty bin before the least of all full bins' hashes decides.
PROBES = 12
#: Stands for a missing id.
NO_ID = -(2**63)


def with_fingerprint(df: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """Adds ``out``: the packed fingerprint (array of longs, ``64 // LOW_BITS`` bins each) of the column ``text``.

    Steps are columns of their own, so that none is computed twice."""
    w, h, s, v, b, p, d = (f"_{out}_{k}" for k in "whsvbpd")
    df = df.withColumn(w, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _BLANK), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x))).drop(w)
    rolled = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))
    df = df.withColumn(s, F.when(F.size(h) > words, rolled).otherwise(F.array(F.xxhash64(h))))
    df = df.withColumn(s, F.sort_array(s)).drop(h)
    # sorted hashes have bins (their top bits, in signed order) together: the first of each is its least
    df = df.withColumn(v, F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(s, i - 1), 64 - BIN_BITS)))).drop(s)
    df = df.withColumn(b, F.transform(v, lambda x: (F.shiftright(x, 64 - BIN_BITS) + BINS // 2).cast("int")))
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    df = df.withColumn(p, F.when(F.size(v) == BINS, F.col(v)).otherwise(F.transform(every, lambda i: F.get(v, (F.array_position(b, i) - 1).cast("int")))))

    def filled(x: Column, i: Column) -> Column:
        probes = [F.get(p, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(1, PROBES + 1)]
        last = F.get(p, F.array_min(F.transform(b, lambda j: F.struct(F.xxhash64(i, j).alias("h"), j.alias("j"))))["j"])
        return F.coalesce(x, *probes, last)

    df = df.withColumn(d, F.when(F.size(v) == BINS, F.col(p)).otherwise(F.transform(p, filled))).drop(v, b, p)
    per = 64 // LOW_BITS

    def packed(k: Column) -> Column:
        word = None
        for j in range(per):
            low = F.shiftleft(F.get(d, k * per + j).bitwiseAND((1 << LOW_BITS) - 1), 64 - LOW_BITS * (j + 1))
            word = low if word is None else word.bitwiseOR(low)
        return word

    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), packed)).drop(d)


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, from 0 to 1; low bits that are equal by chance are accounted for."""
    assert LOW_BITS == 8
    ones = F.lit(0x0101010101010101).cast("long")

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)  # a byte of z is zero where the bins agree; each byte's bits are gathered in its lowest
        for n in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, n))
        return F.bit_count(z.bitwiseAND(ones))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, x: n + x)
    equal = 1.0 - unequal / F.lit(float(BINS))
    chance = 2.0**-LOW_BITS
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, packed, fingerprint)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_fingerprint(df, "text", "packed", words).select("doc_id", "packed", as_hex(F.col("packed")).alias("fingerprint"))


def _bounds(keys: DataFrame, per_block: int) -> list[tuple[int, int]]:
    """The first (_id, _hash) of each block of the order of ``keys``, by range partitions of them alone (no texts)."""
    blocks = min(BLOCKS, max(1, -(-keys.count() // per_block)))
    ranged = keys.repartitionByRange(blocks, "_id", "_hash").groupBy(F.spark_partition_id().alias("_part")).agg(F.min(F.struct("_id", "_hash")).alias("_first"))
    return sorted({(r._first._id, r._first._hash) for r in ranged.collect()})


def _placed(bounds: list[tuple[int, int]]) -> tuple[Column, Column, Column, int]:
    """Where a row (_id, _hash) stands among the bounds, in two steps of about their square root: its group, its place within (_group), whether it is that bound, and the width of groups."""
    width = isqrt(len(bounds) - 1) + 1
    groups = [list(some) for some in batched(bounds, width)]
    one = "struct<i:bigint,h:bigint>"
    as_json = lambda x: F.lit(json.dumps(x))
    tops = F.from_json(as_json([{"i": i, "h": h} for (i, h), *_ in groups]), f"array<{one}>")
    nested = F.from_json(as_json([[{"i": i, "h": h} for i, h in some] for some in groups]), f"array<array<{one}>>")
    key = F.struct(F.col("_id").alias("i"), F.col("_hash").alias("h"))
    group = (F.size(F.filter(tops, lambda x: x <= key)) - 1).cast("int")
    within = F.size(F.filter(F.get(nested, F.col("_group")), lambda x: x <= key)) - 1
    first = F.get(F.get(nested, F.col("_group")), F.col("_within").cast("int")) == key
    return group, within, first, width


def with_next(docs: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """Rows (doc_id, text, packed, next_text, next_packed): with the next document by id; after the last comes the first.

    Whole texts are shuffled once, by block; the first rows of each block go to the one before as well."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("_id")
    hash_ = F.xxhash64("text").alias("_hash")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", "text", id_, hash_)
    bounds = _bounds(own.select("_id", "_hash"), per_block)
    own = with_fingerprint(own, "text", "packed")
    if not bounds:
        return own.select("doc_id", "text", "packed", F.col("text").alias("next_text"), F.col("packed").alias("next_packed"))
    group, within, first, width = _placed(bounds)
    own = own.withColumn("_group", group).withColumn("_within", within).withColumn("_first", first)
    block = F.col("_group") * width + F.col("_within")
    # (block, guest): a row in its own block, and a first row in the block before as well; before the first block comes the last
    home = F.struct(block.alias("at"), F.lit(False).alias("guest"))
    away = F.struct(F.pmod(block - 1, F.lit(len(bounds))).alias("at"), F.lit(True).alias("guest"))
    placed = own.select("doc_id", "text", "packed", "_id", "_hash", F.explode(F.when(F.col("_first"), F.array(home, away)).otherwise(F.array(home))).alias("_p"))
    placed = placed.select("doc_id", "text", "packed", "_id", "_hash", F.col("_p.at").alias("_at"), F.col("_p.guest").alias("_guest"))
    order = Window.partitionBy("_at").orderBy("_guest", "_id", "_hash", "text")
    led = placed.select("doc_id", "text", "packed", "_guest", F.lead("text").over(order).alias("next_text"), F.lead("packed").over(order).alias("next_packed"))
    return led.where(~F.col("_guest")).drop("_guest")


def compare_with_edits(docs: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """Each document, its edited text (its last half replaced by the start of the next document), and how like they are by their fingerprints."""
    df = with_next(docs, per_block).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    df = df.select("doc_id", "n_chars", "packed", "next_packed", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    df = with_fingerprint(df, "edited", "edited_packed")
    return df.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("packed")).alias("fingerprint"), as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
