import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from placewise.llm import bpe, packing
from tokenizers import Tokenizer

BYTE, WORD = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
PARTS = ["a", "the", "ing", " ", "\n", "'s", "'ll", "é", "é", "ß", "漢", "12", "!!", "\x1c", "\x85", "😀", "\t", "  ", "İ", "Σ", "ΑΣ", "\x01", "<|endoftext|>", "Don't", ".", ",", "ABLE"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_replay_equals_the_library():
    codec = bpe.Codec(BYTE, P.PATTERN)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    some = [*texts(3000), "a" * 3000, "ab" * 1500, " " * 2000, "é" * 999]
    for text, ids in zip(some, codec.encode(some), strict=True):
        assert ids.tolist() == other.encode_ordinary(text)
        assert codec.decode(ids.tolist()) == text.encode()


def test_a_small_cache_changes_nothing():
    some = texts(400, 2)
    large, small = bpe.Codec(BYTE, P.PATTERN), bpe.Codec(BYTE, P.PATTERN, cache=20)
    for k in range(0, 400, 40):
        assert [x.tolist() for x in large.encode(some[k : k + 40])] == [x.tolist() for x in small.encode(some[k : k + 40])]


def test_chunks_equal_whole_texts():
    encoder, whole = packing.ChunkEncoder(WORD, cache=300), Tokenizer.from_file(WORD)
    whole.encode_special_tokens = True
    some = texts(3000, 3)
    for k in range(0, 3000, 100):
        for text, raw in zip(some[k : k + 100], encoder.encode(some[k : k + 100]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_letters_marks_and_signs_before_punctuation():
    encoder, whole = packing.ChunkEncoder(WORD), Tokenizer.from_file(WORD)
    whole.encode_special_tokens = True
    texts = [f"a{c}! {c}< {c}x {c}\u0301' B{c}" for c in map(chr, range(0x20, 0x3100))]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_as_tables(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x")], "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, BYTE, P.PATTERN)
    assert sorted((r.doc_id, bytes(r.data)) for r in bpe.decode(encoded, BYTE, P.PATTERN).collect()) == [(1, b"Hello world"), (2, b""), (3, b""), (3, b"")]
    assert bpe.round_trip_digest(docs.limit(0), BYTE, P.PATTERN).count() == 0


@pytest.mark.parametrize(("max_open", "per_packer"), [(packing.MAX_OPEN, packing.PER_PACKER), (4, 50), (64, 100)])
def test_packing_is_whole_and_gapless(spark, max_open, per_packer):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["ab", "cd", "the", "x1"]) for _ in range(rng.choice([0, 3, 30, 90, 200])))) for k in range(300)] + [(900, None), (900, None), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = packing.pack_documents(docs, WORD, capacity=64, max_open=max_open, per_packer=per_packer, with_ids=True).collect()
    whole = Tokenizer.from_file(WORD)
    texts_of = {i: t or "" for i, t in rows}
    pieces, sequences = {}, {}
    for r in found:
        assert r.ids and len(r.ids) == r.length <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in texts_of.items():
        own = sorted(pieces[i])[:: 2 if i == 900 else 1]
        assert [p for p, _, _ in own] == list(range(len(own))) and all(len(x) == 64 for _, _, x in own[:-1])
        assert [s for _, s, _ in own] == [64 * k for k in range(len(own))]
        assert sum((x for _, _, x in own), []) == [*whole.encode(text, add_special_tokens=False).ids, 0]
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.25 * sum(r.length for r in found) / 64


def test_bins_by_brute_force():
    rng = random.Random(5)
    for max_open in (1, 3, 20):
        bins, free, closed, made = packing.Bins(50, max_open), {}, set(), 0
        for _ in range(2000):
            n = rng.randint(1, 50)
            fits = [k for k, f in free.items() if f >= n and k not in closed]
            placed = bins.place(n)
            least = min((free[k] for k in fits), default=None)
            if least is None:
                assert placed == (made, 0)
                free[made], made = 50, made + 1
            else:
                assert free[placed[0]] == least and placed == (placed[0], 50 - least)
            free[placed[0]] -= n
            if not free[placed[0]]:
                closed.add(placed[0])
            live = [k for k in free if k not in closed]
            if len(live) > max_open:  # of equally full ones any may close: the one that the packer let go
                fullest = min(free[k] for k in live)
                kept = {k for some in bins.by_free for k in some}
                (gone,) = set(live) - kept
                assert free[gone] == fullest
                closed.add(gone)


def test_the_bound_binds_and_costs_little():
    rng = np.random.default_rng(6)
    sizes = np.clip(rng.lognormal(5.7, 1.0, packing.PER_PACKER), 1, 2048).astype(int)
    bins, most = packing.Bins(2048, packing.MAX_OPEN), 0
    for n in sizes.tolist():
        bins.place(n)
        most = max(most, bins.open)
    assert most == packing.MAX_OPEN and bins.made <= 1.01 * sizes.sum() / 2048


def test_a_very_long_text_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 100_000), (2, "ab"), (2, "ab")], "doc_id long, text string")
    found = packing.pack_documents(docs, WORD).collect()
    own = sorted((r.piece, r.start, r.length) for r in found if r.doc_id == 1)
    assert all(length == 2048 and start == 2048 * k for k, start, length in own[:-1]) and len(found) == len(own) + 2


def test_bins_close_the_fullest_first():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 9)] == [(0, 0), (1, 0), (2, 0)]  # the third makes three open: it closes
    assert bins.place(1) == (1, 7) and bins.place(4) == (0, 6)


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def test_plain_words_are_learned_as_they_stand(monkeypatch):
    encoder, whole = packing.ChunkEncoder(WORD), Tokenizer.from_file(WORD)
    met = []
    tokenizer, ids = encoder.tokenizer, encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text: met.append(text) or ids(text))
    encoder.tokenizer = type("Seen", (), {"encode_batch_fast": lambda self, texts, **k: met.extend(texts) or tokenizer.encode_batch_fast(texts, **k)})()
    text = "plain Words, WORDS and wörds don't İstanbul x\ny zzzqqq"
    expected = whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == expected
    # only what has other letters or signs is shown to the pattern
    shown = set(" ".join(met).split())
    assert not shown & {"plain", "words", "and", "x", "y", "zzzqqq"} and {"wörds", "don't", "İstanbul"} <= shown
