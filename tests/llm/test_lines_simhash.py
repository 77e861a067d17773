import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from placewise.llm import lines, simhash
from placewise.operators import components


def lines_by_hand(rows, min_chars, min_docs):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup_by_hand(spark, batches):
    rng = random.Random(5)
    pool = ["abcde", "ABCDE ", "\tabcde\r", "äöüxy", "äöüx", "", "long line %d", "Ünique", "x\x1cyzab", " abcd", " abcde"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for k in range(60)] + [(7, "abcde\nother line"), (None, "abcde"), (None, None), (99, "")]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_lines string").repartition(3)
    found = lines.digest(lines.dedup_lines(docs, min_chars=5, min_docs=3, batches=batches)).collect()
    assert sorted(map(tuple, found), key=repr) == lines_by_hand(rows, 5, 3)


def test_line_dedup_of_nothing(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def fingerprint_by_hand(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprints_by_hand():
    for text in ("", " \n", "One", "Ä b", "a b c", "A b c d e f a b c", "x " * 50, "ÀB c d e\tf"):
        assert simhash.fingerprint(text) == fingerprint_by_hand(text)


def test_golay_table_is_the_nearest_codeword():
    table = simhash.golay_table()

    def codeword(message):
        word = message << 11
        rest = word
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= simhash.GENERATOR << (bit - 11)
        return word | rest

    for word in range(0, 1 << 16, 97):
        assert bin(word ^ codeword(int(table[word]))).count("1") <= 3


def test_keys_meet_for_every_pair_within_three_bits():
    rng = random.Random(6)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        _, keys, wide = simhash.segment_keys(np.array([x], np.uint64))
        _, keys2, wide2 = simhash.segment_keys(np.array([y], np.uint64))
        assert set(keys[~wide]) & set(keys2[wide2])


def parts(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("block", [4, 2048])
def test_links_by_brute_force(spark, block):
    rng = random.Random(7)
    fps = {0, 1, 2**64 - 1}
    for _ in range(6):
        near = [rng.getrandbits(64)]
        for _ in range(60):
            y = rng.choice(near)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            near.append(y)
        fps |= set(near)
    fps = sorted(fps)
    rows = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    edges = simhash.links(spark.createDataFrame(rows, "fp long"), block)
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    expected = parts(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    signed = [r[0] for r in rows]
    groups = defaultdict(set)
    for k, p in enumerate(expected):
        groups[p].add(signed[k])
    for group in groups.values():
        assert {found.get(x, x) for x in group} == {min(group)}


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(100)] + [(5000, 5000)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert all(found[k] == 0 for k in range(201)) and all(found[1000 + k] == 1000 for k in range(100)) and found[5000] == 5000
    assert components.connected_components(edges.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(5, long, "b"), (3, long, "a"), (3, long, "c"), (9, long + " more", "a"), (11, "quite another text", "a"), (None, None, "z"), (12, "", "a"), (13, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = {(r.doc_id, r.fp) for r in simhash.keep_one(docs).collect()}
    assert (3, "a") in kept and (11, "a") in kept and (12, "a") in kept and (None, "z") in kept
    assert not {(5, "b"), (3, "c"), (13, "a")} & kept
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bridge", [None, 2])
def test_fingerprints_and_other_edges_are_one_graph(spark, monkeypatch, bridge):
    calls, whole = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda edges: calls.append(1) or whole(edges))
    # 5 - 6 by fingerprint, 6 - 9 by an edge, 9 = 12 by copies; 20 and 31 by a row that may have no id
    fps = {5: 0b0, 6: 0b111, 9: 0xFF << 40, 12: 0xFF << 40, 20: 0xFFFF << 20, bridge: 0xFFFF << 20 | 0b111, 31: 0xFFFF << 20 | 0b111111}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "fp"))
    docs = spark.createDataFrame([(k, v) for k, v in fps.items()], "doc_id long, fp long")
    also = spark.createDataFrame([(9, 6)], "a long, b long")
    kept = {r.doc_id for r in simhash.keep_one(docs, also).collect()}
    assert kept == ({5, 2} if bridge else {5, 20, None})
    assert len(calls) == (1 if bridge else 2)
