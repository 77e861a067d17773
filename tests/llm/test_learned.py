import random

import numpy as np
import pytest
from placewise.llm import minhash, quality, toxicity
from pyspark.sql import functions as F


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_automaton_by_brute_force():
    rng = random.Random(1)
    terms = ["idiot", "moron", "scum", "trash", "stupid", "aab", "abcde"]
    automaton = toxicity.Automaton(terms)
    for _ in range(5000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(word))
            kind = rng.randint(0, 2)
            word[k : k + (kind > 0)] = [rng.choice("abdiot")] if kind < 2 else []
        word = "".join(word)
        best = min((edits(word, t), k) for k, t in enumerate(terms) if edits(word, t) == 0 or (len(t) >= 5 and edits(word, t) == 1)) if any(edits(word, t) == 0 or (len(t) >= 5 and edits(word, t) == 1) for t in terms) else (2, -1)
        assert automaton.match(word) == best


def test_automaton_with_stems_by_brute_force():
    rng = random.Random(8)
    terms = ["idiot", "abc*", "trash", "ab"]
    automaton = toxicity.Automaton(terms)
    for _ in range(5000):
        word = "".join(rng.choice("abcidotrsh") for _ in range(rng.randint(0, 3)))
        word = rng.choice([word, "abc" + word, "ab" + word, "idiot"[: rng.randint(3, 5)] + word[:2]])
        near = [(0, k) for k, t in enumerate(terms) if word == t or (t.endswith("*") and word.startswith(t[:-1]))]
        near += [(1, k) for k, t in enumerate(terms) if not t.endswith("*") and len(t) >= 5 and edits(word, t) == 1]
        assert automaton.match(word) == min(near, default=(2, -1))


def corpus(rng, n):
    plain = [f"w{k}ord" for k in range(300)]
    texts, y = [], []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        label = rng.random() < 0.3
        if label:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "stupid", "pathetic"])
        texts.append(" ".join(words))
        y.append(int(label))
    return texts, np.array(y, float)


@pytest.fixture(scope="module")
def toxic_model():
    texts, y = corpus(random.Random(2), 600)
    return toxicity.fit_texts(texts, y, np.ones(len(y)))


def test_toxicity_on_held_out_texts(toxic_model):
    texts, y = corpus(random.Random(3), 400)
    assert set(toxic_model.terms) >= {"idiot", "moron", "stupid", "pathetic"}
    assert ((toxic_model.score(texts) >= 0.3) == (y == 1)).mean() > 0.99


def test_misspelling_and_quotation(toxic_model):
    frame = "w1ord w2ord {} w3ord {} w4ord {}"
    score = lambda *w: float(toxic_model.score([frame.format(*w)])[0])
    assert score("idiot", "stupid", "moron") > 0.3 > score("w5ord", "w6ord", "w7ord")
    hits = toxic_model.hits_of("st0pid"), toxic_model.hits_of("Moron!!")
    at = toxic_model.terms.index
    assert hits == (((at("stupid"), toxicity.DISCOUNT),), ((at("moron"), 1.0),))
    assert score("idiiot", "stuupid", "moronn") > 0.3  # misspelt abuse is abuse
    assert score("idiot", "stupid", "moron") > score("idiiot", "stuupid", "moronn") > score("idiiot", "w6ord", "w7ord") > score("w5ord", "w6ord", "w7ord")
    assert score('"idiot"', '"stupid"', '"moron"') < score("idiot", "stupid", "moron")
    assert score("said idiot", "said stupid", "said moron") < score("idiot", "stupid", "moron")
    plain, quoted = toxic_model.features(["they said you are an idiot w1ord", 'they said "you are an idiot" w1ord'])
    assert plain.sum() > quoted.sum()


def test_innocent_words_next_to_a_term_count_nothing():
    texts, y = corpus(random.Random(6), 600)
    texts = [t + " idiom crown" * (k % 3) for k, t in enumerate(texts)]
    model = toxicity.fit_texts(texts, y, np.ones(len(y)))
    assert "idiom" in model.innocent and model.hits_of("idiom") == ()
    assert model.hits_of("idoot") == ((model.terms.index("idiot"), toxicity.DISCOUNT),)


def test_stems_are_found_and_take_any_ending_but_no_error():
    rng = random.Random(7)
    texts, y = corpus(rng, 600)
    endings = ["ing", "ed", "er", "ly", "ness", "s", "dom"]
    texts = [" ".join("fraul" + rng.choice(endings) if w in ("idiot", "moron", "stupid", "pathetic") else w for w in t.split()) for t in texts]
    model = toxicity.fit_texts(texts, y, np.ones(len(y)))
    (stem,) = model.terms
    assert "fraul*".startswith(stem[:-1]) and stem.endswith("*")
    assert model.hits_of("fraulxyz") == ((0, 1.0),) and model.hits_of("fxaulxyz") == ()
    assert ((model.score(texts) >= 0.3) == (y == 1)).mean() > 0.99


def test_repeated_rows_and_very_long_texts(spark, toxic_model):
    long = "w1ord " * 200_000
    docs = spark.createDataFrame([(1, "idiot moron"), (1, "idiot moron"), (2, long), (3, long + "idiot stupid moron pathetic " * 500)], "doc_id long, text string")
    found = [(r.doc_id, r.score) for r in toxicity.classify(docs, toxic_model).collect()]
    assert len(found) == 4 and len({s for i, s in found if i == 1}) == 1 and dict(found)[2] < 0.3 < dict(found)[3]


def test_toxicity_tables(spark, toxic_model):
    docs = spark.createDataFrame([(1, "idiot moron stupid idiot", 5), (2, "w1ord w2ord w3ord", 5), (3, "", 5), (4, None, 5), (None, "w1ord", 5)], "doc_id long, text string, score int")
    found = {r.doc_id: r for r in toxicity.classify(docs, toxic_model).collect()}
    assert found[1].predicted == 1 and found[3].score == found[4].score and found[4].predicted == 0 and len(found) == 5
    assert {r.doc_id for r in toxicity.keep_clean(docs, toxic_model).collect()} == {2, 3, 4, None}
    empty = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.classify(docs.limit(0), empty).count() == 0 and empty.score(["x"])[0] == 0.0


def test_no_score_sees_its_own_held_out_label(spark):
    texts, y = corpus(random.Random(5), 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    labels = [(i, int(v)) for i, v in enumerate(y)]
    flipped = [(i, 1 - v if held(i) else v) for i, v in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.terms == b.terms and np.array_equal(a.weights, b.weights)
    found = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out_column().alias("h")).collect()}
    assert all(found[i] == held(i) for i in range(120))


def test_marginals_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(1)
    unary, starts, stay = rng.normal(size=9) * 2, np.array([0, 3, 4]), 0.7
    good, same = quality.marginals(unary, stay, starts)
    for a, b in ((0, 3), (3, 4), (4, 9)):
        total, g, s = 0.0, np.zeros(b - a), np.zeros(b - a)
        for labels in product((0, 1), repeat=b - a):
            kept = np.array([0, *(x == y for x, y in zip(labels, labels[1:], strict=False))])
            w = np.exp(sum(u for u, x in zip(unary[a:b], labels, strict=True) if x) + stay * kept.sum())
            total += w
            g += w * np.array(labels)
            s += w * kept
        assert np.allclose(good[a:b], g / total) and np.allclose(same[a:b], s / total)


def junk(rng):
    lines = []
    for _ in range(rng.randint(2, 8)):
        words = [rng.choice(["the", "of", "house", "river", "walks", "over"]) for _ in range(rng.randint(6, 14))]
        lines.append(" ".join(words).capitalize() + ".")
    bad = rng.random() < 0.4
    if bad:
        for k in range(1, len(lines)):
            lines[k] = " | ".join(lines[k].split()) if rng.random() < 0.5 else lines[k].upper().replace(" ", "!! ")
    return "\n".join(lines), int(not bad)


def test_quality_on_held_out_texts(spark):
    rng = random.Random(4)
    train, test = ([junk(rng) for _ in range(n)] for n in (400, 300))
    model = quality.fit_texts([t for t, _ in train], np.array([y for _, y in train], float), np.ones(400))
    found = model.score([t for t, _ in test]) >= 0.3
    assert (found == np.array([y == 1 for _, y in test])).mean() > 0.98
    text = "The river walks over the house.\nA | b | c | d | e | f | g | h\nThe house of the river walks."
    p = model.label_lines(text)
    assert p.argmin() == 1 and p[1] < 0.5 and (model.label_lines("The river walks over the house.\nThe house of the river walks.") > 0.5).all()
    docs = spark.createDataFrame([(1, "", 0), (2, None, 0), (3, text, 0)], "doc_id long, text string, predicted int")
    found = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert found[1].score == found[2].score and 0 <= found[3].score <= 1
    assert quality.classify(docs.limit(0), quality.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def shingles(text):
    words = (text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_minhash_against_exact_likeness(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = [f"w{rng.randint(0, 900)}" for _ in range(rng.choice([1, 4, 30, 120, 600]))]
        rows.append((i * 7, " ".join(words)))
        if i % 4 == 0:
            words[len(words) // 2] = "changed"
            rows.append((i * 7 + 1, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, rows[0][1]), (1002, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, packed int").repartition(4)
    found = sorted(minhash.compare_with_edits(docs, per_block=5).collect(), key=lambda r: r.doc_id)
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert len(found) == len(rows)
    errors, by_text = [], {}
    import hashlib

    for k, (i, text) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        same = [r for r in found if r.doc_id == i and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert same and same[0].n_chars == len(text)
        r = same[0]
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 256
        a, b, c = shingles(text), shingles(edited), shingles(nxt)
        errors += [r.near_edited - len(a & b) / len(a | b), r.near_next - len(a & c) / len(a | c)]
        if text == nxt:
            assert r.near_next == 1.0
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.25
    one = minhash.compare_with_edits(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert minhash.compare_with_edits(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [1, 3, 16_384])
def test_minhash_blocks_of_crowded_ids(spark, monkeypatch, blocks):
    monkeypatch.setattr(minhash, "BLOCKS", blocks)
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 1000, 10**12, None, -5]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.next_text for r in minhash.with_next(docs, per_block=2).collect()}
    order = [None, *sorted(i for i in ids if i is not None)]
    assert found == {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_minhash_rows_without_an_id_are_dealt_out(spark):
    rows = [(None, f"none {k}") for k in range(300)] + [(7, f"seven {k}") for k in range(300)] + [(8, "eight")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [(r.text, r.next_text) for r in minhash.with_next(docs, per_block=10).collect()]
    assert sorted(t for t, _ in found) == sorted(n for _, n in found) == sorted(t for _, t in rows)
    follow = {t: n for t, n in found if t != "eight"}
    at, seen = min(follow), []
    while at in follow and at not in seen:
        seen.append(at)
        at = follow[at]
    assert at == "eight"
    keys = docs.selectExpr("coalesce(doc_id, -9223372036854775808) _id", "xxhash64(text) _hash")
    bounds = minhash._bounds(keys, 10)
    group, within, first, width = minhash._placed(bounds)
    sizes = keys.withColumn("_group", group).withColumn("_within", within).groupBy(F.col("_group") * width + F.col("_within")).count()
    assert len(bounds) > 30 and sizes.agg(F.max("count")).first()[0] < 60


def test_likeness_column(spark):
    a, b = F.array(F.lit(0x0102030405060708)), F.array(F.lit(0x0102030405060709))
    monkey = spark.range(1).select(minhash.likeness(a, a).alias("x"), minhash.likeness(a, b).alias("y")).first()
    assert monkey.x == 1.0 and monkey.y == pytest.approx((1 - 1 / 128 - 1 / 256) / (1 - 1 / 256))
