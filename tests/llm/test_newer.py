"""The prefix trie, hard negatives and quality votes against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.llm import hardnegatives, prefixes, queries, votes

CLASH = "conv slice at t1 t2 bytes depth last owner n cell id row q block anchor windows score good".split()


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in df.columns], F.lit(1).alias("a.b"))


# Conversations.


def plain_trie(rows, spliced=True):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in said.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if spliced else 0
        whole[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members, kids, leaves, saved, out = defaultdict(list), defaultdict(list), {}, {}, []
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    for path in sorted(members, key=len, reverse=True):
        some = members[path]
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(some) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[k] for k in kids[path])
        ends = ",".join(str(c) for c in sorted(some) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(some), len(path), parent, len(some), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


TURNS = "conv_id long, turn long, role string, text string"


def spliced_trie(spark, rows):
    given = clashing(spark.createDataFrame(rows, TURNS))
    conv = F.col("conv")
    found = prefixes.prefix_trie(given, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9)
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = [
        (c, rng.choice([None, 10]) if t == 0 else t, rng.choice(["u", "a", None]), rng.choice(["x", "é", "", None, "longer text"][: 2 + seed]))
        for c in rng.sample(range(-20, 120), 60)
        for t in range(rng.randrange(1, 14))
        if t != 10
    ]
    assert spliced_trie(spark, rows) == plain_trie(rows)


def test_trie_of_a_chain_of_prefixes_and_of_copies(spark):
    # Conversation c is the first c turns of one path, so the compressed tree is as deep as it can be.
    chain = [(c, t, "u", f"t{t}") for c in range(1, 40) for t in range(c)]
    copies = [(1000 + c, t, "a", "same") for c in range(300) for t in range(3)]
    rows = chain + copies + [(5000, t, "u", f"t{t}") for t in range(600)]
    found = sorted((tuple(r) for r in prefixes.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=lambda r: r[:2])
    assert found == plain_trie(rows, spliced=False)


def test_trie_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 8)
    long = "word " * 100_000
    rows = [(5, 1, "u", long), (6, 1, "u", long), (6, 1, "u", long), (7, None, None, None), (8, None, "", ""), (None, 1, "u", "x"), (15, 2**40, "u", "b"), (15, -3, "u", "a")]
    # Repeated turns of one number are told apart by nothing, so each counts.
    assert spliced_trie(spark, rows) == plain_trie(rows)
    assert spliced_trie(spark, []) == []


# Hard negatives.


def plain_negatives(rows):
    usable = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    order, out = lambda s, i: (-s, i is None, i or 0), []
    for anchor, label, vector in {(i, k, tuple(v)) for i, k, v in usable if i is not None and i % 100 == 0}:
        scored = [(sum(a * b for a, b in zip(vector, v, strict=False)), i, k) for i, k, v in usable]
        good = sorted([(s, i) for s, i, k in scored if k == label and i != anchor], key=lambda x: order(*x))[:5]
        for score, positive in good:
            bad = sorted([(s, i) for s, i, k in scored if k != label and 30 * score <= 100 * s <= 90 * score], key=lambda x: order(*x))[:10]
            out += [(anchor, positive, rank, i, score, s) for rank, (s, i) in enumerate(bad, 1)]
    return sorted(out, key=str)


def mined(spark, rows):
    given = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hardnegatives.hard_negatives(given, F.col("id") % 100 == 0, moved)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("digit", [2, 10])
def test_negatives_of_random_vectors(spark, monkeypatch, digit):
    monkeypatch.setattr(hardnegatives, "DIGIT", digit)
    monkeypatch.setattr(hardnegatives, "CELL", 40)
    monkeypatch.setattr(hardnegatives, "BLOCK", 2)
    rng = np.random.default_rng(digit)
    # Few directions, so scores tie often; every third vector is one and the same.
    some = rng.integers(-1, 3, size=(30, 5)) / 2
    rows = [(int(i), (some[0] if i % 3 == 0 else some[rng.integers(30)]).tolist(), int(rng.integers(4))) for i in range(620)]
    assert mined(spark, rows) == plain_negatives(rows) and len(mined(spark, rows)) > 100


def test_negatives_of_odd_rows(spark):
    v = [1.0, 0.5]
    rows = [
        (0, v, 1), (0, v, 1), (0, [1.0, 0.25], 1), (1, v, 1), (1, v, 1), (2, [0.9, 0.5, 7.0], 1), (3, [], 1), (100, [], 2), (200, v, None), (4, [None, 1.0], 1),
        (5, [float("nan"), 1.0], 2), (6, [float("-inf")], 2), (8, None, 2), (9, [0.5, 0.5], 2), (9, [0.5, 0.5], 2), (None, [0.5, 0.5], 2), (None, [0.5, 0.5], 1), (10, [-1.0, 0.0], 3), (300, [-1.0], 3), (11, [2.0e5, 3.0], 4), (400, [2.0e5, 1.0], 4), (12, [1.0e5, 1.0], 5),
    ]
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, rows[:0]) == [] and mined(spark, [(7, v, 1)]) == []
    with pytest.raises(Exception, match="fit a long|OVERFLOW"):
        mined(spark, [(0, [1e15], 1), (1, [1e15], 1)])


# Quality votes.


def test_terms_against_plain_python():
    texts = ["one two  one\nONE two, é!\n\nab\nab", "", " \n ", "x" * 50]
    counts = votes.term_counts([t.encode() for t in texts])
    families = np.split(counts, votes.STARTS[1:], axis=1)
    for text, runs, words, back, sizes, empty in zip(texts, families[0], families[1], families[2], families[3], families[6], strict=True):
        raw, said = text.encode() + b"\n\n", text.encode().lower().split()
        want = defaultdict(int)
        for i in range(len(raw) - 2):
            a, b, c = (int(votes.CLASS[x]) for x in raw[i : i + 3])
            want[(a * votes.N_CLASSES + b) * votes.N_CLASSES + c] += 1
        assert {int(i): int(runs[i]) for i in np.flatnonzero(runs)} == want
        assert words.sum() == back.sum() == sizes.sum() == len(said) and empty[0] == (not said)
        gaps = [next((d for d in range(1, i + 1) if said[i - d] == w), 0) for i, w in enumerate(said)]
        assert [int(n) for n in back[:4]] == [sum((g.bit_length() if g else 0) == k for g in gaps) for k in range(4)]
        assert all(sizes[min(len(w), votes.LENGTHS - 1)] >= 1 for w in said)
    repeated = families[5][0]
    assert repeated[1] == 1  # "ab" right after itself; the empty line between is no line


def plain_score(model, text, k, power):
    own = model.place(votes.term_counts([text]))[0]
    near = sorted(((round(float(np.dot(own, v)), 5), i) for i, v in enumerate(model.vectors)), reverse=True)
    last = near[min(k, len(near)) - 1][0]
    voting = [(s**power * model.stands[i], model.good[i]) for s, i in near if s >= last - 1e-9 and s > 0]
    return sum(w * g for w, g in voting) / sum(w for w, _ in voting)


def test_votes_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    counts, good, stands = votes.sample(docs, labels)
    model = votes.Model(counts, good, stands, votes.document_frequencies(docs))
    texts = [(r["text"] or "").encode() for r in docs.limit(60).collect()]
    want = [plain_score(model, t, votes.NEIGHBOURS, votes.POWER) for t in texts]
    assert np.abs(model.score(texts) - want).max() < 0.02


def test_document_frequencies_cover_all_rows(spark):
    texts = ["a b", "A!", None, "9 9"] * 50
    found = votes.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    want = (votes.term_counts([(t or "").encode() for t in texts]) > 0).sum(0)
    assert found[0] == len(texts) and (found[1:] == want).all()


def test_votes_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    marked = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = queries.op13_quality_votes(spark, sf).where("held_out").join(marked, "doc_id").collect()
    bad, good = ([r["predicted"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert len(bad) > 8 and 1 - sum(bad) / len(bad) > 0.85 and sum(good) / len(good) > 0.98


def test_votes_of_odd_rows(spark):
    clean, noisy = "plain words follow each other to make up a sentence here.", "$$$ ### $$$ ### $$$ ### &&& %%%"
    docs = [(i, f"{clean if i % 2 else noisy} {i}", "en", "s") for i in range(60)] + [(70, None, None, None), (70, "", "xx", "s"), (71, " \n", "", ""), (None, clean, "en", "s"), (72, clean, "en", "s"), (72, clean, "en", "s"), (73, clean * 20_000, "en", "s")]
    given = clashing(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, None), (70, 0, 0), (71, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = votes.fit_and_score(given, labels).collect()
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    assert len(found) == len(docs) and all(by[i][0]["predicted"] == i % 2 for i in range(60))
    assert by[None][0]["held_out"] is None and by[None][0]["score"] == by[72][0]["score"] == by[72][1]["score"] > 0.9
    assert by[73][0]["predicted"] == 1
    assert votes.fit_and_score(given.limit(0), labels).count() == 0
    assert {r["score"] for r in votes.fit_and_score(given, labels.limit(0)).collect()} == {0.0}
