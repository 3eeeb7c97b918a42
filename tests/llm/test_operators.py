"""The training-data operators against brute force, on small fixtures and the small sample tables."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from promptloom.llm import licenses, mixing, neighbours, packing, pii, quality, queries, simhash, toxicity, urls, warc
from promptloom.llm.common import stage
from promptloom.llm.components import connected_components
from promptloom.llm.tokens import PartTokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Null, empty, blank, odd letters, ties, and a text of many words; columns that clash with the operators' names.
ODD = [
    (1, None, "en", "b", 7),
    (2, "", None, None, 8),
    (3, " \t\n", "en", "a", 9),
    (4, "one two", "xx", "a", 1),
    (4, "one two", "xx", "a", 1),
    (5, "İstanbul naïve ΑΣ " * 3, "en", "", 2),
    (6, "lorem ipsum dolor " * 9000, "en", "b", 3),
    (None, "a row without an id", "en", "a", 4),
    (8, "plain words that nobody has written before in this place of all places", "en", "b", 5),
]
KIND = "doc_id long, text string, lang string, source string, size long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def groups(pairs, items):
    """Least member of each item's group."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# URL filters


def test_url_parts_and_rules():
    assert urls.parts("HTTP://A.Org/x?y=/z#f") == ("a.org", "/x", "?y=/z")
    assert urls.parts(None)[:2] == urls.parts("mailto:x")[:2] == ("", "")
    book = urls.Rules(urls.RULES)
    cases = {("a.org", "/"): "org/", ("example.org", "/es/1"): "example.org/es/", ("m.example.org", "/en/17"): "example.org/en/1", ("x.com", "/fr/"): "com/fr/", ("org", ""): None, ("aorg", "/"): None, ("x.net", "/"): None}
    for (host, path), rule in cases.items():
        assert (book.find(host, path) or (None,))[0] == rule


def test_url_query(spark):
    rows = queries.op1_urls(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    verdict = dict(urls.RULES)
    assert all(r["verdict"] == verdict[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block") for r in rows)
    given = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "http://" + "a" * 9000 + ".org/", "z")], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.filter_urls(given).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("", "", None) and got[3]["rule"] == "org/" and got[2]["verdict"] == "allow"
    assert urls.filter_urls(given.limit(0)).count() == 0


def test_url_trees_on_held_out_urls():
    rng = np.random.default_rng(1)
    make = lambda bad: f"http://{'x9' * 6 if bad else 'news'}{rng.integers(99)}.net/{rng.integers(9999)}?" + ("a=1&b=2&c=3" if bad else "")
    rows = [(make(b), not b) for b in (rng.random(1200) < 0.5).tolist()]
    judge = urls.Judge(rows[:900])
    right = (judge.allow([u for u, _ in rows[900:]]) >= 0.5) == np.array([a for _, a in rows[900:]])
    assert right.mean() > 0.97
    assert urls.Judge([]).allow(["x"]).tolist() == [1.0]


def test_url_sample_is_of_distinct_urls(spark):
    hot = [(i, "http://hot.org/page") for i in range(3000)]
    rest = [(5000 + i, f"http://site{i}.{'org' if i % 2 else 'de'}/{'x' if i % 2 else 'de'}/{i}") for i in range(400)] + [(9000 + i, f"http://s{i}.com/de/a{i}") for i in range(60)]
    pages = spark.createDataFrame(hot + rest, "page_id long, url string")
    judge = urls.train(pages, rows=100)
    assert judge.trees is not None and 60 <= sum(n for _, n in judge.rates[0].values()) <= 100
    found = urls.filter_urls(pages)
    book = urls.Rules(urls.RULES)
    for r in found.collect():
        host, path, _ = urls.parts(r["url"])
        hit = book.find(host, path)
        assert (r["host"], r["path"]) == (host, path) and r["rule"] == (hit[0] if hit else None) and r["verdict"] == (hit[1] if hit else "allow" if r["allow"] >= 0.5 else "block")


# Quality rules


def counted(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, documents, odd):
    for given in (documents, odd):
        rows = quality.judged(given, spark.createDataFrame([], "doc_id long, quality int")).collect()
        texts = Counter((r["doc_id"], *counted(r["text"])) for r in given.collect())
        assert texts == Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"])


def test_binomial_tail_is_exact():
    from fractions import Fraction
    from math import comb

    for n, k, p in ((10, 2, 0.1), (200, 0, 0.02), (50, 50, 0.5), (300, 7, 0.05)):
        want = sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(float(want), rel=1e-9)


def test_cutoffs_need_evidence_and_limit_false_rejection():
    few, many = (np.zeros((len(quality.GRID) + 1, 2), dtype=int) for _ in range(2))
    few[-1, 0], few[40, 1] = 50, 20
    many[-1, 0], many[40, 1], many[100, 1], many[100, 0] = 3000, 500, 500, 900
    assert quality.choose(few, 0.01, 0.003) == float("inf")
    cutoff = quality.choose(many, 0.01, 0.003)
    assert cutoff == quality.GRID[40]


def test_learned_cutoffs_reject_symbols_and_keep_clean_texts(spark):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "en") for i in range(900)]
    junk = [(1000 + i, " ".join(f"w{i}y{j}###" for j in range(20)), "en") for i in range(300)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in clean + junk], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.drop_rejected(docs, marks).collect()}
    assert kept == {i for i, _, _ in clean}


def test_verdicts_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # A null stratum and the empty one, apart from each other.
    docs = docs.withColumn("lang", F.when(F.col("lang") == "de", None).when(F.col("lang") == "fr", "").otherwise(F.col("lang")))
    rows = {r["doc_id"]: r for r in quality.judged(docs, marks).collect()}
    good = {r["doc_id"]: r["quality"] for r in marks.collect()}
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(quality.FIT)) == 0).alias("f")).collect()}
    values = {i: (r["n_symbols"] / max(r["n_words"], 1), r["n_dup_lines"] / max(r["n_lines"], 1), r["n_repeat_words"] / max(r["n_words"], 1), r["n_capitals"] / max(r["word_chars"], 1)) for i, r in rows.items()}
    use = [i for i, r in rows.items() if not r["base_failed"] and i in good]
    level = lambda x: sum(g > x for g in quality.STEPS)
    score = {}
    for i in rows:
        best = []
        for k in range(4):
            at = level(values[i][k])
            seen = [[j for j in use if fold[j] and good[j] == y] for y in (1, 0)]
            over = [sum(level(values[j][k]) <= at for j in s) for s in seen]
            best.append(np.log((over[1] + 0.01) / (len(seen[1]) + 2)) - np.log((over[0] + 1) / (len(seen[0]) + 2)))
        score[i] = max(best)
        assert rows[i]["score"] == pytest.approx(score[i])
    strata = {r["stratum"] for r in rows.values()}
    assert {None, "", "en"} <= strata
    for s in strata:
        # Copies of one text are one trial.
        own = list({rows[j]["text_hash"]: j for j in use if not fold[j] and rows[j]["stratum"] == s}.values())
        best, cutoff = 0, np.inf
        for g in quality.GRID:
            hit = [good[j] for j in own if score[j] >= g]
            n = sum(good[j] for j in own)
            if quality.binomial_tail(sum(hit), n, quality.ALPHA) > quality.DELTA / len(strata):
                break
            if (gain := len(hit) - sum(hit) - quality.HARM * sum(hit)) > best:
                best, cutoff = gain, g
        for i, r in rows.items():
            if r["stratum"] == s:
                assert r["kept"] == (not r["base_failed"] and score[i] < cutoff)
    learned = [i for i, r in rows.items() if not r["base_failed"] and not r["kept"]]
    assert learned and sum(good.get(i, 0) for i in learned) <= quality.ALPHA * sum(good[i] for i in use)


# Packing


def test_part_tokenizer_equals_the_tokenizer(documents):
    import pyarrow as pa

    coder = PartTokenizer(queries.public_tokenizer(), parts=300)
    texts = [r["text"] for r in documents.limit(60).collect()] + [t for _, t, *_ in ODD if t] + ["it's 'tis _a__b \\'\\'s 10½² \"'s they'll'd", "a <|endoftext|> b", "a\x1cb", ""]
    for text, got in zip(texts, coder.ids(pa.array(texts)), strict=True):
        assert got == coder.exact(text), text[:80]


def test_packing_round_trip(spark, documents, odd, none):
    coder = PartTokenizer(queries.public_tokenizer())
    for given, capacity in ((documents, 2048), (odd, 64)):
        rows = packing.pack_documents(given.where("doc_id is not null"), queries.public_tokenizer(), capacity).collect()
        texts = {r["doc_id"]: coder.exact(r["text"] or "") + b"\0\0\0\0" for r in given.collect()}
        for r in rows:
            part = texts[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"] and r["start"] == r["piece"] * capacity
        times = Counter(r["doc_id"] for r in given.where("doc_id is not null").collect())
        for doc, n in times.items():
            assert sum(r["length"] for r in rows if r["doc_id"] == doc) * 4 == n * len(texts[doc])
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in bins.values():
            ends = np.cumsum([n for _, n in sorted(own)])
            assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= capacity
        least = -(-sum(r["length"] for r in rows) // capacity)
        assert len(bins) <= least * 1.02 + 1
    assert packing.pack_documents(none, queries.public_tokenizer()).count() == 0


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 400).tolist()
    a = packing.best_fit(list(range(400)), lengths, 128)
    b = packing.best_fit(list(range(399, -1, -1)), lengths, 128)
    child = packing.crossover(a, b, lengths, 128, rng)
    assert sorted(i for x in child.bins for i in x) == list(range(400))
    assert child.fills == [sum(lengths[i] for i in x) for x in child.bins] and max(child.fills) <= 128
    best, done, start = packing.evolve(lengths, [a, b], 128, rng)
    assert len(best.bins) <= start <= min(len(a.bins), len(b.bins)) and sorted(i for x in best.bins for i in x) == list(range(400))
    assert packing.evolve([], [], 128, rng)[0].bins == [] and done <= packing.CHILDREN


def test_islands_beat_best_fit_decreasing(spark):
    # About three pieces a sequence: the falling order wastes much.
    lengths = np.random.default_rng(0).integers(350, 1000, 600).tolist()
    falling = packing.best_fit(sorted(range(600), key=lambda i: -lengths[i]), lengths, 2048)
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    told = packing.history(pieces).collect()
    assert {(r["island"], r["epoch"]) for r in told} == {(0, 1), (1, 1), (0, 2), (1, 2)}
    assert all(r["bound"] <= r["bins"] <= r["start_bins"] for r in told) and all(r["crossovers"] >= 10 and r["bins"] < r["start_bins"] for r in told if r["epoch"] == 1)
    rows = packing.pack(pieces).collect()
    assert len({r["sequence_id"] for r in rows}) < len(falling.bins) - 3
    assert all(v <= 2048 for v in Counter({s: sum(r["length"] for r in rows if r["sequence_id"] == s) for s in {r["sequence_id"] for r in rows}}).values())


def test_windows_of_an_order(spark, odd, none):
    coder = queries.public_tokenizer()
    docs = odd.unionByName(odd.where("doc_id = 6")).withColumn("part", F.lit("clash")).coalesce(1)
    order = {"part": F.pmod(F.xxhash64("text", "size"), F.lit(3)), "row": F.monotonically_increasing_id()}
    rows = packing.pack_in_order(docs, coder, **order, capacity=64, shard=4).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert len({(r["position"], r["piece"]) for r in rows}) == len(rows) and all(r["window"] == r["position"] // 4 for r in rows)
    assert all(len({r["window"] for r in rows if r["sequence_id"] == s}) == 1 for s in {r["sequence_id"] for r in rows})
    assert packing.pack_in_order(none, coder, F.lit(0), F.monotonically_increasing_id()).count() == 0


# Embeddings


def brute_links(rows, cosine=0.93):
    vectors = {}
    for i, v, label in rows:
        ok = v is not None and label is not None and i is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
        if ok and np.abs(v).sum() > 0:
            vectors[i] = (np.array(v, dtype=float), label)
    pairs = []
    for i, (x, a) in vectors.items():
        pairs += [(i, j) for j, (y, b) in vectors.items() if i < j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine]
    return pairs


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 120)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * rng.choice([0.1, 0.25, 0.6])).tolist(), i % 2) for i in range(600)]
    rows += [(700, rows[3][1], 1), (701, rows[3][1], 1), (702, [0.0] * 16, 1), (703, None, 1), (704, rows[3][1], None), (705, [float("nan")] * 16, 0)]
    rows += [(706, [None] * 16, 0), (707, [1.0, 2.0], 0), (708, [2.0, 4.0], 0), (709, [], 0), (710, [x * 3 for x in rows[5][1]], 1)]
    got = {r["id"]: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    pairs = brute_links(rows)
    links = Counter(i for p in pairs for i in p)
    assert len(pairs) > 1000 and {i: r["n_links"] for i, r in got.items()} == {r[0]: links[r[0]] for r in rows}
    assert {i: r["component_id"] for i, r in got.items()} == groups(pairs, [r[0] for r in rows])


def test_tiny_vectors_and_shared_ids(spark):
    a, b, c = [1e-200, 1e-200], [1.0, 0.0], [0.0, 2.0]
    rows = [(1, a, 1), (2, a, 1), (3, [1.0, 1.0], 1), (4, b, 1), (4, c, 1), (5, b, 1), (6, [0.0, 1.0], 1), (None, b, 1), (7, None, 1), (8, b, None)]
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r["id"] or 0, r["n_links"], r["component_id"] or 0) for r in got.collect()) == [
        (0, 2, 4), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (4, 2, 4), (5, 2, 4), (6, 1, 4), (7, 0, 7), (8, 0, 8)
    ]


def test_search_finds_all_links_on_its_graph():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24))
    x = neighbours._normed(np.concatenate([centres + rng.normal(size=centres.shape) * s for s in (0.05, 0.1, 0.2, 0.25, 0.3, 0.5) for _ in range(2)]))
    lists = neighbours.build(x)
    assert lists.shape == (len(x), 2 * neighbours.DEGREE) and all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(lists))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert set(zip(*(v.tolist() for v in neighbours.search(x, lists, 0.93)), strict=True)) == set(zip(a.tolist(), b.tolist(), strict=True))


def test_pairs_count_in_the_first_shard_of_both():
    shards = [np.array(s) for s in ([1, 4, 9], [4, 9], [2, 9], [7])]
    a, b = np.array([0, 0, 1, 0]), np.array([1, 2, 2, 3])
    assert neighbours.least_common(shards, a, b).tolist() == [4, 9, 9, -1]


@pytest.mark.parametrize("whole", [True, False])
def test_full_shards_are_cut_into_blocks(spark, whole):
    rng = np.random.default_rng(9)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.3).tolist(), 1) for i in range(150)]
    classes = stage(neighbours.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label"), "test")
    id_of = {r["key"]: r["id"] for r in classes.collect()}
    found = neighbours.linked(classes.withColumn("shards", F.array(F.lit(0).cast("long"))), 0.93, full=60, whole=whole).collect()
    pairs = brute_links(rows)
    assert groups([(id_of[r["key"]], id_of[r["to"]]) for r in found], range(150)) == groups(pairs, range(150))
    want, got = Counter(i for p in pairs for i in p), Counter()
    for r in found:
        got[id_of[r["key"]]] += r["links"]
    assert {i: n for i, n in got.items() if n} == dict(want)


@pytest.mark.parametrize("merge", [True, False])
def test_dense_groups_are_compared_whole(spark, monkeypatch, merge):
    # The bound default of ``shard``: about 80 pivots, far more than any overlap.
    monkeypatch.setattr(neighbours.pivots, "__defaults__", (5, 16_384))
    if not merge:
        # As where pivots of a group are out of each other's reach.
        monkeypatch.setattr(neighbours, "reached", lambda x, _: np.arange(len(x)), raising=False)
    rng = np.random.default_rng(8)
    rows = [(i, (np.ones(48) + rng.normal(size=48) * 0.2).tolist(), 1) for i in range(300)]
    rows += [(300 + i, rng.normal(size=48).tolist(), 1) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["id"]: r for r in neighbours.near_duplicates(frame).collect()}
    pairs = brute_links(rows)
    want = Counter(i for p in pairs for i in p)
    assert all(0.97 <= r["recall"] <= 1 for r in got.values())
    if not merge:
        # The whole label was compared in the end.
        assert {r["recall"] for r in got.values()} == {1.0}
    assert len(pairs) > 40_000 and {i: r["n_links"] for i, r in got.items()} == {r[0]: want[r[0]] for r in rows}
    assert {i: r["component_id"] for i, r in got.items()} == groups(pairs, [r[0] for r in rows])


def test_empty_embeddings(spark):
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# Mixing


def test_mixing_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    names = ["doc_id", "size", "source_size", "target", "taken", "first_due"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.OP5_SQL}) ORDER BY doc_id").fetchall()
    got = queries.op5_mixing(spark, SF).orderBy("doc_id").select(*names).collect()
    assert [tuple(r) for r in got] == want


def test_schedules_invert(spark):
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.5, 2.0), (1.0, 0.0))):
        whole = mixing.integral(schedule)
        at = spark.range(21).select((F.col("id") / 20).alias("p")).select("p", mixing.due(F.col("p"), schedule).alias("t")).collect()
        for r in at:
            area = 0.0
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
                end = min(max(r["t"], t0), t1)
                w = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                area += (end - t0) * (w0 + w) / 2
            assert area / whole == pytest.approx(r["p"], abs=1e-9)


def test_mixing_of_odd_rows(odd, none):
    rows = mixing.curriculum(odd, slice_rows=2).collect()
    assert len(rows) == len(ODD) and mixing.curriculum(none).count() == 0
    sizes = {"a": 0, "b": 0, "": 0, None: 0}
    for _, t, _, s, _ in ODD:
        sizes[s] += len(WORD.findall(t or ""))
    for r in rows:
        m = r["mix"]
        assert m["size"] == len(WORD.findall(r["text"] or "")) and m["source_size"] == sizes[r["source"]] and m["target"] <= 2 * m["source_size"] + 1e-9
        assert len(m["due"]) <= 2 and all(0 <= d <= 1 for d in m["due"])
    ordered = mixing.training_order(odd, 3)
    assert ordered.columns == odd.columns and ordered.count() == sum(len(r["mix"]["due"]) for r in rows)


def test_mixing_of_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a b c " * (i % 5), "s", i, i, i, i) for i in range(40)] + [(None, None, None, 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix int, due int, row int, `a.b` int")
    runs = [[tuple(r) for r in mixing.training_order(docs.repartition(n), 2).collect()] for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and set(runs[0]) <= set(rows)
    assert mixing.training_order(docs).columns == docs.columns
    placed = mixing.curriculum(docs)
    assert sorted(placed.columns) == sorted(docs.columns) and placed.select("mix.size", "due").count() == len(rows)


# WARC


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * 50) for i in range(60)] + [(90, None, None), (91, "a\r\nb", ""), (92, "u", "é" * 300_000), (None, "n", "<p>0</p>" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(pages, file_bytes=2000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = {r["page_id"]: r for r in warc.read_archives(spark, manifest, range_bytes=97, payloads=True).collect()}
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        body = (h or "").encode()
        r = got[i]
        again = i is not None and first[h or ""] != i
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (first[h or ""] if again else None)
        assert r["payload"] is None if again else r["payload"] == body
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_scan_owns_each_record_once(tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(2)
    members = [warc.record(i, "u", bytes(rng.integers(0, 256, 400, dtype=np.uint8)) + warc.MAGIC * 3, "A", 409, None) for i in range(40)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(members))
    with fs.LocalFileSystem().open_input_file(str(path)) as source:
        for width in (1, 13, 500, 10**6):
            if width == 1:
                starts = range(0, 1500)
                want = sum(int(s < 1500) for s in np.cumsum([0, *map(len, members)])[:-1])
                assert sum(len(list(warc.Scan(source, s, s + 1))) for s in starts) == want
            else:
                found = [w for s in range(0, source.size(), width) for w in warc.Scan(source, s, s + width)]
                assert len(found) == 40


@pytest.mark.parametrize("harm", ["cut", "flip", "junk", "head"])
def test_damaged_archives_are_not_read_in_part(spark, tmp_path, harm):
    manifest = warc.write_archives(spark.range(30).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id * 7919 AS string), 50) AS html").coalesce(1))
    path, size, records = manifest.first()
    assert records == 30 and warc.read_archives(spark, manifest, range_bytes=500).count() == 30
    whole = bytearray(open(path.removeprefix("file://"), "rb").read())
    at = whole.rindex(warc.MAGIC)
    harmed = {"cut": whole[:-9], "flip": whole[: at + 60] + b"\xff" + whole[at + 61 :], "junk": whole[:at] + b"junk" + whole[at:], "head": b"x" + whole}[harm]
    (tmp_path / "harmed.warc.gz").write_bytes(bytes(harmed))
    told = spark.createDataFrame([(f"file://{tmp_path}/harmed.warc.gz", len(harmed))], "path string, size long")
    with pytest.raises(Exception, match="record"):
        warc.read_archives(spark, told, range_bytes=500).collect()


# Personal data


def personal(text):
    found = {}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                found.setdefault(kind, []).append(m.span())
    return found


TRICKY = [
    "a@b.c_x@d.e.f 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 4111 1111-1111 1111 4111111111111112",
    "é +1 (555) 123-4567. ++49 30 123456 x+y@z.museum @no a.b@c 1.2.3.4567890123456789012",
    "7" * 30_000 + " " + "x" * 60_000 + " end@mail.org",
]


def test_personal_data_against_brute_force(spark, documents, odd, none):
    tricky = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for given in (documents, odd, tricky):
        texts = Counter((r["doc_id"], str(personal(r["text"]))) for r in given.select("doc_id", "text").collect())
        rows = pii.spans(given).collect()
        got = Counter((r["doc_id"], str({k: [tuple(s) for s in r[k]] for k in pii.KINDS if r[k]})) for r in rows)
        assert got == texts
    assert pii.spans(none).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"text {i}. Reach me under +1 (555) 010-{1000 + i} today.") for i in range(30)]
    rows += [(100 + i, f"text {i}. Reach me under 555-01-{100 + i} today.") for i in range(4)]
    rows += [(200 + i, f"It took {i + 1000} steps in all.") for i in range(30)]
    seeds = [(300 + i, f"Reach me under 10.0.{i}.7 today") for i in range(30)]
    seen = [(400 + i, f"Reach me under 10.0.{i}.999 today") for i in range(3)]
    docs = spark.createDataFrame(rows + seeds + seen, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    assert all(len(got[i]["other"]) == 1 for i, _ in seen) and not any(got[i]["other"] for i, _ in rows[34:])
    text = dict(seen)[400]
    assert text[slice(*got[400]["other"][0])] == "10.0.0.999"


def test_contexts_discover_other_formats(spark):
    rows = [(i, f"text {i}. Reach me under +1 (555) 010-{1000 + i} today.") for i in range(30)]
    rows += [(50 + i, f"Write to {'abcdefghijklmnopqrstuvwxyz'[i]}.who@mail.org or call.") for i in range(26)]
    new = {100 + i: ("Reach me under {} today.", f"555-01-{100 + i}") for i in range(4)}
    new |= {110: ("Reach me under {} today.", "AB77345"), 111: ("Write to {} or call.", "@who77"), 112: ("Reach me under {} soon", "555.01.100")}
    rows += [(i, t.format(m)) for i, (t, m) in new.items()]
    plain = [(200 + i, f"It took {i + 1000} steps in all, under {i + 3000} today and to {i + 5000} more.") for i in range(30)]
    got = {r["doc_id"]: r for r in pii.spans(spark.createDataFrame(rows + plain, "doc_id long, text string")).collect()}
    found = {i: [t.format(m)[slice(*s)] for s in got[i]["other"]] for i, (t, m) in new.items()}
    assert found == {i: [m] for i, (_, m) in new.items()}
    assert not any(got[i]["other"] for i, _ in rows if i < 100) and not any(got[i]["other"] for i, _ in plain)


def test_keys_are_discovered_where_their_context_is_trusted(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'see token = "{key(i)}" and x{i}') for i in range(20)] + [(50, 'the token = "ab12cd" here'), (51, f"alone {key(3)}"), (52, f"alone {key(99)} too")]
    got = {r["doc_id"]: [t[slice(*s)] for s in r["other"]] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() for t in [dict(rows)[r["doc_id"]]]}
    assert all(got[i] == [key(i)] for i in range(20)) and got[50] == ["ab12cd"] and got[51] == [key(3)] and got[52] == []
    # About half of the keys are no seeds, and are found by the patterns of the others.
    found = pii.discovered(pii.occurrences(pii.extracted(spark.createDataFrame(rows, "doc_id long, text string")))).collect()
    assert {r["core"] for r in found} == {key(i) for i in range(20)} | {"ab12cd"} and 5 < sum(not r["seed"] for r in found) < 17


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_planted_keys_are_found_without_being_seeds(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    found = {r["core"]: r["seed"] for r in pii.discovered(pii.occurrences(pii.extracted(docs))).collect()}
    planted = {k.lower() for r in docs.select("text").collect() for k in re.findall(r'(?i)token = "([0-9a-f]{40})', r["text"] or "")}
    assert planted and set(found) == planted and sum(not s for s in found.values()) > len(planted) / 3


def test_graph_scores_equal_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    words = "call mail near from until today soon".split()
    rows = [(i, " ".join([*rng.choice(words, 2), str(rng.choice(["+49 30 1234567", f"10.0.0.{i % 9}", "x77", "a-1234", f"n{i % 7}00", f"k3y{i % 8}bcdefgh1234567890"])), *rng.choice(words, 2)])) for i in range(400)]
    occurred = pii.occurrences(pii.extracted(spark.createDataFrame(rows, "doc_id long, text string"))).cache()
    edges = {(p["context"], p["pattern"], r["core"]) for r in occurred.collect() for p in r["patterns"]}
    seeds = {r["core"] for r in occurred.collect() if r["seed"]}
    unsaid = {r["core"] for r in occurred.collect() if r["open"]}
    assert seeds & unsaid == set() and unsaid
    trust = {c: float(c in seeds) for _, _, c in edges}
    for _ in range(pii.ROUNDS):
        of = {}
        for _, p, c in edges:
            of.setdefault(p, set()).add(c)
        score = {p: sum(trust[c] for c in v - unsaid) / (len(v - unsaid) + 1) for p, v in of.items()}
        best = {}
        for x, p, c in edges:
            best.setdefault(c, {})[x] = max(best.get(c, {}).get(x, 0), score[p])
        trust = {c: 1.0 if c in seeds else sum(v.values()) / len(v) for c, v in best.items()}
    for bound in (0.1, 0.3, 0.5):
        want = {p for p, v in of.items() if score[p] >= bound and len(v) >= 2 and len(v & seeds) >= 1}
        assert {r["pattern"] for r in pii.trusted_patterns(occurred, confidence=bound, instances=2, seeds=1).collect()} == want and want


def test_long_texts_take_time_in_proportion(spark):
    text = " ".join(f"at 10.{i % 250}.3.{i % 99} x{i}" for i in range(8_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = pii.spans(docs).collect()[0]
    assert [tuple(s) for s in found["ip"]] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", text)]
    assert pii.redact(docs).collect()[0]["text"] == re.sub(r"[0-9]+(\.[0-9]+){3}", "<IP>", text)
    assert time.time() - began < 120


def test_masks_over_block_edges(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(40):
        text = "".join(rng.choice(list("abcé\n"), 60).tolist())
        spans = sorted((int(a), int(a + n)) for a, n in zip(rng.integers(0, 50, 6), rng.integers(1, 10, 6), strict=True))
        at, want = 0, ""
        for a, b in spans:
            want += text[at:a] + "<OTHER>" if a >= at else ""
            at = max(at, b)
        rows.append((text, spans, want + text[at:]))
    rows += [("", [], ""), ("x", [(0, 1)], "<OTHER>")]
    frame = spark.createDataFrame(rows, "text string, other array<struct<start:int,end:int>>, want string")
    for block in (1, 7, 60, 4096):
        assert frame.where(pii.masked(F.col("text"), {"other": F.col("other")}, block) != F.col("want")).count() == 0


def test_redaction(spark, odd):
    docs = spark.createDataFrame([(1, "mail a@b.org or 10.0.0.1 é", 5), (2, None, 6), (3, "clean", 7), (3, "x@y.org", 8), (None, "c@d.org", 9)], "doc_id long, text string, start int")
    got = sorted((r["start"], r["text"]) for r in pii.redact(docs).collect())
    assert got == [(5, "mail <EMAIL> or <IP> é"), (6, None), (7, "clean"), (8, "<EMAIL>"), (9, "<EMAIL>")]
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ODD)


# Licenses


def test_license_query_against_brute_force(spark, documents, odd, none):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for given in (documents, odd):
        want = Counter()
        for r in given.collect():
            words = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
            places = [i for p, _ in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            want[(r["doc_id"], len(words), len(places), min(places, default=None), max(places, default=None))] += 1
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"]) for r in licenses.scan(given).collect()) == want
    assert licenses.scan(none).count() == 0


def test_diagonals_find_edited_notices(spark):
    mit = dict(licenses.NOTICES[::-1])
    bsd = next(t for label, t in licenses.NOTICES if label == "bsd")
    words = bsd.split()
    edited = " ".join(words[:6] + ["INSERTED"] + words[6:14] + words[15:])
    docs = [(1, f"intro words {bsd} tail"), (2, f"x {edited} y"), (3, "redistribution of wealth and use in trade"), (4, f"{bsd} and again {bsd}"), (5, "Licensed under CC BY-NC 4.0")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [{f["label"] for f in got[i]["found"]} for i in (1, 2, 3)] == [{"bsd"}, {"bsd"}, set()]
    assert got[1]["score"] == 1.0 and 0.7 < got[2]["score"] < 1 and len(got[4]["found"]) == 2 and got[1]["found"][0]["start"] == 2
    assert {f["label"] for f in got[5]["found"]} == {"cc-by-nc"} and got[5]["base"] == ["cc-by"] and mit
    parts = {label: [t for n, t in licenses.NOTICES if n == label][-1] for label in ("mit", "apache", "gpl", "lgpl", "bsd", "isc")}
    tails = spark.createDataFrame([(i, f"some words before {t} and after") for i, t in enumerate(parts.values())], "doc_id long, text string")
    assert {r["doc_id"]: {f["label"] for f in r["found"]} for r in licenses.scan(tails).collect()} == {i: {n} for i, n in enumerate(parts)}
    assert licenses.phrase_places(b" mit license cc by cc by mit license ") == [(2, "cc-by"), (4, "cc-by"), (0, "mit"), (6, "mit")]
    assert licenses.common_words(list("abcd"), list("xaxbd")) == 3


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.train_and_score(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in scored)
    hit = sum(r["predicted"] for r in scored if r["toxic"])
    wrong = sum(r["predicted"] for r in scored if not r["toxic"])
    assert hit >= 0.85 * sum(r["toxic"] for r in scored) and wrong <= 0.04 * len(scored)


def test_toxicity_tolerates_gaps_and_odd_rows(spark, odd, none):
    rows = [(1, f"you are such an {w} today number {i}") for i, w in enumerate(["idiot"] * 40 + ["moron"] * 40 + ["scum"] * 40 + ["trash"] * 40)]
    rows += [(0, f"you are such an {w} today number {i} in town on a fine day") for i, w in enumerate(["artist", "engineer", "friend", "editor"] * 40)]
    model = toxicity.train(rows)
    import pyarrow as pa

    said = ["what an i.d.i.o.t", "i d i o t", "id*iot", "you iddiot", "a fine day in town", "", "x" * 100 + "idiot" + "y" * 100]
    got = model.score(toxicity.score_block(pa.array(said, pa.large_string()), model)) >= toxicity.THRESHOLD
    assert got.tolist()[:6] == [True, True, True, True, False, False]
    assert toxicity.toxicity(odd, model).count() == len(ODD) and toxicity.toxicity(none, model).count() == 0
    assert toxicity.train([(1, "x")]).score(np.zeros(1))[0] < 0.01 and toxicity.train([(1, None), (0, "")]) is not None


def test_witnesses_are_found_outside_the_landmarks():
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("ta", "mo", "re", "li", "su", "ke") for b in ("lon", "mir", "dap", "ves", "tok", "nan", "pel")]
    say = lambda n: " ".join(rng.choice(plain, n).tolist())
    rows = [(1, f"{say(6)}. {say(3)} {w} {say(3)}. {say(5)}") for w in ["grobnik"] * 60 + ["grobn1k", "gro-bnik", "groobnik", "grobnikk", "g.robnik", "grobnyk"] * 2]
    rows += [(0, f"{say(6)}. {say(6)}. {say(5)}") for _ in range(200)]
    model = toxicity.train([rows[i] for i in rng.permutation(len(rows))])
    import pyarrow as pa

    said = pa.array([f"{say(5)} {w} {say(4)}" for w in ("grobnik", "gro.bnik", "grobbnik", "grob_nik")] + [say(9) for _ in range(40)], pa.large_string())
    got = model.score(toxicity.score_block(said, model)) >= toxicity.THRESHOLD
    assert got[:4].all() and not got[4:].any()


def test_sample_is_bounded_by_rows_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}", i) for i in range(50)] + [(2, "b", 0), (3, None, 0), (5, "x", 0)], "doc_id long, text string, toxic int")
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, None), (5, 0)], "doc_id long, toxic int")
    use = [i for i in (1, 2, 3, 5) if zlib.crc32(b"%d" % i) % 4 != 2]
    rows, balance = toxicity.sample(docs, marks, rows=1)
    clean = len([i for i in use if i != 1])
    assert len(rows) == 1 + (1 in use) and balance == (float(clean), 1.0)


def test_kernel_table_equals_the_kernel():
    words = ["idiot", "moron", "banana", "a", "trashy"]
    kernel = toxicity.Kernel(words)
    features = kernel.features(words)
    assert np.allclose(np.diag(features @ features.T)[:2], 1, atol=0.35)
    table = np.zeros(toxicity.ALPHABET**3, dtype=np.float32)
    table[kernel.known] = features[0]
    assert np.allclose(toxicity.score_words(words, table), features @ features[0], atol=1e-5)


# SimHash


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd, documents):
    for _, text, *_ in ODD:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    for r in documents.limit(40).collect():
        assert simhash.fingerprint(r["text"]) == slow_fingerprint(r["text"])


@pytest.mark.parametrize("cell", [0, 2, 64])
def test_links_have_the_components_of_all_pairs(spark, cell):
    rng = np.random.default_rng(8)
    values = set()
    for base in rng.integers(0, 2**63, 12).tolist():
        values |= {base}
        for _ in range(12):
            x = base if rng.random() < 0.4 else int(rng.choice(sorted(values)))
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << b
            values.add(x)
    values |= {0, 1, 2**63, 2**64 - 1}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), cell=cell)
    for r in links.collect():
        assert ((r["src"] ^ r["dst"]) & (2**64 - 1)).bit_count() <= 2
    assert groups([(r["src"], r["dst"]) for r in links.collect()], signed) == groups(pairs, signed)


def test_simhash_components(spark, documents, odd, none):
    docs = documents.select("doc_id", "text")
    docs = docs.unionByName(docs.limit(30).select((F.col("doc_id") + 10_000).alias("doc_id"), F.upper("text").alias("text")).where("text rlike '^[ -~\n]*$'"))
    texts = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in docs.collect()}
    pairs = [(a, b) for a in texts for b in texts if a < b and (texts[a] ^ texts[b]).bit_count() <= 2]
    got = {r["id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert got == groups(pairs, list(texts)) and any(i != c for i, c in got.items())
    assert simhash.simhash_components(odd).count() == len(ODD) and simhash.simhash_components(none).count() == 0
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 8]


def test_near_copies_of_one_id_stand_for_their_own_texts(spark):
    a, b, c = (f"{w} words that say something else about {w} and nothing more of it" for w in ("seven", "lorem", "other"))
    rows = [(5, a, 1), (5, b, 2), (5, b, 2), (7, a, 3), (9, b, 4), (3, c, 5), (8, c, 6), (8, "a text that no other row has at all, or so it seems", 7)]
    prints = [simhash.fingerprint(t) for t in (a, b, c, rows[-1][1])]
    assert all((x ^ y).bit_count() > 2 for x in prints for y in prints if x != y)
    want = sorted({(5, a, 1), (5, b, 2), (3, c, 5), rows[-1]})
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "doc_id long, text string, n long").repartition(parts)
        assert sorted(tuple(r) for r in simhash.drop_near_copies(docs).collect()) == want
    # The same id in a near copy of a kept document: only the clean text stays.
    docs = spark.createDataFrame([(3, c, 1), (8, c, 2), (8, a, 3)], "doc_id long, text string, n long")
    assert sorted(r["n"] for r in simhash.drop_near_copies(docs).collect()) == [1, 3]
