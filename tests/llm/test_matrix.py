"""Every operator and every pipeline stage on one odd table: nulls, blanks, long texts, ties, repeats, clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from promptloom.llm import licenses, mixing, neighbours, packing, pii, quality, queries, simhash, toxicity, urls, votes, warc
from promptloom.llm.common import stage

# Names that the operators give or use themselves.
CLASH = (
    "mix due row tie kept score cutoff stratum of own found id fp first order component_id n_links text_hash shard window position piece start length "
    "sequence_id offset rid spans base labels held_out predicted size worked email other instances host path rule verdict sha1 again body key space vector "
    "print0 links __key __own __found __row __due"
).split()
LONG = "some plain words in a row with 10.0.0.1 and x7y7z7 " * 6000
ROWS = [
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \t\n", "", "a"),
    (4, "one two three four five six seven eight nine ten eleven", "xx", "b"),
    (4, "one two three four five six seven eight nine ten eleven", "xx", "b"),
    (4, "another text that shares its id with a row of quite different words in it", "xx", "b"),
    (5, "mail ann@example.org or call +1 (555) 123-4567 about the thing that you wanted to see", "en", ""),
    (6, LONG, "en", "b"),
    (None, "a row without an id but with more than ten words that nobody else has said", None, "a"),
]


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return stage(docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)], F.lit(7).alias("a.b")), "matrix")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, None), (5, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda d, m: quality.judged(d, m),
    "packing": lambda d, m: packing.pack_documents(d, queries.public_tokenizer()).where("piece = 0"),
    "order": lambda d, m: packing.pack_in_order(d, queries.public_tokenizer(), F.lit(0), F.monotonically_increasing_id()).where("piece = 0"),
    "mixing": lambda d, m: mixing.curriculum(d),
    "pii": lambda d, m: pii.spans(d),
    "redact": lambda d, m: pii.redact(d),
    "licenses": lambda d, m: licenses.scan(d),
    "toxicity": lambda d, m: toxicity.train_and_score(d, m),
    "simhash": lambda d, m: simhash.simhash_components(d),
    "votes": lambda d, m: votes.fit_and_score(d, m),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(table, marks, name):
    found = OPERATORS[name](table, marks)
    assert len(found.collect()) == len(ROWS) and OPERATORS[name](table.limit(0), marks).count() == 0
    if name == "redact":
        assert found.columns == table.columns


NOTICE = "this program is free software you can moved it and or edited it under the terms of the gnu general plain license as published by the free software group either version 3 of the license or at your option any newer version"
COPIED = [
    NOTICE,
    "Released unter the MIT Licence and more words than the base rules want for a text",
    "mail ann@example.org or call +1 (555) 123-4567 about the thing that you wanted",
    "$$$ some ### words *** that &&& hold %%% many ||| marks <<< and >>> so ### on $$$",
    "Plain words that nobody else has said in just this order or in any other one here.",
]


@pytest.mark.parametrize("name", ["licenses", "pii", "quality", "redact", "simhash", "toxicity", "packing"])
def test_repeated_rows_get_what_a_single_one_gets(spark, name):
    work = {**OPERATORS, "quality": lambda d, m: quality.judged(d, m).drop("cutoff", "score")}[name]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    placed = {"sequence_id", "offset", "window", "position", "island"}
    found = []
    for copies in (1, 5):
        docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(COPIED) for _ in range(copies)], "doc_id long, text string, lang string, source string")
        rows = work(docs, labels).drop(*placed).collect()
        assert len(rows) == copies * len(COPIED)
        found.append({str(r) for r in rows})
    assert found[0] == found[1]


def test_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.org/" + "x" * 50_000, "<p>" * 60_000), (4, "http://b.com/de/", "same"), (4, "http://b.com/de/", "same"), (5, "ftp://q", "same"), (None, "http://c.net", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    assert len(urls.filter_urls(pages).collect()) == len(rows) and urls.filter_urls(pages.limit(0)).count() == 0
    read = warc.read_archives(spark, warc.write_archives(pages)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in read) == [(0, "response"), (1, "response"), (2, "revisit"), (3, "response"), (4, "response"), (4, "response"), (5, "revisit")]
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    wide = rng.normal(size=3000).tolist()
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, -0.0], 1), (4, [1.0, 2.0], 1), (4, [2.0, 4.0], 1), (4, [5.0, -1.0], 1), (5, wide, 1), (6, wide, 1), (None, wide, 1), (7, [1.0, 2.0], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    vectors = vectors.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    found = neighbours.near_duplicates(vectors).collect()
    assert sorted((r["id"] or 0, r["n_links"]) for r in found) == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1), (4, 1), (5, 2), (6, 2), (7, 0)]
    assert neighbours.near_duplicates(vectors.limit(0)).count() == 0


def test_stages(spark, table, marks, tmp_path):
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    want = {"quality rules": 5, "simhash near-dedup": 4, "personal data": 4}
    for docs, empty in ((table, False), (table.limit(0), True)):
        state = stage(docs, "odd")
        for name, function in corpus_pipeline.STAGES:
            state = stage(function(spark, state, str(tmp_path)), "odd")
            if name != "packing":
                assert state.columns == table.columns
            assert state.count() == 0 if empty else state.count() == want.get(name, state.count()) > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
