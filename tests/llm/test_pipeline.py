"""The corpus pipeline, stage by stage, on the small sample tables."""

import pytest

import corpus_pipeline
from promptloom.llm import mixing, pii, queries, quality, simhash
from promptloom.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, states = docs.columns, [docs]
    for i, (_, function) in enumerate(corpus_pipeline.STAGES):
        states.append(stage(function(spark, states[-1], SF), "test"))
        if i < 4:
            assert states[-1].columns == names
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    raw, good, single, masked, mixed, packed = states
    ids = lambda d: {r["doc_id"] for r in d.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(good) == {r["doc_id"] for r in quality.judged(raw, labels).where("kept").collect()}
    groups = {}
    for r in good.collect():
        groups.setdefault(simhash.fingerprint(r["text"]), []).append(r["doc_id"])
    assert ids(single) <= {min(g) for g in groups.values()} and len(ids(single)) == single.count()
    assert ids(masked) == ids(single)
    found = pii.spans(masked).where(" + ".join(f"size({k})" for k in ("email", "phone", "card", "ip")) + " > 0")
    assert found.count() == 0
    copies = {r["doc_id"]: len(r["mix"]["due"]) for r in mixing.curriculum(masked).collect()}
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} == {d: n for d, n in copies.items() if n}
    assert packed.groupBy("doc_id").agg({"*": "count"}).count() == len(ids(mixed))
    assert packed.where("length > 2048 OR length < 1").count() == 0


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13


@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if not n.startswith(("op11", "op12"))))
def test_queries_keep_every_row(spark, name):
    table = {"op1": "pages", "op6": "pages", "op4": "embeddings"}.get(name.split("_")[0], "documents")
    got, rows = queries.queries()[name](spark, SF), spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert got.count() >= rows if name.startswith("op3") else got.count() == rows


def test_order_of_training_over_several_files_a_partition(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    docs.write.option("maxRecordsPerFile", 9).parquet(str(tmp_path / "docs"))
    packed = corpus_pipeline.packing(spark, spark.read.parquet(str(tmp_path / "docs")), SF).where("piece = 0").collect()
    order = sorted((r["position"], r["doc_id"]) for r in packed)
    assert [p for p, _ in order] == list(range(len(order))) and [d for _, d in order] == sorted(d for _, d in order)
