"""Prompt files as a data source and a sink, arriving files, spend over a restart, and runs of the model pipeline."""

import json
import os
import subprocess

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from promptloom.plans import reports, runs
from promptloom.sources import files, promptfiles
from promptloom.streaming import streams


@pytest.fixture(scope="module")
def source(spark):
    promptfiles.register(spark)
    return lambda folder, **options: spark.read.format("prompt_files").options(**options).load(str(folder))


def put(folder, **contents):
    for name, text in contents.items():
        path = folder / name.replace("__", "/").replace("_md", ".md").replace("_txt", ".txt")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_globs_take_the_files_that_the_walk_takes(source, tmp_path):
    put(tmp_path, a_md="1", x__b_md="2", x__y__c_md="é", x__y__d_txt="4", node_modules__e_md="5", x__f="6")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "g.md").write_text("7")
    for patterns in (["**/*.md"], ["x/**/*.md"], ["x/*/?.{md,txt}"], ["a.md", "x/b.md"], ["none/*.md"]):
        found = source(tmp_path, patterns=json.dumps(patterns), per_task=1)
        assert sorted(r["path"] for r in found.collect()) == files.expand(patterns, str(tmp_path))
    every = {r["path"]: r["content"] for r in source(tmp_path).collect()}
    assert every == {"a.md": "1", "x/b.md": "2", "x/y/c.md": "é", "x/y/d.txt": "4"}
    assert source(tmp_path, patterns="**/*.md", per_task=1).rdd.getNumPartitions() == 3


def test_files_at_a_git_reference(source, tmp_path):
    git = lambda *words: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *words], check=True, capture_output=True)
    git("init", "-b", "main")
    put(tmp_path, a_md="old\n", x__b_md="", x__c_txt="no newline")
    git("add", "."), git("commit", "-m", "one")
    put(tmp_path, a_md="new", d_md="later")
    found = {r["path"]: r["content"] for r in source(tmp_path, ref="main", per_task=2).collect()}
    assert found == {"a.md": "old\n", "x/b.md": "", "x/c.txt": "no newline"}
    assert [r["path"] for r in source(tmp_path, ref="main", patterns="x/*.md").collect()] == ["x/b.md"]


def test_a_task_that_is_tried_again_leaves_files_whole_and_once(tmp_path):
    rows = [{"path": f"d/{i}.md", "content": f"text {i} " * 1000} for i in range(20)]

    def killed():
        yield from rows[:7]
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        promptfiles._Writer({"path": str(tmp_path)}).write(killed())
    writer = promptfiles._Writer({"path": str(tmp_path)})
    writer.commit([writer.write(iter(rows)), None])
    assert {p.name: p.read_text() for p in (tmp_path / "d").iterdir()} == {f"{i}.md": r["content"] for i, r in enumerate(rows)}
    (manifest,) = (tmp_path / promptfiles.MANIFESTS).iterdir()
    assert json.loads(manifest.read_text())["files"] == 20
    for path in ("/etc/x", "a/../../x", None):
        with pytest.raises(ValueError):
            writer.write(iter([{"path": path, "content": "x"}]))


def test_arriving_files_are_read_once(spark, source, tmp_path):
    put(tmp_path / "in", a_md="one", b_md="two")

    def run():
        stream = spark.readStream.format("prompt_files").option("patterns", "*.md").load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["one", "two"] == run()
    put(tmp_path / "in", c_md="three", d_txt="no")
    assert run() == ["one", "three", "two"]


def test_spend_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = [(f"text number {i}", i * 1200) for i in range(60)]
    late = [("far too late", 0)]
    given = lambda some: spark.createDataFrame(some, "text string, s long").select("text", F.timestamp_seconds("s").alias("ts"))
    read = lambda: streams.read_stream(spark, str(tmp_path / "in"), "text string, ts timestamp")
    for part in (rows[:30], rows[30:50] + late, rows[50:]):
        given(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.spent(read(), str(tmp_path / "check"), str(tmp_path / "out"))
    found = {r["start"].timestamp(): (r["prompts"], r["tokens"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {r["start"].timestamp(): (r["prompts"], r["tokens"]) for r in streams.spend(given(rows)).collect()}
    # The last three hours are open still; the late row was left out.
    assert found == {t: v for t, v in whole.items() if t + 3600 <= 59 * 1200 - 7200} and len(found) > 10


class Broken(reports.HalvingClient):
    def __init__(self, task):
        super().__init__()
        self.task = task

    def complete(self, task, fields):
        return "no json" if task == self.task else super().complete(task, fields)


TEXT = "Please open it. Never exceed 5 retries. You must answer in JSON. Due 2024-01-02."


@pytest.mark.parametrize("task,steps,calls", [("compress", "failed,pending,pending", 1), ("verify", "done,done,done", 4), ("repair", "done,done,failed", 4), (None, "done,done,done", 4)])
def test_runs_survive_failed_steps(task, steps, calls):
    got = runs.run(TEXT, Broken(task))
    assert ",".join(s["status"] for s in got["steps"]) == steps and got["calls"] == calls
    assert (got["error"] is not None) == (task == "compress") and (task != "compress" or got["output"] == TEXT)
    assert (got["lost"] > 0) == (task == "repair") and bool(got["verdicts"]) == (task in ("repair", None))


def test_runs_of_odd_prompts(spark):
    given = spark.createDataFrame([(None, 1), ("", 2), ("No demand here", 3)], "text string, run int")
    rows = runs.with_run(given, reports.HalvingClient()).collect()
    assert [s["status"] for s in rows[2]["run"]["steps"]] == ["done", "skipped", "skipped"] and rows[0]["run"]["error"]
    assert runs.judged(runs.with_run(given, reports.HalvingClient())).count() == 0


def test_git_and_folder_of_the_check(spark, tmp_path):
    from promptloom.plans import check

    git = lambda *words: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *words], check=True, capture_output=True)
    git("init", "-b", "main")
    put(tmp_path, p__a_md="Please go in order to win.\n")
    git("add", "."), git("commit", "-m", "one")
    put(tmp_path, p__a_md="Please go in order to win the long and very old game.\n", p__b_md="Go.\n")
    said, code = check.check(spark, check.parser().parse_args(["p/*.md", "--cwd", str(tmp_path), "--write", "--format", "json", "--fail-on", "regression"]))
    rows = {r["path"]: r for r in json.loads(said)["files"]}
    assert code == 1 and rows["p/a.md"]["delta_tokens"] > 0 and rows["p/b.md"]["delta_tokens"] is None
    assert (tmp_path / "p" / "a.md").read_text() == "Go to win the long and very old game.\n" and (tmp_path / "p" / "b.md").read_text() == "Go.\n"
    assert sorted(os.listdir(tmp_path)) == [".git", "p"]


def test_listing_keeps_only_the_names_it_takes(tmp_path, monkeypatch):
    for name in ("a/1-x.md", "a/b/2-y.md", "a/3.json", ".h/4.md", "a/_m/5.md", "node_modules/6.md", "7.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    told = {(): ["7.md", "a/1-x.md", "a/b/2-y.md"], ("a/*.md",): ["a/1-x.md"], ("**/*.md", "*.md"): ["7.md", "a/1-x.md", "a/b/2-y.md"], (".h/*.md",): [], ("none/*.md",): []}
    local = promptfiles._entries
    by_store = lambda store, at: local(fs.SubTreeFileSystem("/", store), at.lstrip("/"))
    for patterns, names in told.items():
        assert promptfiles.named(str(tmp_path), list(patterns)) == names
        monkeypatch.setattr(promptfiles, "_entries", by_store)
        assert promptfiles.named(str(tmp_path), list(patterns)) == names
        monkeypatch.setattr(promptfiles, "_entries", local)
    assert [p for p, _ in promptfiles.listed(str(tmp_path), [])] == told[()]


def test_tasks_are_bounded_however_many_the_files():
    for n in (0, 1, 200, 200_001, 5_000_000):
        dealt = promptfiles._dealt(range(n), None)
        assert sum(len(f.paths) for f in dealt) == n and len(dealt) <= promptfiles.MOST_TASKS
    assert len(promptfiles._dealt(list(range(10)), 2)) == 5
