"""Prompt files as a data source of Spark: planned reading by globs, reading at a git reference, arriving files, and a sink that may be tried again.

``register`` makes it known as ``prompt_files``::

    spark.read.format("prompt_files").option("patterns", "prompts/**/*.md").load(folder)
    docs.write.format("prompt_files").mode("append").save(folder)

Folders are reached through pyarrow's file systems, by a path or a uri. The driver lists
names; tasks read contents, ``per_task`` files each. At a git reference each task asks one
git process for its files. A file that is written appears under its name at once and in
whole, so a task that is killed and tried again leaves it whole and once; when all tasks
are done a manifest of the job is written, unless the option ``manifest`` is ``no``.
"""

from __future__ import annotations

import json
import os
import subprocess
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import EXTENSIONS, SKIPPED, matches, root_of

SCHEMA = "path string, content string"
# Files of a task, and about how many tasks there are at most where nothing is said of the files of each.
PER_TASK, MOST_TASKS = 200, 1000
MANIFESTS = "_manifests"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))


def _hidden(path: str) -> bool:
    return any(part.startswith((".", "_")) or part in SKIPPED for part in path.split("/"))


def _taken(patterns: list[str], path: str) -> bool:
    return any(matches(p, path) for p in patterns) if patterns else path.endswith(EXTENSIONS)


def _entries(store: fs.FileSystem, at: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder holds; of one on this machine one name at a time, with no look at the files."""
    if isinstance(store, fs.LocalFileSystem):
        if os.path.isdir(at):
            with os.scandir(at) as held:
                for entry in held:
                    if entry.is_dir() or entry.is_file():
                        yield entry.name, entry.is_dir()
        return
    for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if info.type in (fs.FileType.File, fs.FileType.Directory):
            yield info.base_name, info.type == fs.FileType.Directory


def named(folder: str, patterns: list[str]) -> list[str]:
    """Paths under the folder of the files that a pattern takes, sorted; no pattern takes all prompt files.

    Walks begin at the folder before a pattern's first wildcard; hidden and build folders
    are skipped. Only names that are taken are kept.
    """
    store, base = _store(folder)
    found: set[str] = set()
    waiting = [r for r in {root_of(p) for p in patterns} or {""} if not _hidden(r)] if patterns else [""]
    while waiting:
        under = waiting.pop()
        for name, is_folder in _entries(store, f"{base}/{under}".rstrip("/")):
            path = f"{under}/{name}" if under else name
            if _hidden(name):
                continue
            if is_folder:
                waiting.append(path)
            elif _taken(patterns, path):
                found.add(path)
    return sorted(found)


def listed(folder: str, patterns: list[str]) -> list[tuple[str, int]]:
    """``named`` files with the time of their last change in ns, for streams."""
    store, base = _store(folder)
    infos = ((path, store.get_file_info(f"{base}/{path}")) for path in named(folder, patterns))
    return [(path, info.mtime_ns or 0) for path, info in infos if info.type == fs.FileType.File]


@dataclass
class Files(InputPartition):
    paths: list[str]


def _dealt(paths: list[str], per_task: int | None) -> list[Files]:
    per_task = per_task or max(PER_TASK, -(-len(paths) // MOST_TASKS))
    return [Files(paths[i : i + per_task]) for i in range(0, len(paths), per_task)]


def _read(folder: str, paths: list[str]) -> Iterator[tuple[str, str]]:
    store, base = _store(folder)
    for path in paths:
        with store.open_input_stream(f"{base}/{path}") as f:
            yield path, f.read().decode("utf-8", "replace")


def _read_at(folder: str, ref: str, paths: list[str]) -> Iterator[tuple[str, str]]:
    """Files as a git reference has them, from one process; those it doesn't have are left out."""
    asked = "".join(f"{ref}:./{p}\n" for p in paths).encode()
    done = subprocess.run(["git", "-C", folder, "cat-file", "--batch"], input=asked, capture_output=True, check=True)
    out, at = done.stdout, 0
    for path in paths:
        line, at = out[at : out.index(b"\n", at)], out.index(b"\n", at) + 1
        words = line.split()
        if len(words) == 3 and words[1] == b"blob":
            size = int(words[2])
            yield path, out[at : at + size].decode("utf-8", "replace")
            at += size + 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.patterns, self.ref = options["path"], _patterns(options), options.get("ref")
        self.per_task = int(options.get("per_task", 0)) or None

    def partitions(self) -> list[Files]:
        if self.ref:
            said = subprocess.run(["git", "-C", self.folder, "ls-tree", "-r", "-z", "--name-only", self.ref], capture_output=True, check=True).stdout
            names = [n for n in said.decode("utf-8", "replace").split("\0") if n and not _hidden(n)]
            return _dealt(sorted(n for n in names if _taken(self.patterns, n)), self.per_task)
        return _dealt(named(self.folder, self.patterns), self.per_task)

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        paths = partition.paths if partition else []
        return _read_at(self.folder, self.ref, paths) if self.ref else _read(self.folder, paths)


class _StreamReader(DataSourceStreamReader):
    """Files by the time of their last change and their name; an offset is the last one seen."""

    def __init__(self, options: dict):
        self.folder, self.patterns = options["path"], _patterns(options)
        self.per_task = int(options.get("per_task", 0)) or None

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        changed, path = max(((t, p) for p, t in listed(self.folder, self.patterns)), default=(-1, ""))
        return {"time": changed, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _dealt([p for p, t in listed(self.folder, self.patterns) if low < (t, p) <= high], self.per_task)

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return _read(self.folder, partition.paths if partition else [])


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.job, self.told = options["path"], uuid.uuid4().hex, options.get("manifest", "yes") == "yes"

    def write(self, rows: Iterator) -> Written:
        store, base = _store(self.folder)
        count = size = 0
        made: set[str] = set()
        for row in rows:
            path = row["path"]
            if path is None or row["content"] is None or path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"no file can have the path {path!r}")
            raw = row["content"].encode("utf-8", "surrogatepass")
            at = f"{base}/{path}"
            within = at.rsplit("/", 1)[0]
            if within not in made:
                store.create_dir(within, recursive=True)
                # Folders of few files each are not all kept in mind.
                made = {*made, within} if len(made) < PER_TASK else {within}
            # Hidden until it is whole; a file of that name is replaced in one step.
            held = f"{within}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(held) as f:
                f.write(raw)
            store.move(held, at)
            count, size = count + 1, size + len(raw)
        return Written(count, size)

    def commit(self, messages: list[Written | None]) -> None:
        if not self.told:
            return
        store, base = _store(self.folder)
        done = [m for m in messages if m is not None]
        store.create_dir(f"{base}/{MANIFESTS}", recursive=True)
        with store.open_output_stream(f"{base}/{MANIFESTS}/{self.job}.json") as f:
            f.write(json.dumps({"job": self.job, "files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Whole files that tasks have put in place stay; without a manifest the job isn't done."""


def _patterns(options: dict) -> list[str]:
    """One pattern, or a JSON list of them."""
    said = options.get("patterns", "")
    return json.loads(said) if said.startswith("[") else [said] if said else []


class PromptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prompt_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PromptFiles)
