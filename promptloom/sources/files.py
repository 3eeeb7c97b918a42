"""Prompt files: pattern expansion on the driver, reading by Spark."""

from __future__ import annotations

import os
import re
import subprocess
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import imported

# Fixed values.
EXTENSIONS = (".md", ".markdown", ".txt", ".prompt")
SKIPPED = frozenset(("node_modules", ".git", "dist", "coverage", ".next", ".cache"))
GLOB = re.compile(r"\*\*/|\*\*|\*|\?|\{[^}]*\}|[^*?{]+|\{")


def glob_pattern(pattern: str) -> str:
    """A regular expression of a glob: ** crosses folders, also none; * and ? don't; {a,b} chooses."""
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": r"\{"}

    def one(part: str) -> str:
        if part.startswith("{") and part.endswith("}"):
            return "(?:" + "|".join(glob_pattern(p) for p in part[1:-1].split(",")) + ")"
        return known.get(part) or re.escape(part)

    return "".join(one(p) for p in GLOB.findall(pattern))


@lru_cache(maxsize=256)
def _glob(pattern: str) -> re.Pattern:
    return re.compile(glob_pattern(pattern), re.S)


def matches(pattern: str, path: str) -> bool:
    return _glob(pattern).fullmatch(path) is not None


def root_of(pattern: str) -> str:
    """The folders before the first wildcard, where a walk begins."""
    folders = pattern.split("/")[:-1]
    wild = next((i for i, p in enumerate(folders) if re.search(r"[*?{]", p)), len(folders))
    return "/".join(folders[:wild])


def expand(patterns: list[str], folder: str = ".") -> list[str]:
    """Files of patterns, folders or names, each once, sorted by code point; hidden and build folders are skipped."""
    found: set[str] = set()
    for pattern in patterns:
        full = os.path.join(folder, pattern)
        if os.path.isfile(full):
            found.add(pattern)
            continue
        whole = os.path.isdir(full)
        for at, folders, names in os.walk(full if whole else os.path.join(folder, root_of(pattern))):
            folders[:] = [d for d in folders if d not in SKIPPED and not d.startswith(".")]
            for name in names:
                path = os.path.relpath(os.path.join(at, name), folder)
                if not name.startswith(".") and (name.endswith(EXTENSIONS) if whole else matches(pattern, path)):
                    found.add(path)
    return sorted(found)


def read_prompts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of whole files; an exported .json gives its ``input``."""
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return raw.select("path", imported(F.col("path"), F.col("content")).alias("content"))


def with_base(files: DataFrame, base: DataFrame) -> DataFrame:
    """Adds ``base_content`` from (path, content) of another snapshot."""
    return files.join(base.select("path", F.col("content").alias("base_content")), "path", "left")


def _git(folder: str, *words: str) -> str | None:
    """What a git command says, or None where it fails."""
    done = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True)
    return done.stdout if done.returncode == 0 else None


def is_repository(folder: str) -> bool:
    return (_git(folder, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def base_ref(folder: str, ref: str) -> tuple[str, str] | None:
    """(name, commit) of a reference as it is here, else as origin has it, else None."""
    for name in (ref, f"origin/{ref}"):
        if commit := (_git(folder, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}") or "").strip():
            return name, commit
    return None


def at_ref(folder: str, ref: str, path: str) -> str | None:
    """A file as a git reference has it, else as origin's has it, else None."""
    for name in (ref, f"origin/{ref}"):
        if (content := _git(folder, "show", f"{name}:{path}")) is not None:
            return content
    return None


def write_prompts(docs: DataFrame, path: str, column: str = "content") -> None:
    docs.select(F.col(column).alias("value")).write.text(path)
