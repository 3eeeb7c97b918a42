"""The file check as a command: ``python -m promptloom.plans.check "prompts/**/*.md" --budget 2000``.

Exit codes: 0 fine, 1 a gate objects, 2 wrong usage. The driver lists and renders;
files are analysed by Spark.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import data
from ..operators.rewrite import LEVELS
from ..sources import files, promptfiles
from ..sources.staging import staged
from . import reports

GATES = ("budget", "regression", "duplicates")
MODEL = "claude-opus-5"
COLUMNS = ["path", "tokens", "exact", "base_tokens", "delta_tokens", "monthly_cost", "over_by", "duplicate_groups", "saved_tokens", "verified"]


def _positive(value: str) -> int:
    number = int(value)
    if number < 1:
        raise argparse.ArgumentTypeError("must be a positive whole number")
    return number


def _gates(value: str) -> list[str]:
    named = [g.strip() for g in value.split(",") if g.strip() and g.strip() != "none"]
    if unknown := [g for g in named if g not in GATES]:
        raise argparse.ArgumentTypeError(f"unknown gate {unknown[0]!r}; known: {', '.join(GATES)}")
    return named


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="check", description="Token budgets, growth and duplicated instructions of prompt files.")
    p.add_argument("patterns", nargs="+")
    p.add_argument("--budget", type=_positive)
    p.add_argument("--no-budget", dest="budget", action="store_const", const=None)
    p.add_argument("--model", default=MODEL, choices=[m[0] for m in data.MODELS])
    p.add_argument("--level", default="balanced", choices=LEVELS)
    p.add_argument("--base", default="main")
    p.add_argument("--no-base", dest="base", action="store_const", const=None)
    p.add_argument("--calls-per-day", type=_positive, default=reports.CALLS_PER_DAY)
    p.add_argument("--write", action="store_true")
    p.add_argument("--vocabulary", help="a tokenizer file for models whose vocabulary is public; others are estimated")
    p.add_argument("--format", default="text", choices=("text", "markdown", "json"))
    p.add_argument("--out")
    p.add_argument("--fail-on", dest="gates", type=_gates, default=["budget"])
    p.add_argument("--cwd", default=".")
    return p


def table(spark: SparkSession, paths: list[str], folder: str, ref: str | None) -> DataFrame:
    """(path, content, base_content) of files; the base is read by tasks, each from one git process."""
    whole = {"file:" + os.path.realpath(os.path.join(folder, p)): p for p in paths}
    names = spark.createDataFrame(list(whole.items()), "at string, name string")
    read = files.read_prompts(spark, list(whole))
    even = F.regexp_replace("path", "^file:/+", "file:/")
    joined = read.withColumn("at", even).join(F.broadcast(names), "at").select(F.col("name").alias("path"), "content")
    at = files.base_ref(folder, ref) if ref and files.is_repository(folder) else None
    if at is None:
        return joined.withColumn("base_content", F.lit(None).cast("string"))
    promptfiles.register(spark)
    # Names of files that are asked for; a pattern may be one of them.
    base = spark.read.format("prompt_files").option("ref", at[1]).option("patterns", json.dumps(["**/*"])).load(os.path.realpath(folder))
    return files.with_base(joined, base)


def rendered(rows: list[dict], total: dict, failed: list[str], form: str, model_id: str) -> str:
    if form == "json":
        return json.dumps({"model": model_id, "files": rows, "totals": total, "failures": failed}, indent=2, default=str) + "\n"
    head = ["file", "tokens", "delta", "monthly", "duplicates", "saves"]
    lines = []
    for r in rows:
        delta = "" if r["delta_tokens"] is None else f"{r['delta_tokens']:+,}"
        saves = "" if r["saved_tokens"] is None else f"{r['saved_tokens']:,}" + ("" if r["verified"] else " (unverified)")
        lines.append([r["path"], f"{'' if r['exact'] else '~'}{r['tokens']:,}" + (f" (+{r['over_by']:,} over)" if r["over_by"] else ""), delta, f"${r['monthly_cost']:,.2f}", str(r["duplicate_groups"]), saves])
    foot = f"{total['files']} files, ~{total['tokens'] or 0:,} tokens, ${total['monthly_cost'] or 0:,.2f} a month with {model_id}"
    if form == "markdown":
        body = ["| " + " | ".join(x) + " |" for x in (head, ["-"] * len(head), *lines)]
    else:
        wide = [max(map(len, c)) for c in zip(head, *lines, strict=True)]
        body = ["  ".join(v.ljust(w) for v, w in zip(x, wide, strict=True)).rstrip() for x in (head, *lines)]
    return "\n".join([*body, "", foot, *(f"FAIL: {f}" for f in failed)]) + "\n"


def check(spark: SparkSession, options: argparse.Namespace) -> tuple[str, int]:
    """The report and the exit code; ``--write`` changes only files whose suggestion is verified."""
    paths = files.expand(options.patterns, options.cwd)
    if not paths:
        raise SystemExit("no files match")
    found = reports.analyse(table(spark, paths, options.cwd, options.base), options.model, options.level, options.budget, options.calls_per_day, options.vocabulary)
    found = staged(found.withColumn("duplicate_groups", F.size("duplicates")), "check")
    rows = [r.asDict() for r in found.select(COLUMNS).orderBy("path").collect()]
    total, failed = reports.totals(found).first().asDict(), reports.failures(found, options.gates)
    if options.write:
        promptfiles.register(spark)
        verified = found.where("verified").select("path", F.col("output").alias("content"))
        verified.write.format("prompt_files").mode("append").option("manifest", "no").save(os.path.realpath(options.cwd))
    said = rendered(rows, total, failed, options.format, options.model)
    if options.out:
        os.makedirs(os.path.dirname(os.path.abspath(options.out)), exist_ok=True)
        with open(options.out, "w", encoding="utf-8") as f:
            f.write(said)
    return said, int(bool(failed))


def main(argv: list[str] | None = None) -> int:
    options = parser().parse_args(argv)
    said, code = check(SparkSession.builder.getOrCreate(), options)
    sys.stdout.write(said)
    return code


if __name__ == "__main__":
    sys.exit(main())
