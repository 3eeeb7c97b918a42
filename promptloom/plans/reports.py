"""Reports over many prompts: file checks, gates, rewriting benchmarks, model pipelines."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counting, data, pricing
from ..functions import text as T
from ..operators import frames, ledger, rewrite, scan

CALLS_PER_DAY = 1000


def over_budget(files: DataFrame, budget: int | None) -> DataFrame:
    """Adds whether and by how much ``tokens`` exceed the budget."""
    by = F.greatest(F.lit(0), F.col("tokens") - budget) if budget is not None else F.lit(0)
    return files.withColumn("over_by", by.cast("long")).withColumn("over_budget", F.col("over_by") > 0)


def against_base(files: DataFrame) -> DataFrame:
    """Adds growth against ``base_tokens``; null where there is no base."""
    ratio = F.when(F.col("base_tokens") > 0, F.round(F.col("tokens") / F.col("base_tokens") - 1, 9))
    return files.withColumns({"delta_tokens": F.col("tokens") - F.col("base_tokens"), "delta_ratio": ratio})


def totals(files: DataFrame) -> DataFrame:
    """One row; sums over no base are null. Costs and suggestions are summed where they are there."""
    sums = [
        F.count(F.lit(1)).alias("files"),
        F.sum("tokens").alias("tokens"),
        F.sum("base_tokens").alias("base_tokens"),
        F.sum(F.col("tokens") - F.col("base_tokens")).alias("delta_tokens"),
        F.count_if("over_budget").alias("over_budget"),
    ]
    if "monthly_cost" in files.columns:
        sums += [
            F.sum("monthly_cost").alias("monthly_cost"),
            F.sum("monthly_delta").alias("monthly_delta"),
            F.sum(F.size("duplicates")).alias("duplicate_groups"),
            F.coalesce(F.sum(F.when(F.col("verified"), F.col("saved_tokens"))), F.lit(0)).alias("saved_tokens"),
            F.coalesce(F.sum(F.when(F.col("verified"), F.col("monthly_saving"))), F.lit(0.0)).alias("monthly_saving"),
            F.count_if(~F.col("verified")).alias("unverified"),
        ]
    return files.agg(*sums)


def analyse(
    files: DataFrame,
    model_id: str,
    level: str = "balanced",
    budget: int | None = None,
    calls_per_day: int = CALLS_PER_DAY,
    vocabulary: str | None = None,
    service: counting.Counter | None = None,
) -> DataFrame:
    """(path, content, base_content) -> tokens, growth, cost, duplicates and a vetted suggestion per file.

    Every level is vetted by the ledger, since nobody watches the diff. Tokens are counted
    by the model's ``vocabulary`` or ``service`` where there is one; ``exact`` says whether
    all counts of a file are, estimates stand in for the others.
    """
    price = F.lit(data.model(model_id)[3])
    month = lambda tokens: pricing.monthly_cost(tokens, price, F.lit(calls_per_day))
    found = frames.with_rewrite(files, level, text="content", enforce=True, duplicates=True)
    count = lambda c: counting.counted(F.col(c), model_id, vocabulary, service)
    both = found.withColumns({"_now": count("content"), "_base": count("base_content"), "_new": count("output")})
    based = F.col("base_content").isNotNull()
    counted = both.withColumns(
        {
            "tokens": F.col("_now.tokens"),
            "base_tokens": F.when(based, F.col("_base.tokens")),
            "new_tokens": F.col("_new.tokens"),
            "exact": F.col("_now.exact") & F.col("_new.exact") & (~based | F.col("_base.exact")),
        }
    ).drop("_now", "_base", "_new")
    lost = F.size(F.filter("checks", lambda c: (c["severity"] == "critical") & ~c["preserved"]))
    saved = F.col("tokens") - F.col("new_tokens")
    suggested = (F.size("changes") > 0) & (F.col("output") != F.col("content")) & (saved > 0)
    priced = counted.withColumns(
        {
            "monthly_cost": month(F.col("tokens")),
            "monthly_delta": month(F.col("tokens")) - month(F.col("base_tokens")),
            "saved_tokens": F.when(suggested, saved),
            "monthly_saving": F.when(suggested, month(F.col("tokens")) - month(F.col("new_tokens"))),
            "verified": F.when(suggested, lost == 0),
        }
    )
    return against_base(over_budget(priced, budget))


def objections(files: DataFrame, gates: Iterable[str] = ("budget",)) -> DataFrame:
    """(gate, path, by): a row per file that a gate objects to, and by how much."""
    told = {"budget": ("over_budget", "over_by"), "regression": ("delta_tokens > 0", "delta_tokens"), "duplicates": ("size(duplicates) > 0", "size(duplicates)")}
    if unknown := [g for g in gates if g not in told]:
        raise ValueError(f"unknown gate {unknown[0]!r}")
    each = [F.when(F.expr(told[g][0]), F.struct(F.lit(g).alias("gate"), F.expr(told[g][1]).cast("long").alias("by"))) for g in gates]
    return files.select("path", F.inline(F.array_compact(F.array(*each)))).select("gate", "path", "by")


def failures(files: DataFrame, gates: Iterable[str] = ("budget",)) -> list[str]:
    """What the gates object to, for a command to print; ``objections`` is the table of it."""
    gates, said = list(gates), []
    plural = lambda n, what: f"{n:,} {what}{'s' * (n != 1)}"
    rows = objections(files, gates).orderBy("path").collect() if gates else []
    for gate in gates:
        own = [r for r in rows if r["gate"] == gate]
        if own and gate == "budget":
            said.append(f"{plural(len(own), 'file')} over budget: {', '.join(r['path'] for r in own)}")
        elif own and gate == "regression":
            said.append(f"{plural(len(own), 'file')} grew against the base: " + ", ".join(f"{r['path']} (+{r['by']:,})" for r in own))
        elif own:
            said.append(f"{plural(sum(r['by'] for r in own), 'duplicated instruction')} detected")
    return said


def _levels(docs: DataFrame, levels: Iterable[str]) -> DataFrame:
    """(corpus, level, before, after, ratio, critical, kept, blocked): a row per prompt and level."""
    worked = frames.with_levels(docs.select("corpus", "text"), levels=levels)
    every = worked.select("corpus", T.estimated_tokens(F.col("text")).alias("before"), F.inline("levels")).withColumn(
        "after", T.estimated_tokens(F.col("output"))
    )
    return every.withColumn("ratio", F.when(F.col("before") > 0, 1 - F.col("after") / F.col("before")).otherwise(0.0))


def _reductions() -> list[Column]:
    """The mean of prompts' reductions, and the reduction of all tokens, which long prompts decide."""
    return [
        F.count(F.lit(1)).alias("prompts"),
        F.avg("ratio").alias("avg_reduction"),
        (1 - F.sum("after") / F.sum("before")).alias("aggregate_reduction"),
        F.sum("critical").alias("critical"),
        F.sum("kept").alias("critical_kept"),
        F.sum("blocked").alias("blocked"),
    ]


def bench(docs: DataFrame, levels: Iterable[str] = rewrite.LEVELS) -> DataFrame:
    """Mean and aggregate token reduction, critical constraints kept and blocked changes by corpus and level."""
    return _levels(docs, levels).groupBy("corpus", "level").agg(*_reductions())


def bench_report(docs: DataFrame, levels: Iterable[str] = rewrite.LEVELS) -> DataFrame:
    """``bench`` by corpus and level, by level, and of everything, in one pass; ``depth`` is 0, 2 and 3 of these."""
    every = _levels(docs, levels)
    sets = [[F.col("corpus"), F.col("level")], [F.col("level")], []]
    return every.groupingSets(sets, "corpus", "level").agg(F.grouping_id().alias("depth"), *_reductions())


def batch_rows(docs: DataFrame, level: str = "balanced", text: str = "text") -> DataFrame:
    """``docs`` with a row per prompt of their batches: index, preview, tokens before and after, percent saved, critical constraints kept, and output."""
    each = docs.select("*", F.posexplode(T.batch(F.col(text))).alias("place", "prompt"))
    out = frames.with_checks(frames.with_rewrite(each, level, text="prompt"), "prompt", "output")
    critical = F.filter("checks", lambda k: k["severity"] == "critical")
    before, after = F.col("tokens_before"), F.col("tokens_after")
    found = out.withColumns(
        {
            "index": F.col("place") + 1,
            "preview": T.preview(F.col("prompt")),
            "tokens_before": T.estimated_tokens(F.col("prompt")),
            "tokens_after": T.estimated_tokens(F.col("output")),
            "critical_kept": F.size(F.filter(critical, lambda k: k["preserved"])),
            "critical_total": F.size(critical),
            "blocked": F.size("blocked"),
        }
    ).withColumn("percent", F.when(before > 0, F.floor((before - after) / before * 100 + 0.5)).otherwise(0).cast("int"))
    names = ("index", "preview", "tokens_before", "tokens_after", "percent", "critical_kept", "critical_total", "blocked", "output")
    return found.select(*[c for c in docs.columns if c not in names], *names)


def joined_batch(outputs: Column) -> Column:
    """The outputs of a batch as one text again."""
    return F.array_join(outputs, "\n\n---\n\n")


def demands(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, type, anchor, tokens): a row per constraint of a prompt whose wording is compared."""
    each = frames.with_demands(docs, text).select(F.col(f"`{key}`").alias("id"), F.explode("demands").alias("d"))
    return each.select("id", "d.type", "d.anchor", "d.tokens")


def shared_demands(constraints: DataFrame, least: int = 2, tokens: Column | None = None) -> DataFrame:
    """(type, tokens, prompts, example): demands that prompts share by tokens, of (id, type, anchor); corpus-wide, by an aggregation.

    ``tokens`` are those of the anchor where they are known already.
    """
    kind = F.col("type").isin(*ledger.COMPARED)
    known = T.tokens(F.col("anchor")) if tokens is None else tokens
    keyed = constraints.where(kind).select("id", "type", "anchor", F.array_join(known, " ").alias("tokens"))
    found = keyed.groupBy("type", "tokens").agg(F.count_distinct("id").alias("prompts"), F.min("anchor").alias("example"))
    return found.where(F.col("prompts") >= least)


def accuracy(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Recall and precision per type: anchors match if one holds the other, by tokens, in one prompt and type.

    Both are (id, type, anchor). Sides meet on (id, type), which bounds each match to one prompt.
    """
    g = gold.select("id", "type", F.concat(F.lit(" "), F.array_join(T.tokens(F.col("anchor")), " "), F.lit(" ")).alias("g"))
    f = found.select("id", "type", F.concat(F.lit(" "), F.array_join(T.tokens(F.col("anchor")), " "), F.lit(" ")).alias("f"))
    holds = lambda a, b: (a["id"] == b["id"]) & (a["type"] == b["type"]) & (F.contains(a["g"], b["f"]) | F.contains(b["f"], a["g"]))
    hit_gold = g.join(f, holds(g, f), "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("recalled"))
    hit_found = f.join(g, holds(g, f), "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("right"))
    counts = g.groupBy("type").agg(F.count(F.lit(1)).alias("gold")).join(f.groupBy("type").agg(F.count(F.lit(1)).alias("found")), "type", "full")
    joined = counts.join(hit_gold, "type", "left").join(hit_found, "type", "left").na.fill(0)
    return joined.select("type", "gold", "found", (F.col("recalled") / F.col("gold")).alias("recall"), (F.col("right") / F.col("found")).alias("precision"))


# Model pipelines: the client is the caller's; nothing here talks to a network.

MAX_REPAIRS = 2


class Client(Protocol):
    """What a provider does: a task's name and its fields in, the answer's JSON text out."""

    def complete(self, task: str, fields: dict) -> str: ...


class HalvingClient:
    """A deterministic stand-in: drops every other sentence, judges by words, repairs by appending.

    It denies constraints of the types in ``doubted`` and says nothing of those in ``ignored``.
    """

    def __init__(self, doubted: Iterable[str] = (), ignored: Iterable[str] = ()):
        self.doubted, self.ignored = frozenset(doubted), frozenset(ignored)

    def complete(self, task: str, fields: dict) -> str:
        if task == "compress":
            short = "\n".join(s.text for s in scan.sentences(fields["text"])[::2]) or fields["text"]
            there = [(i, a.lower() in short.lower()) for i, a in fields.get("anchors", ())]
            return json.dumps({"compressed": short, "kept": [i for i, found in there if found], "dropped": [i for i, found in there if not found]})
        if task == "verify":
            said = fields["output"].lower()
            asked = [(i, a, i.partition(":")[0]) for i, a in fields["anchors"]]
            return json.dumps({"results": [{"id": i, "preserved": a.lower() in said and t not in self.doubted, "evidence": ""} for i, a, t in asked if t not in self.ignored]})
        return json.dumps({"compressed": "\n".join([fields["output"], *(s for _, s in fields["missing"])])})


def output_budget(chars: int) -> int:
    return min(32_000, max(2_048, math.ceil(chars / 2) + 2_048))


def agreement(own: Column, model: Column) -> Column:
    """How two verifiers' verdicts on a constraint compare; null model verdicts are unjudged."""
    return (
        F.when(model.isNull(), "unjudged")
        .when(own & model, "agree-kept")
        .when(~own & ~model, "agree-lost")
        .otherwise(F.when(own, "local-only").otherwise("model-only"))
    )


def disagreements(checks: Column, verdicts: Column) -> Column:
    """The checks whose verdict a model's (a map of constraint to kept or not) contradicts."""
    return F.filter(checks, lambda k: agreement(k["preserved"], F.try_element_at(verdicts, k["id"])).isin("local-only", "model-only"))


def critical_lost(checks: Column) -> Column:
    return F.filter(checks, lambda k: (k["severity"] == "critical") & ~k["preserved"])


def payload(answer: str) -> dict:
    """An answer's JSON object; an empty one if it is none."""
    try:
        said = json.loads(answer)
    except ValueError:
        return {}
    return said if isinstance(said, dict) else {}


def compressed_in(answer: str) -> str:
    """The text of a compression or repair; ValueError if there is none."""
    said = payload(answer).get("compressed")
    if not isinstance(said, str) or not said.strip():
        raise ValueError("the model returned an empty prompt")
    return said.strip()


def verdicts_in(answer: str) -> dict[str, dict]:
    """Verdicts of a verification by constraint; rows without an id or a verdict go."""
    rows = payload(answer).get("results")
    good = (r for r in rows if isinstance(r, dict)) if isinstance(rows, list) else ()
    fine = (r for r in good if isinstance(r.get("id"), str) and isinstance(r.get("preserved"), bool))
    return {r["id"]: {"preserved": r["preserved"], "evidence": r["evidence"] if isinstance(r.get("evidence"), str) else ""} for r in fine}


def model_pipeline(docs: DataFrame, client: Client, text: str = "text", repairs: int = MAX_REPAIRS) -> DataFrame:
    """Adds output, repairs, calls, lost and error of a run per prompt; ``runs.with_run`` has the whole record."""
    from .runs import with_run

    names = ("output", "repairs", "calls", "lost", "error")
    done = with_run(docs, client, text, repairs)
    return done.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *[F.col(f"run.{n}").alias(n) for n in names])
