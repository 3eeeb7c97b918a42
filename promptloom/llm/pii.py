"""Personal data: fixed formats, and identifiers found by bootstrapped contexts.

The base kinds are regular expressions with a check of each match. Their matches are
seeds of the bootstrap, whole, with the spaces inside them; so are some of the long words
that mix digits and letters, as keys and tokens do (``STRONG`` characters or more): one of
``SEED_SHARE`` by a hash of the word, so that the others are for the patterns to find, and
how many of them are found tells what the patterns are worth. Every other word with a
digit or an at sign, ``SHORTEST`` characters or more without the marks around it, is an
instance too. The word before an instance (with the one before that, if it has no letter,
as in ``token =``), the word after it, or both are its contexts; a context is a pattern
with the instance's shape, with its classes of characters, and, if it has both words, with
anything (marks without a letter only with the shape), so that formats no seed has are
found where seeds stand. Over the graph of distinct patterns and instances, each round
scores a pattern by the mean confidence of its instances, but for strong words outside the
seeds, which count neither for nor against it, and an instance outside the seeds by the
mean of its contexts, each by its best pattern, so trust spreads from the seeds. A pattern
with a high score, enough instances and enough seeds discovers its instances outside the
base kinds, and what is discovered is an ``other`` span wherever it stands.

All of it is DataFrame functions. Offsets are running totals over the matches and the
gaps between them, in code points, ends exclusive. Every pass over a text is linear or
nearly so: patterns start only where an earlier match or another class ends, and running
totals go over chunks of chunks.

Defined cases: a null text is an empty one and has no spans; very long texts go
in whole; equal spans of one kind in repeated rows of one text are one; a
repeated row gives a row each; matches that fail their check are dropped and not
retried; ties of patterns don't matter, for every pattern that passes counts; an empty
table gives an empty one; other columns are ignored by ``spans`` and kept by ``redact``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

KINDS = ("email", "ip", "card", "phone")
LEARNED = "other"

LOCAL = "A-Za-z0-9._%+-"
SPACE = r"\x20\x09-\x0D"
# A greedy run that nothing follows may be possessive, which keeps Java from recursing.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
# A word with a digit or an at sign.
INSTANCE = rf"(?<![^{SPACE}])[^{SPACE}]*[0-9@][^{SPACE}]*+"
# Marks that don't belong to the word they stand around.
EDGE = "\"'.,;:!?()[]{}<>|*#$%&"
# Characters of the shortest word that may be an identifier, and of a word that is a seed by its form.
SHORTEST, STRONG = 4, 20
# One strong word of so many is a seed.
SEED_SHARE = 2

# Characters of a text that masking cuts at a time.
BLOCK = 4096

ROUNDS = 3
CONFIDENCE = 0.8
FEWEST, SEEDS = 5, 3

MATCHES = "array<struct<start:int,end:int,m:string,before:string,after:string>>"
INSTANCES = "array<struct<start:int,kind:int,end:int,core:string,left:string,right:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results from ``start`` on; its copies grow with the square of the items, so they must be few."""
    begin = F.struct(start.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        at = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(items, begin, add)["out"]


def running(items: Column, step: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """``step`` over an array<long> up to each element; 0 is where it starts and must change nothing.

    Chunks are scanned each for itself, from where a run over the chunks' results has
    come to, so the work grows as the 4/3rd power of the array with three levels.
    """
    if levels == 1:
        return _scan(items, F.lit(0), step)

    def cut(x: Column) -> Column:
        last = F.ceil(F.size(x["items"]) / x["width"]).cast("int") - 1
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(x["items"], i * x["width"] + 1, x["width"]))
        return let(chunks, lambda low: join(low))

    def join(low: Column) -> Column:
        whole = F.transform(low, lambda c: F.aggregate(c, F.lit(0).cast("long"), step))
        ends = running(whole, step, levels - 1)
        starts = F.concat(F.array(F.lit(0).cast("long")), ends)
        return F.flatten(F.zip_with(low, F.slice(starts, 1, F.size(low)), lambda c, at: _scan(c, at, step)))

    def body(v: Column) -> Column:
        width = F.ceil(F.pow(F.size(v).cast("double"), F.lit(1 / levels))).cast("int")
        return F.when(F.size(v) == 0, F.array().cast("array<long>")).otherwise(let(F.struct(v.alias("items"), width.alias("width")), cut))

    return let(items, body)


def _add(x: Column, y: Column) -> Column:
    return x + y


def _most(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern that never matches nothing: array of (start, end, m, before, after), with the gaps around each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def body(x: Column) -> Column:
        n = F.size(x["found"])
        pairs = F.zip_with(F.slice(x["gaps"], 1, n), F.slice(x["gaps"], 2, n), lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        sizes = F.zip_with(x["found"], pairs, lambda m, g: (F.length(m) + F.length(g["before"])).cast("long"))
        ends = F.zip_with(x["found"], running(sizes, _add), lambda m, e: F.struct(m.alias("m"), e.cast("int").alias("end")))

        def one(m: Column, g: Column) -> Column:
            start = m["end"] - F.length(m["m"])
            return F.struct(start.alias("start"), m["end"].alias("end"), m["m"].alias("m"), g["before"].alias("before"), g["after"].alias("after"))

        return F.when(n == 0, F.array().cast(MATCHES)).otherwise(F.zip_with(ends, pairs, one))

    return let(parts, body)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def value(at: Column) -> Column:
        d = F.substring(digits, F.length(digits) - at + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(at % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, at: s + value(at)) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(m))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The matches of one base kind that hold."""
    held = F.filter(matches(text, PATTERNS[kind]), lambda x: _holds(kind, x["m"]))
    return F.when(text.rlike(HINTS[kind]), held).otherwise(F.array().cast(MATCHES))


def _word(found: Column) -> Column:
    """``found`` as a context: nothing, if it is itself an instance or cut off by one."""
    return F.when(found.rlike("[0-9@\u0001]"), "").otherwise(F.lower(found))


def _before(gap: Column, first: Column) -> Column:
    """The word before an instance that ``gap`` leads up to, with the one before that if it has no letter."""
    whole = F.translate(F.when(first, gap).otherwise(F.concat(F.lit("\u0001"), gap)), "\t\n\x0b\x0c\r", "     ")

    def body(g: Column) -> Column:
        rest = F.rtrim(F.left(g, F.length(g) - F.length(F.substring_index(g, " ", -1))))
        return let(F.struct(rest.alias("rest"), F.substring_index(rest, " ", -1).alias("last")), words)

    def words(x: Column) -> Column:
        more = F.substring_index(F.rtrim(F.left(x["rest"], F.length(x["rest"]) - F.length(x["last"]))), " ", -1)
        return F.when((x["last"] == "") | x["last"].rlike(r"[\p{L}0-9@\x01]"), _word(x["last"])).otherwise(
            F.concat_ws(" ", F.nullif(_word(more), F.lit("")), x["last"])
        )

    return let(whole, body)


def _after(gap: Column, last: Column) -> Column:
    """The word after an instance that ``gap`` follows."""
    whole = F.translate(F.when(last, gap).otherwise(F.concat(gap, F.lit("\u0001"))), "\t\n\x0b\x0c\r", "     ")
    return let(whole, lambda g: _word(F.substring_index(F.ltrim(F.substring(g, F.length(F.substring_index(g, " ", 1)) + 1, F.length(g))), " ", 1)))


def _instance(x: Column, kind: int, length: Column) -> Column:
    """(start, kind, end, core, left, right) of a match; kind 0 is a base span, 1 a word, of which marks around it are no part."""
    inner = F.ltrim(x["m"], F.lit(EDGE)) if kind else x["m"]
    core = F.rtrim(inner, F.lit(EDGE)) if kind else inner
    start = x["start"] + F.length(x["m"]) - F.length(inner)
    return F.struct(
        start.alias("start"),
        F.lit(kind).alias("kind"),
        (start + F.length(core)).alias("end"),
        F.lower(core).alias("core"),
        _before(x["before"], x["start"] == F.length(x["before"])).alias("left"),
        _after(x["after"], x["end"] + F.length(x["after"]) == length).alias("right"),
    )


def instances(text: Column, base: Column) -> Column:
    """Array of (start, kind, end, core, left, right): base spans, and the words with a digit or an at sign beside them."""
    found = F.when(text.rlike("[0-9@]"), matches(text, INSTANCE)).otherwise(F.array().cast(MATCHES))
    parts = F.struct(F.length(text).alias("length"), found.alias("words"), base.alias("base"))

    def events(x: Column) -> Column:
        words = F.filter(F.transform(x["words"], lambda w: _instance(w, 1, x["length"])), lambda w: F.length(w["core"]) >= SHORTEST)
        both = F.array_sort(F.concat(F.transform(x["base"], lambda b: _instance(b, 0, x["length"])), words))
        return let(F.struct(both.alias("events"), x["length"].alias("length")), apart)

    def apart(x: Column) -> Column:
        # A word meets no base span if those up to it have ended and the next begins after it.
        length = x["length"]
        ends = running(F.transform(x["events"], lambda e: F.when(e["kind"] == 0, e["end"]).otherwise(0).cast("long")), _most)
        left = F.transform(F.reverse(x["events"]), lambda e: F.when(e["kind"] == 0, length - e["start"]).otherwise(0).cast("long"))
        tied = F.arrays_zip(x["events"].alias("e"), ends.alias("before"), F.reverse(running(left, _most)).alias("left"))
        free = F.filter(
            tied, lambda t: (t["e"]["kind"] == 0) | ((t["before"] <= t["e"]["start"]) & (length - t["left"] >= t["e"]["end"]))
        )
        return F.transform(free, lambda t: t["e"])

    return let(parts, lambda x: F.when(F.size(x["words"]) + F.size(x["base"]) == 0, F.array().cast(INSTANCES)).otherwise(events(x)))


def strong(core: Column) -> Column:
    """Whether a word is a seed by its form: long, of letters and digits, some of each."""
    digits, letters = (F.length(F.regexp_replace(core, f"[^{c}]", "")) for c in ("0-9", "a-z"))
    return (F.length(core) >= STRONG) & core.rlike("^[a-z0-9_/+=-]++$") & (digits >= 4) & (letters >= 4)


def shape(core: Column) -> Column:
    """Runs of digits as 9, runs of letters as a."""
    return F.regexp_replace(F.regexp_replace(core, "[0-9]+", "9"), r"\p{L}+", "a")


def classes(core: Column) -> Column:
    """Which of letters (a), digits (9) and marks (-) there are."""
    return F.concat(
        F.when(core.rlike(r"\p{L}"), "a").otherwise(""),
        F.when(core.rlike("[0-9]"), "9").otherwise(""),
        F.when(core.rlike(r"[^\p{L}0-9]"), "-").otherwise(""),
    )


def extracted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged (doc_id, text_hash, email, ip, card, phone, instances): what later steps need of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    matched = base.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    found = matched.select(
        "doc_id",
        "text_hash",
        *[F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS],
        instances(F.col("text"), F.concat(*KINDS)).alias("instances"),
    )
    return stage(found, "pii")


def occurrences(found: DataFrame, seed_share: int = SEED_SHARE) -> DataFrame:
    """One row per instance in a text, with its (context, pattern), whether it is a seed, and whether it is of a base kind."""
    x = F.col("x")
    one = found.select("doc_id", "text_hash", F.explode("instances").alias("x"))
    sides = {
        "L": (x["left"] != "", [x["left"]]),
        "R": (x["right"] != "", [x["right"]]),
        "B": ((x["left"] != "") & (x["right"] != ""), [x["left"], x["right"]]),
    }
    patterns = []
    for side, (there, words) in sides.items():
        context = F.concat_ws(" ", F.lit(side), *words)
        # Marks alone, as between cells of a table, say nothing of other formats.
        spoken = there
        for word in words:
            spoken = spoken & word.rlike(r"\p{L}")
        levels = [("shape", shape(x["core"]), there), ("class", classes(x["core"]), spoken)]
        for level, form, ok in [*levels, ("any", F.lit(""), spoken)] if side == "B" else levels:
            pattern = F.concat_ws(" ", context, F.lit(level), form)
            patterns.append(F.when(ok, F.struct(context.alias("context"), pattern.alias("pattern"))))
    return one.select(
        "doc_id",
        "text_hash",
        x["start"].alias("start"),
        x["end"].alias("end"),
        x["core"].alias("core"),
        F.array_compact(F.array(*patterns)).alias("patterns"),
        ((x["kind"] == 0) | (strong(x["core"]) & (F.pmod(F.xxhash64(x["core"]), F.lit(seed_share)) == 0))).alias("seed"),
        ((x["kind"] != 0) & strong(x["core"]) & (F.pmod(F.xxhash64(x["core"]), F.lit(seed_share)) != 0)).alias("open"),
        (x["kind"] == 0).alias("base"),
    )


def trusted_patterns(
    occurred: DataFrame,
    rounds: int = ROUNDS,
    confidence: float = CONFIDENCE,
    instances: int = FEWEST,
    seeds: int = SEEDS,
) -> DataFrame:
    """(pattern) that passes after ``rounds`` of scoring the pattern-instance graph."""
    edges = stage(
        occurred.select("core", "seed", "open", F.inline("patterns"))
        .groupBy("context", "pattern", "core")
        .agg(F.max("seed").alias("seed"), (F.max("open") & ~F.max("seed")).alias("open")),
        "graph",
    )
    trust = edges.groupBy("core").agg(F.max("seed").cast("double").alias("trust")).withColumn("is_seed", F.col("trust") == 1)
    for _ in range(rounds):
        scored = (
            edges.select("pattern", "core", "open")
            .join(trust, "core")
            .groupBy("pattern")
            .agg(
                # Strong words outside the seeds speak neither for a pattern nor against it.
                (F.coalesce(F.sum(F.when(~F.col("open"), F.col("trust"))), F.lit(0.0)) / (F.count_if(~F.col("open")) + 1)).alias("score"),
                F.count(F.lit(1)).alias("n"),
                F.count_if("is_seed").alias("n_seed"),
            )
        )
        scored = scored.checkpoint()
        trust = (
            edges.groupBy("core")
            .agg(F.max("seed").alias("is_seed"))
            .join(
                edges.select("context", "pattern", "core")
                .join(scored, "pattern")
                .groupBy("core", "context")
                .agg(F.max("score").alias("best"))
                .groupBy("core")
                .agg(F.avg("best").alias("mean")),
                "core",
            )
            .select("core", "is_seed", F.when(F.col("is_seed"), 1.0).otherwise(F.col("mean")).alias("trust"))
        )
    return scored.where(
        (F.col("score") >= confidence) & (F.col("n") >= instances) & (F.col("n_seed") >= seeds)
    ).select("pattern")


def discovered(occurred: DataFrame, **bounds: float) -> DataFrame:
    """(core, seed): what trusted patterns find outside the base kinds, and whether it was a seed itself."""
    patterns = trusted_patterns(occurred, **bounds)
    fresh = occurred.where(~F.col("base")).select("core", "seed", F.explode("patterns.pattern").alias("pattern")).distinct()
    return fresh.join(patterns, "pattern", "left_semi").groupBy("core").agg(F.max("seed").alias("seed"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed_share: int = SEED_SHARE, **bounds: float) -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone, other): arrays of (start, end), one row per row of ``docs``."""
    found = extracted(docs, id_col, text_col)
    occurred = occurrences(found, seed_share)
    new = (
        occurred.where(~F.col("base"))
        .select("doc_id", "text_hash", "core", F.struct("start", "end").alias("span"))
        .join(discovered(occurred, **bounds), "core", "left_semi")
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("span")).alias(LEARNED))
    )
    # Both sides of the key may be null only in doc_id.
    joined = found.drop("instances").alias("f").join(
        new.alias("n"), F.col("f.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("f.text_hash") == F.col("n.text_hash")), "left"
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return joined.select("f.doc_id", "f.text_hash", *KINDS, F.coalesce(LEARNED, none).alias(LEARNED))


def as_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind, then start, joined by commas."""

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))

    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")


def masked(text: Column, kinds: dict[str, Column], block: int = BLOCK) -> Column:
    """``text`` with every stretch that spans cover replaced by its first span's kind.

    A text is cut into blocks of ``block`` characters and the spans at their edges, so
    that every cut is a short way into its block.
    """

    def named(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.array_sort(F.concat(*[named(k, c) for k, c in kinds.items()]))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))

    def uncovered(spans: Column) -> Column:
        """Spans without what earlier ones cover; those that begin inside one have no name."""
        ends = running(F.transform(spans, lambda x: x["end"].cast("long")), _most)
        earlier = F.slice(F.concat(F.array(F.lit(0).cast("long")), ends), 1, F.size(spans))

        def one(x: Column, before: Column) -> Column:
            name = F.when(x["start"] >= before, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")
            return F.struct(F.greatest(x["start"], before.cast("int")).alias("start"), x["end"].alias("end"), name.alias("name"))

        return F.filter(F.zip_with(spans, earlier, one), lambda x: x["start"] < x["end"])

    def by_block(x: Column) -> Column:
        """Per block the parts of spans in it, as (block, 1, start, end, name)."""

        def parts(s: Column) -> Column:
            first, last = F.floor(s["start"] / block).cast("int"), F.floor((s["end"] - 1) / block).cast("int")
            return F.transform(
                F.sequence(first, last),
                lambda b: F.struct(
                    b.alias("block"),
                    F.lit(1).alias("kind"),
                    F.greatest(s["start"] - b * block, F.lit(0)).alias("start"),
                    F.least(s["end"] - b * block, F.lit(block)).alias("end"),
                    F.when(b == first, s["name"]).otherwise("").alias("name"),
                ),
            )

        heads = F.transform(
            F.sequence(F.lit(0), F.size(x["blocks"]) - 1),
            lambda b: F.struct(b.alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("name")),
        )
        events = F.array_sort(F.concat(heads, F.flatten(F.transform(x["spans"], parts))))
        return let(F.struct(x["blocks"].alias("blocks"), events.alias("events")), cut)

    def cut(x: Column) -> Column:
        # A head at place p begins its block's events.
        places = F.transform(x["events"], lambda e, i: F.struct(e["kind"].alias("kind"), i.alias("at")))
        heads = F.transform(F.filter(places, lambda p: p["kind"] == 0), lambda p: p["at"])
        ends = F.concat(F.slice(heads, 2, F.size(heads)), F.array(F.size(x["events"])))
        runs = F.zip_with(heads, ends, lambda a, b: F.slice(x["events"], a + 1, b - a))
        return F.array_join(F.zip_with(x["blocks"], runs, one_block), "")

    def one_block(part: Column, run: Column) -> Column:
        # After each event the characters up to the next one.
        upto = F.concat(F.transform(F.slice(run, 2, F.size(run)), lambda e: e["start"]), F.array(F.length(part)))
        return F.array_join(
            F.zip_with(run, upto, lambda e, to: F.concat(e["name"], F.substring(part, e["end"] + 1, to - e["end"]))), ""
        )

    def body(x: Column) -> Column:
        return F.when(F.size(x["blocks"]) == 0, F.lit("")).otherwise(by_block(x))

    return let(every, lambda e: let(F.struct(blocks.alias("blocks"), uncovered(e).alias("spans")), body))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: float) -> DataFrame:
    """``docs`` with personal data in the text replaced; null texts stay null, rows without any stay as they are."""
    kinds = (*KINDS, LEARNED)
    hits = spans(docs, id_col, text_col, **bounds).where(" + ".join(f"size({k})" for k in kinds) + " > 0")
    hits = hits.dropDuplicates(["doc_id", "text_hash"]).select(F.struct("doc_id", "text_hash").alias("own"), F.struct(*kinds).alias("found"))
    text = F.col(text_col).cast("string")
    own = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), own.alias("own"))
    joined = rows.join(hits, "own", "left")
    new = F.when(F.col("found").isNull(), F.col("text")).otherwise(masked(F.col("text"), {k: F.col(f"found.{k}") for k in kinds}))
    return joined.select([new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
