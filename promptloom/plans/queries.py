"""The library's own queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import data, patterns, pricing
from ..functions import text as T
from ..operators import frames, ledger, rewrite
from ..operators.rules import RULES
from . import cases, reports
from .prompts import PROMPTS, WORKLOADS, of_events, prompts, spread, table, tasks, workloads
from .registry import QUERIES, SQL, query
from .registry import TOKENS as _TOKENS
from .registry import canonical_sql as _canonical
from .registry import rows_sql as _rows
from .registry import tokens_sql as _tokens_sql
from .registry import value as _value

_BEHAVIOUR = {p: (r, s) for p, r, s in data.PROVIDERS}
MODELS = (
    "models(model_id, provider, label, input_per_mtok, output_per_mtok, cache_read_per_mtok, cache_write_5m_per_mtok, "
    "cache_write_1h_per_mtok, cache_write_per_mtok, cached_input_per_mtok, storage_per_mtok_hour, min_cacheable_tokens, "
    "ttl_ids, refresh_on_hit, storage_billed) AS (SELECT * FROM (VALUES "
    + _rows([(*m, *_BEHAVIOUR[m[1]]) for m in data.MODELS])
    + ")), ttls(ttl_id, seconds) AS (SELECT * FROM (VALUES "
    + _rows(data.TTLS)
    + ")), priced AS (SELECT *, COALESCE(cache_read_per_mtok, cached_input_per_mtok, input_per_mtok) AS read_price FROM models)"
)


def _write(ttl: str) -> str:
    return (
        f"COALESCE(CASE WHEN provider = 'anthropic' THEN CASE WHEN {ttl} = 'anthropic-1h' THEN cache_write_1h_per_mtok "
        f"ELSE cache_write_5m_per_mtok END ELSE cache_write_per_mtok END, input_per_mtok)"
    )


# Tokens and prices.


@query(f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents")
def tokens_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT lang, COUNT(*) AS docs, CAST(SUM({_TOKENS.format('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("lang", T.estimated_tokens(F.col("text")).alias("tokens"))
    return counted.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))


@query(
    f"WITH {MODELS}, sums AS (SELECT lang, CAST(SUM({_TOKENS.format('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang) "
    "SELECT model_id, lang, tokens, round(tokens / 1e6 * input_per_mtok * 1000 * 30, 6) AS monthly_cost FROM sums, models"
)
def monthly_cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Twelve prices beside a handful of sums: the cost is linear, so sums come first.
    priced = tokens_by_lang(spark, sf_dir).join(F.broadcast(data.models(spark)))
    cost = pricing.monthly_cost(F.col("tokens"), F.col("input_per_mtok"), F.lit(1000))
    return priced.select("model_id", "lang", "tokens", F.round(cost, 6).alias("monthly_cost"))


def _by_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workloads beside each cache lifetime of each model."""
    each = data.models(spark).withColumn("ttl_id", F.explode("ttl_ids"))
    return workloads(spark, sf_dir).join(F.broadcast(each))


_EACH = f"WITH {MODELS}, {WORKLOADS}, each AS (SELECT * FROM workloads, (SELECT *, unnest(ttl_ids) AS ttl_id FROM priced) m) "


@query(_EACH + f"SELECT c_custkey, model_id, ttl_id, prefix_tokens / 1e6 * read_price AS read_cost, prefix_tokens / 1e6 * {_write('ttl_id')} AS write_cost FROM each")
def cache_price_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = lambda price: F.col("prefix_tokens") / F.lit(1e6) * price
    return _by_lifetime(spark, sf_dir).select(
        "c_custkey", "model_id", "ttl_id", cost(pricing.read_price()).alias("read_cost"), cost(pricing.write_price(F.col("ttl_id"))).alias("write_cost")
    )


_BREAK_EVEN = (
    "CASE WHEN read_price >= input_per_mtok THEN 'Infinity'::DOUBLE "
    "ELSE floor(({0} - read_price) / (input_per_mtok - read_price)) + 1 END"
)


@query(_EACH + f"SELECT c_custkey, model_id, ttl_id, {_BREAK_EVEN.format(_write('ttl_id'))} AS calls, calls_per_day >= {_BREAK_EVEN.format(_write('ttl_id'))} AS reached FROM each")
def break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = pricing.break_even_calls(F.col("ttl_id"))
    return _by_lifetime(spark, sf_dir).select("c_custkey", "model_id", "ttl_id", calls.alias("calls"), (F.col("calls_per_day") >= calls).alias("reached"))


_PER_HOUR = (
    "CASE WHEN COALESCE(storage_per_mtok_hour, 0) = 0 THEN 0 WHEN read_price >= input_per_mtok THEN 'Infinity'::DOUBLE "
    "ELSE storage_per_mtok_hour / (input_per_mtok - read_price) END"
)


@query(f"WITH {MODELS}, {WORKLOADS} SELECT c_custkey, model_id, CAST({_PER_HOUR} AS DOUBLE) AS calls_per_hour, calls_per_day / 24.0::DOUBLE >= {_PER_HOUR} AS reached FROM workloads, priced")
def min_calls_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = workloads(spark, sf_dir).join(F.broadcast(data.models(spark)))
    least = pricing.min_calls_per_hour()
    return both.select("c_custkey", "model_id", least.alias("calls_per_hour"), (F.col("calls_per_day") / F.lit(24.0) >= least).alias("reached"))


_GAP = "COALESCE(interval_seconds, CASE WHEN calls_per_day > 0 THEN 86400::DOUBLE / calls_per_day ELSE 'Infinity'::DOUBLE END)"
_FITTING = "(SELECT arg_min(ttl_id, seconds) FROM ttls WHERE list_contains(ttl_ids, ttl_id) AND seconds >= {0})"


@query(
    f"WITH {MODELS}, {WORKLOADS} SELECT c_custkey, model_id, {_FITTING.format('gap')} AS ttl_id "
    f"FROM (SELECT *, {_GAP} AS gap FROM workloads, models) x"
)
def choose_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = workloads(spark, sf_dir).join(F.broadcast(data.models(spark)))
    gap = F.coalesce("interval_seconds", pricing.default_interval(F.col("calls_per_day")))
    return both.select("c_custkey", "model_id", pricing.shortest_ttl(gap).alias("ttl_id"))


_ADVICE = f"""WITH {MODELS}, {WORKLOADS}, rows_of AS (
  SELECT *, {_GAP} AS gap FROM workloads, priced
), options AS (
  SELECT c_custkey, model_id, 0 AS rank, NULL AS ttl_id, CAST(calls_per_day AS DOUBLE) AS writes_per_day, 0::DOUBLE AS reads_per_day,
         prefix_tokens / 1e6 * input_per_mtok * calls_per_day * 30 AS prefix_cost
  FROM rows_of
  UNION ALL
  SELECT c_custkey, model_id, list_position(ttl_ids, ttl_id), ttl_id, writes, greatest(0, calls_per_day - writes),
         prefix_tokens / 1e6 * {_write('ttl_id')} * writes * 30
         + prefix_tokens / 1e6 * read_price * greatest(0, calls_per_day - writes) * 30
         + CASE WHEN storage_billed AND storage_per_mtok_hour IS NOT NULL
                THEN prefix_tokens / 1e6 * storage_per_mtok_hour * writes * (seconds / 3600) * 30 ELSE 0 END
  FROM (
    SELECT r.*, t.ttl_id, t.seconds, CASE WHEN r.gap > t.seconds THEN CAST(r.calls_per_day AS DOUBLE) WHEN r.refresh_on_hit THEN 1
           ELSE r.calls_per_day / (floor(t.seconds / r.gap) + 1) END AS writes
    FROM rows_of r JOIN ttls t ON list_contains(r.ttl_ids, t.ttl_id)
    WHERE NOT COALESCE(r.prefix_tokens < r.min_cacheable_tokens, FALSE)
  ) x
), chosen AS (
  SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY c_custkey, model_id ORDER BY prefix_cost, rank) = 1
), costs AS (
  SELECT r.*, c.ttl_id, c.writes_per_day, c.reads_per_day,
         r.original_tokens / 1e6 * r.input_per_mtok * r.calls_per_day * 30 AS as_is,
         r.compressed_tokens / 1e6 * r.input_per_mtok * r.calls_per_day * 30 AS compress,
         c.prefix_cost + r.compressed_dynamic_tokens / 1e6 * r.input_per_mtok * r.calls_per_day * 30 AS cache
  FROM rows_of r JOIN chosen c USING (c_custkey, model_id)
), advised AS (
  SELECT *, CASE WHEN cache < CASE WHEN compress < as_is - as_is * 0.005 THEN compress ELSE as_is END - as_is * 0.005 THEN 'cache'
            WHEN compress < as_is - as_is * 0.005 THEN 'compress' ELSE 'as-is' END AS best,
         {_BREAK_EVEN.format(_write('ttl_id'))} AS break_even_calls
  FROM costs
)"""


def _advised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.advise(workloads(spark, sf_dir).join(F.broadcast(data.models(spark))))


@query(
    _ADVICE + " SELECT c_custkey, model_id, as_is, compress, cache, ttl_id, writes_per_day, reads_per_day, best, break_even_calls FROM advised"
)
def advise_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ["as_is", "compress", "cache", "ttl_id", "writes_per_day", "reads_per_day", "best", "break_even_calls"]
    return _advised(spark, sf_dir).select("c_custkey", "model_id", *found)


@query(_ADVICE + " SELECT model_id, best, COUNT(*) AS n, round(SUM(as_is - least(as_is, compress, cache)), 4) AS saved FROM advised GROUP BY 1, 2")
def best_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = F.col("as_is") - F.least("as_is", "compress", "cache")
    return _advised(spark, sf_dir).groupBy("model_id", "best").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(saved), 4).alias("saved")
    )


def _usd_sql(v: str) -> str:
    return (
        f"CASE WHEN abs({v}) < 0.00005 THEN '$0' ELSE CASE WHEN {v} < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs({v}) < 0.01 THEN printf('%.4f', abs({v})) "
        f"WHEN abs({v}) < 10 THEN printf('%.2f', CASE WHEN abs({v}) * 8 = floor(abs({v}) * 8) AND (abs({v}) * 8) % 2 = 1 THEN abs({v}) + 0.001 ELSE abs({v}) END) ELSE format('{{:,}}', CAST(floor(abs({v}) + 0.5) AS BIGINT)) END END"
    )


def _interval_sql(v: str) -> str:
    return (
        f"CASE WHEN isinf({v}) THEN 'a very long time' WHEN {v} < 90 THEN CAST(floor({v} + 0.5) AS BIGINT) || ' s' "
        f"WHEN {v} < 5400 THEN CAST(floor({v} / 60 + 0.5) AS BIGINT) || ' min' ELSE printf('%.1f h', CASE WHEN {v} / 900 = floor({v} / 900) AND ({v} / 900) % 2 = 1 THEN {v} / 3600 + 0.01 ELSE {v} / 3600 END) END"
    )


def _share_sql(v: str) -> str:
    return f"CAST(floor(CASE WHEN as_is > 0 THEN ({v}) / as_is ELSE 0 END * 100 + 0.5) AS BIGINT) || '%'"


_SAVES = {"compress": "(as_is - compress)", "cache": "(as_is - cache)"}
_PREFIX_SQL = "format('{:,}', prefix_tokens) || ' tokens'"


@query(
    _ADVICE + " SELECT c_custkey, model_id, best, CASE WHEN best = 'cache' THEN 'Cache the static prefix (' || " + _PREFIX_SQL + " || ').' "
    f"WHEN best = 'compress' THEN 'Compress: ' || {_usd_sql(_SAVES['compress'])} || '/month (' || {_share_sql(_SAVES['compress'])} || '). Caching isn''t worth it here.' "
    "WHEN as_is = 0 THEN 'Nothing to save yet.' ELSE 'Leave it as it is: neither compressing nor caching is cheaper.' END AS headline, "
    "CASE WHEN COALESCE(prefix_tokens < min_cacheable_tokens, FALSE) THEN label || ' caches nothing under ' || format('{:,}', min_cacheable_tokens) || ' tokens; the static prefix has ' || " + _PREFIX_SQL + " "
    f"WHEN {_FITTING.format('gap')} IS NULL THEN 'Calls are about ' || {_interval_sql('gap')} || ' apart, too far for any cache lifetime.' "
    "WHEN ttl_id IS NULL THEN 'At this call rate a cache costs more than it saves.' "
    "ELSE 'Caching pays from call ' || CASE WHEN isinf(break_even_calls) THEN 'Infinity' ELSE printf('%.0f', break_even_calls) END || ' on within one lifetime of ' || ttl_id END || chr(10) || "
    f"'Compressing saves ' || {_usd_sql(_SAVES['compress'])} || '/month (' || {_share_sql(_SAVES['compress'])} || '); reordering and caching saves ' || {_usd_sql(_SAVES['cache'])} || '/month (' "
    f"|| {_share_sql(_SAVES['cache'])} || ').' AS reasons FROM advised"
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pricing.recommend(_advised(spark, sf_dir))
    return found.select("c_custkey", "model_id", "best", "headline", F.array_join("reasons", "\n").alias("reasons"))


@query(
    f"WITH {MODELS}, {WORKLOADS} SELECT c_custkey, model_id, CAST(CASE WHEN original_tokens <= 0 THEN 0 ELSE floor(dynamic_tokens * (compressed_tokens / original_tokens) + 0.5) END AS BIGINT) AS dynamic_after, "
    f"{_usd_sql('(original_tokens / 1e6 * input_per_mtok)')} AS call_cost, {_usd_sql('(original_tokens / 1e6 * input_per_mtok * calls_per_day * 30)')} AS month_cost, {_interval_sql(_GAP)} AS gap FROM workloads, models"
)
def workload_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = workloads(spark, sf_dir).join(F.broadcast(data.models(spark)))
    gap = F.coalesce("interval_seconds", pricing.default_interval(F.col("calls_per_day")))
    call = F.col("original_tokens") / F.lit(1e6) * F.col("input_per_mtok")
    return both.select(
        "c_custkey",
        "model_id",
        pricing.scaled_tokens(F.col("dynamic_tokens"), F.col("original_tokens"), F.col("compressed_tokens")).cast("long").alias("dynamic_after"),
        pricing.usd(call).alias("call_cost"),
        pricing.usd(call * F.col("calls_per_day") * 30).alias("month_cost"),
        pricing.interval(gap).alias("gap"),
    )


# Normalised text.


@query(f"WITH {PROMPTS} SELECT event_id, {_canonical('text')} AS canonical FROM prompts")
def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("event_id", T.canonical(F.col("text")).alias("canonical"))


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents) x")
def reduce_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return reduced.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(
    f"WITH {PROMPTS} SELECT event_id, CAST(len(list_filter(range(1, len(t)), lambda i: t[i] = 'example' AND t[i + 1] = 'org')) AS INTEGER) AS n "
    f"FROM (SELECT event_id, {_tokens_sql('text')} AS t FROM prompts) x"
)
def ngram_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sought = F.array(F.lit("example"), F.lit("org"))
    # Tokens as a column of their own, or the search would work them out at every place.
    reduced = prompts(spark, sf_dir).select("event_id", T.tokens(F.col("text")).alias("t"))
    return reduced.select("event_id", T.occurrences(F.col("t"), sought).alias("n"))


_REWRITE = "CASE WHEN event_type = 'error' THEN replace(text, 'Never exceed 5 retries. ', '') ELSE text END"


@query(
    f"WITH {PROMPTS}, kept AS (SELECT event_id, {_tokens_sql('text')} AS t, {_tokens_sql(_REWRITE)} AS s FROM prompts) "
    "SELECT event_id, len(list_filter(range(1, len(s) - 1), lambda i: s[i] = 'exceed' AND s[i + 1] = '5' AND s[i + 2] = 'retries')) >= "
    "greatest(1, len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'exceed' AND t[i + 1] = '5' AND t[i + 2] = 'retries'))) AS preserved FROM kept"
)
def verify_anchor_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.array(*[F.lit(w) for w in ("exceed", "5", "retries")])
    reduced = prompts(spark, sf_dir).select(
        "event_id", T.tokens(F.col("text")).alias("before"), T.tokens(F.expr(_REWRITE)).alias("after")
    )
    before, after = (T.occurrences(F.col(c), anchor) for c in ("before", "after"))
    return reduced.select("event_id", (after >= F.greatest(F.lit(1), before)).alias("preserved"))


@query(
    f"WITH t AS (SELECT conv_id, turn, {_tokens_sql('text')} AS t FROM conversations) "
    "SELECT a.conv_id, a.turn, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE "
    "round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 9) END AS similarity "
    "FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return turns.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(T.similarity(F.col("t"), F.col("u")), 9).alias("similarity")
    )


def dealt_sql(rows, columns: str) -> str:
    return (
        f"cases({columns}, number) AS (SELECT * FROM (VALUES {_rows([(*r, i) for i, r in enumerate(rows)])})), "
        f"dealt AS (SELECT e.event_id, e.event_type, c.* FROM events e JOIN cases c ON e.event_id % {len(rows)} = c.number)"
    )


def _filled_sql(column: str) -> str:
    return f"replace({column}, '◊', event_type)"


_CUT = "before_it string, it string, after_it string"
_CUT_SQL = "before_it, it, after_it"
_START = f"length({_filled_sql('before_it')})"
_END = f"{_START} + length({_filled_sql('it')})"


def _case_prompts(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    dealt = cases.dealt(spark, spread(table(spark, sf_dir, "events").select("event_id", "event_type")), rows, schema)
    return dealt.withColumn("text", F.concat(*[cases.filled(c) for c in ("before_it", "it", "after_it")]))


@query(
    f"WITH {dealt_sql(cases.RULES, 'rule_id, given, want')} SELECT event_id, rule_id, {_filled_sql('want')} AS output, TRUE AS undoable FROM dealt"
)
def rules_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = cases.dealt(spark, spread(table(spark, sf_dir, "events").select("event_id", "event_type")), list(cases.RULES), "rule string, given string, want string")
    out = frames.with_rewrite(dealt.select("event_id", cases.filled("given").alias("text")), "aggressive", enforce=False)
    fired = F.array_join(F.transform("changes", lambda c: c["rule_id"]), ",")
    return frames.with_undone(out).select("event_id", fired.alias("rule_id"), "output", (F.col("undone") == F.col("text")).alias("undoable"))


_REGION_ROWS = [(kind, *cases.parts(prompt)) for kind, prompt in cases.REGIONS]


@query(
    f"WITH {dealt_sql(_REGION_ROWS, 'kind, ' + _CUT_SQL)} SELECT event_id, kind, CAST({_START} AS INTEGER) AS start, "
    f"CAST({_END} AS INTEGER) AS \"end\", {_filled_sql('it')} AS text, 3 AS pieces FROM dealt"
)
def regions_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = frames.with_segments(_case_prompts(spark, sf_dir, _REGION_ROWS, "kind string, " + _CUT).select("event_id", "text"))
    each = cut.select("event_id", F.size("segments").alias("pieces"), F.explode(F.filter("segments", lambda s: s["kind"].isNotNull())).alias("s"))
    return each.select("event_id", "s.kind", "s.start", "s.end", "s.text", "pieces")


_CONSTRAINT_ROWS = [(t, severity, label, *cases.parts(prompt)) for t, severity, label, prompt in cases.CONSTRAINTS]
_CONSTRAINT_SQL = f"WITH {dealt_sql(_CONSTRAINT_ROWS, 'type, severity, label, ' + _CUT_SQL)} "


def _case_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _case_prompts(spark, sf_dir, _CONSTRAINT_ROWS, "type string, severity string, label string, " + _CUT)
    found = frames.with_constraints(given.select("event_id", "text", F.col("label").alias("sought")))
    return found.select("event_id", "sought", F.explode("constraints").alias("c")).where("c.label = sought").select("event_id", "c.*")


@query(
    _CONSTRAINT_SQL + f"SELECT event_id, type, severity, label, {_filled_sql('it')} AS anchor, CAST({_START} AS INTEGER) AS start, "
    f"CAST({_END} AS INTEGER) AS \"end\" FROM dealt"
)
def constraints_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_constraints(spark, sf_dir).select("event_id", "type", "severity", "label", "anchor", "start", "end")


@query(_CONSTRAINT_SQL + "SELECT severity, COUNT(DISTINCT type) AS types, COUNT(*) AS n FROM dealt GROUP BY severity")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_constraints(spark, sf_dir).groupBy("severity").agg(F.count_distinct("type").alias("types"), F.count(F.lit(1)).alias("n"))


_MARKER_ROWS = [(kind, *cases.parts(prompt)) for kind, prompt in cases.MARKERS]


@query(
    f"WITH {dealt_sql(_MARKER_ROWS, 'kind, ' + _CUT_SQL)} SELECT event_id, kind, CAST({_START} AS INTEGER) AS start, CAST({_END} AS INTEGER) AS \"end\", "
    f"it AS text, CAST(length(before_it) - length(replace(before_it, chr(10), '')) AS INTEGER) AS line FROM dealt"
)
def markers_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = frames.with_layout(_case_prompts(spark, sf_dir, _MARKER_ROWS, "kind string, " + _CUT).select("event_id", "text"))
    return cut.select("event_id", F.explode("markers").alias("m")).select("event_id", "m.kind", "m.start", "m.end", "m.text", "m.line")


_LEVELS = "levels(level, up_to) AS (SELECT * FROM (VALUES ('light', 1), ('balanced', 2), ('aggressive', 3)))"


@query(
    f"WITH {dealt_sql(cases.RULES, 'rule_id, given, want')}, {_LEVELS}, rules(rule_id, level) AS (SELECT * FROM (VALUES {_rows([r[:2] for r in RULES])})) "
    "SELECT l.level, COUNT(DISTINCT d.rule_id) AS rules, COUNT(*) AS prompts FROM levels l JOIN rules r ON (SELECT up_to FROM levels o WHERE o.level = r.level) <= l.up_to "
    "JOIN dealt d ON d.rule_id = r.rule_id GROUP BY l.level"
)
def level_cumulative_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = cases.dealt(spark, spread(table(spark, sf_dir, "events").select("event_id", "event_type")), list(cases.RULES), "rule string, given string, want string")
    given = dealt.select(cases.filled("given").alias("text"))
    fired = [
        frames.with_rewrite(given, level, enforce=False).select(F.lit(level).alias("level"), F.get(F.transform("changes", lambda c: c["rule_id"]), F.lit(0)).alias("rule"))
        for level in rewrite.LEVELS
    ]
    every = fired[0].unionByName(fired[1]).unionByName(fired[2]).where("rule IS NOT NULL")
    return every.groupBy("level").agg(F.count_distinct("rule").alias("rules"), F.count(F.lit(1)).alias("prompts"))


_SENTENCE = "'Work on ' || event_type || ' prior to ' || user_id || ' for the purpose of ' || event_id"


@query(f"SELECT event_id, replace(replace({_SENTENCE}, 'prior to', 'before'), 'for the purpose of', 'for') AS output FROM events")
def substitution_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Work on "), "event_type", F.lit(" prior to "), "user_id", F.lit(" for the purpose of "), "event_id")
    given = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return frames.with_rewrite(given, "balanced").select("event_id", "output")


@query(
    "SELECT event_id, event_type || ' and more' || chr(10) || chr(10) || 'user ' || user_id || ', done' AS output FROM events"
)
def whitespace_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("event_type", F.lit("   and more  \n\n\n\nuser  "), "user_id", F.lit(" , done"))
    given = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return frames.with_rewrite(given, "light").select("event_id", "output")


# What the prompts' template gives, piece by piece.
_FIRST = "split_part(text, chr(10), 1)"
_DATE = "split_part(text, chr(10), 2)"
_STABLE = "split_part(text, chr(10), 3) || chr(10)"
_VARIED = f"{_FIRST} || chr(10) || {_DATE} || chr(10) || substr(text, strpos(text, 'User: what'))"
BALANCED = "replace(replace(text, 'Please process', 'Process'), ' in order to ', ' to ')"
_MONTH = "{0} / 1e6 * 5 * 1000 * 30"
_STATED_ROWS = [
    ("prohibition", "critical", 'prohibition ("never")', "'Never exceed 5 retries'", "'Never exceed 5 retries.'"),
    ("quantity", "critical", "count", "'5 retries'", "'Never exceed 5 retries.'"),
    ("requirement", "critical", 'requirement ("must")', "'must answer in JSON for user_id ' || user_id", "'You must answer in JSON for user_id ' || user_id || '.'"),
    ("format", "critical", "output shape", "'answer in JSON'", "'You must answer in JSON for user_id ' || user_id || '.'"),
    ("format", "critical", "serialisation format", "'in JSON'", "'You must answer in JSON for user_id ' || user_id || '.'"),
    ("entity", "minor", "identifier", "'user_id'", "'You must answer in JSON for user_id ' || user_id || '.'"),
    ("quantity", "critical", "date", "strftime(ts, '%Y-%m-%d')", "'Current date: ' || strftime(ts, '%Y-%m-%d')"),
    ("literal", "critical", "URL", "'https://example.org/e/' || event_id", "'See https://example.org/e/' || event_id || '.'"),
    ("variable", "critical", "template variable", "'{{topic}}'", "'User: what about {{topic}}?'"),
    ("literal", "critical", "JSON string", "'\"k\"'", "'Props: ' || props"),
]
STATED = (
    "stated AS ("
    + " UNION ALL ".join(
        f"SELECT event_id, text, {_value(t)} AS type, {_value(s)} AS severity, {_value(label)} AS label, {anchor} AS anchor, {sentence} AS sentence FROM whole"
        for t, s, label, anchor, sentence in _STATED_ROWS
    )
    + "), placed AS (SELECT *, strpos(text, anchor) - 1 AS start, strpos(text, anchor) - 1 + length(anchor) AS \"end\" FROM stated)"
)
STATED = "whole AS (SELECT p.*, e.props FROM prompts p JOIN events e USING (event_id)), " + STATED


# Batches, markers, counts.


@query(
    "SELECT event_id, CAST(place AS INTEGER) AS place, prompt FROM (SELECT event_id, unnest([0, 1]) AS place, "
    "unnest(['First ' || event_type, 'Second ' || user_id]) AS prompt FROM events) x"
)
def split_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("First "), "event_type", F.lit("\r\n --- \n\n---\nSecond "), "user_id", F.lit("\n"))
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(T.batch(text)).alias("place", "prompt"))


@query(
    "SELECT doc_id, CASE WHEN length(f) <= 60 THEN f ELSE left(f, 59) || '…' END AS preview "
    "FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents) x"
)
def batch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


_KEPT = "'Never exceed 5 retries of ' || event_type || '.'"


@query(
    "WITH rows_of AS (SELECT event_id, 1 AS index, 'Please open ' || event_type || ' now.' AS preview, 'Open ' || event_type || ' now.' AS output, 0 AS critical FROM events "
    f"UNION ALL SELECT event_id, 2, {_KEPT}, {_KEPT}, 2 FROM events), counted AS (SELECT *, {_TOKENS.format('preview')} AS tokens_before, {_TOKENS.format('output')} AS tokens_after FROM rows_of) "
    "SELECT event_id, index, preview, tokens_before, tokens_after, CAST(floor((tokens_before - tokens_after) / tokens_before * 100 + 0.5) AS INTEGER) AS percent, "
    "critical AS critical_kept, critical AS critical_total, 0 AS blocked, output FROM counted"
)
def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Please open "), "event_type", F.lit(" now.\n\n---\nNever exceed 5 retries of "), "event_type", F.lit("."))
    given = spread(table(spark, sf_dir, "events").select("event_id", "event_type")).select("event_id", text.alias("text"))
    return reports.batch_rows(given).drop("text")


@query(
    f"WITH {PROMPTS}, {STATED}, keyed AS (SELECT event_id, type, anchor, array_to_string({_tokens_sql('anchor')}, ' ') AS tokens FROM placed WHERE type IN ('prohibition', 'requirement', 'format')) "
    "SELECT type, tokens, COUNT(DISTINCT event_id) AS prompts, MIN(anchor) AS example FROM keyed GROUP BY type, tokens HAVING COUNT(DISTINCT event_id) >= 2"
)
def shared_demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = reports.demands(prompts(spark, sf_dir).select("event_id", "text"), "event_id")
    return reports.shared_demands(each, tokens=F.col("tokens"))


@query(
    _CONSTRAINT_SQL + ", gold AS (SELECT type FROM dealt UNION ALL SELECT type FROM dealt WHERE event_id % 7 = 0) "
    "SELECT type, COUNT(*) AS gold, (SELECT COUNT(*) FROM dealt d WHERE d.type = g.type) AS found, "
    "round((SELECT COUNT(*) FROM dealt d WHERE d.type = g.type) / COUNT(*), 9) AS recall, 1.0::DOUBLE AS precision FROM gold g GROUP BY type"
)
def extractor_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _case_prompts(spark, sf_dir, _CONSTRAINT_ROWS, "type string, severity string, label string, " + _CUT)
    gold = given.select(F.col("event_id").alias("id"), "type", cases.filled("it").alias("anchor"))
    # Every seventh prompt has an annotation that nothing in it meets.
    missed = gold.where("id % 7 = 0").withColumn("anchor", F.lit("words that stand nowhere"))
    found = _case_constraints(spark, sf_dir).select(F.col("event_id").alias("id"), "type", "anchor")
    return reports.accuracy(gold.unionByName(missed), found).withColumn("recall", F.round("recall", 9))


_DISCARDED = [(w, p) for w, _, p in data.DISCARDED]


@query(f"WITH {dealt_sql(_DISCARDED, 'wording, prompt')} SELECT event_id, wording, prompt || ' About ' || event_type || '.' AS output FROM dealt")
def discarded_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = cases.dealt(spark, spread(table(spark, sf_dir, "events").select("event_id", "event_type")), _DISCARDED, "wording string, prompt string")
    given = dealt.select("event_id", "wording", F.concat("prompt", F.lit(" About "), "event_type", F.lit(".")).alias("text"))
    return frames.with_rewrite(given, "aggressive", enforce=False).select("event_id", "wording", "output")


_NAMES = ["{{today}}", "{req_id}", "${topic}", "{{user.timestamp}}", "[SESSION]"]


@query(
    "SELECT event_id, kind FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'identifier' "
    "WHEN 2 THEN 'variable' WHEN 3 THEN 'date' ELSE 'identifier' END AS kind FROM events) x"
)
def variable_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.variable_kind(name).alias("kind"))


def _counted(name: str, pattern: str, flags: str, tables: str = "prompts", key: str = "event_id") -> None:
    """A query that counts a pattern per row, with its SQL."""
    source = f"WITH {PROMPTS} " if tables == "prompts" else ""
    spelled = ("(?i)" if "i" in flags else "") + pattern
    SQL[name] = f"{source}SELECT {key}, CAST(len(regexp_extract_all(text, {_value(spelled)})) AS INTEGER) AS n FROM {tables}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = prompts(spark, sf_dir) if tables == "prompts" else table(spark, sf_dir, tables)
        return given.select(key, T.count_matches(F.col("text"), pattern, flags).alias("n"))

    QUERIES[name] = run


_BY = {label: (p, f) for group in (patterns.MARKERS, patterns.DYNAMIC) for label, p, f in group}
_counted("iso_date_markers", *_BY["iso date"])
_counted("uuid_markers", *_BY["uuid"])
_counted("id_hint_markers", *_BY["id hint"])
_counted("date_hint_markers", *_BY["date hint"])
_counted("prohibition_count", *_BY["prohibition"], "documents", "doc_id")
_counted("requirement_count", *_BY["requirement"], "documents", "doc_id")
_counted("quantity_count", *patterns.QUANTITIES[6][1:])
_counted("email_spans", *patterns.REGIONS[2][1:], "documents", "doc_id")


@query(f"WITH {PROMPTS} SELECT event_id, rtrim(regexp_extract(text, 'https?://[^\\s<>\"`)\\]]+'), '.,;:!?)]') AS url FROM prompts")
def url_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract("text", r"""https?://[^\s<>"`)\]]+""", 0)
    return prompts(spark, sf_dir).select("event_id", F.regexp_replace(found, r"[.,;:!?)\]]+$", "").alias("url"))


# Reports.


@query(f"SELECT doc_id, tokens, tokens > 500 AS over_budget, greatest(0, tokens - 500) AS over_by FROM (SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents) x")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))
    return reports.over_budget(counted, 500)


_BASE = (
    f"counted AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS tokens FROM conversations), "
    "files AS (SELECT a.conv_id, a.turn, a.tokens, b.tokens AS base_tokens FROM counted a LEFT JOIN counted b "
    "ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as files; the turn before is the base, which first turns lack."""
    now = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.estimated_tokens(F.col("text")).alias("tokens"))
    base = now.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("tokens").alias("base_tokens"))
    return now.join(base, ["conv_id", "turn"], "left")


@query(
    f"WITH {_BASE} SELECT conv_id, turn, tokens, base_tokens, tokens - base_tokens AS delta_tokens, "
    "CASE WHEN base_tokens > 0 THEN round(tokens / base_tokens - 1, 9) END AS delta_ratio FROM files"
)
def base_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.against_base(_files(spark, sf_dir))


@query(
    f"WITH {_BASE} SELECT COUNT(*) AS files, CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(SUM(base_tokens) AS BIGINT) AS base_tokens, "
    "CAST(SUM(tokens - base_tokens) AS BIGINT) AS delta_tokens, COUNT(*) FILTER (tokens > 500) AS over_budget FROM files"
)
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(reports.over_budget(_files(spark, sf_dir), 500))


@query(
    f"WITH {PROMPTS} SELECT event_id, 6 AS n, TRUE AS whole, 'json,url,variable' AS kinds FROM prompts"
)
def segment_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = frames.with_segments(prompts(spark, sf_dir).select("event_id", "text"))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    kinds = F.array_sort(F.array_distinct(F.array_compact(F.transform("segments", lambda s: s["kind"]))))
    return cut.select("event_id", F.size("segments").alias("n"), (joined == F.col("text")).alias("whole"), F.array_join(kinds, ",").alias("kinds"))


def _rewritten(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    out = frames.with_undone(frames.with_rewrite(prompts(spark, sf_dir).select("event_id", "text"), level))
    kept = F.coalesce(F.size(F.filter("checks", lambda c: ~c["preserved"] & (c["severity"] == "critical"))), F.lit(0))
    return out.select(
        "event_id",
        "output",
        F.size("changes").alias("changes"),
        F.size("blocked").alias("blocked"),
        kept.alias("critical_lost"),
        (F.col("undone") == F.col("text")).alias("undoable"),
    )


@query(
    f"WITH {PROMPTS} SELECT event_id, {BALANCED} AS output, 2 AS changes, 0 AS blocked, 0 AS critical_lost, TRUE AS undoable FROM prompts"
)
def compress_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir, "balanced")


@query(
    f"WITH {PROMPTS} SELECT event_id, {BALANCED} AS output, 2 AS changes, 0 AS blocked, 0 AS critical_lost, TRUE AS undoable FROM prompts"
)
def compress_aggressive_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir, "aggressive")


@query(
    "SELECT unnest(['politeness.please', 'sub.in-order-to']) AS rule_id, n AS total, unnest([n, 0]) AS lossy FROM (SELECT COUNT(*) AS n FROM events) x"
)
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.with_rewrite(prompts(spark, sf_dir).select("event_id", "text"), "balanced")
    each = out.select(F.explode("changes").alias("c")).select("c.rule_id", "c.lossy")
    return each.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("lossy").alias("lossy"))


@query(
    f"WITH {PROMPTS}, {STATED} SELECT event_id, type || ':' || start || '-' || \"end\" AS id, type, severity, anchor, CAST(start AS INTEGER) AS start, "
    "CAST(\"end\" AS INTEGER) AS \"end\", sentence, CAST(strpos(text, sentence) - 1 AS INTEGER) AS sentence_start, "
    "CAST(strpos(text, sentence) - 1 + length(sentence) AS INTEGER) AS sentence_end, label FROM placed"
)
def extract_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.with_constraints(prompts(spark, sf_dir).select("event_id", "text"))
    return found.select("event_id", F.explode("constraints").alias("c")).select("event_id", "c.*")


@query(
    f"WITH {PROMPTS}, {STATED} SELECT type, COUNT(*) AS total, COUNT(*) AS kept, CAST(list_position({_value(list(ledger.TYPES))}, type) AS BIGINT) AS place "
    "FROM placed GROUP BY type"
)
def checklist_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.with_rewrite(prompts(spark, sf_dir).select("event_id", "text"), "aggressive")
    each = out.select(F.explode("checks").alias("k"))
    order = F.array_position(F.array(*[F.lit(t) for t in ledger.TYPES]), F.col("type"))
    counted = each.groupBy(F.col("k.type").alias("type")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("k.preserved").alias("kept")
    )
    return counted.withColumn("place", order).orderBy("place")


@query(
    "SELECT event_id, 'prohibition' AS type, 'prohibition:0-' || (n - 1) || ',prohibition:' || (n + 1) || '-' || (n + n + 6) AS members, 0 AS start, "
    "round(8 / 9::DOUBLE, 9) AS similarity, sentence AS suggestion FROM (SELECT event_id, 'Never exceed the retry limit of ' || event_id || ' calls.' AS sentence, "
    "length('Never exceed the retry limit of ' || event_id || ' calls.') AS n FROM events) x"
)
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Never exceed the retry limit of "), "event_id", F.lit(" calls.\nNever exceed the retry limit of "), "event_id", F.lit(" calls today."))
    given = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    each = frames.with_duplicates(given).select("event_id", F.explode("duplicates").alias("d")).select("event_id", "d.*")
    return each.withColumns({"members": F.array_join("members", ","), "similarity": F.round("similarity", 9)})


@query(
    f"WITH {PROMPTS} SELECT event_id, text AS restored FROM prompts"
)
def restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = prompts(spark, sf_dir).select("event_id", "text", F.regexp_replace("text", r"Never exceed 5 retries\. ", "").alias("output"))
    return frames.with_restored(given).select("event_id", "restored")


@query(
    f"WITH {PROMPTS} SELECT event_id, CAST(strpos(text, 'User: what') - 1 AS INTEGER) AS boundary, CAST(strpos(text, 'user_id ') - 1 AS INTEGER) AS cacheable_end, "
    f"{_STABLE} AS reordered_prefix, {_VARIED} AS reordered_suffix, 5 AS markers FROM prompts"
)
def split_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = frames.with_layout(prompts(spark, sf_dir).select("event_id", "text"))
    return cut.select("event_id", "boundary", "cacheable_end", "reordered_prefix", "reordered_suffix", F.size("markers").alias("markers"))


@query(
    f"WITH {PROMPTS} SELECT event_id, {_STABLE} || chr(10) || chr(10) || '<!-- cache breakpoint: put cache_control {{\"type\": \"ephemeral\"}} on the last content "
    f"block above this line. -->' || chr(10) || chr(10) || {_VARIED} AS cache_ready, {_FIRST} || chr(10) || {_DATE} AS moved_lines, "
    "'Moved 2 per-request lines below the breakpoint; they cut the cacheable prefix short.' AS notes FROM prompts"
)
def cache_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = frames.with_cache_ready(prompts(spark, sf_dir).select("event_id", "text"), "anthropic")
    return laid.select("event_id", "cache_ready", *[F.array_join(c, "\n").alias(c) for c in ("moved_lines", "notes")])


@query(
    f"WITH {PROMPTS}, cut AS (SELECT *, strpos(text, 'in order to') - 1 AS spot FROM prompts) "
    "SELECT event_id, 'change' AS kind, 0 AS start, 8 AS \"end\", 'P' AS text, 'politeness.please:0:8' AS key, TRUE AS active FROM cut UNION ALL "
    "SELECT event_id, 'text', 8, CAST(spot AS INTEGER), substr(text, 9, spot - 8), NULL, NULL FROM cut UNION ALL "
    "SELECT event_id, 'change', CAST(spot AS INTEGER), CAST(spot + 11 AS INTEGER), 'to', 'sub.in-order-to:' || spot || ':' || (spot + 11), TRUE FROM cut UNION ALL "
    "SELECT event_id, 'text', CAST(spot + 11 AS INTEGER), CAST(length(text) AS INTEGER), substr(text, spot + 12), NULL, NULL FROM cut"
)
def diff_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = frames.with_diff(prompts(spark, sf_dir).select("event_id", "text"))
    return shown.select("event_id", F.explode("diff").alias("d")).select("event_id", "d.*")


@query(
    f"WITH {PROMPTS}, counted AS (SELECT event_id, {_TOKENS.format('text')} AS tokens, {_TOKENS.format(BALANCED)} AS after FROM prompts), "
    "files AS (SELECT a.*, b.tokens AS base_tokens FROM counted a LEFT JOIN counted b ON a.event_id = b.event_id + 1) "
    "SELECT COUNT(*) AS files, CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(SUM(base_tokens) AS BIGINT) AS base_tokens, "
    "CAST(SUM(tokens - base_tokens) AS BIGINT) AS delta_tokens, COUNT(*) FILTER (tokens > 60) AS over_budget, "
    f"round({_MONTH.format('SUM(tokens)')}, 6) AS monthly_cost, round({_MONTH.format('SUM(tokens - base_tokens)')}, 6) AS monthly_delta, "
    "CAST(0 AS BIGINT) AS duplicate_groups, CAST(SUM(tokens - after) AS BIGINT) AS saved_tokens, "
    f"round({_MONTH.format('SUM(tokens - after)')}, 6) AS monthly_saving, CAST(0 AS BIGINT) AS unverified FROM files"
)
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    given, parts = of_events(events), tasks(events)
    files = given.select(F.concat(F.lit("events/"), "event_id", F.lit(".md")).alias("path"), F.col("text").alias("content"))
    base = given.select(F.concat(F.lit("events/"), F.col("event_id") + 1, F.lit(".md")).alias("path"), F.col("text").alias("base_content"))
    # Both sides are dealt by path into short tasks, which the join keeps; its own are as few as their bytes allow.
    files, base = files.repartition(parts, "path"), base.repartition(parts, "path")
    found = reports.totals(reports.analyse(files.join(base, "path", "left"), "claude-opus-5", budget=60))
    return found.withColumns({c: F.round(c, 6) for c in ("monthly_cost", "monthly_delta", "monthly_saving")})


@query(
    f"WITH {PROMPTS}, levels AS (SELECT event_type AS corpus, 'light' AS level, text, text AS output FROM prompts UNION ALL "
    f"SELECT event_type, unnest(['balanced', 'aggressive']), text, {BALANCED} FROM prompts), counted AS (SELECT corpus, level, "
    f"{_TOKENS.format('text')} AS before, {_TOKENS.format('output')} AS after FROM levels) SELECT corpus, level, COUNT(*) AS prompts, "
    "round(AVG(1 - after / before), 9) AS avg_reduction, round(1 - SUM(after) / SUM(before), 9) AS aggregate_reduction, "
    "COUNT(*) * 9 AS critical, COUNT(*) * 9 AS critical_kept, CAST(0 AS BIGINT) AS blocked FROM counted GROUP BY corpus, level"
)
def bench_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.bench(prompts(spark, sf_dir).select(F.col("event_type").alias("corpus"), "text"))
    return found.withColumns({c: F.round(c, 9) for c in ("avg_reduction", "aggregate_reduction")})


@query(
    f"WITH {PROMPTS} SELECT event_id, 'Please event in to Never 5 You answer JSON user_id Current ' || strftime(ts, '%Y-%m-%d') || substr(text, strpos(text, 'https://')) AS output, "
    "7 AS lost FROM prompts"
)
def local_ml_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.with_model_rewrite(prompts(spark, sf_dir).select("event_id", "text"), lambda s: " ".join(s.split()[::2]))
    return frames.with_checks(out).select("event_id", "output", F.size(F.filter("checks", lambda c: ~c["preserved"])).alias("lost"))


@query(
    f"WITH {PROMPTS}, whole AS (SELECT p.*, e.props FROM prompts p JOIN events e USING (event_id)) SELECT event_id, text, 'Please process event ' || event_id || ' in order to ' || event_type || "
    "'.' || chr(10) || 'You must answer in JSON for user_id ' || user_id || '.' || chr(10) || 'See https://example.org/e/' || event_id || '.' || chr(10) || 'Props: ' || props || chr(10) || "
    "'Never exceed 5 retries.' || chr(10) || 'Never exceed 5 retries.' || chr(10) || 'Current date: ' || strftime(ts, '%Y-%m-%d') || chr(10) || 'User: what about {{topic}}?' AS output, "
    "1 AS repairs, 4 AS calls, 0 AS lost, CAST(NULL AS VARCHAR) AS error FROM whole"
)
def ai_pipeline_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.model_pipeline(prompts(spark, sf_dir).select("event_id", "text"), reports.HalvingClient())


@query(
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unjudged' WHEN own AND event_id % 3 = 0 THEN 'agree-kept' WHEN own THEN 'local-only' "
    "WHEN event_id % 3 = 0 THEN 'model-only' ELSE 'agree-lost' END AS agreement FROM (SELECT event_id, event_type <> 'error' AS own FROM events) x"
)
def verifier_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = prompts(spark, sf_dir).select(
        "event_id", "text", F.expr(_REWRITE).alias("output"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3 == 0).alias("model")
    )
    # The ledger's verdict on the prohibition beside a model's, which is missing at times.
    own = F.exists("checks", lambda k: (k["type"] == "prohibition") & k["preserved"])
    return frames.with_checks(given).select("event_id", reports.agreement(own, F.col("model")).alias("agreement"))
