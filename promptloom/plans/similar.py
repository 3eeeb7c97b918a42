"""Groups of near-duplicate token sets across a whole corpus: an exact similarity self-join and its components.

Two sets are linked if their Jaccard similarity reaches a threshold; a group is what links
connect. Equal sets are one row with a count before anything is joined. A token that only
one set holds can't be shared, so sets that agree in everything but such tokens are one
class: similarity is the same for all pairs of two classes, and within a class, whatever
their number. Slots of a template that are filled differently in every prompt thus cost
one row.

Classes meet on the tokens of their prefixes: tokens ordered from the rarest on, of which
the last ones may be left out, because a similar set must share one before them. A token
that more than ``HOT`` classes have in their prefixes is split: its classes meet on that
token and a second one from prefixes one token longer, for similar sets share two tokens,
unless they are so small that one will do; those keep the single token among themselves.
What meets is a row of numbers whose width doesn't depend on the set: two bounds, by what
is left behind the met token and by a bitmap of the tokens, drop pairs that can't be
similar. The others are compared exactly, so nothing is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

SIMILAR, HOT = 0.6, 4000
MAX_ROUNDS = 60
# Words of 64 bits that a class's bitmap has.
WORDS = 4
BITMAP = [f"bits{i}" for i in range(WORDS)]


def set_name(kind: Column, tokens: Column) -> Column:
    """The name of a token set of a kind; null if there are no tokens."""
    return F.md5(F.concat(F.coalesce(kind, F.lit("\u0003")), F.lit("\u0001"), F.array_join(tokens, "\u0002")).cast("binary"))


def token_sets(items: DataFrame, kind: str, tokens: str) -> DataFrame:
    """(kind, set, id, n): the distinct token sets of ``items`` and how many items have each; empty ones have none."""
    own = items.select(F.col(kind).cast("string").alias("kind"), F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("set"))
    sets = own.where(F.size("set") > 0).groupBy("kind", "set").agg(F.count(F.lit(1)).alias("n"))
    return sets.withColumn("id", set_name(F.col("kind"), F.col("set")))


def classes(sets: DataFrame) -> DataFrame:
    """(kind, no, class, core, size) of numbered ``token_sets``: shared tokens from the rarest on, and the set's size.

    Sets of one class have the same core and size; their other tokens are in no other set.
    """
    each = sets.select("kind", "no", F.explode("set").alias("token"))
    # A token that many sets hold is a hot key of this join, whose other side has it once.
    held = each.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("held"))
    known = each.alias("e").join(held.alias("h"), F.col("e.kind").eqNullSafe(F.col("h.kind")) & (F.col("e.token") == F.col("h.token")))
    ranked = known.groupBy("e.kind", "e.no").agg(
        F.array_sort(F.collect_list(F.when(F.col("held") > 1, F.struct("held", "e.token")))).alias("shared"), F.count(F.lit(1)).cast("int").alias("size")
    )
    core = F.transform("shared", lambda x: x["token"])
    name = F.md5(F.concat(F.coalesce("kind", F.lit("\u0003")), F.lit("\u0001"), F.array_join("core", "\u0002"), F.lit("\u0001"), "size").cast("binary"))
    return ranked.select("kind", "no", core.alias("core"), "size").withColumn("class", name)


def numbered(placed: DataFrame) -> DataFrame:
    """(kind, class, core, size, node, bits..): the classes, each with a number and a bitmap of its core."""
    nodes = placed.groupBy("kind", "class", "core", "size").agg(F.count(F.lit(1)).alias("members"))

    def bits(word: int) -> Column:
        def one(acc: Column, token: Column) -> Column:
            own = F.pmod(F.xxhash64(token), F.lit(64 * WORDS))
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(own, F.lit(64)).cast("int"))
            return F.when(F.floor(own / 64) == word, acc.bitwiseOR(bit)).otherwise(acc)

        return F.aggregate("core", F.lit(0).cast("long"), one)

    return nodes.select("kind", "class", "core", "size", F.monotonically_increasing_id().alias("node"), *[bits(i).alias(c) for i, c in enumerate(BITMAP)])


def least_shared(size: Column, threshold: float) -> Column:
    """How many tokens a set of ``size`` shares at least with any similar one."""
    return F.ceil(size * threshold - 1e-9).cast("int")


def similar_enough(shared: Column, one: Column, other: Column, threshold: float) -> Column:
    return shared >= threshold * (one + other - shared) - 1e-9


def _keys(nodes: DataFrame, threshold: float, hot: int) -> DataFrame:
    """(key, node, size, shared, left, bits..): each class with each key at which it may meet a similar one; numbers only.

    ``shared`` is the size of its core, ``left`` how many tokens of that stand from the
    key's first token on. Keys are hashes, of which equal ones bring too many together, not too few.
    """
    least = least_shared(F.col("size"), threshold)
    # Tokens that no other set holds come first in the order, and are met by none.
    length = F.greatest(F.lit(0), F.col("size") - least + 1 - (F.col("size") - F.size("core")))
    told = nodes.select("node", "size", F.size("core").alias("shared"), *BITMAP, F.transform("core", lambda t: F.xxhash64("kind", t)).alias("hashes"), length.alias("length"))
    prefix, longer = F.slice("hashes", F.lit(1), F.col("length")), F.slice("hashes", F.lit(1), F.least(F.col("length") + 1, F.col("shared")))
    open_ = told.select("node", "size", "shared", *BITMAP, prefix.alias("prefix"), longer.alias("longer")).where(F.size("prefix") > 0).withColumn("small", least < 2)
    crowded = open_.select(F.explode("prefix").alias("one")).groupBy("one").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") > hot)
    crowded = staged(crowded.select("one", F.lit(True).alias("crowded")), "crowded")
    columns = ["node", "size", "shared", (F.col("shared") - F.col("at")).alias("left"), *BITMAP]
    if crowded.isEmpty():
        single = open_.select("*", F.posexplode("prefix").alias("at", "one"))
        return single.select(F.xxhash64("one", F.lit(0)).alias("key"), *columns)
    single = open_.select("*", F.posexplode("prefix").alias("at", "one"))
    known = single.join(crowded, "one", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    alone = known.where(~F.col("crowded") | F.col("small")).select(F.xxhash64("one", F.lit(0)).alias("key"), *columns)
    later = F.slice("longer", F.col("at") + 2, F.size("longer"))
    pairs = known.where("crowded").select("*", F.explode(later).alias("two")).select(F.xxhash64("one", "two").alias("key"), *columns)
    return alone.unionByName(pairs)


def links(nodes: DataFrame, threshold: float = SIMILAR, hot: int = HOT) -> DataFrame:
    """(a, b) of distinct classes, by number, that are similar, a before b."""
    keys = _keys(nodes, threshold, hot)
    a, b = keys.alias("a"), keys.alias("b")
    lengths = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * threshold - 1e-9
    # What two classes share, if the met token is the first one that they do.
    behind = similar_enough(F.least("a.left", "b.left"), F.col("a.size"), F.col("b.size"), threshold)
    # A bit that only one of them has is a token that only one of them has.
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in BITMAP])
    alike = similar_enough((F.col("a.shared") + F.col("b.shared") - apart) / 2, F.col("a.size"), F.col("b.size"), threshold)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & lengths & behind & alike)
    maybe = met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    one = nodes.select(F.col("node").alias("a"), F.col("kind").alias("kind_a"), F.col("core").alias("core_a"), F.col("size").alias("size_a"))
    other = nodes.select(F.col("node").alias("b"), F.col("kind").alias("kind_b"), F.col("core").alias("core_b"), F.col("size").alias("size_b"))
    both = maybe.join(one, "a").join(other, "b").where(F.col("kind_a").eqNullSafe(F.col("kind_b")))
    shared = F.size(F.array_intersect("core_a", "core_b"))
    return both.where(similar_enough(shared, F.col("size_a"), F.col("size_b"), threshold)).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of all ends of (a, b): the least id that links lead to.

    In each round every group takes the least root that one of its members sees next to
    it, then roots are followed twice, so groups of any shape are done in a number of
    rounds that grows with the logarithm of their length.
    """
    both = staged(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        seen = both.join(now.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("seen"))
        # What a group's members see, and what its root, as a member of another group, has.
        told = now.join(seen, "id").groupBy("root").agg(F.min(F.least("seen", "root")).alias("to"))
        own = now.select(F.col("id").alias("root"), F.col("root").alias("own"))
        told = staged(told.join(own, "root", "left").select("root", F.least("to", F.coalesce("own", "to")).alias("to")), "told")
        if told.where(F.col("to") != F.col("root")).isEmpty():
            return now
        for _ in range(2):
            onward = told.select(F.col("root").alias("to"), F.col("to").alias("further"))
            told = told.join(onward, "to", "left").select("root", F.coalesce("further", "to").alias("to"))
        now = staged(now.join(told, "root").select("id", F.col("to").alias("root")), "roots")
    raise RuntimeError("groups did not settle")


def near_sets(items: DataFrame, kind: str, tokens: str, threshold: float = SIMILAR, hot: int = HOT) -> DataFrame:
    """(kind, set, n, id, root): each distinct token set of ``items``, its ``set_name``, and a name that its group shares."""
    sets = staged(token_sets(items, kind, tokens).withColumn("no", F.monotonically_increasing_id()), "sets")
    placed = staged(classes(sets), "classes")
    nodes = staged(numbered(placed), "nodes")
    found = components(links(nodes, threshold, hot)).withColumnRenamed("id", "node")
    # A class is connected if its own members are similar or if it has a link.
    alike = similar_enough(F.size("core"), F.col("size"), F.col("size"), threshold)
    told = nodes.select("class", "node", alike.alias("alike")).join(found, "node", "left")
    group = F.coalesce("root", F.when(F.col("alike"), F.col("node")))
    rooted = placed.select("no", "class").join(told, "class").select("no", F.coalesce(F.concat(F.lit("c"), group), F.concat(F.lit("s"), "no")).alias("root"))
    return sets.join(staged(rooted, "rooted"), "no").select("kind", "set", "n", "id", "root")


def near_groups(items: DataFrame, kind: str, tokens: str, threshold: float = SIMILAR, hot: int = HOT) -> DataFrame:
    """(kind, set, n, group): each distinct token set of ``items`` with the first set, in order, of its group.

    Sets of unequal ``kind`` are never linked; a null kind is one of its own. An empty
    table gives an empty one; items without tokens are in no group.
    """
    named = near_sets(items, kind, tokens, threshold, hot)
    first = named.groupBy("root").agg(F.min("set").alias("group"))
    return named.join(first, "root").select("kind", "set", "n", "group")


def near_demands(constraints: DataFrame, kinds: tuple[str, ...], tokens: Column, least: int = 3, threshold: float = SIMILAR) -> DataFrame:
    """(type, demands, prompts, suggestion) of (id, type, anchor): demands that prompts state in nearly the same words.

    A row per group with more than one token set; the suggestion is its shortest anchor,
    the first in order of equal ones. What depends on the words alone is worked out once
    per set; only ids of groups that stay are told apart.
    """
    worded = constraints.where(F.col("type").isin(*kinds)).select("id", "type", "anchor", tokens.alias("tokens"))
    worded = worded.where(F.size("tokens") >= least).select("id", "type", "anchor", F.array_sort(F.array_distinct("tokens")).alias("set"))
    worded = staged(worded.withColumn("of", set_name(F.col("type"), F.col("set"))), "demands")
    anchors = worded.groupBy("type", "of", "anchor").agg(F.first("set").alias("set"))
    sets = near_sets(anchors, "type", "set", threshold).select(F.col("id").alias("of"), "root")
    several = sets.groupBy("root").agg(F.count(F.lit(1)).alias("demands")).where(F.col("demands") > 1)
    kept = staged(sets.join(several, "root"), "kept")
    said = anchors.join(kept, "of").groupBy("root", "type", "demands").agg(F.min_by("anchor", F.struct(F.length("anchor"), "anchor")).alias("suggestion"))
    stated = worded.select("of", "id").join(kept, "of").select("root", "id").distinct()
    prompts = stated.groupBy("root").agg(F.count("id").alias("prompts"))
    return said.join(prompts, "root").select("type", "demands", "prompts", "suggestion")
