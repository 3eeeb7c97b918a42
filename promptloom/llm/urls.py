"""URL filters: host and path rules, and gradient-boosted trees for the rest.

A rule fits its host and all subdomains where the path starts as the rule's; the
longest rule wins. URLs that a rule decides are the labelled ones: trees are
trained on a bounded sample of them (at most ``TRAIN_ROWS`` distinct urls, by a hash, in
proportion to each verdict's distinct urls, but at least a tenth of the sample for each
where there are so many), by lexical features only, and judge the
URLs that no rule fits. Features: lengths, depth, digit ratio, entropies, counts
of parameters and separators, and smoothed allow rates of the host's last labels
and first path part in the training rows.

Rules and trees are small; scoring is row by row and shuffles nothing, so a host
with most rows is no matter.

Defined cases: a null url, or one without ``://``, has an empty host and path and
is judged by the trees; urls of any length count in whole; repeated rows give a
row each; rules that tie in length can't both fit; without labels of both kinds the trees give the share of allowed ones
(allow if there are none); an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# Labelled URLs that training looks at, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAF = 40, 4, 0.2, 32, 20
SMOOTH = 5.0
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
AFTER = re.compile(r"([^/?#]*)([^?#]*)(\??[^#]*)", re.S)


def parts(url: str | None) -> tuple[str, str, str]:
    """Host, path and query of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", ""
    host, path, query = AFTER.match(rest).groups()
    return host.translate(LOWER), path, query


class Rules:
    """Rules by host, each host's longest path first."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host[host].append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict."""
        found, at = None, 0
        while at >= 0:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (found is None or len(rule) > len(found[0])):
                    found = rule, verdict
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return found if host else None


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str, path: str) -> tuple[str, ...]:
    """The host's last label, its last two, and the first part of the path."""
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), "/" + path.split("/", 2)[1] if path.startswith("/") else ""


def lexical(url: str | None) -> list[float]:
    host, path, query = parts(url)
    whole = url or ""
    digits = sum(map(str.isdigit, whole))
    segments = [s for s in path.split("/") if s]
    return [
        len(whole),
        len(host),
        len(path),
        len(query),
        host.count(".") + 1,
        len(segments),
        max(map(len, segments), default=0),
        digits / max(1, len(whole)),
        sum(map(str.isdigit, host)),
        entropy(host),
        entropy(path),
        query.count("&") + ("=" in query),
        whole.count("-"),
        host.count("-"),
        whole.count("_") + whole.count("%"),
        float(path.endswith("/")),
        float("#" in whole),
        float(whole.startswith("https:")),
    ]


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)], 1)


class Trees:
    """Boosted trees of the logistic loss over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = bin_edges(x)
        b = binned(x, self.edges)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = math.log(p / (1 - p))
        self.trees: list[list[tuple]] = []
        margin = np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree: list[tuple] = []
            step = np.zeros(len(y))
            self._grow(b, y - p, p * (1 - p), np.arange(len(y)), DEPTH, tree, step)
            margin += RATE * step
            self.trees.append(tree)

    def _grow(self, b, g, h, rows, depth, tree, step) -> int:
        """Append the node of ``rows``; its number. Nodes: (feature, bin, left, right) or (value,)."""
        at = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if depth and len(rows) >= 2 * LEAF:
            base = total_g**2 / (total_h + 1)
            for f in range(b.shape[1]):
                c = b[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(c, w, BINS + 1)) for w in (g[rows], h[rows], None))
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - base
                gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] < 0:
            tree.append((total_g / (total_h + 1),))
            step[rows] = tree[at][0]
            return at
        tree.append(())
        left = b[rows, best[1]] <= best[2]
        tree[at] = (
            best[1],
            best[2],
            self._grow(b, g, h, rows[left], depth - 1, tree, step),
            self._grow(b, g, h, rows[~left], depth - 1, tree, step),
        )
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        margin = np.full(len(x), self.bias)
        for tree in self.trees:
            waiting = [(0, np.arange(len(x)))]
            while waiting:
                node, rows = waiting.pop()
                if len(tree[node]) == 1:
                    margin[rows] += RATE * tree[node][0]
                elif len(rows):
                    f, cut, left, right = tree[node]
                    low = b[rows, f] <= cut
                    waiting += [(left, rows[low]), (right, rows[~low])]
        return 1 / (1 + np.exp(-margin))


class Judge:
    """Allow probability of urls, from (url, allowed) rows."""

    def __init__(self, rows: list[tuple[str | None, bool]]):
        y = np.array([float(a) for _, a in rows])
        self.prior = float(y.mean()) if len(y) else 1.0
        self.rates: list[dict[str, tuple[float, int]]] = [{}, {}, {}]
        self.trees = None
        if len(set(y.tolist())) < 2:
            return
        sums: list[dict[str, list[float]]] = [defaultdict(lambda: [0.0, 0.0]) for _ in range(3)]
        names = [suffixes(*parts(u)[:2]) for u, _ in rows]
        for name, a in zip(names, y.tolist(), strict=True):
            for of, n in zip(sums, name, strict=True):
                of[n][0] += a
                of[n][1] += 1
        self.rates = [{k: (a, int(n)) for k, (a, n) in of.items()} for of in sums]
        # A training row's own label is left out of its rates.
        own = np.array([[self._rate(i, n, a) for i, n in enumerate(name)] for name, a in zip(names, y.tolist(), strict=True)])
        x = np.hstack([np.array([lexical(u) for u, _ in rows]), own])
        self.trees = Trees(x, y)

    def _rate(self, which: int, name: str, own: float | None = None) -> float:
        allowed, n = self.rates[which].get(name, (0.0, 0))
        if own is not None:
            allowed, n = allowed - own, n - 1
        return (allowed + SMOOTH * self.prior) / (n + SMOOTH)

    def allow(self, urls: list[str | None]) -> np.ndarray:
        if self.trees is None or not urls:
            return np.full(len(urls), self.prior)
        rates = [[self._rate(i, n) for i, n in enumerate(suffixes(*parts(u)[:2]))] for u in urls]
        return self.trees.predict(np.hstack([np.array([lexical(u) for u in urls]), np.array(rates)]))


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, judge: Judge | None = None, id_col: str = "page_id") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, allow) of every row; without a judge, verdict is the rule's."""
    shared = pages.sparkSession.sparkContext.broadcast((Rules(rules), judge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, model = shared.value
        for batch in batches:
            urls = batch.column(1).to_pylist()
            cut = [parts(u) for u in urls]
            hits = [book.find(h, p) for h, p, _ in cut]
            open_rows = [i for i, h in enumerate(hits) if h is None]
            chance: list[float | None] = [None] * len(urls)
            if model is not None:
                for i, a in zip(open_rows, model.allow([urls[i] for i in open_rows]).tolist(), strict=True):
                    chance[i] = a
            verdicts = [
                h[1] if h else None if a is None else "allow" if a >= 0.5 else "block" for h, a in zip(hits, chance, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([c[0] for c in cut], pa.string()),
                    pa.array([c[1] for c in cut], pa.string()),
                    pa.array([h[0] if h else None for h in hits], pa.string()),
                    pa.array(verdicts, pa.string()),
                    pa.array(chance, pa.float64()),
                ],
                names=["page_id", "url", "host", "path", "rule", "verdict", "allow"],
            )

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return narrow.mapInArrow(
        run, "page_id long, url string, host string, path string, rule string, verdict string, allow double"
    )


def train(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, rows: int = TRAIN_ROWS) -> Judge:
    """Trees from at most ``rows`` distinct urls that rules decide, by a hash of the url."""
    # Staged, so that pages are judged once for the counts and the draws.
    labelled = stage(ruled(pages, rules).where("rule is not null").select("verdict", "url", F.xxhash64("url").alias("hash")), "labelled")
    kinds = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.approx_count_distinct("url").alias("n")).collect()}
    whole, some = sum(kinds.values()), []
    for verdict, n in sorted(kinds.items()):
        most = int(rows * min(0.9, max(0.1, n / whole))) if len(kinds) > 1 else rows
        # Only a share of the hashes that leaves somewhat more than ``most`` urls is sorted and sent.
        share = min(1.0, 1.5 * most / max(n, 1) + 100 / max(n, 1))
        low = int(-(1 << 63) + share * ((1 << 64) - 1))
        drawn = labelled.where((F.col("verdict") == verdict) & (F.col("hash") <= min(low, (1 << 63) - 1))).select("hash", "url").distinct()
        some += [(r["hash"], r["url"], verdict == "allow") for r in drawn.orderBy("hash", "url").limit(most).collect()]
    return Judge([(u, a) for _, u, a in sorted(some)])


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    return ruled(pages, rules, train(pages, rules))
