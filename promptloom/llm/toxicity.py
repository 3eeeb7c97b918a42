"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Kernel: words share subsequences of three characters, each weighted by
``DECAY`` to the power of the stretch it covers (at most ``REACH`` characters),
so that gapped or padded spellings still match. Words carry begin and end
marks. A word's self-weight is taken for its length, which keeps the kernel
positive definite and makes a word's score a sum over its subsequences.

Training, on a bounded sample of labelled rows outside the held-out part:
landmarks are words that stand in toxic texts more often than chance explains, with
frequent words of clean texts as contrast; words are mapped to the landmarks' span
(Nyström); a linear SVM is trained on sentences as bags of words. It starts with the
landmarks as toxic words. Then, in each round, each toxic text answers for its highest
sentence and that for its highest word, whether a landmark or not, clean texts answer
for all their words, of which the highest are mined; landmarks also enter in gapped,
padded and doubled spellings. A logistic curve over the rest of the sample, weighted to
the labels' own balance, gives the score.

Scoring: Arrow finds a block's distinct words, one table of subsequence weights
scores them, a text takes its highest word. Runs of single characters also count
as one joined word, long words in overlapping windows.

Defined cases: a null, empty or blank text scores as one without any word; very
long texts go in whole; labels given twice count as toxic if one says so; null
labels are left out; without labels of both kinds every score is 0; repeated
rows give a row each; a null id is in no part, so its ``held_out`` is null; ties of
words go to the later one in code points; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled rows of each kind that training looks at, at most.
TRAIN_ROWS = 3000
TOXIC_LANDMARKS = 160
CLEAN_LANDMARKS = 40
DECAY = 0.7
# Rounds of mining, and the clean words that each adds.
ROUNDS, MINED = 4, 1000
# Weight of a word on the wrong side of the margin.
COST = 100.0
# Times a text is covered by landmarks, and clean texts per toxic one that may hold a landmark.
COVER, CLEAN_SHARE = 3, 0.02
REACH = 6
ALPHABET = 64
# Longest stretch scored as one word, and the step of windows over longer ones.
WINDOW, STEP = 28, 14
# Bytes of text whose words are scored together.
BLOCK = 4_000_000
THRESHOLD = 0.3
PAD, BEGIN, END = "\n" * REACH, "\x02", "\x03"
EDGE = "\"'.,;:!?()[]{}<>«»“”‘’…|"
OFFSETS = [(i, j) for j in range(2, REACH) for i in range(1, j)]


def _codes() -> np.ndarray:
    """Code of each character below U+0250; 0 separates."""
    code = np.full(0x250, 30, dtype=np.int32)
    code[ord("\n")] = 0
    code[ord(BEGIN)], code[ord(END)] = 1, 2
    for c in range(26):
        code[ord("a") + c] = code[ord("A") + c] = 3 + c
    for c in range(10):
        code[ord("0") + c] = 31 + c % 5
    code[0xC0:0x250] = 36 + np.arange(0xC0, 0x250) % 24
    code[0xC0:0xE0] = code[0xE0:0x100]
    return code


CODES = _codes()


def self_weight(n: np.ndarray) -> np.ndarray:
    """Sum of squared weights of all subsequences of a word of ``n`` marked characters."""
    total = np.zeros(len(n))
    for _, far in OFFSETS:
        total += np.maximum(n - far, 0) * DECAY ** (2 * (far + 1))
    return np.maximum(total, DECAY**6)


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character codes of marked words, their starts, and their marked lengths."""
    text = "".join([BEGIN + w + END + PAD for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(points < 0x250, CODES[np.minimum(points, 0x24F)], 60 + points % 4).astype(np.int32)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + len(PAD))[:-1]])
    return codes, starts, lengths


def triples(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each pair of offsets its stretch and the triple that begins at each character."""
    high = codes * (ALPHABET * ALPHABET)
    for near, far in OFFSETS:
        n = len(codes) - far
        ids = high[:n] + codes[near : near + n] * ALPHABET + codes[far:]
        yield far + 1, ids


class Kernel:
    """Explicit subsequence features of few words, restricted to a set of triples."""

    def __init__(self, words: list[str]):
        ids, *_ = self._entries(words)
        self.known = np.unique(ids)

    @staticmethod
    def _entries(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, starts, lengths = encode(words)
        owner = np.repeat(np.arange(len(words)), lengths + len(PAD))
        parts = []
        for stretch, ids in triples(codes):
            n = len(ids)
            far = stretch - 1
            whole = (codes[:n] > 0) & (codes[far:] > 0) & (ids % (ALPHABET * ALPHABET) >= ALPHABET)
            parts.append((ids[whole], owner[:n][whole], np.full(whole.sum(), DECAY**stretch)))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def features(self, words: list[str]) -> np.ndarray:
        ids, owner, weight = self._entries(words)
        at = np.searchsorted(self.known, ids)
        hit = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == ids)
        flat = np.bincount(owner[hit] * len(self.known) + at[hit], weight[hit], len(words) * len(self.known))
        lengths = np.array([len(w) + 2 for w in words])
        return flat.reshape(len(words), -1) / np.sqrt(self_weight(lengths))[:, None]


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW + STEP, STEP)]


def readings(word: str) -> list[str] | None:
    """What is scored for a word besides itself: its letters alone, its windows; None if nothing."""
    if len(word) <= WINDOW and (word.isalnum() or not word):
        return None
    letters = "".join([c for c in word if c.isalpha()])
    return windows(word) + (windows(letters) if letters != word and len(letters) >= 4 else [])


def score_words(words: list[str], table: np.ndarray) -> np.ndarray:
    """The SVM's value, without its constant, of each word."""
    if not words:
        return np.zeros(0)
    cut = [readings(w) for w in words]
    flat = [w for w, c in zip(words, cut, strict=True) for w in (c or (w,))]
    codes, starts, lengths = encode(flat)
    total = np.zeros(len(codes), dtype=np.float32)
    for stretch, ids in triples(codes):
        total[: len(ids)] += table[ids] * np.float32(DECAY**stretch)
    sums = np.add.reduceat(total, starts) / np.sqrt(self_weight(lengths))
    if len(flat) == len(words):
        return sums
    first = np.concatenate([[0], np.cumsum([len(c) if c else 1 for c in cut])[:-1]])
    return np.maximum.reduceat(sums, first)


def _solve(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear SVM (hinge loss) by dual coordinate descent; the last column of ``x`` is constant."""
    weight, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(1)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ weight) - 1) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                weight += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weight


def disguised(word: str) -> list[str]:
    """Gapped, doubled and padded spellings of a word."""
    middle = len(word) // 2
    return [
        word[:middle] + "*" + word[middle:],
        word[: middle + 1] + word[middle:],
        word[:middle] + "x" + word[middle:],
    ]


def text_words(text: str) -> list[set[str]]:
    """The words of each sentence."""
    return [
        {w for w in (x.strip(EDGE) for x in s.lower().split()) if w} for s in re.split(r"(?<=[.!?])\s+|\n", text)
    ]


def _tail(m: int, n: int, p: float) -> float:
    """Log of P(X <= m) for X binomial (n, p), by its largest term and at most ``m + 1`` of them."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(m + 1)]
    return max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))


def _cover(toxic: list[set[str]], clean: Counter, clean_texts: int, most: int) -> list[str]:
    """Words that cover toxic texts best, each text up to ``COVER`` times.

    Only words that stand in toxic texts more often than chance lets the likeliest of
    all candidates do so.
    """
    count = Counter(w for t in toxic for w in t)
    tried = {w: n for w, n in count.items() if n >= 2 and clean[w] <= CLEAN_SHARE * n and 3 <= len(w) <= WINDOW}
    share = clean_texts / (clean_texts + len(toxic))
    apart = {w: n for w, n in tried.items() if _tail(clean[w], n + clean[w], share) <= -math.log(len(tried))}
    left = Counter(apart)
    need = [COVER] * len(toxic)
    where: dict[str, list[int]] = {}
    for i, t in enumerate(toxic):
        for w in t:
            if w in apart:
                where.setdefault(w, []).append(i)
    found: list[str] = []
    while len(found) < most and left:
        word = max(left, key=lambda w: (left[w], w))
        if left[word] < 1:
            break
        del left[word]
        found.append(word)
        for i in where[word]:
            need[i] -= 1
            if not need[i]:
                left.subtract(w for w in toxic[i] if w in left)
    return found


class Model:
    """Weights of subsequences, and the curve from the SVM's value to a score."""

    def __init__(self, table: np.ndarray, low: float, slope: float, shift: float):
        self.table, self.low, self.slope, self.shift = table, low, slope, shift

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -40, 40)))


def train(rows: Iterable[tuple[int, str]], toxic_landmarks: int = TOXIC_LANDMARKS, balance: tuple[float, float] = (1.0, 1.0)) -> Model:
    """``rows``: (toxic 0/1, text) of labelled texts; ``balance``: how many rows each clean and each toxic one stands for."""
    texts = [(bool(y), text_words(t or "")) for y, t in rows]
    fit = [x for i, x in enumerate(texts) if i % 4]
    rest = [x for i, x in enumerate(texts) if not i % 4]
    nothing = Model(np.zeros(ALPHABET**3, dtype=np.float32), 0.0, 0.0, -40.0)
    toxic = [set().union(*s) for y, s in fit if y]
    clean = Counter(w for y, s in fit if not y for w in set().union(*s))
    if not toxic or not clean:
        return nothing
    marks = _cover(toxic, clean, sum(not y for y, _ in fit), toxic_landmarks)
    if not marks:
        return nothing
    landmarks = marks + [w for w, _ in clean.most_common(CLEAN_LANDMARKS) if len(w) <= WINDOW]
    kernel = Kernel(landmarks)
    of_marks = kernel.features(landmarks)
    values, vectors = np.linalg.eigh(of_marks @ of_marks.T)
    keep = values > 1e-6 * values.max()
    project = vectors[:, keep] / np.sqrt(values[keep])

    def features(words: list[str]) -> np.ndarray:
        inner = np.concatenate([kernel.features(words[i : i + 500]) @ of_marks.T for i in range(0, len(words), 500)])
        return np.hstack([inner @ project, np.ones((len(words), 1))])

    def as_table(weight: np.ndarray) -> np.ndarray:
        table = np.zeros(ALPHABET**3, dtype=np.float32)
        table[kernel.known] = (project @ weight[:-1]) @ of_marks
        return table

    # A toxic text is a bag of sentences, of which one at least is toxic; a sentence is its highest word.
    bags = [found for y, text in fit if y and (found := [s for s in text if s])]
    toxic_words = sorted(set().union(*toxic))
    clean_words = sorted(clean)
    rng = np.random.default_rng(0)
    negatives = set(rng.choice(clean_words, min(1500, len(clean_words)), replace=False).tolist())
    witness, chosen = Counter(marks), set(marks)
    weight = np.zeros(1)
    for _ in range(ROUNDS):
        varied = [v for w in marks for v in disguised(w)]
        known = sorted(witness)
        positive = [*known, *varied]
        negative = sorted(negatives - set(positive))
        x = features(positive + negative)
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        cost = np.array([COST] * len(known) + [COST / 5] * len(varied) + [COST] * len(negative))
        weight = _solve(x, y, cost)
        table = as_table(weight)
        mined = score_words(clean_words, table)
        negatives |= {clean_words[i] for i in np.argsort(-mined)[:MINED]}
        # Of each text the toxic sentence, and of that its highest word, if no clean text has it.
        value = dict(zip(toxic_words, (score_words(toxic_words, table) + weight[-1]).tolist(), strict=True))
        witness = Counter()
        for bag in bags:
            sentence = max(bag, key=lambda words: max(value[w] for w in words))
            word = max(sentence, key=lambda w: (value[w], w))
            if value[word] > 0 and len(word) <= WINDOW and (clean[word] == 0 or word in chosen):
                witness[word] += 1
        if not witness:
            break
    table = as_table(weight)
    if not rest or len({y for y, _ in rest}) < 2:
        rest = texts
    top = [(y, max((score_words(sorted(s), table).max() for s in text if s), default=float(-weight[-1]))) for y, text in rest]
    value, label = np.array([v for _, v in top]), np.array([float(y) for y, _ in top])
    slope, shift = _logistic(value, label, balance)
    return Model(table, float(value.min()), slope, shift)


def _logistic(value: np.ndarray, label: np.ndarray, balance: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float]:
    """Slope and shift of a logistic curve, targets smoothed, rows weighted by ``balance``."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.array(balance)[label.astype(int)]
    weight /= max(weight.sum(), 1.0)
    x = np.stack([value, np.ones_like(value)], 1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-5 * at
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-5 * np.eye(2)
        at -= np.linalg.solve(curve, grad)
    return max(float(at[0]), 0.0), float(at[1])


def _joined(words: pa.Array, lists: np.ndarray) -> dict[int, list[str]]:
    """Of each text its runs of four or more single characters, joined."""
    single = (pc.utf8_length(words).to_numpy(zero_copy_only=False) == 1).astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])))
    found: dict[int, list[str]] = {}
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a < 4:
            continue
        for text in range(int(np.searchsorted(lists, a, "right")) - 1, int(np.searchsorted(lists, b, "left"))):
            lo, hi = max(a, int(lists[text])), min(b, int(lists[text + 1]))
            if hi - lo >= 4:
                found.setdefault(text, []).extend(windows("".join(words.slice(lo, hi - lo).to_pylist())))
    return found


def score_block(texts: pa.Array, model: Model) -> np.ndarray:
    """The highest word value of each text."""
    lower = pc.utf8_lower(texts)
    lists = pc.ascii_split_whitespace(lower)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = lists.flatten()
    coded = words.dictionary_encode()
    if not len(words):
        return np.full(len(texts), model.low)
    values = score_words([w.strip(EDGE) for w in coded.dictionary.to_pylist()], model.table)[coded.indices.to_numpy()]
    values = np.append(values, -np.inf)
    best = np.maximum.reduceat(values, np.minimum(bounds[:-1], len(values) - 1))
    best = np.where(bounds[1:] > bounds[:-1], best, model.low)
    for text, runs in _joined(words, bounds).items():
        best[text] = max(best[text], score_words(runs, model.table).max())
    return np.maximum(best, model.low)


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[tuple[int, str]], tuple[float, float]]:
    """Labelled texts outside the held-out part, at most ``rows`` ids of each kind, by a hash of the id, and the balance.

    An id with several texts gives the one whose hash is least. The balance is how many
    labelled ids each one of the sample stands for, clean and toxic.
    """
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    totals = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    some = one.where("toxic = 1").orderBy(*order).limit(rows).union(one.where("toxic = 0").orderBy(*order).limit(rows))
    # At most twice ``rows`` ids, so they may be broadcast.
    held = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    found = held.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    balance = tuple(totals.get(k, 0) / max(1, min(rows, totals.get(k, 0))) or 1.0 for k in (0, 1))
    return [(r["toxic"], r["text"]) for r in sorted(found, key=lambda r: (zlib.crc32(b"%d" % r["doc_id"]), r["doc_id"]))], balance


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            sizes, scores, at = np.cumsum(pc.binary_length(texts).to_numpy()), [], 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK)))
                scores.append(found.score(score_block(texts.slice(at, end - at), found)))
                at = end
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = narrow.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows, balance = sample(docs, labels)
    return toxicity(docs, train(rows, balance=balance))
