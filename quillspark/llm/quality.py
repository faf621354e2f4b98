"""Quality by Bradley-Terry ranking: a document's strength is linear in its features, learned from preference
pairs (one document of label 1, one of label 0) by logistic loss on the difference of their features; a
document passes if its strength reaches the quantile of training strengths that the share of label 0 sets.

All training rows count, and all pairs of them. A pair's loss depends on two strengths, so each round of Newton's
method tallies the rows by strength, shared between the two nearest multiples of STEP in proportion, and weighs the
tallies of one label against those of the other: the loss of every pair, but for some STEP ** 2 / 8 of it, without
listing pairs. The threshold is exact, by histograms that close in on it. Features of training rows are written once;
the driver gets tallies of at most PARTS parts.

The score maps that threshold to ACCEPT, so that a document passes where its score is at least ACCEPT.
Features come from the whole text and nothing else. Null and empty texts have the features of no words.
Without labels of both classes every score is the share of label 1 (0.5 without labels). Repeated rows get
equal scores; null doc_id rows are scored and not held out.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import python_stage, remove, shared_dir, table
from quillspark.llm.learn import held_out, sigmoid

ACCEPT = 0.3
#: The pairs that the mean loss of all pairs stands for when it is weighed against the penalty of weights.
PAIRS = 100_000
#: Strengths between neighbouring tallies: those of the gradient, and those of the curvature, which sets only the way to the optimum.
STEP, COARSE = 1 / 32, 1 / 2
#: Newton's rounds at most, parts of the training rows, rows tallied at a time, and bins of a histogram.
ROUNDS, PARTS, CHUNK, BINS = 50, 32, 1 << 15, 1024
#: Added to the word count of each ratio, so that a few words decide nothing.
SMOOTH = 4
FEATURES = (
    "symbol_ends", "bare_marks", "upper_words", "repeats", "distinct", "word_length", "log_words", "marks", "upper_letters", "digits", "lines", "commonest", "repeated_lines", "long_words",
)
WORD_BLOCK = 1 << 16
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 1 if "A" <= _ch <= "Z" else 2 if "a" <= _ch <= "z" or _c >= 128 else 3 if _ch.isdigit() and _c < 128 else 4 if _c == 10 else 5 if _c in (9, 11, 12, 13, 32) else 6


def features(text: str | None) -> list[float]:
    """The FEATURES of a text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, np.int64)
    upper, lower, digits, lines, _, marks = np.bincount(_CLASS, kinds, minlength=7)[1:]
    words = text.split()
    n = len(words)
    ends = bare = uppers = same = long = 0
    counts: dict[str, int] = {}
    last = ""
    for w in words:
        if not w[-1].isalnum() and len(w) > 2 and w[-1] == w[-2]:
            ends += 1
        if w == last:
            same += 1
        elif len(w) == 1 and not w.isalnum():
            bare += 1
        if w.isupper() and len(w) > 1:
            uppers += 1
        if len(w) > 24:
            long += 1
        counts[w] = counts.get(w, 0) + 1
        last = w
    rows = [x for x in text.split("\n") if x]
    d, chars = n + SMOOTH, len(raw) + 8 * SMOOTH
    return [
        ends / d, bare / d, uppers / d, same / d, (len(counts) + SMOOTH) / d, min(20.0, (upper + lower) / d), float(np.log1p(n)), marks / chars, upper / chars, digits / chars,
        lines / d, max(counts.values(), default=0) / d, (len(rows) - len(set(rows))) / (len(rows) + SMOOTH), long / d,
    ]


def strengths(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row's strength, to the last bit the same whatever rows are beside it (as a matrix product's is not)."""
    return (z * weights).sum(axis=1)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    threshold: float
    base: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return strengths((x - np.array(self.center)) / np.array(self.scale), np.array(self.weights))

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.base
        gap = float(self.strength(np.array([features(text)]))[0]) - self.threshold
        return sigmoid(gap + float(np.log(ACCEPT / (1 - ACCEPT))))


#: Features and labels of some training rows.
Chunks = Iterator[tuple[np.ndarray, np.ndarray]]
#: Hands all training rows, part by part, to a function; its results in the order of the parts.
Each = Callable[[Callable[[Chunks], object]], list]
#: Of each label: multiples of a step (increasing) and a row of sums for each.
Tally = list[tuple[np.ndarray, np.ndarray]]


def merged(tallies: list[Tally]) -> Tally:
    out = []
    for y in range(2):
        bins = np.concatenate([t[y][0] for t in tallies])
        order = np.argsort(bins, kind="stable")
        kinds, starts = np.unique(bins[order], return_index=True)
        sums = np.concatenate([t[y][1] for t in tallies])[order]
        out.append((kinds, np.add.reduceat(sums, starts) if len(kinds) else sums))
    return out


def _summed(bins: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(bins, return_inverse=True)
    return kinds, np.column_stack([np.bincount(at, c, len(kinds)) for c in columns])


def tallies(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[Tally, Tally]:
    """Rows and sums of z by multiples of STEP; and rows, sums of z and of its products by multiples of COARSE."""
    fine, coarse = [], []
    one, two = np.triu_indices(z.shape[1])
    for label in range(2):
        own = z[y == label]
        s = strengths(own, weights)
        low = np.floor(s / STEP)
        up = s / STEP - low
        share = np.concatenate([1 - up, up])
        fine.append(_summed(np.concatenate([low, low + 1]), [share, *(share * np.concatenate([c, c]) for c in own.T)]))
        coarse.append(_summed(np.rint(s / COARSE), [np.ones(len(s)), *own.T, *(own[:, i] * own[:, j] for i, j in zip(one, two, strict=True))]))
    return fine, coarse


def pair_loss(fine: Tally, coarse: Tally, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean over all pairs of the logistic loss, its gradient and its curvature, from the tallies of label 0 and 1."""
    (bad, bad_sums), (good, good_sums) = fine
    loss, slope = 0.0, np.zeros(size)
    for i in range(0, len(good), 256):
        gap = np.clip((good[i : i + 256, None] - bad[None]) * STEP, -500, 500)
        rows, lost = good_sums[i : i + 256], 1 / (1 + np.exp(gap))
        loss += rows[:, 0] @ np.logaddexp(0, -gap) @ bad_sums[:, 0]
        slope += bad_sums[:, 1:].T @ (rows[:, 0] @ lost) - rows[:, 1:].T @ (lost @ bad_sums[:, 0])
    (bad, b), (good, g) = coarse
    one, two = np.triu_indices(size)
    curve = np.zeros((size, size))
    for i in range(0, len(good), 256):
        gap = np.clip((good[i : i + 256, None] - bad[None]) * COARSE, -500, 500)
        rows, heavy = g[i : i + 256], 1 / (2 + np.exp(gap) + np.exp(-gap))
        squares = (heavy @ b[:, 0]) @ rows[:, 1 + size :] + (rows[:, 0] @ heavy) @ b[:, 1 + size :]
        cross = rows[:, 1 : 1 + size].T @ heavy @ b[:, 1 : 1 + size]
        whole = np.zeros((size, size))
        whole[one, two] = whole[two, one] = squares
        curve += whole - cross - cross.T
    n = good_sums[:, 0].sum() * bad_sums[:, 0].sum()
    return loss / n, slope / n, curve / n


def preferred(each: Each, center: np.ndarray, scale: np.ndarray, l2: float) -> np.ndarray:
    """The weights of least loss over all pairs, by Newton's method; a step that makes it grow is halved."""
    size = len(center)
    weights, last, before = np.zeros(size), np.inf, np.zeros(size)
    for _ in range(ROUNDS):

        def work(chunks: Chunks, weights: np.ndarray = weights) -> tuple[Tally, Tally]:
            got = None
            for x, y in chunks:
                new = tallies((x - center) / scale, y, weights)
                got = tuple(merged([a, b]) for a, b in zip(got, new, strict=True)) if got else new
            return got

        parts = [p for p in each(work) if p]
        loss, slope, curve = pair_loss(merged([p[0] for p in parts]), merged([p[1] for p in parts]), size)
        loss = PAIRS * loss + l2 / 2 * weights @ weights
        if loss > 1.01 * last:
            weights = (weights + before) / 2
            continue
        step = np.linalg.solve(PAIRS * curve + (l2 + 1e-9) * np.eye(size), PAIRS * slope + l2 * weights)
        last, before, weights = loss, weights, weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def quantile(each: Each, strength: Callable[[np.ndarray], np.ndarray], mass: np.ndarray, share: float) -> float:
    """The strength at which the mass of all rows, mass[label] each, reaches share, midway to the next row's."""
    low, high, above, below = -np.inf, np.inf, None, 0.0
    while True:

        def work(chunks: Chunks, low: float = low, high: float = high) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of each bin from low to high the rows of each label, the least and the greatest strength; of all strengths, one bin."""
            counts, least, most = np.zeros((2, BINS)), np.full(BINS, np.inf), np.full(BINS, -np.inf)
            for x, y in chunks:
                s = strength(x)
                inside = (s >= low) & (s <= high)
                s, y = s[inside], y[inside]
                bins = np.minimum(((s - low) / (high - low) * BINS).astype(int), BINS - 1) if np.isfinite(high - low) else np.zeros(len(s), int)
                np.add.at(counts, (y, bins), 1)
                np.minimum.at(least, bins, s)
                np.maximum.at(most, bins, s)
            return counts, least, most

        parts = each(work)
        counts, least, most = sum(p[0] for p in parts), np.min([p[1] for p in parts], axis=0), np.max([p[2] for p in parts], axis=0)
        held = np.nonzero(counts.sum(axis=0))[0]
        reach = below + np.cumsum(mass @ counts[:, held])
        at = min(int(np.searchsorted(reach, share - 1e-9)), len(held) - 1)
        if at + 1 < len(held):
            above = least[held[at + 1]]
        low, high, below = least[held[at]], most[held[at]], reach[at - 1] if at else below
        if low == high:  # equal strengths: is the row that reaches share the last of them?
            last = mass[counts[:, held[at]] > 0].min()
            return float(low if above is None or reach[at] - last >= share - 1e-9 else (low + above) / 2)


def learned(each: Each, share_bad: float, l2: float = 1.0) -> Model:
    """A model of all training rows; share_bad is the share of label 0 among all training labels."""
    counts = lambda chunks: [(np.bincount(y, minlength=2), x.sum(axis=0)) for x, y in chunks]
    parts = [c for p in each(counts) for c in p]
    n = sum((c for c, _ in parts), np.zeros(2))
    if not n.all():
        return Model((), (), (), 0.0, float(n[1] / n.sum()) if n.any() else 0.5)
    center = sum(x for _, x in parts) / n.sum()
    squares = lambda chunks: [((x - center) ** 2).sum(axis=0) for x, _ in chunks]
    scale = np.sqrt(sum(c for p in each(squares) for c in p) / n.sum()) + 1e-6
    weights = preferred(each, center, scale, l2)
    mass = np.array([share_bad, 1 - share_bad]) / n
    threshold = quantile(each, lambda x: strengths((x - center) / scale, weights), mass, share_bad)
    return Model(tuple(weights), tuple(center), tuple(scale), threshold, 0.5)


def fit(x: np.ndarray, y: np.ndarray, share_bad: float, l2: float = 1.0) -> Model:
    """A model of features x and labels y; share_bad is the share of label 0 among all training labels."""
    return learned(lambda work: [work(iter([(x, y)]))], share_bad, l2)


def _each(rows: DataFrame) -> Each:
    """The rows (label int, x array<double>) of a table, PARTS parts at most."""
    few = rows.coalesce(PARTS)

    def each(work: Callable[[Chunks], object]) -> list:
        def chunks(batches: Iterator[pa.RecordBatch]) -> Chunks:
            held, n = [], 0

            def whole() -> tuple[np.ndarray, np.ndarray]:
                flat = np.concatenate([b.column("x").flatten().to_numpy(zero_copy_only=False) for b in held])
                return flat.reshape(-1, len(FEATURES)), np.concatenate([b.column("label").to_numpy() for b in held])

            for b in batches:
                if b.num_rows:
                    held.append(b)
                    n += b.num_rows
                if n >= CHUNK:
                    yield whole()
                    held, n = [], 0
            if held:
                yield whole()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(chunks(batches)))], pa.binary())], names=["part"])

        return [pickle.loads(r["part"]) for r in few.mapInArrow(run, "part binary").collect()]

    return each


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled documents outside the held-out ones; a document of both labels counts for each."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(5, 0)).select("doc_id", F.col("quality").cast("int").alias("label"))
    share_bad = known.agg(F.avg(1 - F.col("label"))).first()[0]
    # features before the join, so that no text is shuffled
    told = python_stage(docs.select("doc_id", "text").filter(~held_out(5, 0)), ["text"], "x array<double>", lambda t: (features(t),)).join(known.distinct(), "doc_id")
    path = shared_dir(docs.sparkSession, "quality-features")
    told.select("label", "x").write.parquet(path)
    model = learned(_each(docs.sparkSession.read.parquet(path)), float(share_bad or 0.0))
    remove(docs.sparkSession, path)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1)."""
    return python_stage(docs, ["text"], "score double", lambda t: (model.score(t),))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    got = score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
