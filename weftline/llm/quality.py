"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Emissions use features of the line and of
its neighbours, transitions tie neighbouring labels. Lines of the labelled
sample carry their document's label; weights are fitted by gradient steps on the
exact conditional likelihood (forward-backward in numpy, all documents side by
side). A document's quality is the length-weighted mean of its lines' marginals
for good, calibrated on the sample by a logistic curve.

Learning reads a sample of at most :data:`SAMPLE` labelled rows, as features of
a few numbers a line; every line of every document is scored.

Defined results: null and empty texts are one empty line; without labelled rows
(or labels of one kind only) every score is that kind's share, 0 without any;
repeated rows give repeated rows, an empty table an empty table; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table
from .sample import held_out, labelled

SAMPLE = 6_000
STEPS = 120
RATE = 0.08
RIDGE = 1e-3
THRESHOLD = 0.3
PARTS, PART = 5, 0
_symbols = re.compile(r"[^\w\s]").findall
_digits = re.compile(r"\d").findall
OWN = 17


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of own features and a length for every line."""
    rows, sizes = [], []
    lines = (text or "").split("\n")
    count = Counter(lines)
    total = len((text or "").split())
    for i, line in enumerate(lines):
        words = line.split()
        n, size = len(words), len(line)
        d, w = max(1, size), max(1, n)
        marks = _symbols(line)
        plain = sum(map(marks.count, ".,;:!?'\"-"))
        rows.append(
            (
                n,
                size,
                sum(map(len, words)) / w,
                len(set(words)) / w,
                line.count("|") / w,
                (len(marks) - plain) / d,
                plain / w,
                len(_digits(line)) / d,
                sum(x[0].isupper() for x in words) / w,
                line.rstrip()[-1:] in tuple(".!?") if n else 0,
                sum(len(x) < 4 for x in words) / w,
                sum(map(str.__eq__, words, words[1:])) / w,
                total,
                len(lines),
                i == 0,
                i == len(lines) - 1,
                count[line] > 1,
            )
        )
        sizes.append(size)
    x = np.array(rows, float)
    x[:, [0, 1, 12, 13]] = np.log1p(x[:, [0, 1, 12, 13]])
    return x, np.array(sizes, float)


def with_neighbours(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own, previous and next features and a constant; zeros beyond a document's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


class Batch:
    """Lines of many documents, in lanes of falling length for the recursions."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.start = np.cumsum(lengths) - lengths
        self.order = np.argsort(-lengths, kind="stable")
        self.sorted = lengths[self.order]
        self.rows = self.start[self.order]

    def lanes(self, t: int) -> np.ndarray:
        """Row numbers of the t-th line of every document that has one."""
        return self.rows[: np.searchsorted(-self.sorted, -t, "left")] + t

    def marginals(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, summed pair probabilities (2 x 2), log Z of each document (in lane order).

        ``emit`` is the score of good over bad, ``trans`` that of label pairs.
        """
        e = np.stack([np.zeros_like(emit), emit], 1)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        top = int(self.sorted[0]) if len(self.sorted) else 0
        prev = None
        for t in range(top):
            rows = self.lanes(t)
            if prev is None:
                alpha[rows] = e[rows]
            else:
                a = alpha[prev[: len(rows)]]
                alpha[rows] = np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1]) + e[rows]
            prev = rows
        for t in range(top - 2, -1, -1):
            rows, nxt = self.lanes(t), self.lanes(t + 1)
            b = beta[nxt] + e[nxt]
            beta[rows[: len(nxt)]] = np.logaddexp(b[:, :1] + trans[:, 0], b[:, 1:] + trans[:, 1])
        end = self.rows + self.sorted - 1
        z = np.logaddexp(alpha[end, 0], alpha[end, 1])
        whole = np.empty(len(emit))
        whole[np.concatenate([self.lanes(t) for t in range(top)])] = np.concatenate([z[: len(self.lanes(t))] for t in range(top)])
        good = np.exp(np.minimum(0, alpha[:, 1] + beta[:, 1] - whole))
        pairs = np.zeros((2, 2))
        inner = np.ones(len(emit), bool)
        inner[self.start + self.lengths - 1] = False
        at = np.flatnonzero(inner)
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] = np.exp(np.minimum(0, alpha[at, a] + trans[a, b] + e[at + 1, b] + beta[at + 1, b] - whole[at])).sum()
        return good, pairs, z


class Model:
    def __init__(self, prior: float):
        self.prior = prior
        self.weights = None
        self.trans = np.zeros((2, 2))
        self.curve = (0.0, 1.0)

    def emissions(self, x: np.ndarray, batch: Batch) -> np.ndarray:
        z = with_neighbours((x - self.mean) / self.scale, batch.start, batch.start + batch.lengths - 1)
        return z @ self.weights

    def fit(self, x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> "Model":
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        batch = Batch(lengths)
        z = with_neighbours((x - self.mean) / self.scale, batch.start, batch.start + batch.lengths - 1)
        y = np.repeat(labels, lengths).astype(float)
        seen = np.zeros((2, 2))
        seen[0, 0] = (lengths[labels == 0] - 1).sum()
        seen[1, 1] = (lengths[labels == 1] - 1).sum()
        theta = np.zeros(z.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            self.weights, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
            good, pairs, _ = batch.marginals(z @ self.weights, self.trans)
            g = np.r_[z.T @ (good - y), (pairs - seen).ravel()] / len(lengths) + RIDGE * theta * np.r_[np.ones(z.shape[1]), np.full(4, 30.0)]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
        q = self.logit(self.quality(x, sizes, lengths))
        a, b = 0.0, 1.0
        for _ in range(50):  # Newton steps, lightly damped
            p = 1 / (1 + np.exp(-(a + b * q)))
            w = p * (1 - p) + 1e-6
            g = np.array([(p - labels).sum(), ((p - labels) * q).sum() + 0.1 * (b - 1)])
            h = np.array([[w.sum(), (w * q).sum()], [(w * q).sum(), (w * q * q).sum() + 0.1]])
            d = np.linalg.solve(h + 1e-6 * np.eye(2), g)
            a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
        self.curve = (float(a), float(b))
        return self

    @staticmethod
    def logit(q: np.ndarray) -> np.ndarray:
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))

    def quality(self, x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document."""
        batch = Batch(lengths)
        good = batch.marginals(self.emissions(x, batch), self.trans)[0]
        weight = sizes + 1.0
        return np.add.reduceat(weight * good, batch.start) / np.add.reduceat(weight, batch.start)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        rows = [line_features(t) for t in texts]
        lengths = np.array([len(s) for _, s in rows])
        q = self.quality(np.concatenate([x for x, _ in rows]), np.concatenate([s for _, s in rows]), lengths)
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * self.logit(q))))


def learn(docs: DataFrame, labels: DataFrame, parts: int = PARTS, part: int = PART, rows: int = SAMPLE, text: str = "text", key: str = "doc_id") -> Model:
    sample = labelled(docs, labels, "quality", parts, part, rows, text, key)

    def make():
        def run(keys, texts, marks):
            got = [line_features(t) for t in texts]
            return {"k": keys, "x": [x.astype("<f4").tobytes() for x, _ in got], "label": marks}

        return run

    kind = docs.schema[key].dataType.simpleString()
    got = sorted(map_rows(sample.select(key, "text", "label"), make, f"k {kind}, x binary, label int").collect(), key=lambda r: str(r.k))
    y = np.array([r.label == 1 for r in got], int)
    model = Model(float(y.mean()) if len(y) else 0.0)
    if len(set(y.tolist())) < 2:
        return model
    xs = [np.frombuffer(r.x, "<f4").reshape(-1, OWN).astype(float) for r in got]
    return model.fit(np.concatenate(xs), np.expm1(np.concatenate([x[:, 1] for x in xs])), np.array([len(x) for x in xs]), y)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda keys, texts: {key: keys, "score": sent.value.scores(texts)}

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"`{key}` {kind}, score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", PARTS, PART).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
