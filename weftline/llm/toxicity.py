"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the words of a text (``\\w+``, lower case) and their first 3 to 5
letters; the vocabulary is every term associated with label 1 in the labelled
sample (chi-square of :data:`LEAST` or more) and the :data:`TERMS` terms most
associated with label 0. Document frequencies are counted over all documents.
Examples with equal vectors are one point with counts. Points lie in inverted
lists cut into aligned blocks with the largest weight of each (block-max): a
query adds up its block bounds, visits the :data:`FIRST` blocks of highest bound
one by one and then all others that can reach the k-th best cosine at once, so
the result is exact.
Votes of the k nearest points, weighted by similarity, are calibrated by the
rates seen when each example is scored without itself; the nearest examples'
ids are the evidence.

Learning reads a sample of at most :data:`SAMPLE` labelled rows, so vocabulary
and index are bounded by the sample and can be broadcast; every document is scored.

Defined results: texts without any vocabulary term (null and empty ones among
them) get the rate of such examples; without labelled rows every score is 0;
ties in similarity are broken by the order of points; repeated rows give
repeated rows, an empty table an empty table; other columns are ignored by
:func:`score` and kept by :func:`drop_toxic`.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_rows, materialise, slices, table
from .sample import held_out, labelled

SAMPLE = 12_000
TERMS = 512
LEAST = 20.0
NEAREST = 15
BLOCK = 64
#: Blocks that a query visits one by one.
FIRST = 4
THRESHOLD = 0.3
PARTS, PART = 4, 2
EVIDENCE = 5
CACHE_WORDS = 100_000
_words = re.compile(r"\w+").findall


def terms_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in (3, 4, 5) if len(word) > n)]


def term_counts(sample: DataFrame) -> DataFrame:
    """``term, p, n``: examples of label 1 and 0 with each term, summed within tasks first."""

    def run(batches):
        import pyarrow as pa

        p: Counter = Counter()
        n: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (p if label == 1 else n).update({t for w in set(_words((text or "").lower())) for t in terms_of(w)})
        every = list(p.keys() | n.keys())
        for i in range(0, len(every), 50_000):
            part = every[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([p[t] for t in part], pa.int64()), pa.array([n[t] for t in part], pa.int64())], names=["term", "p", "n"])

    parts = sample.select("text", "label").transform(map_batches, run, "term string, p bigint, n bigint")
    return parts.groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def document_counts(docs: DataFrame, terms: dict[str, int], text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term; tasks send one row a term."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        import pyarrow as pa

        vectors = Vectors(sent.value, np.ones(len(sent.value)))
        rows, count = 0, np.zeros(len(sent.value), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for part in slices(batch):
                for value in part.column(0).to_pylist():
                    count[list({i for word in set(_words((value or "").lower())) for i in vectors.numbers(word)})] += 1
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some], pa.int64()), pa.array(np.r_[rows, count[some]], pa.int64())], names=["term", "n"])

    found = {r.term: r.n for r in docs.select(text).transform(map_batches, run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(terms))], np.int64)


def choose_terms(sample: DataFrame, docs: DataFrame, count: int = TERMS, least: float = LEAST, text: str = "text") -> tuple[dict[str, int], np.ndarray]:
    """Term numbers and inverse document frequencies."""
    total = {r.label == 1: r.n for r in sample.groupBy((F.col("label") == 1).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = total.get(True, 0), total.get(False, 0)
    if not pos or not neg:
        return {}, np.zeros(0)
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    chi = (pos + neg) * F.pow(p * (neg - n) - n * (pos - p), 2) / ((p + n) * (pos + neg - p - n + 1e-9) * pos * neg)
    scored = materialise(term_counts(sample).withColumn("chi", chi), "terms")
    toxic = scored.where((p * neg > n * pos) & (F.col("chi") >= least)).orderBy(F.desc("chi"), "term").collect()
    clean = scored.where(p * neg < n * pos).orderBy(F.desc("chi"), "term").limit(count).collect()
    terms = {r.term: i for i, r in enumerate([*toxic, *clean])}
    rows, with_term = document_counts(docs, terms, text)
    return terms, np.log((1 + rows) / (1 + with_term)) + 1


class Vectors:
    """Unit TF-IDF vectors over the vocabulary."""

    def __init__(self, terms: dict[str, int], idf: np.ndarray):
        self.terms, self.idf, self.known = terms, idf, {}

    def numbers(self, word: str) -> tuple[int, ...]:
        known = self.known
        ids = known.get(word)
        if ids is None:
            if len(known) > CACHE_WORDS:
                known.clear()
            ids = known[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
        return ids

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        count: Counter = Counter()
        for word in _words((text or "").lower()):
            for i in self.numbers(word):
                count[i] += 1
        ids = np.array(sorted(count), np.int64)
        w = np.array([(1 + math.log(count[i])) * self.idf[i] for i in ids.tolist()])
        return ids, w / math.sqrt(float(w @ w)) if len(w) else w


class Index:
    """Block-max inverted lists over distinct example vectors."""

    def __init__(self, examples: list[tuple[object, tuple[int, ...], tuple[float, ...], int]], n_terms: int, nearest: int = NEAREST):
        points: dict = defaultdict(lambda: [0, 0, []])
        for key, ids, w, label in sorted(examples, key=lambda e: (e[1], e[2], str(e[0]))):
            point = points[ids, tuple(round(x, 9) for x in w)]
            point[0] += 1
            point[1] += label == 1
            point[2].append(key)
        members = [p[2] for p in points.values()]
        self.where = {key: k for k, keys in enumerate(members) for key in keys}
        self.nearest = nearest
        self.n = np.array([p[0] for p in points.values()], float)
        self.toxic = np.array([p[1] for p in points.values()], float)
        self.keys = [keys[:EVIDENCE] for keys in members]
        self.blocks = -(-len(points) // BLOCK)
        self.bound = np.zeros((n_terms, self.blocks))
        lists: dict = defaultdict(lambda: ([], [], []))
        for k, (ids, w) in enumerate(points):
            for i, x in zip(ids, w):
                for part, value in zip(lists[k // BLOCK], (i, k % BLOCK, x)):
                    part.append(value)
                self.bound[i, k // BLOCK] = max(self.bound[i, k // BLOCK], x)
        # postings of each block, by term
        self.lists = {b: tuple(np.array(x)[np.argsort(v[0], kind="stable")] for x in v) for b, v in lists.items()}
        # and those of each term, by point
        flat = sorted((i, k, x) for k, (ids, w) in enumerate(points) for i, x in zip(ids, w))
        self.points, self.values = np.array([k for _, k, _ in flat], np.int64), np.array([x for _, _, x in flat])
        self.start = np.searchsorted(np.array([i for i, _, _ in flat], np.int64), np.arange(n_terms + 1))
        self.memory: dict = {}

    def search(self, ids: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The nearest points (without ``skip``) and their cosines, best first."""
        bound = w @ self.bound[ids]
        order = np.argsort(-bound, kind="stable")
        query = np.zeros(len(self.bound))
        query[ids] = w
        best_k, best_s = np.zeros(0, np.int64), np.zeros(0)
        for b in order[:FIRST].tolist():
            if bound[b] <= 0 or len(best_s) == self.nearest and bound[b] < best_s[-1] - 1e-9:
                return best_k, best_s
            terms, at, y = self.lists[b]
            s = np.bincount(at, query[terms] * y, BLOCK)
            if skip // BLOCK == b:
                s[skip % BLOCK] = 0
            at = np.flatnonzero(s > 0)
            best_k, best_s = np.r_[best_k, b * BLOCK + at], np.r_[best_s, s[at]]
            best_k, best_s = self.best(best_k, best_s)
        least = best_s[-1] - 1e-9 if len(best_s) == self.nearest else 0.0
        open_ = (bound > 0) & (bound >= least)
        open_[order[:FIRST]] = False
        if open_.any():
            of = [slice(self.start[i], self.start[i + 1]) for i in ids.tolist()]
            s = np.bincount(np.concatenate([self.points[o] for o in of]), np.concatenate([x * self.values[o] for x, o in zip(w.tolist(), of)]), len(self.n))
            if skip >= 0:
                s[skip] = 0
            at = np.flatnonzero((s > 0) & (s >= least))
            at = at[open_[at // BLOCK]]
            best_k, best_s = self.best(np.r_[best_k, at], np.r_[best_s, s[at]])
        return best_k, best_s

    def best(self, k: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(s) > 4 * self.nearest:  # the sort is for those that may be among the nearest
            near = s >= np.partition(s, -self.nearest)[-self.nearest] - 2e-9
            k, s = k[near], s[near]
        top = np.lexsort((k, -s.round(9)))[: self.nearest]
        return k[top], s[top]

    def vote(self, ids: np.ndarray, w: np.ndarray, leave: tuple[int, int] | None = None) -> tuple[float, list]:
        """Share of label 1 among the nearest, -1 without any; evidence.

        ``leave`` is a point and a label of which one example is not counted.
        """
        n, toxic, skip = self.n, self.toxic, -1
        if leave:
            k, label = leave
            if n[k] == 1:
                skip = k
            else:
                n, toxic = n.copy(), toxic.copy()
                n[k] -= 1
                toxic[k] -= label == 1
        near, s = self.search(ids, w, skip)
        if not len(near):
            return -1.0, []
        weight = s**4 * n[near]
        return float((weight * toxic[near] / n[near]).sum() / weight.sum()), [key for k in near[:EVIDENCE].tolist() for key in self.keys[k]][:EVIDENCE]


class Model:
    """Vocabulary, index and calibration; all of bounded size."""

    BINS = 10

    def __init__(self, terms, idf, examples):
        self.terms, self.idf = terms, idf
        self.index = Index([e for e in examples if e[1]], len(terms))
        rate = sum(e[3] == 1 for e in examples) / max(1, len(examples))
        votes = [(self.index.vote(np.array(ids), np.array(w), (self.index.where[key], label))[0] if ids else -1.0, label == 1) for key, ids, w, label in examples]
        hits: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
        for raw, toxic in votes:
            for i, x in enumerate((toxic, 1, raw)):
                hits[-1 if raw < 0 else min(self.BINS - 1, int(raw * self.BINS))][i] += x
        # rates rise with the vote: pool neighbours that do not
        pools: list[list[float]] = []
        for b in range(self.BINS):
            y, n, raw = hits[b]
            pools.append([y + rate, n + 1.0, raw + (b + 0.5) / self.BINS])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last)]
        # between the mean votes of two pools the rate goes up evenly
        self.knots = [p[2] / p[1] for p in pools], [p[0] / p[1] for p in pools]
        y, n, _ = hits[-1]
        self.none = (y + rate) / (n + 1)
        self.index.where = {}
        self.vectors = None

    def score(self, text: str | None) -> tuple[float, list]:
        if self.vectors is None:
            self.vectors = Vectors(self.terms, self.idf)
        ids, w = self.vectors.of(text)
        if not len(ids):
            return self.none, []
        at = (ids.tobytes(), w.tobytes())
        memory = self.index.memory
        if at not in memory:
            if len(memory) > 20_000:
                memory.clear()
            raw, keys = self.index.vote(ids, w)
            memory[at] = (self.none if raw < 0 else float(np.interp(raw, *self.knots)), keys)
        return memory[at]


def learn(docs: DataFrame, labels: DataFrame, parts: int = PARTS, part: int = PART, rows: int = SAMPLE, text: str = "text", key: str = "doc_id") -> Model:
    sample = labelled(docs, labels, "toxic", parts, part, rows, text, key)
    terms, idf = choose_terms(sample, docs, text=text)

    def make():
        vectors = Vectors(terms, idf)

        def run(keys, texts, marks):
            got = [vectors.of(t) for t in texts]
            return {"k": keys, "ids": [i.tolist() for i, _ in got], "w": [w.tolist() for _, w in got], "label": marks}

        return run

    kind = docs.schema[key].dataType.simpleString()
    rows_ = map_rows(sample.select(key, "text", "label"), make, f"k {kind}, ids array<bigint>, w array<double>, label int").collect()
    return Model(terms, idf, [(r.k, tuple(r.ids), tuple(r.w), r.label) for r in sorted(rows_, key=lambda r: str(r.k))])


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, score, evidence`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(keys, texts):
            got = [sent.value.score(t) for t in texts]
            return {key: keys, "score": [s for s, _ in got], "evidence": [e for _, e in got]}

        return run

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"`{key}` {kind}, score double, evidence array<{kind}>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that score below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                yield part.filter(pa.array([sent.value.score(t)[0] < threshold for t in texts], pa.bool_()))

    return docs.transform(map_batches, keep, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", PARTS, PART).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
