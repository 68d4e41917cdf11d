"""N-gram Jaccard join by vertical partitioning of a global n-gram order.

A document's set holds 64-bit hashes of its distinct word shingles. All n-grams
have one global order: rare ones first (by hash), frequent ones last (by count).
The order is cut into fragments. The leading fragment of a set (its prefix) is as
short as the threshold allows: two sets that link share one of its n-grams.

1. Equal sets are one node from here on, so copies make no pairs.
2. Prefix n-grams that two or more nodes share are kept as ``(gram, node, size)``.
3. Sizes and parity sketches rule out most pairs of nodes that share an n-gram.
   First only pairs that span each group are verified; links give components.
4. Of n-grams whose nodes are still in several components, only rows of nodes that
   sizes and sketches let pair with a node of another component stay. Their nodes
   get wide sketches, which let few pairs pass that do not link.
5. With these, pairs that span each group are verified once more, so nodes near a
   large component join it by few pairs; then all pairs between components that are
   left, large groups in blocks. A pair left out lies within a component already or
   cannot link, so components are exact.

To verify pairs, the sets of the nodes concerned are cut by fragment, partial
overlaps are counted fragment by fragment and summed per pair.

Defined results: documents without words (null and empty ones among them) have
no shingles and link with nothing; fewer words than a shingle make one shingle;
a component's id is its smallest non-null document id (null if it has none);
repeated rows give repeated rows, an empty table an empty table; other columns
are ignored by :func:`classes` and kept by :func:`keep_one`. Two different sets
are taken for one only if size and 64-bit fingerprints agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, discard, map_batches, materialise, most_frequent, quoted, slices, table
from .graph import components

WORDS = 4
PERCENT = 85
#: Frequent n-grams that are ordered by count (the rest only by hash).
FREQUENT = 1_000_000
#: Leading bits of a frequent n-gram that are looked up before it is searched for.
RANK_BITS = 23
#: N-grams of a task counted at a time, and repeats from which one is frequent.
COUNTED, REPEATS = 1_000_000, 3
#: Prefix rows of a bucket, about, and those a task packs at a time.
BUCKET_ROWS, PACKED = 150_000, 150_000
FRAGMENTS = 4
#: Times as wide are the sketches of nodes that may still link with another component.
WIDE = 4
#: Nodes or ids up to which a side is broadcast; beyond it joins shuffle.
SMALL = 500_000
GROUP = 2048
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_IN_WORD = bytes(b != 32 and not 9 <= b <= 13 for b in range(256))
CACHE_WORDS = 60_000
#: Words are hashed eight bytes at a time, up to this many times; longer ones by the library.
LANES = 8
#: Bytes of texts that are hashed together, about: all intermediate arrays fit a core's cache.
TOGETHER = 128 << 10
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash of a word, kept once computed."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a column, and where those of each text begin (and the last ones end)."""
    texts = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    data = b"\n".join([b"", *texts, b" " * 8]).translate(_LOWER)
    inside = np.frombuffer(data.translate(_IN_WORD), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, length = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=1)
    h, on = length.astype(np.uint64) * _MULTIPLIERS[0], np.arange(len(start))
    for lane in range(LANES):
        on = on[length[on] > 8 * lane]
        if not len(on):
            break
        h[on] = mix(h[on] ^ eight[start[on] + 8 * lane] & _MASKS[np.minimum(length[on] - 8 * lane, 8)])
    for i in np.flatnonzero(length > 8 * LANES):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + length[i]])
    return h, np.searchsorted(start, np.cumsum([1, *(len(t) + 1 for t in texts)]))


class Shingler:
    """Sorted distinct shingle hashes of whole texts, for a column at a time: a Python step for each word would cost most."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def shingles(self, h: np.ndarray) -> np.ndarray:
        """A hash of each run of words, from the words' hashes."""
        n = max(0, len(h) - self.words + 1)
        total = h[:n] * _MULTIPLIERS[0]
        for i in range(1, self.words):
            total += h[i : n + i] * _MULTIPLIERS[i % 8] + np.uint64(i)
        return mix(total)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text, as parts of larger arrays: copy what is to be kept."""
        step = max(1, len(texts) * TOGETHER // max(1, texts.nbytes))
        for at in range(0, len(texts), step):
            yield from self.sets_together(texts.slice(at, step))

    def sets_together(self, texts: pa.Array) -> Iterator[np.ndarray]:
        h, first = word_hashes(texts)
        found, n = np.diff(first), self.words
        whole = np.ones(max(0, len(h) - n + 1), bool)
        for i in range(1, n):  # runs that go on into the next text
            at = first[1:] - i
            whole[at[(at >= 0) & (at < len(whole))]] = False
        total = self.shingles(h)[whole]
        end = np.cumsum(np.maximum(found - n + 1, 0))
        begin = np.r_[0, end[:-1]]
        for a, b in zip(begin.tolist(), end.tolist()):
            total[a:b].sort()
        new = np.ones(len(total), bool)
        new[1:] = total[1:] != total[:-1]
        new[begin[end > begin]] = True
        total, before = total[new], np.r_[0, np.cumsum(new)]
        for i, a, b, m in zip(range(len(found)), before[begin].tolist(), before[end].tolist(), found.tolist()):
            yield total[a:b] if m >= n or not m else self.shingles(np.r_[h[first[i] : first[i + 1]], np.full(n - m, m, np.uint64)])


def node_key(grams: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams)) - (1 << 63)


def read_sets(docs: DataFrame, words: int, text: str, key: str, most: int = FREQUENT) -> tuple[DataFrame, "Order"]:
    """``key, n, k, sketch`` of every row, and the global n-gram order.

    One pass writes both: size, fingerprint and sketch of every set (nulls for
    empty ones), and the n-grams that repeat within COUNTED n-grams of a task. The
    order keeps the (at most ``most``) n-grams that repeat most.
    """
    kind = docs.schema[key].dataType
    ddl = f"`{key}` {kind.simpleString()}, n bigint, k bigint, sketch binary, gram bigint, m bigint"
    names = [key, "n", "k", "sketch", "gram", "m"]
    types = list(arrow_schema(ddl).types)

    def batch(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches):
        shingler, seen, held, size = Shingler(words), set(), [], 0

        def count():
            grams = np.concatenate(held)
            held.clear()
            grams.sort()
            cut = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            m = np.diff(np.r_[cut, len(grams)])
            grams, m = grams[cut][m >= REPEATS].view(np.int64), m[m >= REPEATS]
            none = [None] * len(grams)
            return batch(none, none, none, none, grams, m)

        for source in batches:
            for part in slices(source):
                ns, ks, marks = [], [], []
                for grams in shingler.sets(part.column(1)):
                    k = node_key(grams) if len(grams) else None
                    ns.append(len(grams)), ks.append(k), marks.append(sketch(grams) if len(grams) else None)
                    if k is not None and k not in seen:
                        seen.add(k)
                        held.append(grams.copy())
                        size += len(grams)
                none = [None] * len(ns)
                yield batch(part.column(0), ns, ks, marks, none, none)
                if size >= COUNTED:
                    yield count()
                    held, size = [], 0
        if held:
            yield count()

    both = materialise(docs.select(key, text).transform(map_batches, run, ddl), "sets")
    counted = materialise(both.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("m").alias("m")), "often")
    rows = most_frequent(counted, "m", most).toArrow().sort_by([("m", "descending"), ("gram", "ascending")])
    discard(counted)
    grams = rows["gram"].to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(grams)
    return both.where("gram IS NULL").select(key, "n", "k", "sketch"), Order(grams[by], (len(grams) - np.arange(len(grams)))[by])


def distinct_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Fingerprint and set of each different set of a task, from a text column."""
    shingler, seen = Shingler(words), set()
    for batch in batches:
        for part in slices(batch):
            for grams in shingler.sets(part.column(0)):
                if len(grams):
                    k = node_key(grams)
                    if k not in seen:
                        seen.add(k)
                        yield k, grams


class Order:
    """The global n-gram order: rank 0 for rare n-grams, then rising with frequency."""

    def __init__(self, grams: np.ndarray, ranks: np.ndarray):
        self.grams, self.values = grams, ranks
        self.maybe = None

    def ranks(self, grams: np.ndarray) -> np.ndarray:
        """Most n-grams are rare: a table of the frequent ones' leading bits saves nearly all of them the search."""
        found = np.zeros(len(grams), np.int64)
        if len(self.grams):
            if self.maybe is None:  # made where it is used, not sent
                self.maybe = np.zeros(1 << RANK_BITS, bool)
                self.maybe[self.grams >> np.uint64(64 - RANK_BITS)] = True
            here = np.flatnonzero(self.maybe[grams >> np.uint64(64 - RANK_BITS)])
            at = np.minimum(np.searchsorted(self.grams, grams[here]), len(self.grams) - 1)
            found[here] = np.where(self.grams[at] == grams[here], self.values[at], 0)
        return found

    def prefix(self, grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The leading n-grams of a set and their ranks."""
        size = len(grams) - (percent * len(grams) + 99) // 100 + 1
        ranks = self.ranks(grams)
        rare = np.flatnonzero(ranks == 0)
        if len(rare) < size:
            rare = np.argsort(ranks, kind="stable")
        return grams[rare[:size]], ranks[rare[:size]]

    def fragments(self, grams: np.ndarray, count: int) -> np.ndarray:
        """The fragment of each n-gram: rare ones by hash range, frequent ones in the last."""
        rare = (grams >> np.uint64(32)) * np.uint64(count - 1) >> np.uint64(32)
        return np.where(self.ranks(grams) > 0, count - 1, rare.astype(np.int64))


def shared_prefixes(docs: DataFrame, order, percent: int, words: int, text: str, n_grams: int) -> DataFrame:
    """``gram, k, n`` of every prefix n-gram that at least two nodes share.

    Tasks send their prefixes as packed arrays, one for each bucket of n-grams.
    Frequent n-grams go to buckets by n-gram and node (they are shared anyway),
    so no bucket grows with one n-gram.
    """
    share = max(1, n_grams * (102 - percent) // 100)
    buckets = max(8, -(-share // BUCKET_ROWS))
    row = np.dtype([("gram", "<u8"), ("k", "<i8"), ("n", "<i8")])

    def send(batches):
        held, size = [], 0

        def pack():
            rows = np.concatenate([r for r, _ in held])
            hot = np.concatenate([h for _, h in held])
            to = (mix(np.where(hot, rows["gram"] ^ mix(rows["k"].view(np.uint64)), rows["gram"])) % np.uint64(buckets)).astype(np.int64)
            to = np.where(hot, -1 - to, to)
            by = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(to[by]) != 0])
            parts = np.split(rows[by], cut[1:])
            return pa.RecordBatch.from_arrays([pa.array(to[by][cut], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "data"])

        for k, grams in distinct_sets(batches, words):
            first, ranks = order.value.prefix(grams, percent)
            rows = np.empty(len(first), row)
            rows["gram"], rows["k"], rows["n"] = first, k, len(grams)
            held.append((rows, ranks > 0))
            size += len(rows)
            if size >= PACKED:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    def share_rows(batches):
        # whole buckets arrive in order: a bucket is complete when the next begins
        now, held = None, []

        def out():
            rows = np.unique(np.concatenate(held)) if held else np.zeros(0, row)
            held.clear()
            if now is not None and now >= 0 and len(rows):
                same = rows["gram"][1:] == rows["gram"][:-1]
                rows = rows[np.r_[False, same] | np.r_[same, False]]
            return pa.RecordBatch.from_arrays([pa.array(rows["gram"].view(np.int64)), pa.array(rows["k"]), pa.array(rows["n"])], names=["gram", "k", "n"])

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    if held:
                        yield out()
                    now, held = bucket, []
                held.append(np.frombuffer(data.as_buffer(), row).copy())
        if held:
            yield out()

    sent = docs.select(text).transform(map_batches, send, "bucket bigint, data binary")
    return sent.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket").transform(map_batches, share_rows, "gram bigint, k bigint, n bigint")


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if its counted size allows, else let the join shuffle."""
    return F.broadcast(df) if df.count() <= SMALL else df


def texts_of(nodes: DataFrame, docs: DataFrame, ids: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """``k, owner``: a document that stands for each node; ``owner, k, text`` of rows with these ids."""
    owners = materialise(ids.join(nodes, "k", "left_semi").groupBy("k").agg(F.min(key).alias("owner")).where("owner IS NOT NULL"), "owners")
    return owners, docs.select(F.col(key).alias("owner"), F.col(text).alias("text")).join(small(owners), "owner")


def wide_sketches(nodes: DataFrame, docs: DataFrame, ids: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """``k, n, sketch`` of the ``nodes`` (k), with sketches WIDE times as wide."""
    owners, texts = texts_of(nodes, docs, ids, text, key)

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch):
                ks, ns, marks = [], [], []
                for k, grams in zip(part.column(0).to_pylist(), shingler.sets(part.column(1))):
                    if node_key(grams) == k:  # else another row with the owner's id
                        ks.append(k), ns.append(len(grams)), marks.append(sketch(grams, WIDE))
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ns, pa.int64()), pa.array(marks, pa.binary())], names=["k", "n", "sketch"])

    found = materialise(texts.select("k", "text").transform(map_batches, run, "k bigint, n bigint, sketch binary").dropDuplicates(["k"]), "wide")
    discard(owners)
    return found


def verify(pairs: DataFrame, docs: DataFrame, ids: DataFrame, order, percent: int, words: int, text: str, key: str) -> DataFrame:
    """The linked pairs among ``a, b``: partial overlaps by fragment, summed per pair."""
    owners, texts = texts_of(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct(), docs, ids, text, key)

    def cut(batches):
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch):
                ks, ns, fs, gs = [], [], [], []
                for k, grams in zip(part.column(0).to_pylist(), shingler.sets(part.column(1))):
                    if node_key(grams) != k:
                        continue  # another row with the owner's id
                    f = order.value.fragments(grams, FRAGMENTS)
                    for i in range(FRAGMENTS):
                        own = grams[f == i]
                        if len(own):
                            ks.append(k), ns.append(len(grams)), fs.append(i), gs.append(own.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ns, pa.int64()), pa.array(fs, pa.int32()), pa.array(gs, pa.list_(pa.int64()))], names=["k", "n", "f", "g"])

    parts = texts.select("k", "text").transform(map_batches, cut, "k bigint, n bigint, f int, g array<bigint>").dropDuplicates(["k", "f"])
    parts = materialise(parts, "fragments")
    a = parts.select(F.col("k").alias("a"), F.col("n").alias("na"), "f", F.col("g").alias("ga"))
    b = parts.select(F.col("k").alias("b"), F.col("n").alias("nb"), "f", F.col("g").alias("gb"))
    partial = pairs.join(a, "a").join(b, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("c"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    links = materialise(total.where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * percent).select("a", "b"), "links")
    discard(owners, parts)
    return links


def cross_pairs(rows: DataFrame, sketches: DataFrame, percent: int, spanning: bool, among: bool = False) -> DataFrame:
    """Pairs of nodes that share an n-gram, lie in different components ``c`` and may link.

    ``rows``: gram, k, n, c; ``sketches``: k, sketch. N-grams within one component
    are left alone; groups of more than GROUP nodes are cut into blocks that meet
    pair by pair. Sizes and sketches only rule out pairs that cannot link. With
    ``spanning``, a block gives no pair whose nodes its earlier pairs connect, and
    blocks do not meet: once these pairs are verified, most others lie within a
    component. With ``among`` it gives no pairs but the distinct rows ``gram, k, n``
    of their nodes, at most as many as ``rows`` has.
    """
    open_ = rows.groupBy("gram").agg(
        F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("m"), F.min("k").alias("a"), F.max("k").alias("b"), F.min("n").alias("n0"), F.max("n").alias("n1")
    ).where("c0 <> c1")
    open_ = materialise(open_, "open")
    # most n-grams are shared by two nodes; each of these pairs is looked at once
    pairs_of_two = open_.where(f"m = 2 AND n0 * 100 >= n1 * {percent}")
    two = pairs_of_two.select("a", "b").distinct()
    other = sketches.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    two = two.join(sketches.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(other, "b")

    def near(batches):
        for batch in batches:
            for part in slices(batch):
                a, b, na, nb, sa, sb = (c.to_pylist() for c in part.columns)
                ok = []
                for x, y, p, q in zip(na, nb, sa, sb):
                    width = min(len(p), len(q))
                    ok.append(int(np.bitwise_count(fold(p, width) ^ fold(q, width)).sum()) * (100 + percent) <= (x + y) * (100 - percent))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    two = two.select("a", "b", "na", "nb", "sa", "sb").transform(map_batches, near, "a bigint, b bigint")
    found = rows.join(open_.where("m > 2").select("gram", "m"), "gram").join(sketches.select("k", "sketch"), "k")
    blocks = F.ceil(F.col("m") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("k"), blocks).cast("int")
    met = F.array(own) if spanning else F.sequence(F.lit(0), blocks - 1)
    met = found.select("gram", "k", "n", "c", "sketch", own.alias("own"), F.explode(met).alias("other"))
    met = met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    groups = met.groupBy("gram", "lo", "hi").agg(F.collect_list(F.struct("k", "n", "c", "own", "sketch")).alias("x")).where(F.size("x") > 1)
    if among:

        def members(batches):
            for batch in batches:
                for part in slices(batch):
                    for gram, lo, hi, x in zip(*(c.to_pylist() for c in part.columns[:3]), part.column(3)):
                        k, n = block_members(x.values, lo == hi, percent)
                        if len(k):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), gram)), pa.array(k), pa.array(n)], names=["gram", "k", "n"])

        both = pairs_of_two.select("gram", "a", "b").join(two, ["a", "b"], "left_semi").select("gram", F.explode(F.array("a", "b")).alias("k"))
        many = groups.select("gram", "lo", "hi", "x").transform(map_batches, members, "gram bigint, k bigint, n bigint").distinct()
        return both.join(sketches.select("k", "n"), "k").select("gram", "k", "n").union(many)
    row = np.dtype([("a", "<i8"), ("b", "<i8")])
    buckets = max(64, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pair(batches):
        held, size = [], 0

        def out():
            pairs = np.unique(np.concatenate(held))
            to = (mix(pairs["a"].view(np.uint64) ^ mix(pairs["b"].view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(to[by]) != 0])
            parts = np.split(pairs[by], cut[1:])
            return pa.RecordBatch.from_arrays([pa.array(to[by][cut], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for part in slices(batch):
                for lo, hi, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    left, right = block_pairs(x.values, lo == hi, percent, spanning)
                    if len(left):
                        pairs = np.empty(len(left), row)
                        pairs["a"], pairs["b"] = left, right
                        held.append(pairs)
                        size += len(pairs)
                    if size > 250_000:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    def once(batches):
        # a pair that shares several n-grams comes from several tasks; what still repeats here, distinct() drops
        held, size = [], 0

        def out():
            pairs = np.unique(np.concatenate(held))
            for i in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs["a"][i : i + 100_000]), pa.array(pairs["b"][i : i + 100_000])], names=["a", "b"])

        for batch in batches:
            for data in batch.column(1):
                held.append(np.frombuffer(data.as_py(), row))
                size += len(held[-1])
            if size > 1_000_000:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    many = groups.select("lo", "hi", "x").transform(map_batches, pair, "bucket bigint, data binary").repartition(buckets, "bucket").transform(map_batches, once, "a bigint, b bigint")
    return two.union(many).distinct()


class Block:
    """Nodes of one block, or of two that meet (unless ``one``), in order of size; ``x``: k, n, c, own, sketch."""

    def __init__(self, x: pa.StructArray, one: bool, percent: int):
        k, n, c, own = (x.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        by = np.lexsort((k, n))
        self.k, self.n, self.own, self.one, self.percent = k[by], n[by], own[by], one, percent
        self.end = np.searchsorted(percent * self.n, 100 * self.n, "right")
        _, self.root = np.unique(c[by], return_inverse=True)
        raw = x.field(4).to_pylist()
        self.raw = [raw[j] for j in by]
        self.marks: dict[int, np.ndarray] = {}

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Later nodes with another root that sizes and sketches let link with node ``i``, and their sketches' distances."""
        at = np.arange(i + 1, self.end[i])
        at = at[(self.root[at] != self.root[i]) & (self.k[at] != self.k[i])]
        if not self.one:
            at = at[self.own[at] != self.own[i]]
        if not len(at):
            return at, at
        width = len(self.raw[i])
        if width not in self.marks:
            # sets of the next sizes may have wider sketches; those fold to the narrower
            self.marks[width] = np.stack([fold(r, width) if len(r) >= width else np.zeros(width // 8, np.uint64) for r in self.raw])
        far = np.bitwise_count(self.marks[width][at] ^ self.marks[width][i]).sum(1, dtype=np.int64)
        ok = far * (100 + self.percent) <= (self.n[at] + self.n[i]) * (100 - self.percent)
        return at[ok], far[ok]


def block_members(x: pa.StructArray, one: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a block's pairs, and their sizes."""
    block = Block(x, one, percent)
    found = np.zeros(len(block.k), bool)
    for i in range(len(block.k)):
        at, _ = block.near(i)
        found[at] = True
        found[i] |= len(at) > 0
    return block.k[found], block.n[found]


def block_pairs(x: pa.StructArray, one: bool, percent: int, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one block, or (unless ``one``) between two, that :func:`cross_pairs` is to give."""
    block = Block(x, one, percent)
    k, root = block.k, block.root
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(k)):
        at, far = block.near(i)
        if spanning:
            at, kept = at[np.argsort(far, kind="stable")], []  # the nearest are likeliest to link
            while len(at):
                j = at[0]
                kept.append(j)
                root[root == root[j]] = root[i]
                at = at[root[at] != root[i]]
            at = np.array(kept, np.int64)
        if len(at):
            left.append(np.minimum(k[i], k[at]))
            right.append(np.maximum(k[i], k[at]))
    return np.concatenate(left), np.concatenate(right)


def sketch_bytes(n: int) -> int:
    """Bytes of the sketch of a set of ``n``: a power of two with over 1 bit an n-gram, at least 64 bytes.

    At 85 % two sets that link differ in 0.17 n n-grams at most; sketches of sets
    that have little in common differ in about half their bits.
    """
    return max(64, 1 << max(1, n).bit_length() >> 3)


def sketch(grams: np.ndarray, times: int = 1) -> bytes:
    """Parity bits of a set by hash: two sketches differ in no more bits than the sets in n-grams."""
    bits = sketch_bytes(len(grams)) * 8 * times
    odd = np.bincount((grams % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(data: bytes, width: int) -> np.ndarray:
    """A sketch at a smaller width, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(data, np.uint64).reshape(-1, width // 8), 0)


def classes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id`` of every row."""
    docs = docs.select(key, text)
    ids, order = read_sets(docs, words, text, key)
    n_grams = ids.agg(F.sum("n")).first()[0] or 0
    order = docs.sparkSession.sparkContext.broadcast(order)
    rows = materialise(shared_prefixes(docs, order, percent, words, text, n_grams), "prefixes")
    shared = rows.select("k").distinct()
    sketches = materialise(ids.join(shared, "k", "left_semi").groupBy("k").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    labels = links = None

    def join_up(rows, sketches, spanning):
        nonlocal labels, links
        pairs = materialise(cross_pairs(labelled(rows), sketches, percent, spanning), "pairs")
        if pairs.limit(1).count():
            found = verify(pairs, docs, ids, order, percent, words, text, key)
            links = found if links is None else links.union(found)
            labels = components(links)
        discard(pairs)

    def labelled(rows):
        if labels is None:
            return rows.withColumn("c", F.col("k"))
        return rows.join(labels, "k", "left").withColumn("c", F.coalesce("c", "k"))

    join_up(rows, sketches, True)
    left = materialise(cross_pairs(labelled(rows), sketches, percent, False, among=True), "left")
    discard(rows, sketches)
    if left.limit(1).count():
        wide = wide_sketches(left.select("k").distinct(), docs, ids, words, text, key)
        for spanning in (True, False):
            join_up(left, wide, spanning)
        discard(wide)
    discard(left)
    if labels is None:
        labels = ids.where("false").select("k", F.col("k").alias("c"))
    first = ids.where("k IS NOT NULL").groupBy("k").agg(F.min(key).alias("first"))
    named = first.join(labels, "k", "left").select("k", "first", F.coalesce("c", "k").alias("c"))
    named = materialise(named, "named")
    component = named.groupBy("c").agg(F.min("first").alias("component_id"))
    of = named.join(component, "c").select("k", "component_id")
    return ids.join(of, "k", "left").select(
        F.col(key), F.col("n").alias("n_shingles"), F.when(F.col("k").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The document with the smallest id of each component, and all that link with nothing."""
    found = classes(docs, percent, words, text, key)
    gone = materialise(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), "gone")
    return docs.join(small(gone), key, "left_anti").select(*map(quoted, docs.columns))


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
