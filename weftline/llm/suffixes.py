"""Removal of long repeated byte strings by a sparse, distributed suffix sort.

Every byte covered by a string of :data:`LENGTH` bytes that also starts anywhere
else is removed. Only some suffixes need sorting: each such string holds an
anchor, the position in its first ``LENGTH - PREFIX`` bytes whose 8-byte hash is
least, and equal strings hold it at the same place. So for every anchor ``x``

1. the hash of its first :data:`PREFIX` bytes is counted; anchors with a hash
   that occurs once are done with (their distinguishing prefix is no longer);
2. the suffix at ``x`` (at most ``LENGTH`` bytes) is put into sorted runs, which
   are front-coded (length of the prefix shared with the one before, and the
   rest) and exchanged by the hash of the prefix, with the bytes to the left;
3. runs are merged by a loser tree on known common prefixes: a contest compares
   only bytes beyond the prefix that both share with the last winner, and gives
   the common prefix of neighbours for free;
4. for two suffixes that share ``R`` bytes to the right and ``L`` to the left,
   the strings that start ``i`` bytes before the anchors are equal for all
   ``LENGTH - R <= i <= L``.

Prefixes shared by more than :data:`HOT` anchors never meet in one task: their
strings are counted by 128-bit hashes, summed within tasks first. Copies of whole
texts are found by their digest beforehand; one of them stands for all.

:func:`remove_repeats` can also remove repeated runs of so many words or more,
however few bytes they have: each word (bytes between ASCII white space) becomes
:data:`CODE` bytes of hash, and the same steps run over whole codes.

Defined results: null is the empty text; texts shorter than ``LENGTH`` keep all
their bytes and lend none; repeated rows are copies of each other; an empty table
gives an empty table; other columns are ignored by :func:`repeats` and kept by
:func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, discard, map_batches, materialise, quoted, slices, table, utf8
from .jaccard import CACHE_WORDS, WordHashes

LENGTH = 400
#: The fewest words of a passage whose repeats the query counts beside the removed bytes.
PASSAGE_WORDS = 51
PREFIX = 100
#: Bytes of a word's hash, and the words of an anchor's prefix where words are compared.
CODE = 8
PREFIX_WORDS = 16
#: Anchors with one prefix up to which suffixes are merged; beyond it strings are counted.
HOT = 64
#: Anchors with one prefix in a task from which it is hot.
HOT_IN_TASK = 8
#: Anchors of a bucket, about, and those a task packs at a time.
BUCKET_ROWS, PACKED = 150_000, 150_000
#: Bytes of suffixes that a task sorts into one run.
RUN_BYTES = 8 << 20
#: Positions of a text looked at together for their anchors.
POSITIONS = 1 << 24
#: Strings with a hot anchor that a task compares at a time.
HELD = 400_000
#: Rows (of fixed size, or counted with their spans) up to which a side is broadcast; beyond it joins shuffle.
SMALL = 300_000

_ANCHOR = np.dtype([("c", "<u8"), ("r", "<i8"), ("p", "<i4"), ("n", "<i4")])
#: A string of ``length`` bytes by its hashes, and where it starts; or (``end`` not 0) a span; or (``start`` NOTE) a summary.
_STRING = np.dtype([("a", "<u8"), ("b", "<u8"), ("r", "<i8"), ("start", "<i4"), ("end", "<i4")])
NOTE = -1
_rng = np.random.default_rng(20240229)
_BYTES = [_rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_word = re.compile(rb"[^ \t-\r]+")
_SPANS = "array<struct<start:int,end:int>>"
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as long as asked for."""

    def __init__(self, base: int):
        self.up, self.down = (self.make(b, 1 << 16) for b in (base, pow(base, -1, 1 << 64)))
        self.base = base

    @staticmethod
    def make(base: int, n: int) -> np.ndarray:
        x = np.full(n, np.uint64(base))
        x[0] = 1
        return np.multiply.accumulate(x)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = (self.make(b, 2 * n) for b in (self.base, pow(self.base, -1, 1 << 64)))


_powers = [Powers(b) for b in _BASES]


def prefix_sums(data: np.ndarray, which: int) -> np.ndarray:
    """Polynomial prefix hashes; a substring's hash is a difference, moved to exponent 0."""
    powers = _powers[which]
    powers.reach(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * powers.up[: len(data)], out=out[1:])
    return out


def hashes(sums: np.ndarray, at: np.ndarray, length: int, which: int) -> np.ndarray:
    return (sums[at + length] - sums[at]) * _powers[which].down[at]


def leaders(data: bytes, length: int = LENGTH, prefix: int = PREFIX, step: int = 1) -> np.ndarray:
    """The anchor of the string of ``length`` bytes at each position that ``step`` divides (empty if there is none)."""
    n = (len(data) - length) // step + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if n > POSITIONS:  # a position's anchor depends on its own string only
        parts = range(0, n, POSITIONS)
        return np.concatenate([leaders(data[i * step : (min(n, i + POSITIONS) - 1) * step + length], length, prefix, step) + i * step for i in parts])
    width = (length - prefix) // step + 1
    # 8 bytes at every position that an anchor may have
    v = np.ndarray((n + width - 1,), "<u8", data, strides=(step,)) * np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    v >>= np.uint64(28)
    v <<= np.uint64(28)
    v |= np.arange(len(v), dtype=np.uint64)  # of equal hashes the first is least
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[: n], v[width - span : width - span + n])
    return (v[:n] & np.uint64((1 << 28) - 1)).astype(np.int64) * step


def text_ref(digest: Column) -> Column:
    """60 bits of a text's digest as a long."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def buckets_for(rows: float) -> int:
    return max(8, int(rows // BUCKET_ROWS) + 1)


def pack(rows: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    """One packed array for each bucket."""
    by = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(to[by]) != 0]) if len(by) else np.zeros(0, np.int64)
    parts = np.split(rows[by], cut[1:]) if len(by) else []
    return pa.RecordBatch.from_arrays([pa.array(to[by][cut], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "data"])


def by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket")


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """``bucket, [data]`` of a partition sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(data.as_py())
    if held:
        yield now, held


def candidates(texts: DataFrame, n_bytes: int, length: int, prefix: int, step: int = 1) -> DataFrame:
    """``r, p, hot``: anchors of ``texts`` (r, text) whose prefix occurs at another anchor.

    A task that holds a prefix HOT_IN_TASK times sends one summary of it; its
    anchors are hot already and are dealt out by anchor, so no bucket grows with
    one prefix.
    """
    buckets = buckets_for(n_bytes * 2 / (length - prefix))

    def send(batches):
        held, size = [], 0

        def out():
            rows = np.concatenate(held)
            values, where, count = np.unique(rows["c"], return_inverse=True, return_counts=True)
            hot = count[where] >= HOT_IN_TASK
            own = rows["c"] ^ (rows["r"].astype(np.uint64) * np.uint64(31) + rows["p"].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            to = (np.where(hot, own, rows["c"]) >> np.uint64(20)) % np.uint64(buckets)
            to = np.where(hot, -1 - to.astype(np.int64), to.astype(np.int64))
            often = count >= HOT_IN_TASK
            notes = np.zeros(int(often.sum()), _ANCHOR)
            notes["c"], notes["p"], notes["n"] = values[often], -1, np.minimum(count[often], 1 << 30)
            note_to = ((notes["c"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            return pack(np.concatenate([rows, notes]), np.r_[to, note_to])

        for batch in batches:
            for part in slices(batch):
                for r, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = utf8(text)
                    at = np.unique(leaders(data, length, prefix, step))
                    if len(at):
                        rows = np.empty(len(at), _ANCHOR)
                        rows["c"] = hashes(prefix_sums(np.frombuffer(data, np.uint8), 0), at, prefix, 0)
                        rows["r"], rows["p"], rows["n"] = r, at, 1
                        held.append(rows)
                        size += len(rows)
                if size >= PACKED:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def find(batches):
        for bucket, data in whole_buckets(batches):
            rows = np.frombuffer(b"".join(data), _ANCHOR)
            if bucket < 0:
                hot = np.ones(len(rows), bool)
            else:
                _, where = np.unique(rows["c"], return_inverse=True)
                total = np.bincount(where, rows["n"])
                noted = np.bincount(where, rows["p"] < 0) > 0
                hot = (noted | (total > HOT))[where]
                keep = (rows["p"] >= 0) & (total[where] >= 2)
                rows, hot = rows[keep], hot[keep]
            for i in range(0, len(rows), 50_000):
                part = rows[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part["r"]), pa.array(part["p"]), pa.array(hot[i : i + 50_000])], names=["r", "p", "hot"])

    sent = texts.select("r", "text").transform(map_batches, send, "bucket bigint, data binary")
    return by_bucket(sent, buckets).transform(map_batches, find, "r bigint, p int, hot boolean")


# --- sorted runs and their merge -------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are not looked at."""
    n = min(len(a), len(b))
    d = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (d.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix lengths and rests of a sorted list."""
    shared = [0, *map(common_prefix, suffixes, suffixes[1:])] if suffixes else []
    return shared, [s[n:] for s, n in zip(suffixes, shared)]


class Run:
    """A front-coded sorted run, read one suffix at a time."""

    def __init__(self, shared, rests, loads):
        self.items = iter(zip(shared, rests, loads))
        self.now: bytes | None = b""
        self.load = None
        self.known = 0  # common prefix with the last winner met
        self.step()

    def step(self) -> None:
        item = next(self.items, None)
        if item is None:
            self.now = None
        else:
            self.known, rest, self.load = item
            self.now = self.now[: self.known] + rest


class LoserTree:
    """Merges runs; yields ``(suffix, common prefix with the one before, load)`` in order."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size

    def contest(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one it shares with the winner."""
        if b < 0 or b >= len(self.runs) or self.runs[b].now is None:
            return a, b
        if a < 0 or a >= len(self.runs) or self.runs[a].now is None:
            return b, a
        x, y = self.runs[a], self.runs[b]
        if x.known != y.known:  # the longer prefix shared with the last winner is nearer to it
            return (a, b) if x.known > y.known else (b, a)
        n = common_prefix(x.now, y.now, x.known)
        first = x.now[n:] <= y.now[n:] if n >= min(len(x.now), len(y.now)) else x.now[n] < y.now[n]
        if first:
            y.known = n
            return a, b
        x.known = n
        return b, a

    def build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self.build(2 * node), self.build(2 * node + 1)
        winner, self.losers[node] = self.contest(a, b)
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        if not self.runs:
            return
        winner = self.build(1) if self.size > 1 else 0
        first = True
        while 0 <= winner < len(self.runs) and (run := self.runs[winner]).now is not None:
            yield run.now, 0 if first else run.known, run.load
            first = False
            run.step()
            node = (winner + self.size) // 2
            while node:
                winner, self.losers[node] = self.contest(winner, self.losers[node])
                node //= 2


def equal_strings(cluster: list[tuple[bytes, int, tuple]], length: int, prefix: int, step: int = 1) -> Iterator[tuple[int, int, int]]:
    """``r, start, end`` of repeated strings around the anchors of one cluster.

    ``cluster``: suffixes in order with the common prefix of each and the one
    before; the load is ``(r, x, left)``.
    """
    most = length - prefix
    spans: list[list[tuple[int, int]]] = [[] for _ in cluster]
    lefts = [(int.from_bytes(load[2], "big"), len(load[2])) for _, _, load in cluster]
    for a in range(len(cluster)):
        right = length
        la, na = lefts[a]
        for b in range(a + 1, len(cluster)):
            right = min(right, cluster[b][1])
            lb, nb = lefts[b]
            n = min(na, nb, most)
            if d := la ^ lb:
                n = min(n, ((d & -d).bit_length() - 1) // 8)
            lo, hi = -(-(length - right) // step) * step, n // step * step
            if lo <= hi:
                spans[a].append((lo, hi))
                spans[b].append((lo, hi))
    for (_, _, (r, x, _)), own in zip(cluster, spans):
        if own:  # all these strings cover the anchor's prefix, so together they are one stretch
            yield r, x - max(hi for _, hi in own), x - min(lo for lo, _ in own) + length


def merged_repeats(anchored: DataFrame, n_anchors: int, length: int, prefix: int, step: int = 1) -> DataFrame:
    """``r, start, end`` of repeats found by merging sorted runs; ``anchored``: r, text, at (anchors, hot)."""
    buckets = buckets_for(n_anchors * 4)
    load_type = np.dtype([("r", "<i8"), ("x", "<i4"), ("shared", "<u2"), ("rest", "<u2"), ("left", "<u2")])

    def send(batches):
        held, size = [], 0

        def out():
            nonlocal held
            runs: dict[int, list] = {}
            for to, *item in held:
                runs.setdefault(to, []).append(item)
            held = []
            blobs = []
            for to in list(runs):
                items = sorted(runs.pop(to), key=lambda i: i[0])
                shared, rests = front_code([i[0] for i in items])
                head = np.empty(len(items), load_type)
                head["r"], head["x"], head["left"] = [i[1] for i in items], [i[2] for i in items], [len(i[3]) for i in items]
                head["shared"], head["rest"] = shared, [len(x) for x in rests]
                blobs.append((to, len(items).to_bytes(4, "little") + head.tobytes() + b"".join(rests) + b"".join(i[3] for i in items)))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int64()), pa.array([d for _, d in blobs], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for part in slices(batch):
                for r, text, anchors in zip(*(c.to_pylist() for c in part.columns)):
                    data = utf8(text)
                    at = np.array([a["p"] for a in anchors if not a["hot"] and a["p"] + prefix <= len(data)], np.int64)
                    if not len(at):
                        continue
                    to = (hashes(prefix_sums(np.frombuffer(data, np.uint8), 0), at, prefix, 0) >> np.uint64(20)) % np.uint64(buckets)
                    for x, b in zip(at.tolist(), to.tolist()):
                        suffix, left = data[x : x + length], data[max(0, x - length + prefix) : x]
                        held.append((b, suffix, r, x, left))
                        size += len(suffix) + len(left)
                    if size > RUN_BYTES:
                        yield out()
                        size = 0
        if held:
            yield out()

    def parse(blob: bytes) -> Run:
        n = int.from_bytes(blob[:4], "little")
        head = np.frombuffer(blob, load_type, n, 4)
        at = 4 + n * load_type.itemsize
        ends = at + np.cumsum(head["rest"], dtype=np.int64)
        left_ends = (int(ends[-1]) if n else at) + np.cumsum(head["left"], dtype=np.int64)
        rests = (blob[e - k : e] for e, k in zip(ends.tolist(), head["rest"].tolist()))
        loads = ((r, x, blob[e - k : e]) for r, x, e, k in zip(head["r"].tolist(), head["x"].tolist(), left_ends.tolist(), head["left"].tolist()))
        return Run(head["shared"].tolist(), rests, loads)

    def merge(batches):
        for _, blobs in whole_buckets(batches):
            rs, starts, ends = [], [], []
            cluster: list = []

            def solve():
                if len(cluster) > 1:
                    for r, a, b in equal_strings(cluster, length, prefix, step):
                        rs.append(r), starts.append(a), ends.append(b)

            for suffix, shared, load in LoserTree([parse(b) for b in blobs]):
                if shared < prefix:
                    solve()
                    cluster = []
                cluster.append((suffix, shared, load))
            solve()
            yield spans_batch(rs, starts, ends)

    sent = anchored.select("r", "text", "at").transform(map_batches, send, "bucket bigint, data binary")
    return by_bucket(sent, buckets).transform(map_batches, merge, "r bigint, start int, end int")


def spans_batch(rs, starts, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["r", "start", "end"])


# --- prefixes that very many anchors share ---------------------------------------


def hot_strings(data: bytes, hot: list[int], length: int, prefix: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the strings whose anchor is hot, and their two hashes."""
    lead = leaders(data, length, prefix, step)
    at = np.flatnonzero(np.isin(lead, hot)) * step
    flat = np.frombuffer(data, np.uint8)
    return at, *(hashes(prefix_sums(flat, w), at, length, w) for w in (0, 1))


def counted_repeats(anchored: DataFrame, n_hot: int, length: int, prefix: int, step: int = 1) -> DataFrame:
    """``r, start, end`` of repeats with a hot anchor, from counts of string hashes.

    Strings that a task finds twice among HELD are repeated for certain: it passes
    on their spans and one summary each. The others travel with their place, packed
    by buckets of hashes, where all occurrences and summaries of a string meet. So
    of a string that very many texts hold only summaries are gathered.
    """
    buckets = buckets_for(n_hot * (length - prefix) / step / 4)

    def strings(batches):
        for batch in batches:
            for part in slices(batch):
                for r, text, anchors in zip(*(c.to_pylist() for c in part.columns)):
                    hot = [a["p"] for a in anchors if a["hot"]]
                    if hot:
                        yield r, *hot_strings(utf8(text), hot, length, prefix, step)

    def send(batches):
        held, size, turn = [], 0, 0

        def out():
            rows = np.empty(size, _STRING)
            for name, parts in zip(("r", "start", "a", "b"), zip(*held)):
                rows[name] = np.concatenate(parts)
            rows["end"] = 0
            rows = rows[np.lexsort((rows["b"], rows["a"]))]
            new = np.r_[True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])]
            first = np.flatnonzero(new)
            twice = np.diff(np.r_[first, len(rows)]) > 1
            notes = rows[first[twice]]
            notes["r"], notes["start"] = 0, NOTE
            again = np.repeat(twice, np.diff(np.r_[first, len(rows)]))
            spans = covered(rows["r"][again], rows["start"][again], length)
            rows = np.concatenate([rows[~again], notes])
            to = ((rows["a"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            return pack(np.concatenate([rows, spans]), np.r_[to, np.full(len(spans), turn % buckets)])

        for r, at, a, b in strings(batches):
            if len(at):
                held.append((np.full(len(at), r), at, a, b))
                size += len(at)
            if size > HELD:
                yield out()
                held, size, turn = [], 0, turn + 1
        if held:
            yield out()

    def meet(batches):
        for _, data in whole_buckets(batches):
            rows = np.frombuffer(b"".join(data), _STRING)
            done = rows[rows["end"] > 0]
            rows = rows[rows["end"] == 0]
            rows = rows[np.lexsort((rows["b"], rows["a"]))]
            first = np.flatnonzero(np.r_[True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])]) if len(rows) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(rows)])
            note = rows["start"] == NOTE
            again = np.repeat((count > 1) | (np.add.reduceat(note, first) > 0 if len(first) else count > 1), count) & ~note
            found = np.concatenate([done, covered(rows["r"][again], rows["start"][again], length)])
            yield spans_batch(found["r"], found["start"], found["end"])

    source = anchored.where(F.exists("at", lambda x: x["hot"])).select("r", "text", "at")
    sent = source.transform(map_batches, send, "bucket bigint, data binary")
    return by_bucket(sent, buckets).transform(map_batches, meet, "r bigint, start int, end int")


def covered(r: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs covered by strings at ``start`` in the texts ``r``."""
    by = np.lexsort((start, r))
    r, start = r[by], start[by]
    new = np.r_[True, (r[1:] != r[:-1]) | (start[1:] > start[:-1] + length)] if len(r) else np.zeros(0, bool)
    out = np.zeros(int(new.sum()), _STRING)
    out["r"], out["start"], out["end"] = r[new], start[new], start[np.r_[new[1:], True]] + length if len(r) else 0
    return out


# --- the operator ----------------------------------------------------------------


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def merged_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def coded(texts: DataFrame) -> DataFrame:
    """``r, text`` with each word's hash in place of the word."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for part in slices(batch):
                codes = []
                for t in part.column(1).to_pylist():
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    found = utf8(t).split()
                    codes.append(np.fromiter(map(known.__getitem__, found), "<u8", len(found)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.binary())], names=["r", "text"])

    return texts.select("r", "text").transform(map_batches, run, "r bigint, text binary")


def word_spans(data: bytes, spans) -> list[dict[str, int]]:
    """Bytes of a text for spans of its words' codes, up to where the next word starts."""
    if not spans:
        return []
    starts = [m.start() for m in _word.finditer(data)] + [len(data)]
    return [{"start": starts[s["start"] // CODE], "end": starts[s["end"] // CODE]} for s in spans]


def spans_of(texts: DataFrame, n_bytes: int, length: int, prefix: int, step: int = 1) -> DataFrame:
    """``r, spans`` of the repeated strings in ``texts`` (r, text)."""
    found = materialise(candidates(texts, n_bytes, length, prefix, step), "anchors")
    lists = materialise(found.groupBy("r").agg(F.collect_list(F.struct("p", "hot")).alias("at")), "lists")
    n_found, n_lists = found.count(), lists.count()
    own = texts.select("r", "text")
    if n_lists <= SMALL:  # only texts with anchors are moved to their anchors
        own = own.join(F.broadcast(lists.select("r")), "r", "left_semi")
    anchored = materialise(own.join(lists, "r"), "anchored")
    spans = merged_repeats(anchored, n_found, length, prefix, step)
    n_hot = found.where("hot").count()
    if n_hot:
        spans = spans.unionByName(counted_repeats(anchored, n_hot, length, prefix, step))

    def merge(batches):
        for batch in batches:
            rs, spans = [], []
            for r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rs.append(r), spans.append([{"start": a, "end": b} for a, b in merged_spans(x)])
            yield pa.RecordBatch.from_arrays([pa.array(rs, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["r", "spans"])

    spans = spans.groupBy("r").agg(F.collect_list(F.struct("start", "end")).alias("x"))
    spans = materialise(spans.transform(map_batches, merge, f"r bigint, spans {_SPANS}"), "spans")
    discard(found, lists, anchored)
    return spans


class Repeats:
    """What is to be removed from the texts of ``docs``.

    ``ids``: key, digest, n_bytes, n_words (0 without ``words``) of every row.
    ``copies``: digest and sizes of texts that occur more than once, and whether
    they are ``long`` enough to go, or ``wordy`` enough. ``spans``: r and spans of other texts, those of
    ``words`` or more repeated words by their codes.
    """

    def __init__(self, docs: DataFrame, length: int, prefix: int, text: str, key: str, words: int = 0):
        digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
        size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")
        n_words = (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^ \t-\r]+")) if words else F.lit(0)).cast("bigint")
        self.ids = materialise(docs.select(F.col(key), digest.alias("digest"), size.alias("n_bytes"), n_words.alias("n_words")), "digests")
        groups = self.ids.groupBy("digest").agg(F.count(F.lit(1)).alias("m"), F.min(key).alias("rep"), F.max("n_bytes").alias("n_bytes"), F.max("n_words").alias("n_words")).where("m > 1")
        long, wordy = F.col("n_bytes") >= length, F.col("n_words") >= words if words else F.lit(False)
        self.copies = materialise(groups.withColumns({"long": long, "wordy": wordy}), "copies")
        rest = self.ids.join(self.copies.select("digest", "rep"), "digest").where(F.col(key) > F.col("rep")).select(F.col(key).alias("k"), F.col("digest").alias("d")).distinct()
        self.rest = rest = materialise(rest, "further")
        texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"), digest.alias("d")).where(F.octet_length("text") >= (min(length, 2 * words - 1) if words else length))
        n_rest = rest.count()
        if n_rest:
            texts = texts.join(small(rest, n_rest), ["k", "d"], "left_anti")
        self.texts = texts.select(text_ref(F.col("d")).alias("r"), "d", "text")
        total = self.ids.agg(F.sum("n_bytes")).first()[0] or 0
        none = F.array().cast(_SPANS)
        self.spans = spans_of(self.texts, total, length, prefix)
        if words:
            codes = materialise(coded(self.texts), "codes")  # read twice; written, no task holds a worker for codes and one for anchors
            more = spans_of(codes, total, words * CODE, PREFIX_WORDS * CODE, CODE)
            both = self.spans.withColumn("by_word", none).unionByName(more.select("r", none.alias("spans"), F.col("spans").alias("by_word")))
            single, self.spans = self.spans, materialise(both.groupBy("r").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "by_word"))), "spans")
            discard(single, more, codes)

    def discard(self) -> None:
        discard(self.rest, self.spans)

    def affected(self) -> DataFrame:
        """``d, text, spans`` of texts with repeated strings, one of each group of copies among them."""
        spans = self.spans if "by_word" in self.spans.columns else self.spans.withColumn("by_word", F.array().cast(_SPANS))
        weight = spans.agg(F.sum(F.size("spans") + F.size("by_word") + 1)).first()[0] or 0  # spans of a row have no bound, so they count too
        return self.texts.join(small(spans, weight), "r").select("d", "text", "spans", "by_word")


def checked(words: int) -> int:
    if words and words < PREFIX_WORDS:
        raise ValueError(f"runs of under {PREFIX_WORDS} words")
    return words


def repeats(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, text: str = "text", key: str = "doc_id", words: int = 0) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    With ``words`` (:data:`PREFIX_WORDS` at least), also ``n_passages`` and
    ``passage_words``: maximal runs covered by repeated runs of so many words or
    more, however few bytes they have, and the words in them. They take no part
    in what is removed.
    """
    found = Repeats(docs, length, prefix, text, key, checked(words))
    ddl = "digest string, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, passage_words bigint"
    schema = arrow_schema(ddl)

    def digest(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for d, t, s, w in zip(*(c.to_pylist() for c in part.columns)):
                    spans, runs = merged_spans(s), merged_spans(w)
                    kept = hashlib.sha256(cut_out(utf8(t), spans)).hexdigest()
                    out.append((d, sum(b - a for a, b in spans), len(spans), kept, len(runs), sum(b - a for a, b in runs) // CODE))
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), schema.types)], schema=schema)

    parts = found.affected().transform(map_batches, digest, ddl)
    # every byte and word of a copy is repeated, if it has enough of them
    whole = found.copies.where("long OR wordy").select(
        "digest",
        F.when(F.col("long"), F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.col("long").cast("bigint").alias("n_spans"),
        F.when(F.col("long"), F.sha2(F.lit("").cast("binary"), 256)).alias("kept_sha256"),
        F.col("wordy").cast("bigint").alias("n_passages"),
        F.when(F.col("wordy"), F.col("n_words")).otherwise(0).alias("passage_words"),
    )
    parts = parts.join(found.copies.select("digest"), "digest", "left_anti")
    verdict = materialise(parts.unionByName(whole), "verdicts")
    found.discard()
    counts = ["n_removed", "n_spans", "n_passages", "passage_words"][: 4 if words else 2]
    values = [F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    return found.ids.join(verdict, "digest", "left").select(F.col(key), "n_bytes", *values[:2], F.coalesce("kept_sha256", "digest").alias("kept_sha256"), *values[2:])


def remove_repeats(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, text: str = "text", key: str = "doc_id", size: str = "n_chars", words: int = 0) -> DataFrame:
    """Rows of ``docs`` with repeated bytes removed from their texts, all columns kept.

    With ``words``, repeated runs of so many words (:data:`PREFIX_WORDS` at least)
    or more go too, with the white space that follows each word.
    A character that loses some of its bytes loses them all; ``size``, where such
    a column exists, becomes the length of the new text. Null texts stay null.
    """
    found = Repeats(docs, length, prefix, text, key, checked(words))
    mark = uuid.uuid4().hex  # no column of docs has such a name
    own, changed, shortened = f"digest_{mark}", f"text_{mark}", f"shortened_{mark}"

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                ds, ts = [], []
                for d, t, s, w in zip(*(c.to_pylist() for c in part.columns)):
                    data = utf8(t)
                    ds.append(d), ts.append(cut_out(data, merged_spans(s + word_spans(data, w))).decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([pa.array(ds, pa.string()), pa.array(ts, pa.string())], names=[own, changed])

    parts = found.affected().transform(map_batches, cut, f"{own} string, {changed} string").join(found.copies.select(F.col("digest").alias(own)), own, "left_anti")
    new = materialise(parts, "texts")
    found.discard()
    # only digests are broadcast; new texts, whose size has no bound, meet the few rows that get one in a shuffle
    changes = new.select(own, F.lit(True).alias(shortened)).unionByName(found.copies.where("long OR wordy").select(F.col("digest").alias(own), F.lit(False).alias(shortened)))
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    marked = docs.withColumn(own, digest).join(small(changes, changes.count()), own, "left")
    cut_rows = marked.where(F.col(shortened)).join(new, own)
    others = marked.where(~F.coalesce(F.col(shortened), F.lit(False))).withColumn(changed, F.when(F.col(shortened).isNotNull(), F.lit("")))
    joined = cut_rows.unionByName(others)
    values = {text: F.when(F.col(text).isNotNull() & F.col(changed).isNotNull(), F.col(changed)).otherwise(F.col(text))}
    if size in docs.columns:
        values[size] = F.when(F.col(changed).isNotNull(), F.length(changed).cast(docs.schema[size].dataType)).otherwise(F.col(size))
    return joined.select(*(values[c].alias(c) if c in values else F.col(quoted(c)) for c in docs.columns))


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"), words=PASSAGE_WORDS)
