"""Benchmark decontamination by Wu-Manber multi-pattern search.

A text is reduced to its words (lower-cased A-Z; bytes outside words become one
space each run) with a space at either end; a window of test words becomes the
pattern ``" w1 w2 ... "``, a slice of its item's text. Patterns are put in classes by length. In each class
the last block of bytes of the search position selects a shift from a table;
shift 0 selects, by the hash of that block, the bucket of patterns to compare
directly. Many stretches of text, overlapping by the longest pattern, move
through the tables side by side in numpy.

Defined results: null and texts without words have no words and are never
contaminated; an item without words has no windows, one of fewer than ``window``
words is one window; repeated items each count by their own id; repeated rows
give repeated rows; empty tables give empty tables (an empty benchmark leaves
every document clean); other columns are ignored by :func:`search` and kept by
:func:`drop_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, map_rows, materialise, table, utf8

WINDOW = 10
#: Bytes of benchmark text that one pass holds as patterns; more is searched in further passes.
PASS_BYTES = 4 << 20
STRETCH = 4096
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def words(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return data.translate(_WORD).split()


class Windows:
    """The different windows of some items, as slices of one byte string."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.ids = [str(i) for i, _ in items]
        texts, starts, ends, owners, at = [], [], [], [], 0
        for k, (_, text) in enumerate(items):
            found = words(utf8(text))
            if not found:
                continue
            flat = b" " + b" ".join(found) + b" "
            blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32) + at
            size = min(window, len(found))
            starts.append(blanks[: len(blanks) - size])
            ends.append(blanks[size:] + 1)
            owners.append(np.full(len(starts[-1]), k))
            texts.append(flat)
            at += len(flat)
        self.text = b"".join(texts)
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        start, end, owner = join(starts), join(ends), join(owners)
        # equal windows become one, owned by all their items
        digest = b"".join(xxhash.xxh3_128_digest(self.text[a:b]) for a, b in zip(start.tolist(), end.tolist()))
        keys = np.frombuffer(digest, np.dtype([("a", "<u8"), ("b", "<u8")]))
        by = np.lexsort((owner, keys["b"], keys["a"]))
        keys = keys[by]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(by) else by
        self.start, self.length = start[by][first], (end - start)[by][first]
        self.owner, self.owned = owner[by], np.r_[first, len(by)]

    def __len__(self) -> int:
        return len(self.start)

    def items(self, k: int) -> set[str]:
        return {self.ids[i] for i in self.owner[self.owned[k] : self.owned[k + 1]].tolist()}


class WuManber:
    """Finds all occurrences of windows in many texts; a window costs some tens of bytes besides its item's text."""

    def __init__(self, windows: Windows):
        self.windows, self.classes = windows, []
        text = np.frombuffer(windows.text, np.uint8)
        kind = np.minimum(np.frexp(windows.length)[1], 6)
        for c in np.unique(kind).tolist():
            ids = np.flatnonzero(kind == c)
            least = int(windows.length[ids].min())
            block = min(least, 8)
            bits = min(22, max(16, (len(ids) * least * 4).bit_length()))
            shift = np.full(1 << bits, least - block + 1, np.int32)
            suffix = np.zeros(len(ids), np.int64)
            for end in range(block, least + 1):
                suffix = self.hashed([text[windows.start[ids] + (end - block + j)] for j in range(block)], bits)
                np.minimum.at(shift, suffix, least - end)
            by = np.argsort(suffix, kind="stable")
            self.classes.append((least, block, bits, shift, suffix[by], ids[by]))

    @staticmethod
    def hashed(columns, bits: int) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h & np.uint64((1 << bits) - 1)).astype(np.int64)

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """``(text, byte, window)`` of every occurrence."""
        if not len(self.windows) or not texts:
            return
        flat_bytes, own = b"".join(texts), self.windows
        flat = np.frombuffer(flat_bytes, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        count = -(-sizes // STRETCH)
        of = np.repeat(np.arange(len(texts)), count)
        first = starts[of] + STRETCH * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        for least, block, bits, shift, suffixes, ids in self.classes:
            at, text = first.copy(), of.copy()
            # a stretch owns the positions below `stop`; a match there may reach beyond it
            stop = np.minimum(first + STRETCH, ends[of] - least + 1)
            while True:
                live = at < stop
                if not live.all():
                    at, text, stop = at[live], text[live], stop[live]
                if not len(at):
                    break
                tail = at + (least - block)
                h = self.hashed([flat[tail + j] for j in range(block)], bits)
                step = shift[h]
                hit = np.flatnonzero(step == 0)
                lo, hi = np.searchsorted(suffixes, h[hit]), np.searchsorted(suffixes, h[hit], "right")
                for i, a, b in zip(hit.tolist(), lo.tolist(), hi.tolist()):
                    p, end = int(at[i]), int(ends[text[i]])
                    for k in ids[a:b].tolist():
                        start, n = int(own.start[k]), int(own.length[k])
                        if p + n <= end and flat_bytes[p : p + n] == own.text[start : start + n]:
                            yield int(text[i]), p - int(starts[text[i]]), k
                at = at + np.maximum(step, 1)


class Matcher:
    """The windows of some items, searched in batches of documents."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.windows = Windows(items, window)
        self.search = WuManber(self.windows)

    def run(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Word counts, hit word ranges and items found of each text."""
        split = [words(utf8(t)) for t in texts]
        flat = [b" " + b" ".join(w) + b" " if w else b"" for w in split]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        blanks: dict[int, np.ndarray] = {}
        for t, byte, k in self.search.find(flat):
            if t not in blanks:
                blanks[t] = np.flatnonzero(np.frombuffer(flat[t], np.uint8) == 32)
            a, b = np.searchsorted(blanks[t], [byte, byte + int(self.windows.length[k]) - 1]).tolist()
            spans[t].append((a, b))
            items[t] |= self.windows.items(k)
        return [len(w) for w in split], [merged(s) for s in spans], items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def passes(items: DataFrame, text: str, key: str) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of at most PASS_BYTES (or one item) of text, at least one.

    Benchmarks are small beside documents, yet no size is assumed: rows stream
    to the driver, which holds one block; each is one broadcast-sized set of windows.
    """
    block: list[tuple[object, str | None]] = []
    held = 0
    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        size = len(utf8(row.t))
        if block and held + size > PASS_BYTES:
            yield block
            block, held = [], 0
        block.append((row.k, row.t))
        held += size
    yield block


def search(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``key, n_words, spans array<struct<first,after>>, items array<string>`` of every row of ``docs``.

    ``spans`` are merged ranges of hit words, ``items`` the ids (as sorted
    strings) whose windows occur. For several passes every row is written once with
    a number of its own, by which the written results of the passes are put together.
    """
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, n_words bigint, spans array<struct<first:bigint,after:bigint>>, items array<string>"
    blocks = passes(benchmark, item_text, item)
    sc = docs.sparkSession.sparkContext
    block, after = next(blocks), next(blocks, None)
    several = after is not None
    rows = docs.select(key, text)
    if several:
        rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def one(sent) -> DataFrame:
        def make():
            matcher = Matcher(sent.value, window)

            def run(keys, texts, *numbers):
                n, spans, items = matcher.run(texts)
                return dict(zip(["_row"], numbers)) | {key: keys, "n_words": n, "spans": [[{"first": a, "after": b} for a, b in s] for s in spans], "items": [sorted(i) for i in items]}

            return run

        return map_rows(rows, make, "_row bigint, " + ddl if several else ddl)

    if not several:
        return one(sc.broadcast(block))
    found = None
    while block is not None:
        sent = sc.broadcast(block)
        # a later pass has something to say of few rows
        part = materialise(one(sent) if found is None else one(sent).where(F.size("spans") > 0), "pass")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
        block, after = after, next(blocks, None)
    discard(rows)
    parts = found.groupBy("_row").agg(
        F.first(key).alias(key), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).drop("_row")

    def join(keys, n, spans, items):
        return {key: keys, "n_words": n, "spans": [[{"first": a, "after": b} for a, b in merged([(s["first"], s["after"]) for s in x])] for x in spans], "items": items}

    return map_rows(parts, lambda: join, ddl)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """Counts and digest of :func:`search`."""
    found = search(docs, benchmark, window, key=key)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["after"] - s["first"])
    return found.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs`` in which no window of any benchmark item occurs, with all their columns."""
    sc, kept = docs.sparkSession.sparkContext, docs
    for block in passes(benchmark, item_text, item):
        sent = sc.broadcast(block)

        def keep(batches, sent=sent):
            import pyarrow as pa

            from .common import slices

            matcher = Matcher(sent.value, window)
            for batch in batches:
                for part in slices(batch):
                    _, spans, _ = matcher.run(part.column(part.schema.get_field_index(text)).to_pylist())
                    yield part.filter(pa.array([not s for s in spans], pa.bool_()))

        kept = kept.transform(map_batches, keep, kept.schema)
    return kept


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
