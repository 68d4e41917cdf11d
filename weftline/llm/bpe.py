"""BPE encoding and decoding in batched numpy merge rounds.

The vocabulary is a public tokenizer file (JSON, byte symbols, word ends). Text
is normalised (NFC, lower case), cut into pieces by the file's pattern, and the
distinct new pieces of a batch are merged together: all their symbols lie in one
flat array, each round finds every pair's rank by binary search in the sorted
pair keys, takes the lowest rank of each piece and merges all its occurrences.
Pieces of over :data:`LONG` bytes are merged one by one with a heap instead.

Defined results: null is the empty text; an empty text has no ids and decodes to
the empty text; white space is dropped; strings of the special tokens inside a
text become those tokens, as the tokenizers library does by default; repeated
rows give repeated rows; an empty table gives an empty table; other columns are
ignored by :func:`encode` and kept by :func:`encode_documents`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Pieces kept by a worker between batches; beyond it the memory is emptied.
CACHE_PIECES = 100_000
#: Bytes of text cut into pieces at a time: a piece takes some ten times its bytes while it waits.
SLICE = 256 << 10
NONE = np.int64(1 << 40)
#: Bytes of a piece beyond which it is merged by itself: a round looks at all symbols of a piece, so rounds would take the square of its length.
LONG = 512


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable, else 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str | None = None):
        with open(path or default_vocabulary(), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.shift = max(vocab.values()).bit_length()
        keys = np.array([(vocab[a] << self.shift) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(pairs))[order], made[order]
        self.tokens: dict[int, bytes] = {i: t.encode() for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.rules: dict[int, tuple[int, int]] | None = None
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """Normalise a text without special tokens and cut it into pieces."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pieces(text.lower())

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty word, all words merged together."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(sizes)
        ids[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        out: list[np.ndarray] = [ids[:0]] * len(words)
        while len(ids):
            pair = np.full(len(ids), NONE)
            at = np.zeros(len(ids), np.int64)
            if len(ids) > 1:
                key = (ids[:-1] << self.shift) | ids[1:]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = (self.keys[found] == key) & (word[:-1] == word[1:])
                pair[:-1] = np.where(ok, self.ranks[found], NONE)
                at[:-1] = found
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(pair, first)
            done = best == NONE
            lengths = np.diff(np.r_[first, len(ids)])
            if done.any():
                for k in np.flatnonzero(done):
                    out[word[first[k]]] = ids[first[k] : first[k] + lengths[k]]
                keep = np.repeat(~done, lengths)
                ids, word, pair, at = ids[keep], word[keep], pair[keep], at[keep]
                best, lengths = best[~done], lengths[~done]
                if not len(ids):
                    break
            hit = pair == np.repeat(best, lengths)
            # of overlapping occurrences (aaa) every other one, from the left
            start = hit & ~np.r_[False, hit[:-1]]
            index = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(start, index, 0))
            hit &= (index - run) % 2 == 0
            ids[hit] = self.made[at[hit]]
            gone = np.r_[False, hit[:-1]]
            ids, word = ids[~gone], word[~gone]
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: pairs wait in a heap by rank and place, so time is near to linear."""
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        if self.rules is None:
            self.rules = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made.tolist())}
        n, rules, shift = len(ids), self.rules, self.shift
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))

        def pair(a: int) -> None:
            b = right[a]
            if b < n and (rule := rules.get(ids[a] << shift | ids[b])):
                heapq.heappush(heap, (rule[0], a, ids[a], ids[b], rule[1]))

        heap: list[tuple[int, int, int, int, int]] = []
        for a in range(n - 1):
            pair(a)
        while heap:
            _, a, x, y, made = heapq.heappop(heap)
            b = right[a]
            if ids[a] != x or b >= n or ids[b] != y:
                continue  # one of the two has been merged since
            ids[a], ids[b] = made, -1
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            pair(a)
            if left[a] >= 0:
                pair(left[a])
        return np.array([i for i in ids if i >= 0], np.int64)

    def decode(self, ids: Iterable[int]) -> bytes:
        """Tokens joined by spaces: the file has no decoder."""
        return b" ".join(map(self.tokens.__getitem__, ids))

    def learn(self, pieces: Iterable[str]) -> None:
        if len(self.ids_of) > CACHE_PIECES:
            self.ids_of.clear()
            self.text_of.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.ids_of]
        data = [p.encode("utf-8", "surrogatepass") for p in new]
        short = iter(self.merge([d for d in data if len(d) <= LONG]))
        for piece, word in zip(new, data):
            ids = next(short) if len(word) <= LONG else self.merge_long(word)
            self.ids_of[piece] = ids.astype("<u4").tobytes()
            self.text_of[piece] = self.decode(ids.tolist())

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Of each text its ids (little-endian unsigned 32 bits) and their decoded text in UTF-8."""
        cut, marks = [], self.special
        for text in texts:
            text = text or ""
            if self.split and any(s in text for s in marks):
                parts: list[str | int] = []
                for i, part in enumerate(self.split(text)):
                    parts += [marks[part]] if i % 2 else self.cut(part)
                cut.append(parts)
            else:
                cut.append(self.cut(text))
        distinct: set = set().union(*cut) if cut else set()
        fixed = {p for p in distinct if isinstance(p, int)}
        if len(self.ids_of) > CACHE_PIECES:
            self.ids_of.clear()
            self.text_of.clear()
        self.learn(distinct - fixed)
        for p in fixed:
            self.ids_of[p], self.text_of[p] = int(p).to_bytes(4, "little"), self.tokens[p]
        ids_of, text_of = self.ids_of.__getitem__, self.text_of.__getitem__
        return [(b"".join(map(ids_of, c)), b" ".join(map(text_of, c))) for c in cut]


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids array<int>, decoded string`` of every whole text."""

    def make():
        bpe = Bpe(vocabulary)

        def run(keys, texts):
            got = bpe.encode_batch(texts)
            return {key: keys, "ids": [np.frombuffer(i, "<u4") for i, _ in got], "decoded": [d.decode() for _, d in got]}

        return run

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"`{key}` {kind}, ids array<int>, decoded string", SLICE)


def encode_digests(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: :func:`encode` without moving ids out of the worker."""

    def make():
        bpe = Bpe(vocabulary)

        def run(keys, texts):
            got = bpe.encode_batch(texts)
            return {
                key: keys,
                "n_tokens": [len(i) // 4 for i, _ in got],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in got],
                "decoded_sha256": [hashlib.sha256(d).hexdigest() for _, d in got],
            }

        return run

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", SLICE)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode_digests(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", F.col("decoded_sha256"))
