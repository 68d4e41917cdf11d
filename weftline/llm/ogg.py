"""Media columns: lossless storage of byte payloads in the Ogg container.

Writing: the payload becomes 8-bit samples in packets of :data:`PACKET` bytes on
one logical stream; a second stream, multiplexed page by page with the first,
carries an index (one packet for each data page: first sample and CRC-32).
Reading: page checksums are verified, packets are reassembled from the lacing
values, logical streams are demultiplexed by serial number and timestamps are
derived from granule positions (samples finished at the end of a page).

Defined results: null is the empty text; a payload is padded with spaces to a
positive multiple of :data:`UNIT` bytes, so an empty text gives one unit; equal
texts give equal media; a damaged page raises :class:`OggError`; repeated rows
give repeated rows, an empty table an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, utf8

UNIT = 192
RATE = 8000
PACKET = 4096
PAGE_PACKETS = 8
SERIALS = {"samples": 1, "index": 2}
HEADER = struct.Struct("<4sBBqIIIB")
MAGIC = b"\x80pcm8"
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    pass


def _reversed_bits(value: int, width: int) -> int:
    return int(f"{value:0{width}b}"[::-1], 2)


_MIRROR = bytes(_reversed_bits(b, 8) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, most significant bit first, start and final xor 0.

    zlib computes the mirrored form of that polynomial, so the bits of every
    byte are mirrored on the way in and those of the sum on the way out.
    """
    return _reversed_bits(zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF, 32)


def lacing(sizes: list[int]) -> bytes:
    """The lacing values of whole packets: full 255s and a rest below 255 each."""
    return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)


def make_page(kind: int, granule: int, serial: int, number: int, table: bytes, body: bytes) -> bytes:
    def head(crc: int) -> bytes:
        return HEADER.pack(b"OggS", 0, kind, granule, serial, number, crc, len(table)) + table

    return head(page_checksum(head(0) + body)) + body


def mux(payload: bytes) -> bytes:
    """The Ogg file of a payload of 8-bit samples."""
    samples, index = SERIALS["samples"], SERIALS["index"]
    start = MAGIC + struct.pack("<IQ", RATE, len(payload))
    out = [make_page(FIRST, 0, s, 0, lacing([len(start)]), start) for s in (samples, index)]
    numbers = {samples: 1, index: 1}
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    segments = lacing([len(p) for p in packets])
    at = done = byte = 0
    room = PAGE_PACKETS * (PACKET // 255 + 1) - 5  # not a whole number of packets: some span two pages
    while at < len(segments):
        table = segments[at : at + room]
        last = at + len(table) == len(segments)
        body = payload[byte : byte + sum(table)]
        ends = [i for i, n in enumerate(table) if n < 255]
        granule = byte + sum(table[: ends[-1] + 1]) if ends else -1
        kind = (CONTINUED if at and segments[at - 1] == 255 else 0) | (LAST if last else 0)
        out.append(make_page(kind, granule, samples, numbers[samples], table, body))
        note = struct.pack("<QI", byte, zlib.crc32(body))
        done = max(done, granule)
        out.append(make_page(LAST if last else 0, done, index, numbers[index], lacing([len(note)]), note))
        numbers[samples] += 1
        numbers[index] += 1
        at, byte = at + len(table), byte + len(body)
    return b"".join(out)


class Page(NamedTuple):
    kind: int
    granule: int
    serial: int
    number: int
    table: bytes
    body: bytes


def read_pages(media: bytes) -> list[Page]:
    """All pages in file order, each with its checksum verified."""
    pages, at = [], 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError(f"cut off page header at byte {at}")
        magic, version, kind, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        table = media[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(table)
        if len(table) < n or end > len(media):
            raise OggError(f"cut off page at byte {at}")
        page = media[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        pages.append(Page(kind, granule, serial, number, table, page[HEADER.size + n :]))
        at = end
    return pages


class Stream(NamedTuple):
    packets: list[bytes]
    times: list[float]  # seconds at the end of the page that finishes the packet
    pages: int


def demux(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, with packets put together over pages."""
    streams: dict[int, tuple[list[bytes], list[float], list[bytes], list[int]]] = {}
    for page in read_pages(media):
        if page.kind & FIRST:
            if page.serial in streams:
                raise OggError(f"stream {page.serial} begins twice")
            streams[page.serial] = ([], [], [], [0])
        if page.serial not in streams:
            raise OggError(f"stream {page.serial} has no first page")
        packets, times, open_parts, count = streams[page.serial]
        if page.number != count[0]:
            raise OggError(f"page {count[0]} of stream {page.serial} is missing")
        if bool(page.kind & CONTINUED) != bool(open_parts):
            raise OggError(f"page {page.number} of stream {page.serial} continues no packet")
        count[0] += 1
        begin = at = 0
        for n in page.table:
            at += n
            if n < 255:
                packets.append(b"".join([*open_parts, page.body[begin:at]]))
                times.append(page.granule / RATE)
                open_parts.clear()
                begin = at
        if begin < len(page.body) or page.table[-1:] == b"\xff":
            open_parts.append(page.body[begin:])
    for serial, (_, _, open_parts, _) in streams.items():
        if open_parts:
            raise OggError(f"the last packet of stream {serial} has no end")
    return {s: Stream(p, t, n[0]) for s, (p, t, _, n) in streams.items()}


def read_payload(media: bytes) -> tuple[bytes, str]:
    """The payload and a feature line of a file that :func:`mux` wrote."""
    streams = demux(media)
    head, *packets = streams[SERIALS["samples"]].packets
    rate, size = struct.unpack("<IQ", head[len(MAGIC) :])
    payload = b"".join(packets)
    if len(payload) != size:
        raise OggError(f"{len(payload)} samples of {size}")
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    times = streams[SERIALS["samples"]].times
    feature = (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(packets)};"
        f"rate={rate};seconds={times[-1]:.6f};mean={x.mean():.6f};power={(x * x).mean():.6f};"
        f"peak={int(np.abs(x).max())};crossings={crossings}"
    )
    return payload, feature


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, media``: every whole text as an Ogg file."""

    def run(keys, texts):
        data = [utf8(t) for t in texts]
        return {key: keys, "n_bytes": list(map(len, data)), "media": [mux(pad(d)) for d in data]}

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), lambda: run, f"`{key}` {kind}, n_bytes bigint, media binary")


def inspect(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of the payloads read back from ``media``."""

    def run(keys, sizes, files):
        read = [read_payload(m) for m in files]
        return {
            key: keys,
            "n_bytes": sizes,
            "payload_bytes": [len(p) for p, _ in read],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p, _ in read],
            "tail_crc32": [zlib.crc32(p[-16:]) for p, _ in read],
            "media_bytes": [len(m) for m in files],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in files],
            "feature": [f for _, f in read],
        }

    kind = media.schema[key].dataType.simpleString()
    return map_rows(
        media.select(key, "n_bytes", "media"),
        lambda: run,
        f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    )


def op3_ogg(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return inspect(store(table(spark, sf_dir, "documents")))
