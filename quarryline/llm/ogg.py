"""Ogg media columns: a payload as 8-bit PCM in an Ogg file, and the way back.

A file holds two logical streams that share the pages' order: the samples (OggPCM, unsigned
8-bit, mono) and a time index with one packet for each packet of samples. Reading verifies each
page's checksum, rebuilds packets from lacing values across pages, sorts pages by serial number
into their streams and takes timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import fanned_out, map_batches, text_or_empty

#: Fixed values of the Ogg and OggPCM formats.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
PCM_MAGIC, PCM_U8 = b"PCM     ", 1
INDEX_MAGIC = b"TIMEIDX\x00"
NO_GRANULE = (1 << 64) - 1

RATE = 8000
PACKET_SAMPLES = 16_000
UNIT = 64
MIRRORED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes are no valid Ogg file."""


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 04c11db7, most significant bit first, from 0, without a final xor.

    zlib has the same polynomial with all bits mirrored; started from all ones and inverted at
    the end, which are undone here.
    """
    mirrored = zlib.crc32(page.translate(MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIIIB", CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    page = head + body
    return page[:22] + struct.pack("<I", page_crc(page)) + page[26:]


class _StreamWriter:
    """Pages of one logical stream; a packet that overruns 255 lacing values goes on in the next page."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packet: bytes, granule: int, first: bool = False, last: bool = False) -> Iterator[bytes]:
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        for at in range(0, len(lacing), 255):
            part = lacing[at : at + 255]
            ends = at + 255 >= len(lacing)
            flags = CONTINUED * (at > 0) | FIRST * (first and at == 0) | LAST * (last and ends)
            yield _page(flags, granule if ends else NO_GRANULE, self.serial, self.number, part, packet[at * 255 : at * 255 + sum(part)])
            self.number += 1


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def write_ogg(payload: bytes, serials: tuple[int, int] = (1, 2), rate: int = RATE) -> bytes:
    """payload as samples of an Ogg file with its time index as a second logical stream."""
    sound, index = _StreamWriter(serials[0]), _StreamWriter(serials[1])
    packets = [payload[i : i + PACKET_SAMPLES] for i in range(0, len(payload), PACKET_SAMPLES)]
    head = PCM_MAGIC + struct.pack(">HHIIBBHI", 0, 0, PCM_U8, rate, 8, 1, PACKET_SAMPLES & 0xFFFF, 0)
    out = [*sound.pages(head, 0, first=True), *index.pages(INDEX_MAGIC + struct.pack("<IQ", rate, len(payload)), 0, first=True)]
    end = 0
    for i, packet in enumerate(packets):
        end += len(packet)
        last = i + 1 == len(packets)
        out += index.pages(struct.pack("<IQ", i, end), end, last=last)
        out += sound.pages(packet, end, last=last)
    return b"".join(out)


@dataclass
class Stream:
    """One logical stream: whole packets, and the granule position of each packet that ends a page's packets."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: list[bytes] = field(default_factory=list)


def read_ogg(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number; raises OggError for whatever isn't sound."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE or len(data) < at + 27:
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBQIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise OggError(f"page at byte {at} is cut short")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        stream = streams.get(serial)
        if stream is None or stream.ended or number != stream.pages or bool(flags & CONTINUED) != bool(stream.partial):
            raise OggError(f"page {number} of stream {serial} is out of order")
        stream.pages += 1
        begin = body
        for value in lacing:
            body += value
            if value < 255:
                stream.packets.append(b"".join([*stream.partial, data[begin:body]]))
                stream.granules.append(NO_GRANULE)
                stream.partial, begin = [], body
        if begin < body or (lacing and lacing[-1] == 255):
            stream.partial.append(data[begin:body])
        if granule != NO_GRANULE:
            if not stream.granules:
                raise OggError(f"stream {serial} has a position without a packet")
            stream.granules[-1] = granule
        stream.ended = bool(flags & LAST)
        at = end
    if not streams or any(s.partial or not s.ended for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


@dataclass
class Sound:
    samples: bytes
    rate: int
    stamps: list[float]
    pages: int


def read_sound(data: bytes) -> Sound:
    """The samples of the PCM stream, checked against granule positions and the time index."""
    streams = read_ogg(data)
    by_kind = {s.packets[0][:8]: s for s in streams.values()}
    sound, index = by_kind.get(PCM_MAGIC), by_kind.get(INDEX_MAGIC)
    if sound is None or index is None:
        raise OggError("the PCM stream or its index is missing")
    rate = struct.unpack_from(">I", sound.packets[0], 16)[0]
    ends, total = [], 0
    for packet in sound.packets[1:]:
        total += len(packet)
        ends.append(total)
    if sound.granules[1:] != ends or [struct.unpack("<IQ", p) for p in index.packets[1:]] != list(enumerate(ends)) or index.granules[1:] != ends:
        raise OggError("positions don't match the samples")
    return Sound(b"".join(sound.packets[1:]), rate, [0.0, *(e / rate for e in ends)], sum(s.pages for s in streams.values()))


def feature(sound: Sound) -> str:
    """pages, packets, length in microseconds, mean level and mean step between samples, in thousandths."""
    import numpy as np

    levels = np.frombuffer(sound.samples, np.uint8).astype(np.int64)
    steps = int(np.abs(np.diff(levels)).sum())
    return f"pages={sound.pages};packets={len(sound.stamps) - 1};us={round(sound.stamps[-1] * 1e6)};mean={int(levels.sum()) * 1000 // len(levels)};step={steps * 1000 // max(1, len(levels) - 1)}"


def with_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes long, media binary: each whole text as an Ogg file.

    A null text counts as empty: 64 samples 0. Equal texts give equal files. Keys are carried as
    they are (null and repeated ones too); other columns, whatever their names, are dropped. Texts of
    any length are stored whole; an empty table gives no rows. Narrow, no shuffle.
    """

    def make():
        def apply(texts):
            raw = [t.encode() for t in texts]
            return {"n_bytes": [len(r) for r in raw], "media": [write_ogg(padded(r)) for r in raw]}

        return apply

    return map_batches(fanned_out(docs.select(key, text_or_empty(text).alias("text"))), make, "text", "n_bytes long, media binary", (key,))


def media_features(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Read back a column of Ogg files: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error.

    A null or damaged file gives nulls in the payload's columns and feature, and says why in
    error, which is else null; media_bytes and media_sha256 are null for a null file only.
    """

    def make():
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

        def one(data):
            if data is None:
                return [None] * 6 + ["no file"]
            stored = [len(data), hashlib.sha256(data).hexdigest()]
            try:
                sound = read_sound(data)
            except (OggError, struct.error, IndexError) as e:
                return [None] * 3 + stored + [None, str(e)]
            s = sound.samples
            return [len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-UNIT:]), *stored, feature(sound), None]

        def apply(files):
            return dict(zip(names, zip(*map(one, files), strict=True), strict=True)) if files else {n: [] for n in names}

        return apply

    return map_batches(media, make, column, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string", keep)
