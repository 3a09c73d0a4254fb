"""Media columns: an Ogg container for 8-bit samples (pages, lacing, checksums, logical streams, granules).

A payload is cut into packets of `PACKET` samples which go by turns to `STREAMS` logical streams, each starting
with an identification packet on a page of its own. Granule positions count the samples that a stream has completed,
so that a packet's timestamp is its end granule divided by the sample rate. Packets longer than 255 * 255 bytes would
continue on the next page; reading supports that for any packet length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

PACKET = 4096
RATE = 8000
STREAMS = 2
ALIGN = 64
_MAGIC = b"\x01qsraw8\x00"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, unreflected, from 0: zlib's reflected register run over mirrored bits."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _paged(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets come with the granule at which they end."""
    pages: list[bytes] = []
    first, granule0 = packets[0]
    pages.append(_page(serial, 0, granule0, 2, bytes([len(first)]), first))
    lacing, body, granule, flags = bytearray(), bytearray(), -1, 0

    def flush(last: bool, more: bool) -> None:
        nonlocal lacing, body, granule, flags
        pages.append(_page(serial, len(pages), granule, flags | (4 if last else 0), bytes(lacing), bytes(body)))
        lacing, body, granule, flags = bytearray(), bytearray(), -1, int(more)

    for i, (packet, end) in enumerate(packets[1:]):
        at, laces = 0, len(packet) // 255 + 1
        for k in range(laces):
            if len(lacing) == 255:
                flush(False, k > 0)
            n = min(255, len(packet) - at) if k < laces - 1 else len(packet) - at
            lacing.append(n)
            body += packet[at : at + n]
            at += n
        granule = end
        if len(lacing) > 200:
            flush(i == len(packets) - 2, False)
    if lacing:
        flush(True, False)
    return pages


def write(payload: bytes, packet: int = PACKET, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """The payload as an Ogg file of `streams` multiplexed logical streams."""
    packets: list[list[tuple[bytes, int]]] = [[(_MAGIC + struct.pack("<IHH", rate, s, streams), 0)] for s in range(streams)]
    done = [0] * streams
    for i in range(0, len(payload), packet):
        s = (i // packet) % streams
        chunk = payload[i : i + packet]
        done[s] += len(chunk)
        packets[s].append((chunk, done[s]))
    paged = [_paged(0x51530000 + s, p) for s, p in enumerate(packets)]
    out = [p[0] for p in paged]  # all first pages come before any other
    for k in range(1, max(map(len, paged))):
        out += [p[k] for p in paged if k < len(p)]
    return b"".join(out)


@dataclass
class Stream:
    """One logical stream: its packets, the granule position and seconds at which each ends (None inside a page)."""

    serial: int
    packets: list[bytes]
    granules: list[int | None]
    pages: int = 0
    ended: bool = False

    def seconds(self, rate: int) -> list[float | None]:
        return [None if g is None else g / rate for g in self.granules]


def read(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. A bad checksum, a gap in page numbers or a broken packet is a ValueError."""
    streams: dict[int, Stream] = {}
    parts: dict[int, list[bytes]] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError(f"page at {at}: header cut short")
        magic, version, flags, granule, serial, sequence, crc, n = _HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"page at {at}: no page starts here")
        lacing = data[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        end = body_at + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError(f"page at {at}: cut short")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"page at {at}: checksum differs")
        if flags & 2:
            if serial in streams:
                raise ValueError(f"stream {serial} starts twice")
            streams[serial] = Stream(serial, [], [])
        stream = streams.get(serial)
        if stream is None:
            raise ValueError(f"page at {at}: stream {serial} has not started")
        if sequence != stream.pages or stream.ended:
            raise ValueError(f"page at {at}: number {sequence}, {stream.pages} expected")
        if bool(flags & 1) != bool(parts.get(serial)):
            raise ValueError(f"page at {at}: continuation flag doesn't fit")
        stream.pages += 1
        last = None
        k, here = 0, parts.setdefault(serial, [])
        while k < n:
            j = k
            while j < n and lacing[j] == 255:
                j += 1
            stop = min(j + 1, n)
            size = sum(lacing[k:stop])
            here.append(data[body_at : body_at + size])
            body_at += size
            if j < n:
                stream.packets.append(b"".join(here))
                stream.granules.append(None)
                here.clear()
                last = len(stream.granules) - 1
            k = stop
        if last is not None and granule != -1:
            stream.granules[last] = granule
        stream.ended = bool(flags & 4)
        at = end
    for serial, here in parts.items():
        if here:
            raise ValueError(f"stream {serial}: the last packet doesn't end")
    return streams


def join(streams: dict[int, Stream]) -> tuple[bytes, int]:
    """The payload that write() multiplexed, and the sample rate."""
    by: dict[int, Stream] = {}
    rate, count = RATE, 0
    for stream in streams.values():
        if not stream.packets or not stream.packets[0].startswith(_MAGIC):
            raise ValueError(f"stream {stream.serial}: no identification packet")
        rate, index, count = struct.unpack_from("<IHH", stream.packets[0], len(_MAGIC))
        by[index] = stream
    if sorted(by) != list(range(count)):
        raise ValueError("a logical stream is missing")
    longest = max(len(s.packets) for s in by.values())
    return b"".join(by[s].packets[k] for k in range(1, longest) for s in range(count) if k < len(by[s].packets)), rate


def padded(text: bytes) -> bytes:
    size = max(ALIGN, -(-len(text) // ALIGN) * ALIGN)
    return text + bytes(size - len(text))


def _row(text: bytes) -> tuple:
    media = write(padded(text))
    streams = read(media)
    payload, rate = join(streams)
    pages = sum(s.pages for s in streams.values())
    ends = [max(g for g in s.granules if g is not None) for s in streams.values()]
    if sum(ends) != len(payload):
        raise ValueError("granule positions don't add up to the samples")
    feature = f"streams={len(streams)};pages={pages};packets={sum(len(s.packets) for s in streams.values())};ms={max(ends) * 1000 // rate}"
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, media


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text as an Ogg payload, read back: sizes, digests and features; with_media keeps the file itself.

    Null text counts as empty and gives one block of 64 zero bytes; a null id stays null; repeated rows give equal
    rows; an empty table gives none; other columns are not read.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]

    def run(batch: pa.RecordBatch):
        texts = batch.column(1).cast(pa.large_binary())
        step = 512
        for at in range(0, len(texts), step):
            rows = [_row(t.as_py() or b"") for t in texts.slice(at, step)]
            yield {"doc_id": batch.column(0).slice(at, step)} | {n: [r[i] for r in rows] for i, n in enumerate(names) if n != "media" or with_media}

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, schema)
