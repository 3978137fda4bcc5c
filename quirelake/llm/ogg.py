"""Ogg media columns: pages to packets to logical streams.

``read`` walks a binary value: it finds each capture pattern, verifies the page's checksum over
the whole page, reassembles packets from the lacing values across pages, keeps logical streams
apart by serial number and reads the rate from the codec's first packet (Opus, Vorbis,
Speex, FLAC). Granule positions over the rate give times: of the last packet that ends on each page, and of the stream's end.

Defined results: a page whose checksum fails or that is cut off is skipped, and reading goes on at
the next capture pattern; a packet that loses a part isn't returned. How many packets a missing page held
can't be known, so ``lost_runs`` counts the places where one or more packets in a row are missing: before
the first, between two that are whole, or after the last (no page with the end flag). A stream whose first
page is missing has no codec. Bytes that belong to no page are ignored. Streams with an unknown codec
have null times. Null and empty values have no streams. Repeated rows each give rows. An empty
table gives none. Other columns aren't read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4
SCHEMA = "doc_id long, serial long, codec string, rate long, packets long, payload_bytes long, pages long, bad_pages long, lost_runs long, end_granule long, seconds double, page_granules array<long>, page_seconds array<double>"


def checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, from 0: zlib's, mirrored."""
    c = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Stream:
    serial: int
    codec: str | None = None
    rate: int | None = None
    preskip: int = 0
    pages: int = 0
    lost: int = 0
    end_granule: int | None = None
    packets: list[tuple[bytes, int | None]] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    _part: bytearray | None = None
    _next: int = 0
    _ended: bool = False
    _lost_now: bool = False

    def identify(self, packet: bytes) -> None:
        if packet.startswith(b"OpusHead") and len(packet) >= 19:
            self.codec, self.rate, self.preskip = "opus", 48_000, struct.unpack_from("<H", packet, 10)[0]
        elif packet.startswith(b"\x01vorbis") and len(packet) >= 16:
            self.codec, self.rate = "vorbis", struct.unpack_from("<I", packet, 12)[0]
        elif packet.startswith(b"Speex   ") and len(packet) >= 40:
            self.codec, self.rate = "speex", struct.unpack_from("<I", packet, 36)[0]
        elif packet.startswith(b"\x7fFLAC") and len(packet) >= 31:
            self.codec, self.rate = "flac", int.from_bytes(packet[27:30], "big") >> 4

    def time(self, granule: int | None) -> float | None:
        if granule is None or not self.rate:
            return None
        return max(0, granule - self.preskip) / self.rate

    def _hole(self) -> None:
        """Something between the last whole packet and the next one isn't here."""
        self.lost += not self._lost_now
        self._lost_now = True

    def page(self, flags: int, sequence: int, granule: int, lacing: bytes, body: bytes) -> None:
        self.pages += 1
        gap = sequence != self._next
        self._next = (sequence + 1) & 0xFFFFFFFF
        self._ended = bool(flags & LAST)
        part, self._part = self._part, None
        if part is not None and (gap or not flags & CONTINUED):
            part = None
            self._hole()
        if gap:
            self._hole()
        skip = bool(flags & CONTINUED) and part is None  # the packet began on a page that isn't here
        if skip:
            self._hole()
        at, done = 0, 0
        part = bytearray() if part is None else part
        for n in lacing:
            part += body[at : at + n]
            at += n
            if n < 255:
                if skip:
                    skip = False
                else:
                    self.packets.append((bytes(part), None))
                    self._lost_now = False
                    done += 1
                    if sequence == 0 and len(self.packets) == 1:
                        self.identify(self.packets[0][0])
                part = bytearray()
        if lacing and lacing[-1] == 255 and not skip:
            self._part = part
        elif skip:  # goes on; the next page's continuation is headless, too
            self._part = None
        if granule != -1:
            self.end_granule = granule
            self.granules.append(granule)
            if done:
                self.packets[-1] = (self.packets[-1][0], granule)

    def end(self) -> None:
        if self._part is not None or not self._ended:
            self._hole()


def read(data: bytes | None) -> tuple[dict[int, Stream], int]:
    """Streams by serial number, in order of appearance, and the number of damaged pages."""
    streams: dict[int, Stream] = {}
    bad, at = 0, 0
    data = data or b""
    while (at := data.find(b"OggS", at)) >= 0:
        head = data[at : at + 27]
        lacing = data[at + 27 : at + 27 + head[26]] if len(head) == 27 else b""
        if len(head) < 27 or head[4] or len(lacing) < head[26] or len(data) < at + 27 + len(lacing) + sum(lacing):
            bad += 1
            at += 4
            continue
        _, flags, granule, serial, sequence, crc, _ = struct.unpack("<BBqIIIB", head[4:])
        end = at + 27 + len(lacing) + sum(lacing)
        if checksum(head[:22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            bad += 1
            at += 4
            continue
        if serial not in streams:
            streams[serial] = Stream(serial)
        streams[serial].page(flags, sequence, granule, lacing, data[at + 27 + len(lacing) : end])
        at = end
    for s in streams.values():
        s.end()
    return streams, bad


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = b"OggS" + struct.pack("<BBqIIIB", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    c = checksum(head + body)
    return head[:22] + struct.pack("<I", c) + head[26:] + body


def write(streams: dict[int, Iterable[tuple[bytes, int]]], page_bytes: int = 4096) -> bytes:
    """Multiplexes packets with their end granules: headers on pages of their own, then the streams' pages in turn."""
    queues: list[list[bytes]] = []
    for serial, packets in streams.items():
        pages: list[tuple[int, int, bytes, bytes]] = []
        lacing, body, granule, cont = bytearray(), bytearray(), -1, False

        def flush(continues: bool) -> None:
            nonlocal lacing, body, granule, cont
            pages.append((CONTINUED if cont else 0, granule, bytes(lacing), bytes(body)))
            lacing, body, granule, cont = bytearray(), bytearray(), -1, continues

        for number, (packet, end) in enumerate(packets):
            sizes = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            at = 0
            for k, n in enumerate(sizes):
                if len(lacing) == 255:
                    flush(k > 0)
                lacing.append(n)
                body += packet[at : at + n]
                at += n
            granule = end
            if number == 0 or len(body) >= page_bytes:
                flush(False)
        if lacing or not pages:
            flush(False)
        queues.append([_page(serial, i, f | (FIRST if i == 0 else 0) | (LAST if i == len(pages) - 1 else 0), g, l, b) for i, (f, g, l, b) in enumerate(pages)])
    out = []
    for i in range(max(map(len, queues), default=0)):
        out += [q[i] for q in queues if i < len(q)]
    return b"".join(out)


OPUS_HEAD = b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 48_000, 0, 0)
VORBIS_HEAD = b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 1, 16_000, 0, 64_000, 0, 0xB8, 1)


def text_to_ogg(text: str) -> bytes:
    """A file with an Opus-headed stream 0 of the even lines and a Vorbis-headed stream 1 of the odd; a line lasts 960 samples for each character."""
    streams: dict[int, list[tuple[bytes, int]]] = {0: [(OPUS_HEAD, 0)], 1: [(VORBIS_HEAD, 0)]}
    ends = [0, 0]
    for i, line in enumerate(text.split("\n")):
        ends[i % 2] += 960 * len(line)
        streams[i % 2].append((line.encode("utf-8", "replace"), ends[i % 2]))
    return write(streams)


def harm(doc: int | None, data: bytes) -> bytes:
    """Damage by doc_id: a flipped bit in the first page (2 of 5), half a page at the end (3 of 5), else none."""
    kind = -1 if doc is None else doc % 5
    if kind == 2:
        return data[:31] + bytes([data[31] ^ 1]) + data[32:]
    return data + data[:40] if kind == 3 else data


def encode_texts(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """doc_id, ogg: each text as an Ogg value; null for a null text. damaged: with the damage of ``harm``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [None if t is None else text_to_ogg(t) for t in part.column(1).to_pylist()]
                if damaged:
                    made = [v and harm(i, v) for i, v in zip(part.column(0).to_pylist(), made)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "ogg"])

    return docs.select("doc_id", "text").mapInArrow(go, "doc_id long, ogg binary")


def streams(media: DataFrame, column: str = "ogg") -> DataFrame:
    """A row for each logical stream of each value of ``column``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, bad = read(data.as_py())
                rows += [(doc, s.serial, s.codec, s.rate, len(s.packets), sum(len(p) for p, _ in s.packets), s.pages, bad, s.lost, s.end_granule, s.time(s.end_granule), s.granules, [s.time(g) for g in s.granules]) for s in found.values()]
            columns = list(zip(*rows)) or [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    return media.select("doc_id", column).mapInArrow(go, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}[x.split()[1]] for x in SCHEMA.split(", ")]
