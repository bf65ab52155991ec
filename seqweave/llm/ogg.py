"""Ogg media columns: verified pages, reassembled packets, separate logical streams, timestamps.

Follows RFC 3533: a page is 'OggS', version, flags, granule position, serial, sequence number, checksum and lacing
values, of which 255 says that the packet goes on. Granule positions become seconds by what each codec's first packet says.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTINUED, FIRST, LAST = 1, 2, 4
_HEADER = "<4sBBqIIIB"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """The page checksum (polynomial 04C11DB7, most significant bit first, starting at 0).

    zlib's is the same polynomial on mirrored bits, started and ended with all ones.
    """
    crc = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_REVERSED), "little")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(_HEADER, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def clock(first: bytes):
    """(codec, header packets, granule -> seconds) by a stream's first packet; seconds are None for unknown codecs."""
    if first[:8] == b"OpusHead" and len(first) >= 12:
        skip = int.from_bytes(first[10:12], "little")
        return "opus", 2, lambda g: (g - skip) / 48000
    if first[:7] == b"\x01vorbis" and len(first) >= 16 and (rate := int.from_bytes(first[12:16], "little")):
        return "vorbis", 3, lambda g: g / rate
    if first[:8] == b"Speex   " and len(first) >= 40 and (rate := int.from_bytes(first[36:40], "little")):
        return "speex", 2, lambda g: g / rate
    if first[:5] == b"\x7fFLAC" and len(first) >= 30 and (rate := int.from_bytes(first[27:30], "big") >> 4):
        return "flac", 1 + int.from_bytes(first[7:9], "big"), lambda g: g / rate
    if first[:7] == b"\x80theora" and len(first) >= 42 and (num := int.from_bytes(first[22:26], "big")):
        den, shift = int.from_bytes(first[26:30], "big"), (int.from_bytes(first[40:42], "big") >> 5) & 31
        return "theora", 3, lambda g: ((g >> shift) + (g & ((1 << shift) - 1))) * den / num
    return "unknown", 0, lambda g: None


def opus_samples(packet: bytes) -> int:
    """Samples at 48 kHz that an Opus packet lasts, by its first byte: length of a frame and number of frames."""
    if not packet:
        return 0
    config, code = packet[0] >> 3, packet[0] & 3
    frame = (480, 960, 1920, 2880)[config % 4] if config < 12 else (480, 960)[config % 2] if config < 16 else (120, 240, 480, 960)[config % 4]
    frames = (1, 2, 2)[code] if code < 3 else packet[1] & 63 if len(packet) > 1 else 0
    return frame * frames


@dataclass
class Stream:
    serial: int
    pages: int = 0
    lost_pages: int = 0
    dropped: int = 0
    begun: bool = False
    ended: bool = False
    packets: list = field(default_factory=list)  # (bytes, seconds at its end)
    codec: str = "unknown"
    headers: int = 0
    seconds: object = None
    _next: int | None = None
    _open: list | None = None
    _granule: int | None = None

    def add(self, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> None:
        self.pages += 1
        skipping = False
        if self._next is None:  # pages are numbered from 0, so a stream that opens later has lost its first ones
            self.begun = bool(flags & FIRST)
            self.lost_pages += number
        elif number != self._next:
            self.lost_pages += number - self._next if number > self._next else 1
            self.dropped += self._open is not None
            self._open = None
        self._next = (number + 1) & 0xFFFFFFFF
        if flags & CONTINUED:
            skipping = self._open is None  # its beginning is lost
        elif self._open is not None:
            self.dropped += 1
            self._open = None
        at, done, part = 0, [], self._open or []
        opened = self._open is not None
        for size in lacing:
            part.append(body[at : at + size])
            at += size
            opened = True
            if size < 255:
                if skipping:
                    self.dropped += 1
                    skipping = False
                else:
                    done.append(b"".join(part))
                part, opened = [], False
        self._open = part if opened and not skipping else None
        for data in done:
            if not self.packets and self.seconds is None:
                self.codec, self.headers, self.seconds = clock(data)
            self.packets.append([data, None])
        # the granule position is that of the last packet that ends here; those before it go by their own durations or share the way from the last one
        timed = [p for p in self.packets[len(self.packets) - len(done) :]][max(0, self.headers - (len(self.packets) - len(done))) :]
        if granule >= 0 and timed and self.seconds is not None:
            before = self._granule if self._granule is not None and self._granule <= granule else None
            own = [opus_samples(data) for data, _ in timed] if self.codec == "opus" and before is not None else []
            told = all(own) and sum(own) == granule - before if own else False  # the packets' own durations add up
            at = before
            for i, p in enumerate(timed):
                if i == len(timed) - 1:
                    p[1] = self.seconds(granule)
                elif told:
                    at += own[i]
                    p[1] = max(self.seconds(at), 0.0)
                elif before is not None and (lo := self.seconds(before)) is not None:
                    lo = max(lo, 0.0)  # a stream's first samples may lie before its start
                    p[1] = lo + (self.seconds(granule) - lo) * (i + 1) / len(timed)
        if granule >= 0 and done:
            self._granule = granule
        self.ended |= bool(flags & LAST)


def demultiplex(media: bytes) -> tuple[list[Stream], int, int]:
    """The logical streams in order of appearance, the number of bad pages and of bytes outside good pages.

    A page whose checksum fails or that is cut short is bad; reading goes on at the next 'OggS' behind its
    first byte, so damage never hides what follows.
    """
    streams: dict[int, Stream] = {}
    order, bad, outside, at = [], 0, 0, 0
    while at < len(media):
        found = media.find(b"OggS", at)
        if found < 0:
            outside += len(media) - at
            break
        outside += found - at
        at = found
        ok = False
        if at + 27 <= len(media):
            _, version, flags, granule, serial, number, crc, n = struct.unpack_from(_HEADER, media, at)
            lacing = media[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(media):
                whole = media[at:end]
                ok = checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) == crc
        if not ok:
            bad += 1
            outside += 1
            at += 1
            continue
        stream = streams.get(serial)
        if stream is None or flags & FIRST and stream.ended:  # a serial may come again after its stream's end
            stream = streams[serial] = Stream(serial)
            order.append(stream)
        stream.add(number, granule, flags, lacing, whole[27 + n :])
        at = end
    for s in order:
        if s._open is not None:
            s.dropped += 1
            s._open = None
    return order, bad, outside


_PACKET = pa.list_(pa.struct([("data", pa.binary()), ("end_s", pa.float64())]))
SCHEMA = "doc_id long, stream int, serial long, codec string, n_pages int, lost_pages int, dropped_packets int, bad_pages int, bytes_outside long, complete boolean, duration_s double, packets array<struct<data:binary,end_s:double>>"


def ogg_streams(df: DataFrame, doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each logical stream of each medium, with its packets and their end times.

    bad_pages and bytes_outside are those of the whole medium; lost_pages counts gaps in the sequence numbers, those before
    the first page that was read too; dropped_packets those that lack a part; complete says that the stream's first and last page
    were seen and nothing lost; duration_s is the last known time. Packets that end on one page before its last one go by the durations
    that Opus packets tell of themselves, where these add up to the page's; else, and for other codecs, they get even shares. A packet has no end_s where its codec is unknown, for header packets,
    and before the first granule position. A medium without any good page, empty ones included, gives one row with null stream,
    serial and codec; null media too, with 0 bad pages. Very long media are read whole. Repeated rows are each read; streams
    are numbered in the order in which they begin, so there are no ties; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for d, data in zip(part.column("d").to_pylist(), part.column("m").to_pylist()):
                    streams, bad, outside = demultiplex(data or b"")
                    if not streams:
                        rows.append((d, None, None, None, 0, 0, 0, bad, outside, False, None, []))
                    for i, s in enumerate(streams):
                        times = [t for _, t in s.packets if t is not None]
                        packets = [{"data": p, "end_s": t} for p, t in s.packets]
                        whole = s.begun and s.ended and not s.lost_pages and not s.dropped
                        rows.append((d, i, s.serial, s.codec, s.pages, s.lost_pages, s.dropped, bad, outside, whole, times[-1] if times else None, packets))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.float64(), _PACKET)
                names = [c.strip().split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return df.select(F.col(doc_id).cast("long").alias("d"), F.col(media).cast("binary").alias("m")).mapInArrow(run, SCHEMA)


def multiplex(payload: bytes, seed: int, packet_bytes: int = 700, segments: int = 6) -> bytes:
    """An Ogg medium of a Speex and a Vorbis stream whose packets carry the payload in turn.

    Opus packets would tell durations of their own by their first bytes, which here are any.

    Pages hold at most ``segments`` lacing values, so packets go on across pages, and the streams' pages alternate.
    """
    heads = (
        [b"Speex   " + b"1.2".ljust(20, b"\0") + struct.pack("<III", 1, 80, 48000) + bytes(40), struct.pack("<II", 0, 0)],
        [b"\x01vorbis" + struct.pack("<IBIIIIBB", 0, 2, 44100, 0, 128000, 0, 0xB8, 1), b"\x03vorbis" + struct.pack("<II", 0, 0) + b"\x01", b"\x05vorbis\x01"],
    )
    pieces = [payload[i : i + packet_bytes] for i in range(0, len(payload), packet_bytes)]
    pages: list[list[bytes]] = []
    for k, head in enumerate(heads):
        serial, step = (seed * 2 + k) & 0xFFFFFFFF, (960, 1024)[k]
        mine = pieces[k::2]
        out = [page(serial, 0, 0, FIRST, bytes([len(head[0])]), head[0]), page(serial, 1, 0, 0 if mine else LAST, bytes(map(len, head[1:])), b"".join(head[1:]))]
        values: list[tuple[int, bytes, int]] = []  # lacing value, its bytes, packet that ends with it or -1
        for i, p in enumerate(mine):
            cut = [p[j : j + 255] for j in range(0, len(p), 255)]
            if len(p) % 255 == 0:
                cut.append(b"")
            values += [(len(c), c, i if j == len(cut) - 1 else -1) for j, c in enumerate(cut)]
        for j in range(0, len(values), segments):
            group = values[j : j + segments]
            ends = [e for _, _, e in group if e >= 0]
            flags = (CONTINUED if j and values[j - 1][2] < 0 else 0) | (LAST if j + segments >= len(values) else 0)
            out.append(page(serial, len(out), (ends[-1] + 1) * step if ends else -1, flags, bytes(v for v, _, _ in group), b"".join(c for _, c, _ in group)))
        pages.append(out)
    mixed = []
    for i in range(max(map(len, pages))):
        mixed += [p[i] for p in pages if i < len(p)]
    return b"".join(mixed)


def damage(media: bytes, seed: int) -> bytes:
    """By ``seed``: a flipped byte, a lost page, either in the middle or at the first page, bytes before the start, a cut end, or nothing."""
    at = [m.start() for m in re.finditer(b"OggS", media)] if seed % 20 in (3, 5, 11, 13) else []
    if seed % 20 == 11 and len(at) > 1:
        return media[at[1] :]
    if seed % 20 == 13:
        return media[:30] + bytes([media[30] ^ 0x55]) + media[31:]
    if seed % 20 == 3 and at:
        i = at[len(at) // 2] + 30
        return media[:i] + bytes([media[i] ^ 0x55]) + media[i + 1 :] if i < len(media) else media
    if seed % 20 == 5 and len(at) > 2:
        i = len(at) // 2
        return media[: at[i]] + media[at[i + 1] :] if i + 1 < len(at) else media[: at[i]]
    if seed % 20 == 7:
        return b"junk OggS junk" + media
    if seed % 20 == 9:
        return media[:-3]
    return media


def text_media(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, media: each text as the payload of an Ogg medium, some of them damaged; a null text gives null media.

    The tables hold no media, so the query makes them from all documents, whole texts of any length. Rows without doc_id use 0 as
    seed; an empty text makes streams of headers alone; repeated rows are each made; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, texts = part.column("d").to_pylist(), part.column("t").cast(pa.binary()).to_pylist()
                media = [None if t is None else damage(multiplex(t, d or 0), d or 0) for d, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, media binary")
