"""Ogg media columns: pages with verified checksums, packets from lacing values, logical streams apart, timestamps.

``write_ogg`` and ``read_ogg`` are the two sides of the container for one value. ``packets`` is the operator on a table
with a binary column; ``text_media`` stores texts as 8-bit PCM in Ogg, and ``media_features`` reads them back.

What a stream holds is told by its first packet: PCM, Opus, Vorbis and FLAC give their rate, channels and how many
header packets come first. Granule positions, which count samples since the stream began, tell when the last packet
that ends on a page ends. PCM and Opus packets tell their own length, so the others are placed by counting back from
there, and forward behind the last page that tells; packets of other codecs have a start only where the packet before
them ends at a known position.

Nulls: a null medium has no packets; a null text is an empty one, whose payload is one block of padding. Broken pages
(wrong checksum, cut short) are left out and counted; a packet that lost a part is left out. Repeated rows are treated
alike, since nothing but the bytes counts. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 576
RATE = 8000
CONTINUED, FIRST, LAST = 1, 2, 4
_PAGE = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, not reflected, no inversion): zlib's on mirrored bits."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


@dataclass
class Stream:
    """A logical stream: its packets, and after each the samples so far where a page tells (-1: it doesn't)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    pending: list[bytes] | None = None  # parts of a packet that goes on
    sequence: int = -1
    lost: int = 0
    gaps: set[int] = field(default_factory=set)  # packets before which something was lost


def _pages(serial: int, packets: list[tuple[bytes, int]], segments: int) -> Iterator[tuple[int, bytes]]:
    """(granule, page): the packets of one stream, each with the granule position after it, on pages of so many segments."""
    lacing, body, ends = [], [], {}
    for data, granule in packets:
        lacing += [255] * (len(data) // 255) + [len(data) % 255]
        body.append(data)
        ends[len(lacing)] = granule
    whole, at, number, open_packet = b"".join(body), 0, 0, False
    for a in range(0, len(lacing), segments):
        part = lacing[a : a + segments]
        b = a + len(part)
        done = [e for e in range(b, a, -1) if e in ends]
        flags = CONTINUED * open_packet | FIRST * (a == 0) | LAST * (b == len(lacing))
        n = sum(part)
        granule = ends[done[0]] if done else -1
        head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(part))
        page = head + bytes(part) + whole[at : at + n]
        yield granule, page[:22] + struct.pack("<I", checksum(page)) + page[26:]
        at, number, open_packet = at + n, number + 1, part[-1] == 255


def write_ogg(streams: dict[int, list[tuple[bytes, int]]], segments: int = 64) -> bytes:
    """Multiplex streams, serial number to (packet, granule position after it), on pages in order of time.

    The first packet of each stream has a page of its own, as headers do, and these pages come first.
    """
    heads, rest = [], []
    for serial, packets in streams.items():
        first = next(_pages(serial, packets[:1], 255))[1]
        single = len(packets) == 1
        flags = FIRST | LAST * single
        heads.append(_sealed(first, flags, 0))
        for number, (granule, page) in enumerate(_pages(serial, packets[1:], segments)):
            rest.append((granule, serial, number, _sealed(page, page[5] & ~FIRST, number + 1)))
    last: dict[int, int] = {}
    for i, (granule, serial, number, page) in enumerate(rest):  # a page on which no packet ends goes with the one before
        last[serial] = granule if granule >= 0 else last.get(serial, 0)
        rest[i] = (last[serial], serial, number, page)
    return b"".join(heads) + b"".join(p for *_, p in sorted(rest, key=lambda r: r[:3]))


def _sealed(page: bytes, flags: int, number: int) -> bytes:
    """The page with other flags and number."""
    page = page[:5] + bytes([flags]) + page[6:18] + struct.pack("<II", number, 0) + page[26:]
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def read_ogg(data: bytes) -> tuple[dict[int, Stream], int]:
    """Streams by serial number, and how many pages were broken."""
    streams: dict[int, Stream] = {}
    at, broken = 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > len(data):
            broken += 1
            break
        _, version, flags, granule, serial, number, crc, count = _PAGE.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < count or end > len(data) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            broken, at = broken + 1, at + 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        if number != s.sequence + 1:  # pages lost between
            s.lost += 1
            s.gaps.add(len(s.packets))
            s.pending = None
        s.sequence, s.pages, s.ended = number, s.pages + 1, bool(flags & LAST)
        parts, skip = s.pending, bool(flags & CONTINUED) and s.pending is None
        if parts is not None and not flags & CONTINUED:
            s.lost, parts = s.lost + 1, None
            s.gaps.add(len(s.packets))
        at, here, size = at + 27 + count, len(s.packets), 0
        for value in lacing:
            size += value
            if value < 255:
                if not skip:
                    s.packets.append(b"".join([*(parts or ()), data[at : at + size]]))
                    s.granules.append(-1)
                at, size, parts, skip = at + size, 0, None, False
        if skip:
            s.pending = None
        elif lacing and lacing[-1] == 255:
            s.pending = parts if parts is not None else []
            s.pending.append(data[at : at + size])
        else:  # a page without segments leaves an open packet open
            s.pending = parts if not lacing else None
        if len(s.packets) > here and granule >= 0:
            s.granules[-1] = granule
        at = end
    return streams, broken


def pcm_header(rate: int = RATE, channels: int = 1, per_packet: int = BLOCK) -> bytes:
    """The main header packet of PCM in Ogg: unsigned 8-bit samples."""
    return b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, channels, per_packet, 0)


def comment_packet(vendor: bytes = b"lexloom") -> bytes:
    """A comment header without comments."""
    return struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", 0)


@dataclass
class Codec:
    """What the first packet of a stream tells. ``frame`` is the bytes of a sample of all channels, 0 unless PCM."""

    name: str
    rate: int
    channels: int
    headers: int
    frame: int = 0
    skip: int = 0  # samples before time 0


#: Samples at 48 kHz of a frame of Opus, by the configuration in its first byte.
_OPUS_FRAMES = (480, 960, 1920, 2880) * 3 + (480, 960) * 2 + (120, 240, 480, 960) * 4


def codec_of(first: bytes) -> Codec | None:
    """The codec of a stream by its first packet; None if it is no known one or cut short."""
    try:
        if first[:8] == b"PCM     ":
            _, _, _, rate, bits, channels, _, extra = struct.unpack_from(">HHIIBBHI", first, 8)
            return Codec("pcm", rate, channels, 2 + extra, max(1, -(-bits // 8) * channels))
        if first[:8] == b"OpusHead":
            channels, skip = struct.unpack_from("<BH", first, 9)
            return Codec("opus", 48_000, channels, 2, 0, skip)
        if first[:7] == b"\x01vorbis":
            _, channels, rate = struct.unpack_from("<IBI", first, 7)
            return Codec("vorbis", rate, channels, 3)
        if first[:5] == b"\x7fFLAC":
            (extra,) = struct.unpack_from(">H", first, 7)
            bits = int.from_bytes(first[27:31], "big")  # 20 bits of rate, 3 of channels less one
            return Codec("flac", bits >> 12, (bits >> 9 & 7) + 1, 1 + extra)
    except struct.error:
        pass
    return None


def duration(codec: Codec, packet: bytes) -> int | None:
    """Samples of a data packet; None where the packet alone doesn't tell."""
    if codec.name == "pcm":
        return len(packet) // codec.frame
    if codec.name != "opus":
        return None
    if not packet:
        return 0
    kind = packet[0] & 3
    frames = 1 if kind == 0 else 2 if kind < 3 else packet[1] & 63 if len(packet) > 1 else 0
    return frames * _OPUS_FRAMES[packet[0] >> 3]


def timeline(stream: Stream, codec: Codec | None) -> list[tuple[int | None, bytes]]:
    """(first sample or None, data) of each packet behind the headers."""
    if codec is None:
        return [(None, p) for p in stream.packets]
    data, granules = stream.packets[codec.headers :], stream.granules[codec.headers :]
    length = [duration(codec, p) for p in data]
    starts: list[int | None] = [None] * len(data)
    end: int | None = None
    for i in range(len(data) - 1, -1, -1):
        end = granules[i] if granules[i] >= 0 else end
        end = starts[i] = end - length[i] if end is not None and length[i] is not None else None
        end = None if i + codec.headers in stream.gaps else end
    for i in range(len(data)):  # behind the last page that tells, and where packets don't tell their length
        if starts[i] is None:
            before = None
            if i + codec.headers in stream.gaps:
                pass
            elif i == 0:
                before = 0
            elif granules[i - 1] >= 0:
                before = granules[i - 1]
            elif starts[i - 1] is not None and length[i - 1] is not None:
                before = starts[i - 1] + length[i - 1]
            starts[i] = before
    return list(zip(starts, data))


def seconds(codec: Codec | None, sample: int | None) -> float | None:
    return None if codec is None or sample is None or not codec.rate else (sample - codec.skip) / codec.rate


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, then bytes 255 up to a positive multiple of the block."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK))


def media_of(text: str | None, tracks: int = 2) -> bytes:
    """The payload's blocks, dealt in turn to PCM streams of one Ogg file. Serial numbers come from the bytes."""
    payload = payload_of(text)
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    base = zlib.crc32(payload) & 0xFFFFFF00
    streams = {}
    for t in range(min(tracks, len(blocks))):
        own = blocks[t::tracks]
        streams[base + t] = [(pcm_header(), 0), (comment_packet(), 0), *[(b, (i + 1) * BLOCK) for i, b in enumerate(own)]]
    return write_ogg(streams)


def samples_of(media: bytes) -> tuple[bytes, dict[int, Stream], int]:
    """The payload read back: data packets of all PCM streams in order of their timestamps."""
    streams, broken = read_ogg(media)
    timed = []
    for serial, s in streams.items():
        codec = codec_of(s.packets[0]) if s.packets else None
        if codec and codec.name == "pcm":
            timed += [(start, serial, data) for start, data in timeline(s, codec) if start is not None]
    return b"".join(d for *_, d in sorted(timed, key=lambda x: x[:2])), streams, broken


def text_media(text: Column) -> Column:
    """Binary column: each text as Ogg."""

    @F.pandas_udf("binary")
    def store(texts: pd.Series) -> pd.Series:
        return texts.map(media_of, na_action=None)

    return store(text)


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _measured(media: bytes) -> tuple:
    payload, streams, broken = samples_of(media)
    samples = np.frombuffer(payload, np.uint8)
    wave = samples.astype(np.int32) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(wave))))
    energy = int((wave * wave).sum(dtype=np.int64))
    longest = max((s.granules[-1] for s in streams.values() if s.granules), default=0)
    feature = (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};"
        f"broken={broken};samples={len(samples)};ms={longest * 1000 // RATE};peak={int(np.abs(wave).max(initial=0))};"
        f"sum={int(wave.sum(dtype=np.int64))};energy={energy};crossings={crossings}"
    )
    # the padding is of bytes that UTF-8 never has
    unpadded = len(payload.rstrip(b"\xff"))
    return unpadded, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_features(text: Column) -> Column:
    """Struct column: each text is stored as Ogg, the stored bytes are read back, and what they tell is measured."""

    @F.pandas_udf(FEATURES)
    def features(texts: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in FEATURES.split(", ")]
        return pd.DataFrame([_measured(media_of(t)) for t in texts], columns=names)

    return features(text)


def packets(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each data packet, streams demultiplexed: id, serial, codec, rate, channels, packet (from 0, headers not
    counted), start_seconds (null where no position tells it), data. A stream of no known codec has null codec and rate
    and all its packets."""
    names = ["id", "serial", "codec", "rate", "channels", "packet", "start_seconds", "data"]
    types = [None, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]

    def rows(batches):
        for batch in batches:
            for i, value in enumerate(batch["media"].to_pylist()):
                out: list[tuple] = []
                for serial, s in read_ogg(value or b"")[0].items():
                    codec = codec_of(s.packets[0]) if s.packets else None
                    told = (codec.name, codec.rate, codec.channels) if codec else (None, None, None)
                    out += [(serial, *told, n, seconds(codec, start), data) for n, (start, data) in enumerate(timeline(s, codec))]
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), types[1:])]
                    yield pa.record_batch([batch["id"].take(pa.array([i] * len(out), pa.int64())), *columns], names=names)

    kind = media.schema[id_col].dataType.simpleString()
    chosen = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return chosen.mapInArrow(rows, f"id {kind}, serial long, codec string, rate int, channels int, packet int, start_seconds double, data binary")
