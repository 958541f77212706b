"""Media columns: Ogg.

The reader checks each page's checksum, reassembles packets from the lacing values (also across pages),
demultiplexes logical streams by serial number, and derives packet times from granule positions. The writer stores a
payload as 8-bit samples: even places in one logical stream, odd ones in another, their pages in turn.
There is no shuffle; a row is a file.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name, in_small_batches

RATE = 48_000
BLOCK = 960  # samples of a packet
ALIGN = 192
HEAD = struct.Struct("<4sBBqIII B")
#: The byte with its bits in reverse order. Ogg's checksum takes bits from the top, zlib's from the bottom.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 04C11DB7, start and final value 0) by way of zlib's mirrored one."""
    return int(f"{zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


@dataclass
class Packet:
    serial: int
    number: int
    data: bytes
    granule: int  # of its last sample; -1 unknown

    @property
    def end_s(self) -> float:
        return self.granule / RATE


@dataclass
class Stream:
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    part: bytes = b""
    sequence: int | None = None
    ended: bool = False
    gaps: int = 0


def read_pages(data: bytes):
    """(flags, granule, serial, sequence, lacing, body) of each page; ValueError for a broken page or checksum."""
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError(f"page header cut at {at}")
        magic, version, flags, granule, serial, sequence, crc, count = HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise ValueError(f"page cut at {at}")
        if page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at {at}")
        yield flags, granule, serial, sequence, lacing, data[at + 27 + count : end]
        at = end


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial, in order of appearance, with whole packets.

    A page's granule position is that of the last packet it ends; the packets before it on the page count back by
    their length (8-bit samples). A lost page (gap in the sequence) drops the packet it cuts.
    """
    streams: dict[int, Stream] = {}
    for flags, granule, serial, sequence, lacing, body in read_pages(data):
        s = streams.setdefault(serial, Stream())
        lost = s.sequence is not None and sequence != s.sequence + 1
        s.gaps += lost
        s.sequence, s.pages, s.ended = sequence, s.pages + 1, bool(flags & 4)
        if lost or not flags & 1:
            s.part = b""
        skip = bool(flags & 1) and (lost or s.pages == 1)  # the rest of a packet whose start is lost
        done, start, at = [], 0, 0
        for lace in lacing:
            at += lace
            if lace < 255:
                whole = s.part + body[start:at]
                s.part, start = b"", at
                if skip:
                    skip = False
                else:
                    done.append(whole)
        if not skip:
            s.part += body[start:]
        back = granule
        made = []
        for x in reversed(done):
            made.append((x, back if granule >= 0 else -1))
            back -= len(x)
        for x, g in reversed(made):
            s.packets.append(Packet(serial, len(s.packets), x, g))
    return streams


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def write_stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream, from (packet, granule of its last sample); the first packet has its own page.

    A page holds up to 255 lacing values; a packet that doesn't end on a page goes on in the next one.
    """
    pages, lacing, body, ends, open_ = [], bytearray(), bytearray(), [], 0

    def close(last: bool) -> None:
        nonlocal open_
        flags = open_ | (2 if not pages else 0) | (4 if last else 0)
        open_ = int(bool(lacing) and lacing[-1] == 255)
        head = HEAD.pack(b"OggS", 0, flags, ends[-1] if ends else -1, serial, len(pages), 0, len(lacing)) + lacing
        crc = page_crc(bytes(head + body))
        pages.append(bytes(head[:22] + struct.pack("<I", crc) + head[26:] + body))
        lacing.clear(), body.clear(), ends.clear()

    for i, (data, granule) in enumerate(packets):
        at = 0
        while True:
            n = min(255, len(data) - at)
            lacing.append(n)
            body += data[at : at + n]
            at += n
            if n < 255:
                ends.append(granule)
                if i == 0 or i == len(packets) - 1 or len(lacing) == 255:
                    close(i == len(packets) - 1)
                break
            if len(lacing) == 255:
                close(False)
    return pages


def write(payload: bytes) -> bytes:
    """An Ogg file of two logical streams: the samples of even and of odd places, their pages in turn.

    Serial numbers come from the payload, so that equal payloads give equal files.
    """
    a = zlib.crc32(payload)
    each = []
    for k, samples in enumerate((payload[::2], payload[1::2])):
        packets = [(b"PCM8" + struct.pack("<IIQ", RATE, k, len(payload)), 0)]
        packets += [(samples[i : i + BLOCK], min(i + BLOCK, len(samples))) for i in range(0, len(samples), BLOCK)]
        each.append(write_stream((a + k) & 0xFFFFFFFF, packets))
    return b"".join(p for pair in itertools.zip_longest(*each, fillvalue=b"") for p in pair)


def read(data: bytes) -> tuple[bytes, dict]:
    """The payload of a file made by write(), and features of the file.

    The channels are found by their headers, their packets put together where their times agree. Raises ValueError
    if a page, packet or stream is missing, doubled or damaged.
    """
    streams = demultiplex(data)
    channels: dict[int, bytes] = {}
    rate, size, ends = RATE, 0, set()
    for s in streams.values():
        head, rest = s.packets[0], s.packets[1:]
        if head.data[:4] != b"PCM8" or not s.ended or s.gaps or s.part:
            raise ValueError("not such a stream, or not whole")
        rate, k, size = struct.unpack("<IIQ", head.data[4:])
        at = 0
        for p in rest:
            at += len(p.data)
            if p.granule != at:
                raise ValueError(f"packet {p.number} ends at sample {p.granule}, not {at}")
        channels[k] = b"".join(p.data for p in rest)
        ends.add(at)
    if set(channels) != {0, 1} or len(ends) != 1 or sum(map(len, channels.values())) != size:
        raise ValueError("channels don't fit together")
    payload = bytearray(size)
    payload[::2], payload[1::2] = channels[0], channels[1]
    return bytes(payload), {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()), "seconds": round(ends.pop() / rate, 6)}


def pad(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text (null: none), and these with spaces up to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(1, -(-len(raw) // ALIGN)) * ALIGN - len(raw))


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Each text as an Ogg file: `keep` columns, n_bytes (of the text) and media (binary).

    A null text counts as empty; both are a file of one padded block. Equal texts give equal files, in each of repeated
    rows. Columns that are not kept are not used; ValueError if a kept one is named n_bytes or media. Empty table: no rows.
    """
    text = _names(docs, keep, ["n_bytes", "media"])

    def run(batches):
        for b in batches:
            made = [pad(t) for t in b[text].to_pylist()]
            out = [b.column(c) for c in keep] + [pa.array([n for n, _ in made], pa.int64()), pa.array([write(p) for _, p in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, [*keep, "n_bytes", "media"])

    return in_small_batches(docs).select(*keep, F.col("text").alias(text)).mapInArrow(run, f"{_fields(docs, keep)}n_bytes long, media binary")


def features(media: DataFrame, keep: list[str]) -> DataFrame:
    """Reads files made by store() back: `keep` columns and payload_bytes ... feature of SCHEMA.

    A null or damaged file gives nulls, with the reason as feature. Equal files give equal rows. ValueError if a kept
    column has the name of a new one. Empty table: no rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")[1:]]
    data_ = _names(media, keep, names)

    def one(data: bytes | None) -> tuple:
        try:
            payload, f = read(data or b"")
        except (ValueError, struct.error, IndexError) as e:
            return None, None, None, len(data or b""), None, json.dumps({"error": str(e)})
        x = np.frombuffer(payload, np.uint8)
        f |= {"mean": round(float(x.mean()), 4), "rms": round(float(np.sqrt((x.astype(np.float64) ** 2).mean())), 4), "low": int(x.min()), "high": int(x.max()), "turns": int((np.diff((x >= 96).view(np.int8)) != 0).sum())}
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), json.dumps(f, sort_keys=True)

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            cols = zip(*(one(x) for x in b[data_].to_pylist()), strict=True) if b.num_rows else [[]] * 6
            out = [b.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(out, [*keep, *names])

    return in_small_batches(media).select(*keep, F.col("media").alias(data_)).mapInArrow(run, f"{_fields(media, keep)}{SCHEMA.split(', ', 1)[1]}")


def _names(df: DataFrame, keep: list[str], made: list[str]) -> str:
    """A name for the column that is read, which no column has; ValueError if a kept one has a new one's name."""
    if clash := set(keep) & set(made):
        raise ValueError(f"kept columns have names of new ones: {sorted(clash)}")
    return free_name(df, "_in")


def _fields(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
