"""Media columns: Ogg.

Bytes are written as 8-bit samples into packets of one logical stream, multiplexed page by page with a stream of notes. Reading
verifies each page's checksum, reassembles packets from lacing values, demultiplexes the logical streams by serial number and
derives timestamps from granule positions.

Defined results: a null or empty text is 192 spaces; a page whose checksum is wrong is reported and left out, with the packets it
held; bytes between pages are skipped; a null media value has no pages; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm.rows import back, sent, sent_type, small_batches
from molframe.session import table

UNIT, RATE = 192, 8000
#: Bytes of a packet of samples; serial numbers of the two streams.
PACKET, SAMPLES, NOTES = 21 * UNIT, 1, 2
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The CRC-32 of an Ogg page (polynomial 04c11db7, unreflected, from 0): the reflected one of the bit-reversed bytes, reversed."""
    crc = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of a logical stream; packets run on over page ends, a page's granule is that of the last packet it ends. The first packet has a page of its own."""
    pages: list[bytes] = []

    def put(group: list[bytes], positions: list[int], last: bool) -> None:
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in group)
        body, at, done, open_packet = b"".join(group), 0, 0, False
        for k in range(0, len(lacing), 255):
            part = lacing[k : k + 255]
            size, ended = sum(part), len(part) - part.count(255)
            done += ended
            flags = 1 * open_packet | 2 * (not pages) | 4 * (last and k + 255 >= len(lacing))
            pages.append(_page(flags, positions[done - 1] if ended else -1, serial, len(pages), part, body[at : at + size]))
            at, open_packet = at + size, part[-1] == 255

    put(packets[:1], granules[:1], len(packets) == 1)
    if len(packets) > 1:
        put(packets[1:], granules[1:], True)
    return pages


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as 8-bit samples of one stream, interleaved with a stream of notes on it."""
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    head = b"\x7fPCM8\x00" + struct.pack("<IBQ", rate, 1, len(payload))
    notes = [b"\x7fNOTE\x00", struct.pack("<QI", len(payload), zlib.crc32(payload))]
    a, b = stream_pages(SAMPLES, [head, *parts], [0, *ends]), stream_pages(NOTES, notes, [0, len(payload)])
    return b"".join([a[0], b[0], *a[1:2], *b[1:], *a[2:]])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # -1 but for the last packet a page ends
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _open: list[bytes] | None = None
    _number: int = -1

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: memoryview) -> None:
        if number != self._number + 1:  # pages are missing: what was open can't be completed
            self.lost += number - self._number - 1
            self._open = None
        self._number, self.pages = number, self.pages + 1
        self.ended |= bool(flags & 4)
        if not flags & 1:
            self._open = []
        at, start, done = 0, 0, 0
        for value in lacing:
            at += value
            if value < 255:
                if self._open is not None:
                    self.packets.append(b"".join([*self._open, body[start:at]]))
                    self.granules.append(-1)
                    done += 1
                self._open, start = [], at
        if done:
            self.granules[-1] = granule
        if self._open is not None and start < at:
            self._open.append(bytes(body[start:at]))


def demux(media: bytes | None) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and the number of pages whose checksum is wrong."""
    streams: dict[int, Stream] = {}
    data, at, bad = media or b"", 0, 0
    view = memoryview(data)
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        _, version, flags, granule, serial, number, crc = struct.unpack_from("<4sBBqIII", data, at)
        lacing = data[at + 27 : at + 27 + data[at + 26]]
        start = at + 27 + len(lacing)
        end = start + sum(lacing)
        if version or end > len(data) or checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            bad, at = bad + 1, at + 4
            continue
        streams.setdefault(serial, Stream(serial)).add(flags, granule, number, lacing, view[start:end])
        at = end
    return streams, bad


def timestamps(stream: Stream, rate: int) -> list[float | None]:
    """Seconds at each packet's end: from its page's granule, and before that back by the samples that follow."""
    out: list[float | None] = [None] * len(stream.packets)
    known: int | None = None
    for k in range(len(stream.packets) - 1, -1, -1):
        if stream.granules[k] >= 0:
            known = stream.granules[k]
        if known is not None:
            out[k] = known / rate
            known -= len(stream.packets[k]) if k else 0
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def features(streams: dict[int, Stream], bad: int) -> tuple[bytes, str]:
    """The samples read back, and what they sound like."""
    stream = streams[SAMPLES]
    rate = struct.unpack_from("<I", stream.packets[0], 6)[0]
    samples = b"".join(stream.packets[1:])
    wave = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    seconds = timestamps(stream, rate)[-1]
    said = f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};bad={bad};packets={len(stream.packets)};rate={rate};seconds={seconds:.6f};sum={int(wave.sum())};power={int((wave * wave).sum())};peak={int(abs(wave).max()) if len(wave) else 0};crossings={crossings}"
    return samples, said


def ogg_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary) of every text."""

    small_batches(df)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "media": [mux(payload_of(t)[1]) for t in pdf["text"]]})

    out = df.select(sent(df, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {sent_type(df, id_col)}, media binary")
    return out.select(back(df, id_col, "id"), "media")


def ogg_packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", rate: int = RATE) -> DataFrame:
    """(id, serial, packet, seconds, data, bad_pages): a row for each packet of each logical stream."""

    small_batches(df)

    def run(batches):
        for pdf in batches:
            for key, media in zip(pdf["id"], pdf["media"], strict=True):
                streams, bad = demux(media)
                for s in streams.values():
                    yield pd.DataFrame({"id": [key] * len(s.packets), "serial": s.serial, "packet": range(len(s.packets)), "seconds": timestamps(s, rate), "data": s.packets, "bad_pages": bad})

    out = df.select(sent(df, id_col).alias("id"), F.col(media_col).alias("media")).mapInPandas(run, f"id {sent_type(df, id_col)}, serial long, packet long, seconds double, data binary, bad_pages long")
    return out.select(back(df, id_col, "id"), *out.columns[1:])


def ogg_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads the stored bytes back and digests both; a row for each input row."""

    small_batches(df)

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                n, payload = payload_of(text)
                media = mux(payload)
                back, said = features(*demux(media))
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), said))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    shape = f"id {sent_type(df, id_col)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = df.select(sent(df, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, shape)
    return out.select(back(df, id_col, "id"), *out.columns[1:])


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_round_trip(table(spark, sf_dir, "documents"))
