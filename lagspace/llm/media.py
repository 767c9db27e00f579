"""Media columns: MPEG transport streams.

``mux`` puts a payload into a transport stream of 188-byte packets: a program
association table, a program map table, and one private data stream whose
access units are packetised elementary (PES) packets with presentation times;
each access unit's first transport packet is flagged as a random-access point
and has a clock reference. ``demux`` reads any stream of such packets back: it
parses the program tables, checks continuity counters, reassembles elementary
packets and lists their times and random-access points.

Everything is done per document by whole-array numpy operations, in Arrow
batches, without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

PACKET = 188
BODY = PACKET - 4
BLOCK = 192
#: Payload bytes of an access unit, and 90 kHz ticks from one to the next.
UNIT_BYTES = 64 * BLOCK
UNIT_TICKS = 3600
FIRST_PTS = 90_000
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x0100, 0x0101
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD


def payload_of(text: bytes) -> bytes:
    """The text's bytes and then spaces up to a positive multiple of 192."""
    return text + b" " * (-len(text) % BLOCK or (0 if text else BLOCK))


@lru_cache(maxsize=64)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    rows = [bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + s + b"\xff" * (BODY - 1 - len(s)) for pid, s in ((PAT_PID, pat), (PMT_PID, pmt))]
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(2, PACKET)


def _pts(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 29 & 0x0E), ticks >> 22 & 0xFF, 0x01 | (ticks >> 14 & 0xFE), ticks >> 7 & 0xFF, 0x01 | (ticks << 1 & 0xFE)])


def _pcr(ticks: int) -> bytes:
    return (ticks << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload, without loss."""
    rows, counter = [_tables()], 0
    for k, begin in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit, ticks = payload[begin : begin + UNIT_BYTES], FIRST_PTS + k * UNIT_TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts(ticks) + unit
        room = BODY - 8
        more = max(0, len(pes) - room)
        n = 1 + -(-more // BODY)
        p = np.zeros((n, PACKET), dtype=np.uint8)
        p[:, 0] = 0x47
        p[:, 1] = DATA_PID >> 8
        p[0, 1] |= 0x40
        p[:, 2] = DATA_PID & 0xFF
        p[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
        counter += n
        data = np.frombuffer(pes, dtype=np.uint8)
        head = data[:room]
        used = BODY - len(head)
        p[0, 3] |= 0x20
        p[0, 4] = used - 1
        p[0, 5:12] = np.frombuffer(b"\x50" + _pcr(ticks), dtype=np.uint8)
        p[0, 12 : 4 + used] = 0xFF
        p[0, 4 + used :] = head
        if n > 1:
            full, rest = divmod(more, BODY)
            p[1 : 1 + full, 4:] = data[room : room + full * BODY].reshape(full, BODY)
            if rest:
                stuffing = BODY - rest
                p[-1, 3] |= 0x20
                p[-1, 4] = stuffing - 1
                if stuffing > 1:
                    p[-1, 5] = 0
                    p[-1, 6 : 4 + stuffing] = 0xFF
                p[-1, 4 + stuffing :] = data[room + full * BODY :]
        rows.append(p)
    return np.concatenate(rows).tobytes()


@dataclass
class Stream:
    """What a transport stream holds. units: (pts or None, bytes); random_access: (packet index, pts or None)."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    table_errors: int = 0
    sync_errors: int = 0
    continuity_errors: int = 0
    units: list[tuple[int | None, bytes]] = field(default_factory=list)
    random_access: list[tuple[int, int | None]] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        return b"".join(u for _, u in self.units)


def _read_section(packet: np.ndarray, start: int) -> bytes | None:
    raw = packet[start:].tobytes()
    if len(raw) < 1 or len(raw) < raw[0] + 4:
        return None
    raw = raw[1 + raw[0] :]
    size = 3 + ((raw[1] & 0x0F) << 8 | raw[2]) if len(raw) >= 3 else 0
    if size < 12 or len(raw) < size or crc32_mpeg(raw[: size - 4]) != int.from_bytes(raw[size - 4 : size], "big"):
        return None
    return raw[:size]


def demux(media: bytes) -> Stream:
    """Parse a transport stream. Packets out of sync and broken tables are counted, never raised; an empty stream has no units.

    The elementary stream is the first that the first program map names.
    """
    out = Stream()
    p = np.frombuffer(media[: len(media) // PACKET * PACKET], dtype=np.uint8).reshape(-1, PACKET)
    good = p[:, 0] == 0x47
    out.packets, out.sync_errors = len(p), int(len(p) - good.sum()) + (len(media) % PACKET > 0)
    index = np.flatnonzero(good)
    p = p[good]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    has_field, has_body = p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0
    start = np.where(has_field, 5 + p[:, 4].astype(np.int32), 4)
    begins = p[:, 1] & 0x40 > 0

    def tables(which: int, table_id: int):
        for i in np.flatnonzero((pid == which) & begins & has_body):
            s = _read_section(p[i], start[i])
            if s is None or s[0] != table_id:
                out.table_errors += 1
            else:
                yield s

    for s in tables(PAT_PID, 0x00):
        for i in range(8, len(s) - 4, 4):
            if number := s[i] << 8 | s[i + 1]:
                out.programs[number] = (s[i + 2] & 0x1F) << 8 | s[i + 3]
    for number in sorted(out.programs)[:1]:
        for s in tables(out.programs[number], 0x02):
            i = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                out.streams[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 0x0F) << 8 | s[i + 4])
    if not out.streams:
        return out
    mine = (pid == next(iter(out.streams))) & has_body & (start <= PACKET)
    p, start, begins, has_field, index = p[mine], start[mine], begins[mine], has_field[mine], index[mine]
    counters = p[:, 3] & 0x0F
    out.continuity_errors = int((np.diff(counters.astype(np.int32)) % 16 != 1).sum())
    flags = np.where(has_field & (p[:, 4] > 0), p[:, 5], 0)
    for i in np.flatnonzero(flags & 0x10):
        out.clocks.append(int.from_bytes(p[i, 6:12].tobytes(), "big") >> 15)
    body = p[np.arange(PACKET)[None, :] >= start[:, None]]
    ends = np.cumsum(PACKET - start)
    first = np.flatnonzero(begins)
    at = np.concatenate([(ends - (PACKET - start))[first], ends[-1:]]) if len(first) else np.zeros(0, np.int64)
    times = {}
    for k, i in enumerate(first):
        pes = body[at[k] : at[k + 1]].tobytes()
        pts = None
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            continue
        if pes[7] & 0x80:
            t = pes[9:14]
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        size = pes[4] << 8 | pes[5]
        out.units.append((pts, pes[9 + pes[8] : 6 + size if size else len(pes)]))
        times[i] = pts
    out.random_access = [(int(index[i]), times.get(i)) for i in np.flatnonzero(flags & 0x40)]
    return out


def feature(s: Stream) -> str:
    """A summary of a parsed stream: packets, units, times, random-access points and errors."""
    pts = [t for t, _ in s.units if t is not None]
    marks = hashlib.md5(",".join(f"{i}:{t}" for i, t in s.random_access).encode()).hexdigest()[:12]
    return f"packets={s.packets};programs={len(s.programs)};units={len(s.units)};pts={pts[0] if pts else ''}-{pts[-1] if pts else ''};random_access={len(s.random_access)}:{marks};clocks={len(s.clocks)};continuity_errors={s.continuity_errors};sync_errors={s.sync_errors};table_errors={s.table_errors}"


def _media(batches):
    for b in batches:
        media = [mux(payload_of(t)) for t in common.as_bytes(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])


def media(docs: DataFrame) -> DataFrame:
    """doc_id, media binary: the transport stream of every text. A null text is the empty text, whose payload is 192 spaces."""
    return common.pick(docs, "doc_id", "text").mapInArrow(_media, "doc_id long, media binary")


def _parsed(batches):
    for b in batches:
        found = [demux(x or b"") for x in b.column(1).to_pylist()]
        marks = [[{"packet": i, "pts": t} for i, t in s.random_access] for s in found]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array([s.payload for s in found], pa.binary()), pa.array([[t for t, _ in s.units] for s in found], pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64())]))), pa.array([s.continuity_errors for s in found], pa.int64())],
            names=["doc_id", "payload", "pts", "random_access", "continuity_errors"],
        )


def parse(media_rows: DataFrame) -> DataFrame:
    """doc_id, payload, pts array, random_access array of (packet, pts), continuity_errors of every stored stream (a null stream is empty)."""
    return common.pick(media_rows, "doc_id", "media").mapInArrow(_parsed, "doc_id long, payload binary, pts array<bigint>, random_access array<struct<packet: bigint, pts: bigint>>, continuity_errors long")


def _digests(batches):
    for b in batches:
        rows = []
        for t in common.as_bytes(b.column(1)):
            stored = mux(payload_of(t))
            s = demux(stored)
            back = s.payload
            rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(s)))
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digests(docs: DataFrame) -> DataFrame:
    """Per row of docs: sizes and hashes of the payload as read back from the stored stream, of the stream, and its feature.

    A null or empty text is stored as 192 spaces (n_bytes 0). Repeated rows stay
    repeated and equal texts get equal values; a null doc_id stays null.
    """
    return common.pick(docs, "doc_id", "text").mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
