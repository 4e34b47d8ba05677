"""MPEG transport streams as a media column: payload bytes are carried as access units and read back from the packets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varileaf.llm.common import batches, map_arrow, text_bytes

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
PROGRAM, PMT_PID, DATA_PID = 1, 0x0100, 0x0101
CLOCK = 90_000
#: Payloads are padded with spaces to a multiple of UNIT; an access unit carries AU bytes; every GROUP-th is a random-access point.
UNIT, AU, GROUP, RATE = 192, 192 * 64, 8, 25
_PES_HEAD, _FIRST = 14, 176


def crc_mpeg(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(pid: int, body: bytes) -> bytes:
    body += crc_mpeg(body).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + body
    return packet + b"\xff" * (PACKET - len(packet))


def _tables() -> bytes:
    pat = bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0]) + PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")
    pmt = bytes([0x02, 0xB0, 18]) + PROGRAM.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + (0xE000 | DATA_PID).to_bytes(2, "big") + bytes([0xF0, 0, STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + bytes([0xF0, 0])
    return _section(PAT_PID, pat) + _section(PMT_PID, pmt)


TABLES = _tables()


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def mux(payload: bytes) -> bytes:
    """A single-program stream: program tables, then a PES packet with a timestamp for each access unit."""
    return indexed(payload)[0]


def indexed(payload: bytes) -> tuple[bytes, list[int], list[tuple[int, int, int]]]:
    """The stream, the timestamps of its access units, and its random-access points: access unit, timestamp, byte offset of its first packet."""
    out, counter, at_byte = [TABLES], 0, len(TABLES)
    stamps, points = [], []
    for k, at in enumerate(range(0, len(payload), AU)):
        body = payload[at : at + AU]
        pts = k * CLOCK // RATE
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + body
        base = pts & (1 << 33) - 1
        clock = bytes([base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0])
        rest = len(pes) - _FIRST
        full, tail = divmod(rest, PACKET - 4)
        rows = np.empty((1 + full + bool(tail), PACKET), np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        rows[:, 3] = 0x10 | (counter + np.arange(len(rows))) & 15
        counter += len(rows)
        rows[0, 1] |= 0x40
        rows[0, 3] |= 0x20
        rows[0, 4:12] = np.frombuffer(bytes([7, 0x50 if k % GROUP == 0 else 0x10]) + clock, np.uint8)
        data = np.frombuffer(pes, np.uint8)
        rows[0, 12:] = data[:_FIRST]
        rows[1 : 1 + full, 4:] = data[_FIRST : len(data) - tail].reshape(full, PACKET - 4)
        if tail:
            stuffed = PACKET - 4 - tail
            rows[-1, 3] |= 0x20
            rows[-1, 4] = stuffed - 1
            if stuffed > 1:
                rows[-1, 5] = 0
                rows[-1, 6 : 4 + stuffed] = 0xFF
            rows[-1, 4 + stuffed :] = data[len(data) - tail :]
        stamps.append(pts)
        if k % GROUP == 0:
            points.append((k, pts, at_byte))
        at_byte += rows.size
        out.append(rows.tobytes())
    return b"".join(out), stamps, points


class Demuxed:
    """What a stream holds: payload, and for each access unit its timestamp and whether it is a random-access point."""

    def __init__(self, media: bytes):
        rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
        if (rows[:, 0] != SYNC).any():
            raise ValueError("a packet lacks its sync byte")
        pid = (rows[:, 1] & 0x1F).astype(np.int64) << 8 | rows[:, 2]
        control = rows[:, 3] >> 4 & 3
        start = 4 + np.where(control & 2, rows[:, 4].astype(np.int64) + 1, 0)
        self.pmt_pid = self._table(rows, pid, start, PAT_PID, 0, lambda b: int.from_bytes(b[10:12], "big") & 0x1FFF)
        self.data_pid = self._table(rows, pid, start, self.pmt_pid, 2, lambda b: int.from_bytes(b[13 + (int.from_bytes(b[10:12], "big") & 0x0FFF) :][:2], "big") & 0x1FFF)
        mine = np.flatnonzero((pid == self.data_pid) & (control & 1 > 0))
        rows, start = rows[mine], start[mine]
        counters = rows[:, 3] & 15
        self.gaps = int((np.diff(counters.astype(np.int16)) % 16 != 1).sum())
        if self.gaps:
            raise ValueError(f"{self.gaps} packets are missing")
        begins = np.flatnonzero(rows[:, 1] & 0x40)
        flagged = (rows[:, 3] >> 5 & 1 > 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 > 0)
        flat = rows[np.arange(PACKET) >= start[:, None]].tobytes()
        ends = np.cumsum(PACKET - start)
        self.pts, self.random_access, self.points, units = [], [], [], []
        for i, row in enumerate(begins.tolist()):
            a = int(ends[row] - PACKET + start[row])
            b = int(ends[begins[i + 1] - 1]) if i + 1 < len(begins) else len(flat)
            if flat[a : a + 3] != b"\0\0\1" or int.from_bytes(flat[a + 4 : a + 6], "big") != b - a - 6:
                raise ValueError("a PES packet is broken")
            t = flat[a + 9 : a + 14]
            self.pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
            if flagged[row]:
                self.random_access.append(self.pts[-1])
                self.points.append((i, self.pts[-1], int(mine[row]) * PACKET))
            units.append(flat[a + 9 + flat[a + 8] : b])
        self.units = len(units)
        self.payload = b"".join(units)

    @staticmethod
    def _table(rows: np.ndarray, pid: np.ndarray, start: np.ndarray, wanted: int, table: int, value) -> int:
        found = np.flatnonzero((pid == wanted) & (rows[:, 1] & 0x40 > 0))
        if not len(found):
            raise ValueError(f"no table on packet id {wanted}")
        packet = rows[found[0]].tobytes()[int(start[found[0]]) :]
        body = packet[1 + packet[0] :]
        body = body[: 3 + (int.from_bytes(body[1:3], "big") & 0x0FFF)]
        if body[0] != table or body not in _SOUND:
            if body[0] != table or crc_mpeg(body):
                raise ValueError("a program table fails its checksum")
            if len(_SOUND) < 64:
                _SOUND.add(body)
        return value(body)


_SOUND: set[bytes] = set()


def feature(stream: Demuxed) -> str:
    """Timing of the stream and first- and second-order figures of its samples."""
    samples = np.frombuffer(stream.payload, np.uint8)
    p = np.bincount(samples, minlength=256) / len(samples)
    seen = p[p > 0]
    mean = float(p @ np.arange(256))
    return f"units={stream.units};random_access={len(stream.random_access)};first_pts={stream.pts[0]};last_pts={stream.pts[-1]};mean={mean:.4f};var={float(p @ (np.arange(256) - mean) ** 2):.4f};entropy={float(-(seen * np.log2(seen)).sum()):.6f}"


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, pts and random_access: each whole text as a transport stream, with its timestamps and random-access points.

    Null is empty; an empty text is 192 spaces.
    Repeated rows stay, a null doc_id too; an empty table gives none; other columns are left out.
    """

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            texts = text_bytes(frame.column(1))
            media, stamps, points = zip(*(indexed(payload_of(t)) for t in texts), strict=True)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary()), pa.array(stamps, pa.list_(pa.int64())), _points(points)], names=["doc_id", "n_bytes", "media", "pts", "random_access"])

    return map_arrow(docs.select(docs.doc_id.cast("long").alias("doc_id"), "text"), rows, f"doc_id long, n_bytes long, media binary, {_INDEX}")


_INDEX = "pts array<long>, random_access array<struct<access_unit: long, pts: long, byte_offset: long>>"
_POINT = ("access_unit", "pts", "byte_offset")


def _points(points) -> pa.Array:
    return pa.array([[dict(zip(_POINT, x, strict=True)) for x in own] for own in points], pa.list_(pa.struct([(c, pa.int64()) for c in _POINT])))


def read_media(media: DataFrame) -> DataFrame:
    """Demultiplexes every stored stream: payload and stream figures, timestamps and random-access points, which must be the stored ones."""

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, "media"):
            out, stamps, points = [], [], []
            for doc_id, n, raw, pts, access in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                s = Demuxed(raw)
                if s.pts != pts or s.points != [tuple(x[c] for c in _POINT) for x in access]:
                    raise ValueError("the stored timestamps or random-access points aren't those of the stream")
                stamps.append(s.pts)
                points.append(s.points)
                out.append((doc_id, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(s), s.units, len(s.random_access), s.pts[-1]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            own = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(stamps, pa.list_(pa.int64())), _points(points)], names=[*_NAMES, "pts", "random_access"])

    return map_arrow(media.select("doc_id", "n_bytes", "media", "pts", "random_access"), rows, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access_units long, random_access_points long, last_pts long, {_INDEX}")


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_units", "random_access_points", "last_pts"]
