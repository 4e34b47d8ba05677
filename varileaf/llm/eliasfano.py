"""Token files: concatenated ids with Elias-Fano coded document boundaries and a select structure.

A file holds, in this order, a header, the low bits of the boundaries, their high bits in unary, the position
of every SAMPLE-th one among the high bits, and the ids. For n documents over u ids the boundaries take about
n * (2 + log2(u / n)) bits, where a table of 64-bit offsets takes 64 n.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm.common import batches, map_arrow, materialize

_HEAD = struct.Struct("<4sBBHQQQQQ")
_MAGIC = b"EFID"
#: Every so many boundaries the select structure keeps one position.
SAMPLE = 256
#: Ids after which a file is closed.
FILE_IDS = 1 << 21


def _packed(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    cells = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(cells.astype(np.uint8).ravel(), bitorder="little").tobytes()


class Boundaries:
    """Ends of documents as Elias-Fano code: select(i) gives how many ids the first i documents have."""

    def __init__(self, n: int, universe: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.bits = n, self.width(n, universe)
        self.low, self.high, self.samples = low, np.frombuffer(high, np.uint8), samples

    @staticmethod
    def width(n: int, universe: int) -> int:
        return max(0, (universe // max(n, 1)).bit_length() - 1)

    @classmethod
    def code(cls, ends: np.ndarray, universe: int) -> tuple[bytes, bytes, bytes]:
        bits = cls.width(len(ends), universe)
        values = ends.astype(np.uint64)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(len(ends))
        ones = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.uint8)
        ones[at] = 1
        return _packed(values & np.uint64((1 << bits) - 1), bits), np.packbits(ones, bitorder="little").tobytes(), at[::SAMPLE].astype("<u8").tobytes()

    def _low(self, i: int) -> int:
        if not self.bits:
            return 0
        first = i * self.bits
        word = int.from_bytes(self.low[first >> 3 : (first + self.bits + 7) >> 3], "little")
        return word >> (first & 7) & ((1 << self.bits) - 1)

    def select(self, i: int) -> int:
        """Ids in the first i documents; only one sampled stretch of the high bits is looked at."""
        if i == 0:
            return 0
        i -= 1
        position = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = position >> 3
        window = np.unpackbits(self.high[byte : byte + 1 + SAMPLE // 8], bitorder="little")
        window[: position & 7] = 0
        while True:
            found = np.flatnonzero(window)
            if len(found) > left:
                return (byte * 8 + int(found[left]) - i << self.bits) + self._low(i)
            left -= len(found)
            byte += len(window) >> 3
            window = np.unpackbits(self.high[byte : byte + 1 + SAMPLE // 8], bitorder="little")


def write_file(documents: list[np.ndarray], vocabulary: int) -> bytes:
    """One token file; ids take two bytes where the vocabulary allows it."""
    ends = np.cumsum([len(d) for d in documents], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    low, high, samples = Boundaries.code(ends, total)
    width = 2 if vocabulary <= 1 << 16 else 4
    ids = np.concatenate(documents).astype(f"<u{width}").tobytes() if documents else b""
    return _HEAD.pack(_MAGIC, 1, width, 0, len(documents), total, len(low), len(high), len(samples)) + low + high + samples + ids


class TokenFile:
    def __init__(self, raw: bytes):
        magic, version, width, _, n, total, low, high, samples = _HEAD.unpack_from(raw)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a token file")
        a = _HEAD.size
        b, c = a + low, a + low + high
        self.n, self.boundaries = n, Boundaries(n, total, raw[a:b], raw[b:c], np.frombuffer(raw, "<u8", samples // 8, c))
        self.ids = np.frombuffer(raw, f"<u{width}", total, c + samples)

    def document(self, i: int) -> tuple[int, np.ndarray]:
        """Where document i starts among the file's ids, and its ids."""
        start = self.boundaries.select(i)
        return start, self.ids[start : self.boundaries.select(i + 1)]


def write_tokens(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Encodes all documents in ascending doc_id order and writes token files, rows of a table in the shared folder.

    Columns: part, seq (order of the files), part_start (ids of the part before the file), n_ids, doc_ids, file.
    A null text is an empty one and has the end id alone; a null doc_id comes first; rows that repeat a doc_id
    follow one another in order of their texts; an empty table gives no file.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def files(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from varileaf.llm.tokens import encoder

        enc, part = encoder(path), TaskContext.get().partitionId()
        seq = start = held = 0
        names: list[int | None] = []
        kept: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([start]), pa.array([held]), pa.array([names], pa.list_(pa.int64())), pa.array([write_file(kept, enc.vocabulary)], pa.binary())], names=["part", "seq", "part_start", "n_ids", "doc_ids", "file"])

        for frame in batches(frames):
            names += frame.column(0).to_pylist()
            ids, stops = enc.encode(frame.column(1), end_id)
            kept += np.split(ids, stops[:-1])
            held += len(ids)
            if held >= FILE_IDS:
                yield close()
                seq, start, held, names, kept = seq + 1, start + held, 0, [], []
        if kept:
            yield close()

    return materialize(map_arrow(ordered, files, "part long, seq long, part_start long, n_ids long, doc_ids array<long>, file binary"), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone; each document is found by select.

    Rows keep what write_tokens() wrote of them: null doc_ids stay null, a null or empty text has its end id, repeated rows come as
    often as they were written. Without files there are no rows.
    """
    bases, total = {}, 0
    # a row for each task that wrote, however long the table is
    for part, n in sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        bases[part] = total
        total += n

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for frame in frames:
            for r in frame.to_pylist():
                file = TokenFile(r["file"])
                base = bases[r["part"]] + r["part_start"]
                starts, sizes, crc = [], [], []
                for i in range(file.n):
                    start, ids = file.document(i)
                    starts.append(base + start)
                    sizes.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4")))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(files.select("part", "part_start", "doc_ids", "file"), rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
