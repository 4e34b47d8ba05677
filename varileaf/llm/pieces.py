"""Pieces of texts with a public SentencePiece model of merges, each with the bytes of the text it stands for, and back.

Texts are normalised by the model's compiled character map (longest prefix first), which records for every byte of the normalised text where
its source lies. Merges join neighbours within the normalised text; two characters that are next to each other in no piece of the vocabulary
are never joined, so a text falls into independent parts there, and each distinct part is merged once.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm.common import batches, map_arrow

#: Distinct parts that a Python worker keeps, and the bytes beyond which a part isn't kept.
KEPT, LONGEST = 300_000, 64
#: Parts of up to so many characters are merged by looking through all neighbours each time. No score is that far down.
SHORT, FAR = 32, float("inf")
#: Bytes of text that are encoded at a time; each takes about eighty in arrays. A longer text goes in stretches of about as much.
STRETCH = 1 << 19
#: Rows that are decoded at a time.
DECODED = 256
SPACE = "▁"
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_MARK, _LOST = SPACE.encode(), "�".encode()


class CharacterMap:
    """The compiled map of a model: a double array over UTF-8 keys, and the images they point to.

    A unit of the array has a label (its lowest byte), a mark for "a key ends here" (bit 8) and an offset to its children; the value of a key
    lies in the unit at that offset.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.images = blob[4 + size :]
        self.first = np.zeros(256, bool)  # bytes that a key begins with
        if self.units:
            root = self._children(self.units[0])
            self.first[[b for b in range(256) if self._label(root ^ b) == b]] = True

    @staticmethod
    def _children(unit: int) -> int:
        return unit >> 10 << (8 if unit & 0x200 else 0)

    def _label(self, at: int) -> int:
        return self.units[at] & 0x800000FF if at < len(self.units) else -1

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the longest key that the text has at a place, and its image; 0 without one."""
        found, image = 0, b""
        node = self._children(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if self._label(node) != text[i]:
                break
            unit = self.units[node]
            node ^= self._children(unit)
            if unit & 0x100:
                start = self.units[node] & 0x7FFFFFFF
                found, image = i + 1 - at, self.images[start : self.images.index(b"\0", start)]
        return found, image

    def edits(self, text: bytes, marks: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Start, stop and image of what is replaced, in order. marks: starts of texts within `text`, which no key crosses."""
        if not self.units:
            return
        data = np.frombuffer(text, np.uint8)
        bounds = [*marks.tolist(), len(text)]
        done = 0
        for at in np.flatnonzero(self.first[data]).tolist():
            if at >= done:
                stop = bounds[int(np.searchsorted(marks, at, side="right"))]
                size, image = self.longest(text[at : min(stop, at + 64)], 0)
                if size:
                    yield at, at + size, image
                    done = at + size


class Model:
    """What a model file says, and encoding and decoding by it. Only models of merges (BPE) are read."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as files

        spec = files.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules, trainer = spec.normalizer_spec, spec.trainer_spec
        own = [p.piece for p in spec.pieces if p.type in (OWN, UNUSED)]
        if trainer.model_type != trainer.BPE or rules.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix or own or not rules.escape_whitespaces:
            raise ValueError("a model of merges that keeps white space, marks it in front and has no pieces of its own is needed")
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix = rules.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.scores = {p.piece: -p.score for p in spec.pieces if p.type == NORMAL}
        self.kinds = np.array([p.type for p in spec.pieces], np.uint8)
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.bytes = [self.unknown] * 256
        for i in np.flatnonzero(self.kinds == BYTE).tolist():
            self.bytes[int(spec.pieces[i].piece[3:5], 16)] = i
        self.fallback = trainer.byte_fallback
        self.widths = [len(p.piece.encode()) for p in spec.pieces]
        self.code, self.kind = ("H", np.dtype("<u2")) if len(spec.pieces) <= 1 << 16 else ("I", np.dtype("<u4"))
        self.known: dict[bytes, bytes] = {}
        shown = {UNKNOWN: lambda p: trainer.unk_surface, CONTROL: lambda p: ""}
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else shown.get(p.type, lambda p: p.piece.replace(SPACE, " "))(p).encode() for p in spec.pieces]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.marked = np.array([p.piece.startswith(SPACE) and p.type == NORMAL for p in spec.pieces])
        self._pairs()

    def _pairs(self) -> None:
        """Which two characters stand next to each other in some piece: by number of the left and of the right one; 0 is any that does nowhere."""
        left, right = {}, {}
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        for a, b in sorted(pairs):
            left.setdefault(a, len(left) + 1)
            right.setdefault(b, len(right) + 1)
        self.left, self.right = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
        self.left[[*map(ord, left)]], self.right[[*map(ord, right)]] = list(left.values()), list(right.values())
        self.meets = np.zeros((len(left) + 1, len(right) + 1), bool)
        for a, b in pairs:
            self.meets[left[a], right[b]] = True

    def merged(self, part: str) -> list[str]:
        """The symbols of a part after all merges: the best score first, the leftmost of equals."""
        if len(part) > SHORT:
            return self._merged_long(part)
        symbols, get = list(part), self.scores.get
        costs = [get(a + b, FAR) for a, b in zip(symbols, symbols[1:], strict=False)]
        while costs and (least := min(costs)) < FAR:
            i = costs.index(least)
            symbols[i : i + 2] = [both] = [symbols[i] + symbols[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(both + symbols[i + 1], FAR)
            if i:
                costs[i - 1] = get(symbols[i - 1] + both, FAR)
        return symbols

    def _merged_long(self, part: str) -> list[str]:
        """The same with a heap of neighbours."""
        symbols = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(score, i, 2) for i in range(n - 1) if (score := self.scores.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            both = symbols[i] + symbols[j]
            if (score := self.scores.get(both)) is not None:
                heapq.heappush(heap, (score, i, len(both)))

        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s]

    def _part(self, part: bytes) -> bytes:
        """Ids of a part's pieces, then their bytes. Of a character that goes byte by byte the last piece has them all."""
        ids, sizes = [], []
        for symbol in self.merged(part.decode()):
            if (i := self.ids.get(symbol)) is not None:
                ids.append(i)
                sizes.append(self.widths[i])
            else:
                raw = symbol.encode()
                ids += [self.bytes[b] for b in raw] if self.fallback else [self.unknown]
                sizes += [0] * (len(raw) - 1) * self.fallback + [len(raw)]
        out = array(self.code, ids + sizes).tobytes()
        if len(part) <= LONGEST:
            self.known[part] = out
        return out

    def normalised(self, text: bytes, marks: np.ndarray, prefixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The normalised bytes of several texts (starts in `text`: marks), the place in `text` that each is from (and the end), and where the
        texts start. The texts of `prefixed` get a space in front."""
        data = np.frombuffer(text, np.uint8)
        source = np.arange(len(data), dtype=np.int32)
        edits = list(self.map.edits(text, marks))
        starts = marks
        if edits:
            keep = np.ones(len(data), bool)
            for a, b, _ in edits:
                keep[a:b] = False
            at = np.concatenate([np.flatnonzero(keep), *[np.full(len(image), a) for a, _, image in edits]])
            order = np.argsort(at, kind="stable")
            data = np.concatenate([data[keep], np.frombuffer(b"".join(e[2] for e in edits), np.uint8)])[order]
            source = at[order].astype(np.int32)
            starts = np.searchsorted(source, marks)
        size = np.ones(len(data), np.int32)
        size[data == 32] = 3
        into = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(data, size)
        for k, b in enumerate(_MARK):
            out[into[:-1][data == 32] + k] = b
        source = np.append(np.repeat(source, size), np.int32(len(text)))
        first = into[starts]
        if prefixed.any():
            at = np.repeat(first[prefixed], 3)
            out = np.insert(out, at, np.tile(np.frombuffer(_MARK, np.uint8), len(at) // 3))
            source = np.insert(source, at, np.repeat(marks[prefixed], 3).astype(np.int32))
            first = first + 3 * (np.cumsum(prefixed) - prefixed)
        return out, source, first

    def _cuts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the independent parts of normalised texts."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data)])[0].as_py()
        points = np.frombuffer(code.encode("utf-32-le"), "<u4")
        apart = ~self.meets[self.left[points[:-1]], self.right[points[1:]]]
        cut = np.zeros(len(data) + 1, bool)
        cut[lead[1:]] = apart
        cut[0] = cut[first] = True
        return np.flatnonzero(cut[:-1])

    def encode(self, texts: list[bytes], prefixed: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, where each piece starts and stops in its text, and how many each text has."""
        sizes = np.array([len(t) for t in texts], np.int64)
        marks = np.cumsum(sizes) - sizes
        full = np.flatnonzero(sizes)
        if not len(full):
            none = np.zeros(0, np.int32)
            return none, none, none, np.zeros(len(texts), np.int64)
        data, source, first = self.normalised(b"".join(texts), marks[full], np.array(prefixed, bool)[full] & self.prefix)
        where = self._cuts(data, first)
        edges = np.append(where, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        if len(self.known) > KEPT:
            self.known.clear()
        found = [self.known.get(p) or self._part(p) for p in parts.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // (2 * self.kind.itemsize)
        index = parts.indices.to_numpy()
        each = lengths[index]
        ends = np.cumsum(each)
        table = np.frombuffer(b"".join(found), self.kind)
        before = 2 * (np.cumsum(lengths) - lengths)
        pick = np.repeat(before[index] - (ends - each), each) + np.arange(ends[-1])
        ids, sizes = table[pick].astype(np.int32), table[pick + np.repeat(each, each)]
        hi = np.cumsum(sizes, dtype=np.int64)
        counts = np.zeros(len(texts), np.int64)
        counts[full] = np.diff(np.concatenate(([0], ends))[np.searchsorted(where, np.append(first[1:], len(data)))], prepend=0)
        own = np.repeat(marks, counts).astype(np.int32)
        return ids, source[hi - sizes] - own, source[hi] - own, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of several lists of ids, one after another."""
        ends = np.cumsum(counts)
        sizes = self.sizes[ids].copy()
        starts = self.starts[ids].copy()
        shown = np.flatnonzero(self.kinds[ids] != CONTROL)  # a mark in front of a text's first shown piece is no space of the text
        if self.prefix and len(shown):
            begin = np.searchsorted(shown, ends - counts)
            first = shown[begin[begin < np.searchsorted(shown, ends)]]
            first = first[self.marked[ids[first]]]
            sizes[first] -= 1
            starts[first] += 1
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        data = self.raw[np.repeat(starts - (upto - sizes), sizes) + np.arange(total)].tobytes()
        edges = np.concatenate(([0], upto))[np.concatenate(([0], ends))].tolist()
        out = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if len(ids) and (self.kinds[ids] == BYTE).any():
            for k, (t, end, n) in enumerate(zip(out, ends.tolist(), counts.tolist(), strict=True)):
                try:
                    t.decode()
                except UnicodeDecodeError:
                    out[k] = _repaired(t)
        return out


def _repaired(text: bytes) -> bytes:
    """Every byte that isn't part of a character is replaced."""
    out, at = [], 0
    while at < len(text):
        for size in (1, 2, 3, 4):
            try:
                text[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(text[at : at + size])
            at += size
            break
        else:
            out.append(_LOST)
            at += 1
    return b"".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def stretches(text: bytes, most: int = STRETCH) -> list[bytes]:
    """A long text in stretches that begin with a space after another character: nothing is joined across such a place."""
    out = []
    while len(text) > most:
        at = most
        while (at := text.find(b" ", at)) > 0 and text[at - 1] in b" \x81":
            at += 1
        if at < 0:
            break
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, starts and stops: the pieces of every text, and which of its UTF-8 bytes each stands for.

    The space that the model puts in front of a text has no bytes, and of a character that goes byte by byte the last piece has them all.
    A null or empty text has no pieces. Rows that repeat one another stay, null ids too; an empty table gives none; other columns are left out.
    """

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for frame in batches(frames, most=STRETCH):
            texts, prefixed, owner = [], [], []
            for i, t in enumerate(pc.fill_null(frame.column(1).cast(pa.binary()), b"").to_pylist()):
                for j, part in enumerate(stretches(t) if not m.map.units else [t]):
                    texts.append(part)
                    prefixed.append(j == 0)
                    owner.append(i)
            if len(texts) == frame.num_rows:
                ids, starts, stops, counts = m.encode(texts, prefixed)
            else:  # one long text
                found = [m.encode([t], [p]) for t, p in zip(texts, prefixed, strict=True)]
                base = np.cumsum([0, *map(len, texts[:-1])])
                ids = np.concatenate([f[0] for f in found])
                starts, stops = (np.concatenate([f[k] + b for f, b in zip(found, base, strict=True)]) for k in (1, 2))
                counts = np.array([len(ids)])
            yield pa.RecordBatch.from_arrays([frame.column(0), _lists(ids, counts), _lists(starts, counts), _lists(stops, counts)], names=["doc_id", "ids", "starts", "stops"])

    given = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_arrow(given, rows, "doc_id long, ids array<int>, starts array<int>, stops array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with their text, from the column `ids`: pieces one after another, marks as spaces, without the space in front.

    Bytes that make no character are replaced one by one; begin and end ids show nothing; null ids are an empty text.
    """

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for frame in frames:
            at = frame.schema.get_field_index("ids")
            for a in range(0, frame.num_rows, DECODED):
                some = frame.slice(a, DECODED)
                ids = some.column(at)
                counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
                texts = m.decode(ids.flatten().to_numpy(), counts)
                yield some.append_column("text", pa.array(texts, pa.binary()).cast(pa.string()))

    return map_arrow(encoded, rows, ", ".join(f"`{c}` {kind}" for c, kind in encoded.dtypes) + ", text string")
