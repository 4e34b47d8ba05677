"""Token ids of whole texts with a public tokenizer, each distinct piece of a text encoded once."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces kept by a Python worker.
PIECES = 800_000
#: Pieces beyond this many bytes are not kept.
LONGEST = 64
#: Classes of bytes: others, letters, digits, signs. Pre-tokens of visible characters are runs of one class.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
#: First bytes of two-byte letters (U+00C0 to U+00FF but for two signs, and U+0400 to U+047F).
_LEAD = np.zeros(256, bool)
_LEAD[[0xC3, 0xD0, 0xD1]] = True


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions where a byte-level pre-tokenizer surely starts a new piece, and the starts of texts, in order.

    Those are a space before a visible character, both sides of a single line feed between visible characters, and changes of class
    inside visible characters, but not from an apostrophe to a letter. Characters of other scripts than _LEAD's have no class here, so
    their pieces are only longer.
    """
    n = len(data)
    kind = np.zeros(n + 1, np.uint8)
    kind[:n] = _CLASS[data]
    lead = np.flatnonzero(_LEAD[data[:-1]])
    lead = lead[~((data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)))]
    kind[lead] = kind[lead + 1] = 1
    cut = np.zeros(n, bool)
    cut[1:] = (kind[1:n] != kind[: n - 1]) & (kind[1:n] > 0) & (kind[: n - 1] > 0)
    cut[1:] &= (data[:-1] != 39) | (kind[1:n] != 1)
    first = np.zeros(n + 1, bool)
    first[starts] = first[n] = True
    inside = (kind[1:] > 0) & ~first[1:]  # a visible character of the same text follows
    cut |= (data == 32) & inside
    line = np.flatnonzero((data == 10) & inside & ~first[:n])
    line = line[kind[line - 1] > 0]
    cut[line] = cut[line + 1] = True
    cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts as the tokenizers library does; a text's pieces are independent, so known ones are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model.tokenize
        self.code = "H" if self.vocabulary <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        bare = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in bare)}  # the byte-level alphabet shows the other bytes from 256 on
        self.known: dict[bytes, bytes] = {}

    def _piece(self, piece: bytes) -> bytes:
        """Ids of one piece; a run of one class with or without a space in front is one pre-token, others take the library's whole path."""
        text = piece.decode()
        core = text[1:] if text[:1] == " " else text
        if text.isascii():
            if core.isalpha() or core.isdigit() or core == "\n" or not (any(map(str.isalnum, core)) or any(map(core.__contains__, "' \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"))) and core:
                found = self.model(text.replace(" ", "\u0120").replace("\n", "\u010a"))
            else:
                found = None
        else:
            found = self.model(piece.decode("latin-1").translate(self.shown)) if core.isalpha() else None
        ids = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids if found is None else [t.id for t in found]).tobytes()
        if len(piece) <= LONGEST:
            self.known[piece] = ids
        return ids

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, one after another, and where each text's end."""
        _, offsets, buffer = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        if not len(column) or at[0] == at[-1]:
            return np.zeros(0, self.kind), np.zeros(len(column), np.int64)
        starts, stops = at[:-1], at[1:]
        data = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]]
        where = cuts(data, (starts[starts < stops] - at[0]).astype(np.int64))
        edges = np.append(where + at[0], at[-1]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(edges), buffer]).dictionary_encode()
        if len(self.known) > PIECES:
            self.known.clear()
        known = self.known
        blobs = [known.get(p) or self._piece(p) for p in pieces.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.kind.itemsize
        table = np.frombuffer(b"".join(blobs), self.kind)
        index = pieces.indices.to_numpy()
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        ids = table[np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - lengths), lengths) + np.arange(ends[-1])]
        upto = np.searchsorted(where, stops - at[0])  # pieces before the end of each text
        return ids, np.concatenate(([0], ends))[upto]

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, `end_id` after each, and where each text's end; a null text is empty."""
        column = pc.fill_null(column.cast(pa.string()), "")
        special = np.zeros(len(column), bool)
        for token in self.special:
            special |= pc.match_substring(column, token.decode()).to_numpy(zero_copy_only=False)
        if special.any():
            mask = pa.array(special)
            ids, ends = self._plain(pc.if_else(mask, "", column))
            whole = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch(column.filter(mask).to_pylist(), add_special_tokens=False)]
            ids = np.insert(ids, np.repeat(ends[special], [len(x) for x in whole]), np.concatenate(whole))
            more = np.zeros(len(column), np.int64)
            more[special] = [len(x) for x in whole]
            ends = ends + np.cumsum(more)
        else:
            ids, ends = self._plain(column)
        return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)

    def sentence_marks(self) -> tuple[np.ndarray, np.ndarray]:
        """By id: whether a token can end a sentence, and whether it can begin one."""
        ends, begins = np.zeros(self.vocabulary + 1, bool), np.zeros(self.vocabulary + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token[-1:] in ".!?Ċ"
            begins[i] = token[:1] in "ĠĊ" or token[:1].isupper()
        return ends, begins


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
