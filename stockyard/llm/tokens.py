"""Token ids of whole texts by a public byte-level vocabulary.

The tokenizers library does the encoding. Its pre-tokenizer never joins what stands
before a blank with what follows it, unless the blank is followed by more white space,
so a text may be cut before each such blank and each piece looked up in a bounded
per-process cache; the library sees every distinct piece once. Many texts are cut together
into one column of pieces, whose distinct values alone are looked up.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Pieces kept per process; full caches start afresh, which only costs time.
_MOST_PIECES = 1_200_000
_MOST_WORDS = 200_000
# Bytes of text that are well encoded at once.
TEXT_BYTES = 1 << 23

# A blank that belongs to a longer run of white space, where no cut is safe.
_RUN = re.compile(r" (?:\s|\Z)")
# Bytes that white space may begin with. A blank before one of them may belong to a run.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACES = re.compile(r"\s")
# Latin letters and one mark: two pre-tokens whatever the version of Unicode.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?]?)")
_MARKS = (",", ".", ";", ":", "!", "?")
# A blank in the byte alphabet of the vocabulary.
_BLANK = chr(256 + 32)


class Encoder:
    """Ids of texts as arrays of the machine's order, two bytes per id where the vocabulary allows."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.special = [t["content"] for t in described["added_tokens"]]
        before = described["pre_tokenizer"] or {}
        self.cuts = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex") is True
            and not before.get("add_prefix_space")
            and described["normalizer"] is None
            and not any(re.search(r"\s", s) for s in self.special)
            and not any(t["lstrip"] or t["rstrip"] for t in described["added_tokens"])
        )
        self.words: dict[str, bytes] = {}
        self.pieces = _Pieces(self)
        self.tokenize = self.tokenizer.model.tokenize
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.cuts else None

    def plain(self, text: str) -> bytes:
        """The library's own answer for a whole text."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def fresh(self, mapped: str) -> bytes:
        """Ids of one pre-token, given in the byte alphabet of the vocabulary."""
        return array(self.code, [t.id for t in self.tokenize(mapped)]).tobytes()

    def word(self, mapped: str) -> bytes:
        """The same, kept for the next time."""
        found = self.words.get(mapped)
        if found is None:
            if len(self.words) >= _MOST_WORDS:
                self.words.clear()
            found = self.words[mapped] = self.fresh(mapped)
        return found

    def forget(self) -> None:
        """Empties the caches, so that a process that does other work next has their room."""
        self.pieces.clear()
        self.words.clear()

    def bare(self, text: str) -> bytes:
        """Ids of a piece without a blank before it."""
        plain = _PLAIN.fullmatch(text)
        if plain is None:
            return self.piece(text)
        return self.fresh(_mapped(plain[1])) + (self.word(plain[2]) if plain[2] else b"")

    def piece(self, text: str) -> bytes:
        """Ids of a piece that starts and ends at safe cuts."""
        if any(s in text for s in self.special):
            return self.plain(text)
        return b"".join([self.word(mapped) for mapped, _ in self.split(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        if not self.cuts:
            return self.plain(text)
        parts = text.split(" ")
        if _RUN.search(text):
            parts = _rejoined(parts)
        first = self.piece(parts[0]) if parts[0] else b""
        return first + b"".join(map(self.pieces.__getitem__, parts[1:]))

    def encode_all(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where those of each begin and the last end.

        A null text counts as empty. With ``end`` each text has that id behind its own.
        """
        texts = texts.fill_null("").cast(pa.large_string())
        runs = _with_runs(texts) if self.cuts else np.ones(len(texts), bool)
        lists = pc.split_pattern(pc.if_else(pa.array(runs), "", texts), " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        column = lists.flatten().dictionary_encode()
        parts = column.dictionary.to_pylist()
        # Pieces that follow a blank, then the beginning of each text, or all of it, and the end.
        table = [self.pieces[p] if p else b"" for p in parts]
        for row, first in enumerate(offsets[:-1]):
            if runs[row]:
                table.append(self.encode(texts[row].as_py()))
            else:
                begin = parts[column.indices[int(first)].as_py()]
                table.append(self.piece(begin) if begin else b"")
        table.append(b"" if end is None else np.array([end], self.dtype).tobytes())
        rows = np.arange(len(texts))
        codes = np.full(offsets[-1] + len(texts), len(table) - 1, np.int32)
        codes[np.arange(offsets[-1]) + np.repeat(rows, np.diff(offsets))] = column.indices.to_numpy()
        codes[offsets[:-1] + rows] = len(parts) + rows
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        many = sizes[codes]
        after = np.cumsum(many)
        total = int(after[-1]) if len(after) else 0
        places = np.repeat(starts[codes] - (after - many), many) + np.arange(total)
        return np.frombuffer(b"".join(table), self.dtype)[places], np.append(0, after[offsets[1:] + rows])


def _with_runs(texts: pa.Array) -> np.ndarray:
    """Texts in which a blank may belong to a run of white space, or is the last character."""
    _, bounds, buffer = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    blank = data == 0x20
    # What follows the last byte of a text belongs to the next one.
    last = offsets[1:][np.diff(offsets) > 0] - 1
    doubtful = blank.copy()
    doubtful[:-1] &= _MAYBE_SPACE[data[1:]]
    doubtful[last] = blank[last]
    at = np.searchsorted(np.flatnonzero(doubtful), offsets)
    return at[1:] > at[:-1]


class _Pieces(dict):
    """Ids by piece; each piece is understood to follow a blank.

    A line feed with other than white space on both sides is a pre-token of its own, so a
    piece that holds some is put together of its lines. Lines behind one are kept with it.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        if len(self) >= _MOST_PIECES:
            self.clear()
        if "\n" in part:
            self[part] = found = self.lines(part)
            return found
        stem = part[:-1]
        if part.isascii() and part.isalpha():
            self[part] = found = self.encoder.fresh(_BLANK + part)
            return found
        if part[-1:] in _MARKS and stem.isascii() and stem.isalpha():
            self[part] = found = self[stem] + self.encoder.word(part[-1])
            return found
        plain = _PLAIN.fullmatch(part)
        if plain is None:
            found = self.encoder.piece(" " + part)
        elif plain[2]:
            found = self[plain[1]] + self.encoder.word(plain[2])
        else:
            found = self.encoder.fresh(_mapped(" " + part))
        self[part] = found
        return found

    def lines(self, part: str) -> bytes:
        first, *rest = part.split("\n")
        if not all(rest) or _SPACES.search(first) or any(map(_SPACES.search, rest)):
            return self.encoder.piece(" " + part)
        if first:
            return self[first] + b"".join([self["\n" + line] for line in rest])
        if len(rest) > 1:
            return b"".join([self["\n" + line] for line in rest])
        return self.encoder.word(_mapped("\n")) + self.encoder.bare(rest[0])


def _rejoined(parts: list[str]) -> list[str]:
    """Pieces with runs of white space left whole: only the last blank of a run is a cut."""
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


@lru_cache(maxsize=1)
def _alphabet() -> dict[int, int]:
    """Byte values as characters: visible ones stand for themselves, others follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(hidden)}}


def _mapped(text: str) -> str:
    return text.encode().decode("latin-1").translate(_alphabet())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once per process."""
    return Encoder(path)


def ids_crc32(ids: np.ndarray) -> int:
    """The unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
