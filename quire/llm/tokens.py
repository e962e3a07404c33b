"""Exact token ids from the tokenizers library, with bounded memos for units of text.

A byte-level BPE never joins across the start of a white-space run, and a word BPE never across white space. So a text is
cut there, each distinct unit is cut by the tokenizer's own pre-token pattern, the library's model encodes each distinct
piece once, and the ids are joined. That cut is proved for the characters of PLAIN alone, whose classes do not depend on the
version of a Unicode table. Texts with any other character, with the content of an added token, which the library matches
before it cuts, or with white space for which the cut is not exact go to the library whole.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np

from quire.llm.common import only

#: White space other than space and newline, control separators, and the two marks that the cutting uses.
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x01\x02"
#: Characters beyond ASCII (ranges of code points) for which test_plain_characters proves the cut: Latin, Greek and Cyrillic
#: letters, punctuation and symbols, kana, Chinese characters, Hangul. No white space, no combining marks.
PLAIN = ((0xA1, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3C9), (0x400, 0x481), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20AF), (0x2190, 0x21FF), (0x3001, 0x3003), (0x3008, 0x3011), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E))
_other = re.compile("[^\x00-\x7f" + "".join(f"{chr(a)}-{chr(b)}" for a, b in PLAIN) + "]").search
_MARKS = ",.;:!?"
_BREAKS = ("  ", "\n\n", " \n", "\n ")

#: The pre-token patterns of the two tokenizer files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_open: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE files use for each byte: itself if printable Latin-1, else 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _packer(kind: np.dtype):
    """Function from a short list of ids to their bytes of type `kind`; an array of the machine's own order is faster."""
    code = "H" if kind.itemsize == 2 else "I"
    if sys.byteorder == "little" and array(code).itemsize == kind.itemsize:
        return lambda ids: array(code, ids).tobytes()
    return lambda ids: np.array(ids, kind).tobytes()


class _Units(dict):
    """Unit of text -> its ids. New units are kept until `most` are held; frequent ones come early."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, unit: str) -> bytes:
        got = self.make(unit)
        if len(self) < self.most:
            self[unit] = got
        return got


class Encoder:
    """ids(text) gives the same ids as tokenizer.encode(text, add_special_tokens=False), as bytes of type `kind`.

    most: units kept, at about 200 bytes each, in a Python worker.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # matched in the text as it is
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.pack = _packer(self.kind)
        self.words = self.tokenizer.normalizer is not None  # white space is dropped
        self.cut = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN).findall
        self.letters = _byte_letters()
        self.gap = self.letters[0x20]
        self.pieces = _Units(self._piece, most)
        self.units = _Units(self._word if self.words else self._unit, most)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _tokens(self, shown: str) -> bytes:
        return self.pack([t.id for t in self.model.tokenize(shown)])

    def _piece(self, piece: str) -> bytes:
        return self._tokens(piece.encode().decode("latin-1").translate(self.letters))

    def _spaced(self, word: str) -> bytes:
        """The ids of a word of letters after a space; ASCII letters stand for themselves."""
        return self._tokens(self.gap + word if word.isascii() else self.gap + word.encode().decode("latin-1").translate(self.letters))

    def _word(self, unit: str) -> bytes:
        low = unit.lower() if unit.isascii() else self.tokenizer.normalizer.normalize_str(unit)
        if low.isalpha():  # one piece; it is kept under one spelling only
            return self._piece(low) if low == unit else self.units[low]
        return b"".join([self.units[p] if p.isalpha() else self.pieces[p] for p in self.cut(low)])

    def _unit(self, unit: str) -> bytes:
        if unit.isalpha():
            return self._spaced(unit)
        if (word := unit[:-1]).isalpha() and unit[-1] in _MARKS:  # a word, then one piece
            return self.units[word] + self.pieces[unit[-1]]
        text = unit[1:] if unit[:1] == "\x02" else "\n" if unit == "\x01" else " " + unit
        return b"".join([self.units[p[1:]] if p[:1] == " " and p[1:].isalpha() else self.pieces[p] for p in self.cut(text)])

    def _uncut(self, text: str) -> bool:
        odd = not text.replace("\n", "").isprintable() and any(c in text for c in _ODD)  # _ODD is not printable
        return odd or any(a in text for a in self.added) or not text.isascii() and _other(text) is not None

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self._uncut(text):
            return self.whole(text)
        if self.words:
            return b"".join(map(self.units.__getitem__, text.split()))
        if any(b in text for b in _BREAKS):
            return b"".join(map(self.pieces.__getitem__, self.cut(text)))
        return b"".join(map(self.units.__getitem__, ("\x02" + text.replace("\n", " \x01 \x02")).split(" ")))


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _open:
        _open[path] = Encoder(path)
    only(_open[path].units, _open[path].pieces)
    return _open[path]
