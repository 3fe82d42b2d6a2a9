"""Exact, memoised use of the tokenizers library.

A BPE model never merges across the pieces its pre-tokenizer makes, so a text's
ids are the ids of its pieces one after another.  Texts are cut at spaces
first; what stands between two is cut into pieces with a regular expression
where that is sure to agree with the library's (ASCII and Latin letters), by the
library itself elsewhere.  Each piece is encoded by the library's model and kept
in a memo of bounded size, which forgets what hasn't been used for longest.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

#: Letters and other numerals up to U+017F.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: A character outside of those whose classes are settled.
_UNSURE = re.compile("[^\t-\r\x20-\x7e\xa1-ſ]")
_BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
#: One word of letters, perhaps with a mark behind it: two pieces at most.
_WORD = re.compile(f"([{_L}]+)([.,;:!?]?)")
#: A space before something else than white space: such a space belongs to what follows, and all before it stands for itself.
_CUT = re.compile(r" (?=\S)")
#: Entries of each of a memo's two generations: of what stands between spaces, and of pieces.
MEMO, MEMO_PIECES = 500_000, 250_000
_LOADED: dict = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a visible character: itself if it is one, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def load(path: str):
    """The library's tokenizer, without truncation and padding; once for each process."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


def as_letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_LETTERS)


class Memo(dict):
    """Results of ``make`` by key: when ``most`` are held they become the old generation, from which used ones come back."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class _Loose(Exception):
    """A run of white space that isn't one space."""


class ByteBpe:
    """encode(text) = the ids that the library gives, as little-endian bytes of 2 (or 4) each."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize, self.space = self.tokenizer.model.tokenize, as_letters(" ")
        self.pieces, self.spaced = Memo(self._piece, MEMO_PIECES), Memo(self._behind_space, MEMO)

    def _packed(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the pre-tokenizer made."""
        return self._packed(as_letters(piece))

    def _behind_space(self, rest: str) -> bytes:
        """Ids of a space and what follows it up to the next cut."""
        if not rest or rest[0].isspace():
            raise _Loose
        word = _WORD.fullmatch(rest)
        if word is None:
            return self._run(" " + rest)
        letters, mark = word.groups()
        if mark:
            return self.spaced[letters] + self.pieces[mark]
        return self._packed(self.space + (rest if rest.isascii() else as_letters(rest)))

    def _run(self, text: str) -> bytes:
        if _UNSURE.search(text):
            letters = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            return b"".join([self._packed(p) for p, _ in letters])
        return b"".join([self.pieces[p] for p in _BYTE_PIECES.findall(text)])

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        if (cls, path) not in _LOADED:
            _LOADED[cls, path] = cls(path)
        return _LOADED[cls, path]

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        try:
            return b"".join([self._run(first), *map(self.spaced.__getitem__, rest)])
        except _Loose:
            first, *rest = _CUT.split(text)
            return b"".join([self._run(first), *map(self.spaced.__getitem__, rest)])


class WordBpe:
    """Splits a text into the words of a lower-casing word-level BPE, and encodes words."""

    def __init__(self, path: str):
        from tokenizers import Regex, pre_tokenizers

        self.tokenizer = load(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.splitter = pre_tokenizers.Split(Regex(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)

    @classmethod
    def of(cls, path: str) -> WordBpe:
        if (cls, path) not in _LOADED:
            _LOADED[cls, path] = cls(path)
        return _LOADED[cls, path]

    def words(self, text: str) -> list[str]:
        """Words of the normalised text; a special token's string stands for itself."""
        if self.cut and any(s in text for s in self.special):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            if not re.search("[\x1c-\x1f]", text):
                return _WORDS.findall(text.lower())
        elif not _UNSURE.search(text) and "İ" not in text and unicodedata.is_normalized("NFC", text):
            return _WORDS.findall(text.lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tokenizer.model.tokenize(as_letters(word))]
