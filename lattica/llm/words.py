"""Vectorised word and shingle hashing over UTF-8 bytes.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``.  It is hashed eight
bytes at a time: each step xors the next lane into the state and scrambles the
state by a bijection, so that words of up to eight bytes of one length never
collide and longer ones as rarely as random values do.  All words of a block
take a step together, so no Python object is made for a word; words of more
than 64 bytes are left to xxh3.  Two independent halves make 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
#: Multipliers of the two halves' scrambling, and what their states begin with.
_MIXERS = (U(0xD6E8FEB86659FD93), U(0xBF58476D1CE4E5B9))
_SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344))
#: Bytes of text hashed at once; bytes of a word that are hashed in lanes.
BLOCK_BYTES, LANES = 2_000_000, 64


def mix(x: np.ndarray, by: np.uint64 = _MIXERS[0]) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> U(32))
    x *= by
    x ^= x >> U(32)
    x *= by
    x ^= x >> U(32)
    return x


def _table(gaps: Iterable[int], fold: bool) -> bytes:
    """Bytes as they count: gaps between words are spaces, A-Z small if folded."""
    out = bytearray(range(256))
    if fold:
        out[65:91] = range(97, 123)
    for b in gaps:
        out[b] = 32
    return bytes(out)


_WHITE = (9, 10, 11, 12, 13, 32)
#: "bare" is for matching words whatever their punctuation: ASCII letters and digits and all bytes from 128 make words.
TABLES = {"plain": _table(_WHITE, False), "folded": _table(_WHITE, True), "bare": _table((b for b in range(128) if not chr(b).isalnum()), True)}


class Words:
    """All words of some texts: hashes in order, how many each text has, and where each starts and ends in the joined bytes."""

    def __init__(self, texts: list[bytes], kind: str = "plain"):
        joined = b" ".join(texts) + b" " * 9
        self.clean = joined.translate(TABLES[kind])
        data = np.frombuffer(self.clean, np.uint8)
        gap = data == 32
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edges = np.concatenate([np.zeros(1, edges.dtype), edges])
        self.starts, self.ends = edges[::2], edges[1::2]
        if kind == "bare":
            self._cut_signs(data)
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.counts = np.diff(np.searchsorted(self.starts, bounds), prepend=0)

    def _cut_signs(self, data: np.ndarray) -> None:
        """Characters from U+3000 to U+DFFF are written without spaces: each is a word."""
        signs = np.flatnonzero((data >= 0xE3) & (data <= 0xED))
        if not len(signs):
            return
        behind = signs + 3
        starts = distinct(np.concatenate([self.starts, signs, behind[data[behind] != 32]]))
        ends = self.ends[np.searchsorted(self.starts, starts, "right") - 1]
        self.starts, self.ends = starts, np.minimum(ends, np.append(starts[1:], len(data)))

    def half(self, which: int) -> np.ndarray:
        """One half of the words' 128-bit hashes."""
        by, seed = _MIXERS[which], _SEEDS[which]
        lanes = np.ndarray((len(self.clean) - 7,), "<u8", self.clean, strides=(1,))
        length = self.ends - self.starts
        out = mix(length.astype(U) * _ODD + seed, by)
        left = np.flatnonzero(length <= LANES) if len(length) and length.max() > LANES else None
        at, size = (self.starts, length) if left is None else (self.starts[left], length[left])
        while len(at):
            short = np.minimum(size, 8)
            lane = lanes[at] << (U(64) - U(8) * short.astype(U))
            if left is None:
                out = mix(out ^ lane, by)
            else:
                out[left] = mix(out[left] ^ lane, by)
            on = np.flatnonzero(size > 8)
            left = on if left is None else left[on]
            at, size = at[on] + 8, size[on] - 8
        for i in np.flatnonzero(length > LANES).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.clean[self.starts[i] : self.ends[i]], int(seed))
        return out


def hash_words(texts: list[bytes], kind: str = "plain") -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, words per text)."""
    words = Words(texts, kind)
    return words.half(0), words.counts


def blocks(rows: Iterable[tuple], size: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Rows whose last item is bytes, in lists of about ``size`` bytes (one longer text makes a list of its own)."""
    held, n = [], 0
    for row in rows:
        if held and n + len(row[-1]) > size:
            yield held
            held, n = [], 0
        held.append(row)
        n += len(row[-1])
    if held:
        yield held


def shingle(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive words (none if there are fewer), by doubling and scrambling: time grows with log k."""
    out, have = hashes, 1
    if len(hashes) < k:
        return np.empty(0, U)
    while have < k:
        step = min(have, k - have)
        out = mix(out[: len(out) - step] * _ODD + out[step:], _MIXERS[which])
        have += step
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingle hashes of one text; the whole sequence as one if it has fewer words."""
    if len(hashes) == 0:
        return np.empty(0, U)
    return distinct(shingle(hashes, min(k, len(hashes))))
