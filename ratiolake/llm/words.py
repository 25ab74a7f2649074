"""Words of many texts at once, as numbers: hashes of words and of runs of words by prefix sums."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
from xxhash import xxh3_64_intdigest

from .sketch import mix

_BASE, _STEP = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D | 1
#: Bytes of text that are hashed together; a longer text is taken in parts of about so many.
BLOCK_BYTES = 1 << 19
#: Bytes of a word beyond which it is hashed by itself: sums of powers modulo 2**64 can't tell some long words of two letters apart, whatever the base.
LONG_WORD = 16
#: Numbers that one prefix sum covers.
_SUM = 1 << 19
_WORD = re.compile(rb"[^ \t-\r]+")


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64: those below _SUM, and of _SUM itself."""

    def __init__(self, base: int):
        inverse = pow(base, -1, 1 << 64)
        self.up, self.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(_SUM - 1, b, np.uint64), dtype=np.uint64))) for b in (base, inverse))
        self.step_up, self.step_down = (np.uint64(pow(b, _SUM, 1 << 64)) for b in (base, inverse))


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)


def _spans(values: np.ndarray, powers: _Powers, start: np.ndarray, end: np.ndarray, plus: int = 0) -> np.ndarray:
    """sum of (values[start + i] + plus) * base**i over each span, modulo 2**64; starts and ends are in order."""
    out, low = np.zeros(len(start), np.uint64), np.ones(len(start), np.uint64)
    sums = np.empty(_SUM + 1, np.uint64)
    carry, up, down = np.uint64(0), np.uint64(1), np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(values) + 1, _SUM):
            part = values[at : at + _SUM]
            sums[0] = carry
            np.cumsum((part.astype(np.uint64) + np.uint64(plus)) * powers.up[: len(part)] * up, out=sums[1 : len(part) + 1])
            sums[1 : len(part) + 1] += carry
            i, j = np.searchsorted(end, at, "right" if at else "left"), np.searchsorted(end, at + _SUM, "right")
            out[i:j] += sums[end[i:j] - at]
            i, j = np.searchsorted(start, at), np.searchsorted(start, at + _SUM)
            out[i:j] -= sums[start[i:j] - at]
            low[i:j] = powers.down[start[i:j] - at] * down
            carry, up, down = sums[len(part)], up * powers.step_up, down * powers.step_down
        return out * low


class Words:
    """The words of some texts, in order. A word is what lies between U+0020 and U+0009 to U+000D."""

    def __init__(self, texts: list[bytes]):
        parts = [x.split() for x in texts]  # of bytes: exactly that white space
        #: All words, one space after each.
        self.text = b" ".join(b" ".join(x) for x in parts if x) + b" "
        n = np.array([len(x) for x in parts], np.int64)
        #: Index of each text's first word, and the number of all.
        self.first = np.concatenate(([0], np.cumsum(n)))
        self.doc = np.repeat(np.arange(len(texts)), n)
        a = np.frombuffer(self.text, np.uint8)
        self.end = np.flatnonzero(a == 32)[: self.first[-1]]
        self.start = np.concatenate(([0], self.end[:-1] + 1)) if len(self.end) else self.end
        self.hash = mix(_spans(a, _BYTES, self.start, self.end, 1))
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            self.hash[i] = xxh3_64_intdigest(self.text[self.start[i] : self.end[i]])

    def runs(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words; those at a text's last words reach into the next text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        start = np.arange(n)
        return mix(_spans(self.hash, _WORDS, start, start + k))

    def inside(self, k: int) -> np.ndarray:
        """Which runs of k words lie in one text."""
        n = len(self.hash) - k + 1
        return self.doc[:n] == self.doc[k - 1 :] if n > 0 else np.zeros(0, bool)

    def words_of(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text i (those of them that keep has), joined by one space."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        if a == b:
            return b""
        if keep is None:
            return self.text[self.start[a] : self.end[b - 1]]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False]))))
        return b" ".join(self.text[self.start[a + x] : self.end[a + y - 1]] for x, y in zip(edge[::2], edge[1::2], strict=True))


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, Words | bytes]]:
    """The texts some at a time, with the index of the first; a text of over `most` bytes comes by itself, as it is, to be taken in parts."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield at, Words(texts[at:i])
            at, size = i, 0
        if len(x) > most:
            yield i, x
            at = i + 1
        else:
            size += len(x) + 1
    if at < len(texts):
        yield at, Words(texts[at:])


def parts(text: bytes, after: int, size: int = BLOCK_BYTES) -> Iterator[tuple[Words, int, bool]]:
    """A long text cut at white space: the words of each part of about `size` bytes and `after` words that follow it, how many are its own, and whether it is the last.

    What a worker holds is bounded by `size` and the longest words, not by the text.
    """
    at = 0
    while at < len(text):
        cut = _WORD.search(text, min(at + size, len(text)))
        # a word that begins before the cut belongs to this part
        cut = len(text) if cut is None else cut.start() if text[cut.start() - 1] in b" \t\n\x0b\x0c\r" else cut.end()
        last = cut
        for m in islice(_WORD.finditer(text, cut), after):
            last = m.end()
        words = Words([text[at:last]])
        yield words, len(words.hash) - (len(text[cut:last].split()) if last > cut else 0), cut == len(text)
        at = cut


def sliding(x: np.ndarray, k: int, f: np.ufunc) -> np.ndarray:
    """f (np.minimum or np.maximum) over each k neighbours."""
    width, out = 1, x
    while width < k:
        step = min(width, k - width)
        out = f(out[:-step], out[step:])
        width += step
    return out
