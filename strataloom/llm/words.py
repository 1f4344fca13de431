"""Words and shingles of many texts at once, as arrays.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which are single bytes in UTF-8, so words of characters and words
of bytes are the same. Words and shingles are held as 64-bit hashes without algebraic structure: two different shingles
of two documents share one with a chance of 2**-64, so sets of ten thousand shingles are compared wrongly with a chance
below 10**-11; of 10**9 different words of a corpus two share one with a chance of 3 %. Where hashes of all runs of a
corpus meet, more bits are compared (run_marks), or the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a copy."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_STEP = U64(0xD6E8FEB86659FD93)
_SEED = U64(0x9E3779B97F4A7C15)
#: The lowest k bytes of a block.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)
#: Longer spans are hashed one by one.
LONG = 512


def char_places(data: np.ndarray) -> np.ndarray:
    """The number of code points before each byte of UTF-8, and of all."""
    out = np.zeros(len(data) + 1, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


class Words:
    """The words of a run of texts.

    data: their bytes; text_at: where each text begins, and the end; starts, ends: of each word in data;
    word_at: the first word of each text, and the number of words; hashes: of each word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, hashed: bool = True):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
        values = texts.buffers()[2]
        raw = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
        self.text_at = offsets - offsets[0]
        self.data = _LOWER[raw] if lower else raw
        self._blocks = None
        inside = ~_SPACE[raw]
        n = len(raw)
        first = np.zeros(n + 1, dtype=bool)
        first[self.text_at] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | first[:n]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.word_at = np.searchsorted(self.starts, self.text_at)
        if hashed:
            self.hashes = self.hash_spans(self.starts, self.ends)

    def blocks(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, as one number; zeros follow the data."""
        if self._blocks is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._blocks = np.ndarray((len(self.data) + 1,), "<u8", buffer=padded, strides=(1,))
        return self._blocks[at]

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span: blocks of eight, each mixed into the last; of long spans BLAKE2.

        Nothing is linear over the bytes, so no pair of words collides by its structure.
        """
        n = ends - starts
        with np.errstate(over="ignore"):
            out = mix((n.astype(U64) + U64(1)) * _SEED)
            todo, at = np.flatnonzero(n > 0), 0
            while len(todo) and at < LONG:
                left = n[todo] - at
                out[todo] = mix((out[todo] ^ (self.blocks(starts[todo] + at) & _LOW[np.minimum(left, 8)])) * _STEP + _SEED)
                todo, at = todo[left > 8], at + 8
        if len(todo):
            raw = memoryview(np.ascontiguousarray(self.data))
            out[todo] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[todo].tolist(), ends[todo].tolist(), strict=True)]
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of `size` words that lie in one text, and the first word of each.

        Runs of a power of two words are made of two halves, any other of such runs.
        """
        total = len(self.starts)
        if total < size:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            acc, done, half, width = None, 0, self.hashes, 1
            while done < size:
                if size & width:
                    acc = half if acc is None else mix(acc[: len(half) - done] * _STEP + half[done : done + len(acc)])
                    done += width
                if done < size:
                    half, width = mix(half[:-width] * _STEP + half[width:]), 2 * width
        left = np.repeat(self.word_at[1:], self.counts()) - np.arange(total)  # words of the text from here on
        at = np.flatnonzero(left[: total - size + 1] >= size)
        return acc[at], at

    def run_marks(self, at: np.ndarray, size: int) -> np.ndarray:
        """32 more bits for the runs of `size` words that begin at these words, independent of windows()."""
        acc = np.full(len(at), U64(size), dtype=U64)
        with np.errstate(over="ignore"):
            for k in range(size):
                acc = mix((acc ^ self.hashes[at + k]) * U64(0x9FB21C651E98DF25))
        return (acc >> U64(32)).astype(np.uint32)

    def shingles(self, size: int) -> list[np.ndarray]:
        """Each text's set of `size`-word shingles, sorted; of fewer words the whole sequence is the one shingle."""
        hashes, at = self.windows(size)
        owner = np.searchsorted(self.word_at, at, side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(self.word_at)))
        out = []
        for k, n in enumerate(self.counts()):
            if n >= size:
                out.append(np.unique(hashes[cuts[k] : cuts[k + 1]]))
            elif n:
                acc = U64(n)
                with np.errstate(over="ignore"):
                    for h in self.hashes[self.word_at[k] : self.word_at[k + 1]]:
                        acc = mix(np.array([acc * _STEP + h], dtype=U64))[0]
                out.append(np.array([acc], dtype=U64))
            else:
                out.append(np.zeros(0, U64))
        return out
