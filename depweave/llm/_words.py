"""Words of many texts at once, as arrays over their bytes.

A word is a run of ASCII letters, digits and bytes from 128 on (so of all non-ASCII characters), compared with
A-Z and the capitals of Latin-1 in lower case.
"""

from __future__ import annotations

import numpy as np

from ._common import mix64

_CODES = np.arange(256)
WORD = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
FOLD = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
#: A random number for each byte at each of 64 places, beyond which places repeat.
TABLE = mix64(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = 2 << 20


class Words:
    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, self.offsets, n = data, offsets, len(data)
        self.folded = FOLD[data]
        if n > 1:
            capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            self.folded[1:][capital] += 32
        self.inside = WORD[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.concatenate([[False], self.inside[:-1]])[:n]
        after = np.concatenate([self.inside[1:], [False]])[-n or n + 1 :]
        self.starts = np.flatnonzero(self.inside & (~before | first[:-1]))
        self.ends = np.flatnonzero(self.inside & (~after | first[1:])) + 1
        #: Words of text i: at[i] to at[i + 1].
        self.at = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, prefix: int = 0, folded: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first bytes."""
        folded = self.folded if folded is None else folded
        out = np.empty(len(self.starts), np.uint64)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + STEP)))
            a, b, starts = self.starts[lo], self.ends[hi - 1], self.starts[lo:hi]
            place = np.arange(a, b) - np.repeat(starts, np.diff(np.append(starts, b)))
            values = TABLE[((place & 63) << 8) | folded[a:b]]
            values[~self.inside[a:b] | (place >= prefix if prefix else False)] = 0
            out[lo:hi] = np.add.reduceat(values, starts - a)
            lo = hi
        length = self.ends - self.starts
        return mix64(out + (np.minimum(length, prefix) if prefix else length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Text number and 64-bit hash of each run of `width` words; a shorter text that has words is one run."""
        h = self.hashes()
        n = len(h) - width + 1
        doc, run = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n > 0:
            run = np.zeros(n, np.uint64)
            for j in range(width):
                run = run * np.uint64(0x9FB21C651E98DF25) + h[j : j + n]
            within = self.doc[:n] == self.doc[width - 1 :]
            doc, run = self.doc[:n][within], mix64(run[within])
        short = np.flatnonzero((self.counts > 0) & (self.counts < width))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for k, i in enumerate(short):
                for x in h[self.at[i] : self.at[i + 1]]:
                    own[k : k + 1] = own[k : k + 1] * np.uint64(0x9FB21C651E98DF25) + x
            doc, run = np.concatenate([doc, short]), np.concatenate([run, mix64(own)])
        return doc, run


def counted(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) in order, and how often each occurs; of a value 48 bits count. For at most 65,536 texts."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), times
