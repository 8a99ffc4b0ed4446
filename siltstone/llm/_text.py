"""Vectorised word handling over Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D (so UTF-8
letters stay whole).  All functions work on the raw UTF-8 buffer of a column
with numpy; no Python object is made per word.

A word's hash takes its bytes eight at a time through a mixer that is one-to-one,
so words of one length up to eight bytes never collide and longer ones do by
chance only (a polynomial in the bytes would let pairs be written down).  A second
hash of the bytes, with other constants, is made on demand; callers say where
results rest on one hash, on both, or on the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHUNK = 1 << 20
#: Longer words are hashed by a library, so that rounds stay few.
_LONG = 4096
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Per hash: what lengths, states and chunks are mixed with.
_LANES = (
    (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)),
    (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xA24BAED4963EE407)),
)
Q1 = np.uint64(0xD6E8FEB86659FD93)
Q2 = np.uint64(0xA0761D6478BD642F)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_hashes(part: np.ndarray, a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the bytes a[i] .. b[i] - 1 of an array, for all i."""
    size, step, times = _LANES[lane]
    padded = np.concatenate([part, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(part) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from each place on
    n = b - a
    h = mix(n.astype(np.uint64) * size)
    some, at, left = np.flatnonzero(n > 0), a, n
    some = some[n[some] <= _LONG]
    while len(some):
        chunk = eight[at[some]] & _MASK[np.minimum(left[some], 8)]
        h[some] = mix((h[some] + step) ^ (chunk * times))
        at, left = at + 8, left - 8
        some = some[left[some] > 0]
    for i in np.flatnonzero(n > _LONG).tolist():
        digest = hashlib.blake2b(part[a[i] : b[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest()
        h[i] = np.frombuffer(digest, dtype="<u8")[0]
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The rows of a batch in runs of about so many bytes of text, so that the
    arrays made from a run stay small whatever the rows of a batch."""
    off = buffers(batch[column])[1]
    row = 0
    while row < batch.num_rows:
        last = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield batch.slice(row, last - row)
        row = last


class Words:
    """Words of a column: start and end bytes, first word of each row, hashes.

    ``classes`` maps a byte to a class; a word is a run of one class other than
    0.  ``fold`` maps bytes before hashing (lower case, for instance).  With two
    ``lanes`` there is a second hash, ``hash2``.
    """

    def __init__(self, column, classes: np.ndarray | None = None, fold: np.ndarray | None = None, lanes: int = 1):
        self.raw, self.off = buffers(column)
        self.rows = len(self.off) - 1
        starts, ends, hs = [], [], [[], []]
        row = 0
        while row < self.rows:
            last = max(row + 1, int(np.searchsorted(self.off, self.off[row] + _CHUNK, "right")) - 1)
            lo, hi = self.off[row], self.off[last]
            part = self.raw[lo:hi]
            kind = classes[part] if classes is not None else (~SPACE[part]).astype(np.uint8)
            if len(part):
                edge = np.empty(len(part) + 1, dtype=bool)
                edge[0] = edge[-1] = True
                np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
                edge[self.off[row : last + 1] - lo] = True
                at = np.flatnonzero(edge)
                a, b = at[:-1], at[1:]
                real = kind[a] != 0
                a, b = a[real], b[real]
                starts.append(a + lo)
                ends.append(b + lo)
                folded = fold[part] if fold is not None else part
                for lane in range(lanes if len(a) else 0):
                    hs[lane].append(byte_hashes(folded, a, b, lane))
            row = last
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.end = cat(starts, np.int64), cat(ends, np.int64)
        self.hash = cat(hs[0], np.uint64)
        self.hash2 = cat(hs[1], np.uint64) if lanes > 1 else None
        #: row r has the words first[r] .. first[r + 1] - 1
        self.first = np.searchsorted(self.start, self.off).astype(np.int64)
        self.count = np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count)

    def _pack(self) -> None:
        """The words' bytes, each followed by one space unless its row ends there."""
        keep = ~SPACE[self.raw]
        after = self.end[self.end < len(self.raw)]
        keep[after] = True
        packed = self.raw[keep]
        self._packed = np.where(SPACE[packed], np.uint8(32), packed)
        self._from = (np.cumsum(keep) - 1)[self.start] if len(self.start) else np.zeros(0, np.int64)
        self._to = self._from + (self.end - self.start)

    def text(self, a: int, b: int) -> bytes:
        """Words a .. b - 1 of one row joined by one space."""
        if b <= a:
            return b""
        if not hasattr(self, "_packed"):
            self._pack()
        return self._packed[self._from[a] : self._to[b - 1]].tobytes()

    def texts(self, a: np.ndarray, b: np.ndarray) -> bytes:
        """text(a[i], b[i]) for all i (none empty), each followed by a line feed."""
        if not hasattr(self, "_packed"):
            self._pack()
        x, y = self._from[a], self._to[b - 1]
        size = y - x + 1
        last = np.cumsum(size)
        at = np.arange(int(last[-1]) if len(last) else 0) + np.repeat(x - (last - size), size)
        out = self._packed[np.minimum(at, len(self._packed) - 1)]
        out[last - 1] = 10
        return out.tobytes()


def grams(h: np.ndarray, k: int, q: np.uint64 = Q1) -> np.ndarray:
    """Hash of words i .. i + k - 1 for every i of one array (len - k + 1 values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= q
        g += h[j : j + n]
    return mix(g)


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n gram positions lie inside one row."""
    ok = np.ones(max(n, 0), dtype=bool)
    for j in range(1, k):
        x = first[1:-1] - j
        x = x[(x >= 0) & (x < n)]
        ok[x] = False
    return ok


def minimum_of(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbouring values."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, g.dtype)
    m = g[:n].copy()
    for j in range(1, w):
        np.minimum(m, g[j : j + n], out=m)
    return m


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values
