"""Words, windows and their hashes over whole Arrow batches, without a Python object for each word.

A word is a longest run of bytes other than space and \\x09-\\x0D. Texts are UTF-8, where these bytes are only ever
themselves, so splitting bytes and splitting characters agree. A null text has no words.

Words are hashed by their bytes, eight at a time; words over ``LONG_WORD`` bytes and whole lines by BLAKE2b. Ranges (of
word hashes or of bytes) are polynomials over the field of 2**61 - 1: prefix sums give the hash of any range of a batch in
constant time. A field has no texts that agree for every base, which rings modulo 2**64 have. ``Hasher(0)`` and
``Hasher(1)`` are independent; where equality decides about a text without looking at it, both are used together.
``Rolling`` is the cheaper ring; it only proposes places that are compared by other means.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # text that is handled at once; one longer document is handled alone
LONG_WORD = 64
_U64 = np.uint64
_PRIME = (1 << 61) - 1
_P, _LOW29, _LOW32 = _U64(_PRIME), _U64((1 << 29) - 1), _U64((1 << 32) - 1)
_29, _32, _61, _3 = _U64(29), _U64(32), _U64(61), _U64(3)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: bytes as ``Texts(plain=True)`` reads them after putting the text in lower case: ASCII punctuation as spaces
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(32)
    x *= _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(32)
    x *= _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(32)
    return x


def _reduce(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of values below the prime, modulo it: 2**64 is 8 there, and 2**61 is 1."""
    a_high, a_low, b_high, b_low = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    middle, low = a_high * b_low + a_low * b_high, a_low * b_low
    return _reduce((low & _P) + (low >> _61) + (a_high * b_high << _3) + ((middle & _LOW29) << _32) + (middle >> _29))


def _running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values below 2**63, modulo the prime; one more than values."""
    out = np.zeros(len(values) + 1, _U64)
    low, high = np.cumsum(values & _LOW32, dtype=_U64), np.cumsum(values >> _32, dtype=_U64)
    out[1:] = _reduce(_reduce(low) + ((high & _LOW29) << _32) + (high >> _29))
    return out


class Hasher:
    """Hashes of words and ranges; instances with the same seed agree everywhere."""

    _tables: dict[tuple[int, bool], np.ndarray] = {}

    def __init__(self, seed: int = 0):
        self.seed = seed
        self.base = int(mix(np.array([seed * 2 + 11], _U64))[0]) % (_PRIME - 2) + 2
        self.start = mix(np.arange(LONG_WORD + 1, dtype=_U64) + _U64(10_000 * (seed + 1)))
        self.bytes = mix(np.arange(256, dtype=_U64) + _U64(1000 * (seed + 1))) & _LOW29

    def _powers(self, n: int, inverse: bool) -> np.ndarray:
        table = Hasher._tables.get((self.seed, inverse))
        if table is None or len(table) < n:
            step = pow(self.base, -1, _PRIME) if inverse else self.base
            table = np.ones(1, _U64)
            while len(table) < max(n, 1 << 16):  # doubling
                table = np.concatenate([table, _product(table, _U64(pow(step, len(table), _PRIME)))])
            Hasher._tables[self.seed, inverse] = table
        return table[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of 64-bit values, for ``ranges``."""
        return _running(_product(_reduce(values), self._powers(len(values), False)))

    def byte_prefix(self, data: np.ndarray) -> np.ndarray:
        powers = self._powers(len(data), False)
        value = self.bytes[data]
        high = value * (powers >> _32)
        return _running(value * (powers & _LOW32) + ((high & _LOW29) << _32) + (high >> _29))

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) ranges; the length takes part."""
        raw = _product(_reduce(prefix[ends] + _P - prefix[starts]), self._powers(len(prefix), True)[starts])
        return mix(raw + (ends - starts).astype(_U64) * _U64(0x9E3779B97F4A7C15))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words data[start:end]."""
        length = ends - starts
        out = self.start[np.minimum(length, LONG_WORD)]
        eight = np.ndarray(max(0, len(data)), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
        own = np.flatnonzero(length <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            own = own[length[own] > at]
            if not len(own):
                break
            unused = _U64(8) * np.maximum(0, 8 - (length[own] - at)).astype(_U64)
            out[own] = mix(out[own] ^ (eight[starts[own] + at] << unused))
        key = self.seed.to_bytes(8, "little")
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            found = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest()
            out[i] = int.from_bytes(found, "little")
        return out


class Rolling:
    """Polynomials modulo 2**64 over bytes or word hashes: only to propose places."""

    _tables: dict[bool, np.ndarray] = {}
    _base = 0x9FB21C651E98DF25
    _bytes = mix(np.arange(256, dtype=_U64) + _U64(77))

    @classmethod
    def _powers(cls, n: int, inverse: bool) -> np.ndarray:
        table = cls._tables.get(inverse)
        if table is None or len(table) < n:
            steps = np.full(max(n, 1 << 16), pow(cls._base, -1, 1 << 64) if inverse else cls._base, _U64)
            steps[0] = 1
            cls._tables[inverse] = table = np.cumprod(steps, dtype=_U64)
        return table[:n]

    @classmethod
    def windows(cls, values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of ``length`` values (or bytes) from each start."""
        values = cls._bytes[values] if values.dtype == np.uint8 else values
        prefix = np.zeros(len(values) + 1, _U64)
        np.cumsum(values * cls._powers(len(values), False), dtype=_U64, out=prefix[1:])
        return mix((prefix[starts + length] - prefix[starts]) * cls._powers(len(prefix), True)[starts])


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b digests of data[start:end], as rows of two 64-bit values."""
    raw = memoryview(np.ascontiguousarray(data))
    found = b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(found, "<u8").reshape(-1, 2)


def buffer_of(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of an array, and where each string begins in them (and the last ends); null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of ``inside`` that do not cross the bounds of documents."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = offsets[:-1] < offsets[1:]
    begins, stops = offsets[:-1][some], offsets[1:][some] - 1
    first[begins] = inside[begins]
    last[stops] = inside[stops]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Texts:
    """The texts of one Arrow array: their bytes in one buffer, and the words in it."""

    def __init__(self, array: pa.Array | pa.ChunkedArray, plain: bool = False):
        if plain:
            array = pc.utf8_lower(array)
        self.data, self.offsets = buffer_of(array)
        self.n = len(self.offsets) - 1
        if plain:
            self.data = PLAIN[self.data]
        self.in_word = ~IS_SPACE[self.data]
        self.starts, self.ends = spans_of(self.in_word, self.offsets)
        #: words of document i are [word_offsets[i], word_offsets[i + 1])
        self.word_offsets = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.word_offsets)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def byte_prefix(self, hasher: Hasher) -> np.ndarray:
        return hasher.byte_prefix(self.data)

    def word_hashes(self, hasher: Hasher) -> np.ndarray:
        return hasher.words(self.data, self.starts, self.ends)

    def windows(self, k: int) -> np.ndarray:
        """Indexes of the words that begin a window of k words in one document."""
        room = np.repeat(self.word_offsets[1:], self.n_words) - np.arange(len(self.starts))
        return np.flatnonzero(room >= k)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every line, also of empty ones; a document without text has none."""
        breaks = np.flatnonzero(self.data == 10)
        begins = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        stops = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]]
        starts = np.sort(np.concatenate([begins, breaks + 1]))
        ends = np.sort(np.concatenate([stops, breaks]))
        if len(starts) and np.any(self.data[stops - 1] == 10):
            # an end line that is empty starts where the next document starts: order by document, then place
            doc_b = np.searchsorted(self.offsets, breaks, "right") - 1
            doc_s = np.searchsorted(self.offsets, begins, "right") - 1
            docs = np.concatenate([doc_s, doc_b])
            s = np.concatenate([begins, breaks + 1])
            order = np.lexsort((s, docs))
            starts = s[order]
            e = np.concatenate([breaks, stops])
            docs_e = np.concatenate([doc_b, doc_s])
            ends = e[np.lexsort((e, docs_e))]
            return starts, ends, docs[order]
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, start + length)."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + length, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def runs_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys (the first is the main one), and where runs of equal keys begin in it."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return order, np.flatnonzero(new)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype(_U64, copy=False).view(np.int64)
