"""Text columns of Arrow batches as NumPy arrays: words, hashes and per-row reductions."""

import ctypes
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is a piece of its own.
PIECE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def slices(batch, sizes, limit):
    """Slices of a batch whose rows add up to `limit`, or of one larger row."""
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(batch):
        yield batch.slice(start)


def pieces(batches, *columns, limit=PIECE):
    """Slices of the record batches holding about `limit` bytes of the text columns."""
    for batch in batches:
        lengths = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns]
        yield from slices(batch, np.sum(lengths, axis=0, dtype=np.int64), limit)


def release():
    """Gives freed memory back to the system: executors keep their workers, and these what their allocators hold."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only the usual C library has it
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column):
    """The bytes of all texts in one array and the offsets between them; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data, offsets):
    """First and last byte (exclusive) of every word, and the word number at each text offset.

    Words are runs of bytes outside ASCII white space and never reach across two texts.
    """
    solid = ~_SPACE[data]
    size = len(data)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < size)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data):
    return _LOWER[data]


def mix(x):
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size, inverse):
    out = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(size, inverse=False):
    """Powers of the hash base, or of its inverse, modulo 2^64."""
    room = 1 << max(16, int(size).bit_length())
    return _powers(room, inverse)[:size]


def running(values):
    """Prefix sums from which `span_hash` takes the hash of any span in constant time."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), True), out=out[1:])
    return out


def span_hash(prefix, starts, ends):
    """64-bit hashes of the spans; equal spans are equal wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data, starts, ends):
    return span_hash(running(_BYTES[data]), starts, ends)


def counts_of(firsts):
    return np.diff(firsts)


def owners(firsts):
    """The row number of every element, given the element number at each row offset."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def signed(x):
    return x.view(np.int64)


def record_batch(schema, *columns):
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


class Known:
    """Ids of text spans seen before, by 64-bit span hash, in flat arrays; a full store starts anew."""

    def __init__(self, learn, limit=1_000_000):
        self.learn, self.limit = learn, limit
        self._clear()

    def _clear(self):
        self.hashes, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.size = np.zeros(1 << 16, np.int32), 0

    def _add(self, hashes, spans):
        """Learns the spans, whose hashes are sorted; `learn` gives all ids in a row and their count by span."""
        ids, counts = self.learn(spans)
        starts = self.size + np.cumsum(counts) - counts
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        self.flat[self.size:self.size + len(ids)] = ids
        self.size += len(ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts, self.counts = (
            np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.starts, starts), (self.counts, counts)))

    def ids(self, data, starts, ends):
        """The ids of all spans in a row, and the count by span."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        unique, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)

        def missing():
            at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
            return np.flatnonzero(self.hashes[at] != unique) if len(self.hashes) else np.arange(len(unique))

        new = missing()
        if len(new) and len(self.hashes) + len(new) > self.limit:
            self._clear()
            new = missing()
        if len(new):
            raw = data.tobytes()
            self._add(unique[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        at = np.searchsorted(self.hashes, unique)[inverse]
        counts = self.counts[at].astype(np.int64)
        before = np.cumsum(counts) - counts
        return self.flat[np.repeat(self.starts[at] - before, counts) + np.arange(counts.sum())], counts
