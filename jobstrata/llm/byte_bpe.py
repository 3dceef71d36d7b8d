"""Byte-level BPE: pre-tokens by a scan over transition functions, cached pair merging, decoding by offsets."""

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from jobstrata.llm import arrays

# Classes of code points; the last five depend on the code points after them.
LETTER, NUMBER, OTHER, BLANK, WHITE, IN_WHITE, SHORT, LONG = range(8)
# States: inside letters, numbers, others, after an attached blank, inside white space, behind a closed
# token, one or two letters before the end of a contraction.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACE, CLOSED, ONE_LEFT, TWO_LEFT = range(8)

#: Code points with the White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state, kind):
    """Next state, and whether a token begins before the code point."""
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    if state in (ONE_LEFT, TWO_LEFT) and kind == LETTER:  # only letters come here; the rest keeps functions few
        return (CLOSED if state == ONE_LEFT else ONE_LEFT), False
    if kind in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, False
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    if kind in run:
        return run[kind], state not in (run[kind], AFTER_BLANK)
    if kind == IN_WHITE:
        return IN_SPACE, state != IN_SPACE
    return (AFTER_BLANK if kind == BLANK else CLOSED), True


@lru_cache(maxsize=1)
def _machine():
    """The transition functions that runs of code points can have, numbered; and how they compose."""
    one = [tuple(_step(s, k)[0] for s in range(8)) for k in range(8)]
    reset = [tuple([f[CLOSED]] * 8) for f in one]
    number = {f: i for i, f in enumerate(dict.fromkeys([*one, *reset]))}
    found = list(number)
    for f in found:  # grows while it is read: closure under composition
        for g in (*one, *reset):
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(found)
                found.append(h)
    compose = np.array([[number[tuple(g[s] for s in f)] for g in found] for f in found], np.uint8)
    begins = np.array([[_step(s, k)[1] for k in range(8)] for s in range(8)])
    return (np.array([number[f] for f in one], np.uint8), np.array([number[f] for f in reset], np.uint8),
            compose, np.array(found, np.uint8), begins)


@lru_cache(maxsize=1)
def _classes():
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            kinds[code] = LETTER
        elif major == "N":
            kinds[code] = NUMBER
    kinds[WHITE_SPACE] = WHITE
    kinds[0x20] = BLANK
    return kinds


def _scan(functions, compose, width=64):
    """The composition of all functions up to each position, by blocks; compositions are associative."""
    size = len(functions)
    if size <= width:
        out = functions.copy()
        for i in range(1, size):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-size // width)
    block = np.zeros(rows * width, functions.dtype)
    block[:size] = functions
    block = block.reshape(rows, width).T.copy()
    for j in range(1, width):
        block[j] = compose[block[j - 1], block[j]]
    before = _scan(block[-1], compose, width)[:-1]
    block[:, 1:] = compose[before[None, :], block[:, 1:]]
    return block.T.reshape(-1)[:size]


def boundaries(codes, firsts):
    """Whether a pre-token begins at each code point; `firsts` are the places where texts begin."""
    if not len(codes):
        return np.zeros(0, bool)
    one, reset, compose, found, begins = _machine()
    kinds = _classes()[codes]
    first = np.zeros(len(codes) + 1, bool)
    first[firsts] = True
    last = first[1:] | (np.arange(len(codes)) == len(codes) - 1)
    white = (kinds == BLANK) | (kinds == WHITE)
    follows = np.zeros(len(codes), bool)
    follows[:-1] = ~white[1:]
    kinds = np.where(white & ~(follows & ~last), IN_WHITE, kinds).astype(np.uint8)
    marks = np.flatnonzero((codes == ord("'")) & ~last)
    after = codes[marks + 1]
    kinds[marks[np.isin(after, [ord(c) for c in "stmd"])]] = SHORT
    second = np.where(marks + 2 < len(codes), codes[np.minimum(marks + 2, len(codes) - 1)], 0) * ~last[marks + 1]
    pair = ((after == ord("r")) | (after == ord("v"))) & (second == ord("e")) | (after == ord("l")) & (second == ord("l"))
    kinds[marks[pair]] = LONG
    functions = np.where(first[:-1], reset[kinds], one[kinds])
    state = found[_scan(functions, compose), CLOSED]
    out = np.ones(len(codes), bool)
    out[1:] = begins[state[:-1], kinds[1:]]
    return out | first[:-1]


@lru_cache(maxsize=2)
def _vocabulary(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    size = max(ranks.values()) + 1
    lengths = np.zeros(size, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    starts = np.zeros(size, np.int64)
    starts[1:] = np.cumsum(lengths)[:-1]
    flat = bytearray(int(lengths.sum()))
    for token, rank in ranks.items():
        flat[starts[rank]:starts[rank] + len(token)] = token
    return ranks, np.frombuffer(bytes(flat), np.uint8), starts, lengths


def merge(piece, ranks):
    """Ids of one pre-token: the pair of lowest rank is merged, leftmost first, until none is left."""
    if piece in ranks:
        return (ranks[piece],)
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    get, none = ranks.get, len(ranks) + 1
    pairs = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        joined = parts[i] + parts[i + 1]
        parts[i:i + 2] = [joined]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + joined, none)
        if i < len(pairs):
            pairs[i] = get(joined + parts[i + 1], none)
    return tuple([ranks[p] for p in parts])


def _merge_long(piece, ranks):
    """The same by a heap over a linked list, for pieces whose pairs are too many to search."""
    end = len(piece)
    stop = list(range(1, end + 1))
    before = list(range(-1, end - 1))
    alive = [True] * end
    heap = [(ranks[piece[i:i + 2]], i, i + 2) for i in range(end - 1) if piece[i:i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        if not alive[i] or stop[i] == end or stop[stop[i]] != j:
            continue
        middle = stop[i]
        alive[middle] = False
        stop[i] = j
        if j < end:
            before[j] = i
            rank = ranks.get(piece[i:stop[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stop[j]))
        h = before[i]
        if h >= 0:
            rank = ranks.get(piece[h:j])
            if rank is not None:
                heapq.heappush(heap, (rank, h, j))
    return tuple(ranks[piece[i:stop[i]]] for i in range(end) if alive[i])


@lru_cache(maxsize=2)
def _merged(path):
    ranks = _vocabulary(path)[0]

    def learn(spans):
        merged = [merge(span, ranks) for span in spans]
        counts = np.fromiter(map(len, merged), np.int64, len(merged))
        return np.fromiter(chain.from_iterable(merged), np.int32, int(counts.sum())), counts

    return arrays.Known(learn)


def _lists(values, offsets, kind):
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def encode_batch(column, path):
    """Ids and end offsets (bytes) of all texts of an Arrow column, as lists."""
    data, offsets = arrays.utf8(column)
    lengths = _vocabulary(path)[3]
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    places = np.flatnonzero((data & 0xC0) != 0x80)
    firsts = np.searchsorted(places, offsets)
    starts = places[np.flatnonzero(boundaries(codes, firsts))]
    ends = np.append(starts[1:], len(data))
    ids, _ = _merged(path).ids(data, starts, ends)
    done = np.concatenate([[0], np.cumsum(lengths[ids])])
    rows = np.searchsorted(done, offsets)
    return _lists(ids, rows, pa.int32()), _lists(done[1:] - np.repeat(offsets[:-1], np.diff(rows)), rows, pa.int32())


def decode_batch(ids, ends, path):
    """The bytes of lists of ids, gathered at once: every id's bytes go to the place that its end tells."""
    _, flat, starts, lengths = _vocabulary(path)
    rows = np.asarray(ids.offsets) - ids.offsets[0].as_py()
    tokens = ids.flatten().to_numpy(zero_copy_only=False)
    stops = ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.where(rows[1:] > rows[:-1], stops[rows[1:] - 1] if len(stops) else 0, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    places = stops + np.repeat(offsets[:-1], np.diff(rows)) - lengths[tokens]
    out = flat[np.repeat(starts[tokens] - places, lengths[tokens]) + np.arange(offsets[-1])] if len(tokens) else flat[:0]
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [
        None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def encode(docs, path):
    """Ids of every whole text: doc_id, ids array<int>, ends array<int> (end of each id in the UTF-8 text).

    A null or empty text has no ids. Special tokens are ordinary text. Repeated rows, null ids and empty
    tables pass as they are; other columns are ignored. Memory holds about a megabyte of text, or one
    longer text, and a cache of bounded size.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def run(batches):
        for batch in arrays.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *encode_batch(batch.column("text"), path)], schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, ids array<int>, ends array<int>"))


def decode(encoded, path):
    """The text bytes of encoded rows: doc_id, ids, decoded. Rows pass one by one, null lists as empty ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            for part in arrays.slices(batch, sizes, arrays.PIECE // 4):
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("ids"), decode_batch(part.column("ids"), part.column("ends"), path)], schema=schema)

    empty = F.array().cast("array<int>")
    return (encoded.select("doc_id", F.coalesce("ids", empty).alias("ids"), F.coalesce("ends", empty).alias("ends"))
            .mapInArrow(run, "doc_id long, ids array<int>, decoded binary"))


def digests(decoded):
    """Counts and checksums of encoded and decoded rows."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
