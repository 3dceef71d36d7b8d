"""Best-fit-decreasing packing of tokenised documents into windows."""

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from jobstrata.llm import arrays
from jobstrata.llm.shared import saved

WINDOW = 4096
END_ID = 2
#: Tokens that are packed together; packing is sequential inside such a group.
GROUP_TOKENS = 1 << 23

# Classes of bytes: white space, ASCII letters, digits, ASCII marks without the apostrophe, all others.
_KINDS = np.full(256, 4, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
_KINDS[ord("0"):ord("9") + 1] = 2
_KINDS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = 3
#: Whether no token of the vocabulary crosses from a byte of one class to the next byte.
_CUT = np.array([[a == 0 or b == 0 or a == 2 or b == 2 or {a, b} == {1, 3} for b in range(5)] for a in range(5)])

@lru_cache(maxsize=1)
def _words(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def learn(spans):
        ids, counts = [], []
        for start in range(0, len(spans), 10_000):
            part = [span.decode() for span in spans[start:start + 10_000]]
            for coded in tokenizer.encode_batch_fast(part, add_special_tokens=False):
                ids += coded.ids
                counts.append(len(coded.ids))
        return np.array(ids, np.int32), np.array(counts, np.int64)

    return arrays.Known(learn)


def encode_batch(column, path):
    """Ids of all texts of an Arrow column, each with END_ID behind it; and the offsets of the texts.

    Texts are cut where no token can cross (white space, digits, ASCII letters beside ASCII marks) and each
    different span is tokenised once; the vocabulary lower-cases, so ASCII letters are lowered first.
    """
    data, offsets = arrays.utf8(column)
    data = arrays.lower_ascii(data)
    kinds = _KINDS[data]
    begins = np.ones(len(data), bool)
    begins[1:] = _CUT[kinds[:-1], kinds[1:]]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    solid = kinds[starts] != 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    ids, counts = _words(path).ids(data, starts, ends)
    done = np.concatenate([[0], np.cumsum(counts)])
    rows = done[np.searchsorted(starts, offsets)]
    return np.insert(ids.astype(np.uint32), rows[1:], END_ID), rows + np.arange(len(rows))


def windows(docs, path, window=WINDOW):
    """The pieces of every document: full windows and what is left. One row a piece, none without END_ID."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64())])

    def run(batches):
        for batch in arrays.pieces(batches, "text"):
            ids, rows = encode_batch(batch.column("text"), path)
            counts = np.diff(rows)
            pieces = -(-counts // window)
            owner = np.repeat(np.arange(len(counts)), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, counts[owner] - start)
            raw, first = memoryview(ids.astype("<u4").tobytes()), (rows[owner] + start) * 4
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + length * 4).tolist())]
            yield arrays.record_batch(schema, batch.column("doc_id").take(pa.array(owner)), start, length, crcs, counts[owner])
            arrays.release()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))


def best_fit(lengths, window=WINDOW):
    """Window number and offset of each length, longest first into the tightest window that still takes it.

    A segment tree over remaining capacities tells which capacities have an open window; the leftmost such
    capacity from the wanted length on is the tightest.
    """
    size = 1 << window.bit_length()
    tree, open_windows = bytearray(2 * size), [[] for _ in range(window + 1)]
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        at = size + length
        if not tree[at]:  # climb until a right neighbour has something, then go down to its leftmost leaf
            while at > 1 and not (at % 2 == 0 and tree[at + 1]):
                at //= 2
            if at > 1:
                at += 1
                while at < size:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
        if at > 1:
            room = at - size
            window_number = open_windows[room].pop()
            if not open_windows[room]:
                _mark(tree, at, 0)
        else:
            room, window_number = window, used
            used += 1
        number[i], offset[i] = window_number, window - room
        left = room - length
        if left:
            open_windows[left].append(window_number)
            _mark(tree, size + left, 1)
    return number, offset


def _mark(tree, at, value):
    tree[at] = value
    while at > 1:
        at //= 2
        value = tree[2 * at] | tree[2 * at + 1]
        if tree[at] == value:
            break
        tree[at] = value


def pack(docs, path, window=WINDOW, group_tokens=GROUP_TOKENS):
    """Every piece of every document with its sequence and its place there.

    A null or empty text is END_ID alone. Documents longer than a window are first cut into full windows;
    the rest goes into the tightest open window, longest first. Repeated rows are packed as they come,
    null ids like others; an empty table gives no rows; other columns are ignored. The result holds no ids, so
    only lengths move: they are dealt by a hash of their place into groups of about `group_tokens` tokens,
    each packed on its own. Copies do not meet in one group, and a group costs a few windows of padding.
    """
    pieces = saved(windows(docs, path, window).withColumn("place", F.xxhash64(F.monotonically_increasing_id())))
    groups = max(1, -(-(pieces.agg(F.sum("length")).head()[0] or 0) // group_tokens))

    def run(key, table):
        order = pc.sort_indices(table, sort_keys=[("length", "descending"), ("place", "ascending")])
        table = table.take(order)
        number, offset = best_fit(table.column("length").to_numpy(), window)
        sequence = (key[0].as_py() << 32) + number
        arrays.release()
        return (table.drop_columns(["group", "place"]).append_column("sequence_id", pa.array(sequence, pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    return pieces.withColumn("group", F.pmod("place", F.lit(groups))).groupBy("group").applyInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
