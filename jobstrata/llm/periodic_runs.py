"""Periodic runs of words: suffix trees of a text and its reversal answer extensions of Lyndon roots in constant time."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from jobstrata.llm import arrays

#: A run repeats its period EXPONENT times at least and has SHORTEST words at least.
EXPONENT, SHORTEST = 4, 6
#: Words whose repeated sequences show where a run may lie.
GRAM = 3
#: Entries of a block in range-minimum queries; a power of two.
BLOCK_BITS = 4

WHITE = r"[\x20\x09-\x0D]+"


class SuffixTree:
    """Ukkonen's tree of a sequence of symbols from 1 on, whose end is symbol 0, with its Euler tour.

    `rank` orders the suffixes; `common(i, j)` are the lengths that the suffixes at i and j share.
    """

    def __init__(self, symbols):
        text = [*symbols, 0]
        self.size = len(text)
        self._tour(*self._build(text))

    @staticmethod
    def _build(text):
        """Edges {node * base + first symbol: child}, and the start and end of the edge into each node; leaves end at -1.

        Leaves come in the order of their suffixes.
        """
        base = max(text) + 1
        starts, ends, link, edges = [0], [0], [0], {}
        find = edges.get
        node, edge, length, left = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            open_node = 0
            left += 1
            while left:
                if not length:
                    edge = i
                key = node * base + text[edge]
                child = find(key)
                if child is None:
                    edges[key] = len(starts)
                    starts.append(i)
                    ends.append(-1)
                    link.append(0)
                    if open_node:
                        link[open_node] = node
                        open_node = 0
                else:
                    start, end = starts[child], ends[child]
                    span = (i + 1 if end < 0 else end) - start
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[start + length] == symbol:
                        length += 1
                        if open_node:
                            link[open_node] = node
                        break
                    split = len(starts)
                    middle = start + length
                    starts += start, i
                    ends += middle, -1
                    link += 0, 0
                    edges[key] = split
                    edges[split * base + symbol] = split + 1
                    edges[split * base + text[middle]] = child
                    starts[child] = middle
                    if open_node:
                        link[open_node] = split
                    open_node = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        return base, edges, starts, ends

    def _tour(self, base, edges, starts, ends):
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        kids = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        firsts = np.searchsorted(keys[order] // base, np.arange(len(starts) + 1))
        turn, last = firsts[:-1].tolist(), firsts[1:].tolist()
        start, end = np.array(starts), np.array(ends)
        spans = (np.where(end < 0, self.size, end) - start).tolist()
        leaf = (np.cumsum(end < 0) - 1).tolist()
        depth, parent, tour = [0] * len(starts), [0] * len(starts), []
        place, sorted_suffixes = [0] * self.size, []
        node, note = 0, tour.append
        while True:
            note(depth[node])
            at = turn[node]
            if at < last[node]:
                turn[node] = at + 1
                child = kids[at]
                parent[child], depth[child] = node, depth[node] + spans[child]
                node = child
                continue
            if ends[node] < 0:
                place[leaf[node]] = len(tour) - 1
                sorted_suffixes.append(leaf[node])
            elif not node:
                break
            node = parent[node]
        self.place = np.array(place)
        self.rank = np.empty(self.size, np.int64)
        self.rank[sorted_suffixes] = np.arange(self.size)
        self.depths = RangeMinimum(np.array(tour, np.int32))

    def common(self, i, j):
        """Lengths of the longest common prefixes of the suffixes at i and j (arrays, i unlike j)."""
        x, y = self.place[i], self.place[j]
        return self.depths.between(np.minimum(x, y), np.maximum(x, y))


class RangeMinimum:
    """Minima of ranges in constant time: a sparse table over blocks, and running minima inside them."""

    def __init__(self, values):
        size = 1 << BLOCK_BITS
        blocks = -(-len(values) // size)
        padded = np.full(blocks * size, np.iinfo(np.int32).max, np.int32)
        padded[:len(values)] = values
        self.values = padded
        square = padded.reshape(blocks, size)
        self.front = np.minimum.accumulate(square, axis=1).reshape(-1)
        self.back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [square.min(axis=1)]
        step = 1
        while 2 * step <= blocks:
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))
            step *= 2

    def between(self, first, last):
        """Minima from first to last, both included."""
        a, b = first >> BLOCK_BITS, last >> BLOCK_BITS
        out = np.minimum(self.back[first], self.front[last])
        inner = b - a - 1
        for level in range(len(self.levels)):
            here = np.flatnonzero((inner >> level) == 1)
            if len(here):
                row, left = self.levels[level], a[here] + 1
                out[here] = np.minimum(out[here], np.minimum(row[left], row[b[here] - (1 << level)]))
        same = np.flatnonzero(a == b)
        if len(same):
            low, high = first[same], last[same]
            best = self.values[low]
            for step in range(1, 1 << BLOCK_BITS):
                best = np.minimum(best, self.values[np.minimum(low + step, high)])
            out[same] = best
        return out


def _next(rank, lower):
    """For each place the next one of lower (or higher) rank; the length where there is none."""
    out, stack = [len(rank)] * len(rank), []
    values = rank if lower else [-x for x in rank]
    for i, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs(symbols, exponent=EXPONENT, shortest=SHORTEST):
    """Rows (start, length, period) of all runs of a sequence of symbols from 1 on, by start, then period.

    The longest Lyndon word at each place, under an order of the symbols and under its reverse, ends before the next suffix
    of lower, or of higher, rank. Every run has such a word as its root, so each word is a candidate, extended to the right by the
    tree of the sequence and to the left by that of the reversal.
    """
    size = len(symbols)
    if size < shortest:
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(symbols)
    rank = tree.rank.tolist()
    places = np.arange(size)
    starts, ends = [], []
    for lower in (True, False):
        after = np.array(_next(rank, lower)[:-1])
        fits = np.flatnonzero((after <= size) & (exponent * (after - places) <= size))
        starts.append(fits)
        ends.append(after[fits])
    start, end = np.concatenate(starts), np.concatenate(ends)
    period = end - start
    length = period + tree.common(start, end)
    del tree, rank
    grown = SuffixTree(symbols[::-1]).common(size - start, size - end)
    begin, length = start - grown, length + grown
    found = (length >= exponent * period) & (length >= shortest)
    rows = np.stack([begin, period, length], axis=1)[found]
    return (np.unique(rows, axis=0) if len(rows) else rows)[:, [0, 2, 1]]


def _where_possible(hashes, firsts, exponent, shortest):
    """Windows (first, last) of places, both included, that hold all runs of all texts; no window reaches into another text.

    In a run of period q each sequence of three words, from the place q + 3 on, stood q places before: such places make a stretch of
    at least (exponent - 1) * q - 2. So a place whose sequence last stood further back than (stretch + 2) / (exponent - 1)
    is in no such part of a run. It drops out, which cuts its stretch, until nothing changes. No run is lost.
    """
    size = len(hashes)
    row = arrays.owners(firsts)
    if exponent < 3 or shortest < GRAM + 1:
        full = np.flatnonzero(np.diff(firsts))
        return firsts[:-1][full], firsts[1:][full] - 1
    if size < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = arrays.mix(np.arange(len(firsts) - 1, dtype=np.uint64))[row]
    gram = hashes + mixed
    for back in range(1, GRAM):
        gram[back:] = arrays.mix(gram[back:]) + hashes[:-back]
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    back = np.full(size, size, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    inside = np.arange(size) - firsts[:-1][row] >= GRAM - 1
    back[~inside | (np.arange(size) - back < firsts[:-1][row] + GRAM - 1)] = size
    while True:
        alive = back < size
        edge = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8)))
        low, high = edge[::2], edge[1::2]
        reach = (high - low + 2) // (exponent - 1)
        full = np.flatnonzero(alive)
        lost = back[full] > np.repeat(reach, high - low)
        if not lost.any():
            break
        back[full[lost]] = size
    if not len(low):
        return low, high
    first = np.maximum(low - reach - GRAM + 1, firsts[:-1][row[low]])
    first = np.minimum.accumulate(first[::-1])[::-1]
    apart = first[1:] >= high[:-1]  # nothing from here on reaches back into what came before
    return first[np.concatenate([[True], apart])], high[np.concatenate([apart, [True]])] - 1


def _of_batch(column, exponent, shortest):
    """The words of each text, and the rows of its runs or None."""
    data, offsets = arrays.utf8(column)
    starts, ends, firsts = arrays.words(data, offsets)
    low, high = _where_possible(arrays.word_hashes(data, starts, ends), firsts, exponent, shortest)
    raw, owner = data.tobytes(), np.searchsorted(firsts, low, side="right") - 1
    out = [None] * (len(firsts) - 1)
    for doc in np.unique(owner).tolist():
        mine = np.flatnonzero(owner == doc)
        known, symbols, places = {}, [], []
        for a, b in zip(low[mine].tolist(), high[mine].tolist()):
            symbols += [known.setdefault(raw[x:y], len(known) + 1) for x, y in zip(starts[a:b + 1].tolist(), ends[a:b + 1].tolist())]
            symbols.append(known.setdefault(a, len(known) + 1))  # a symbol of its own ends the window
            places += [*range(a, b + 1), -1]
        found = runs(symbols, exponent, shortest)
        if len(found):
            found[:, 0] = np.array(places)[found[:, 0]] - firsts[doc]
            out[doc] = found
    bounds = offsets.tolist()
    return [(raw[a:b].split(), found) for a, b, found in zip(bounds, bounds[1:], out)]


def _collapsed(words, found):
    """The words but those that a run has after its first period, joined by one space."""
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, found[:, 0] + found[:, 2], 1)
    np.add.at(inside, found[:, 0] + found[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(inside)[:-1] == 0).tolist())


def find_runs(docs, exponent=EXPONENT, shortest=SHORTEST):
    """Every row's doc_id, n_words, runs (array of start, length, period by start, then period) and collapsed text.

    Words are runs outside ASCII white space. A run is a stretch of words with smallest period q, of `exponent * q` and of
    `shortest` words at least, that no neighbouring word extends. The collapsed text has the words, joined by one space, but those that a
    run contains after its first q. Null and empty texts and texts without words have no word, no run and an empty collapsed
    text. Null ids and repeated rows are rows like any other. An empty table gives no rows; other columns are ignored.

    The trees of a text and of its reversal leave out what can hold no run (`_where_possible`, which loses none); a symbol of its own
    stands for each part left out. So prose costs a sort of its word sequences, and trees are built where words recur at
    short distance.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def of_each(batches):
        for batch in arrays.pieces(batches, "text"):
            texts, counts, sizes, rows = [], [], [0], [np.zeros((0, 3), np.int64)]
            for words, own in _of_batch(batch.column("text"), exponent, shortest):
                texts.append((b" ".join(words) if own is None else _collapsed(words, own)).decode())
                counts.append(len(words))
                sizes.append(0 if own is None else len(own))
                rows += [] if own is None else [own]
            every = np.concatenate(rows)
            structs = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], fields=list(run))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), structs)
            yield arrays.record_batch(schema, batch.column("doc_id"), counts, lists, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of_each, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periodic_tails(docs):
    """doc_id and text, where each text with words whose hash is divisible by ten becomes periodic from some word on.

    With h = crc32 of the decimal id and g = floor(h / 10), each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Texts of null ids stay as they are.
    """
    words = F.array_remove(F.split("text", WHITE, -1), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w):
        n = F.size(w).cast("long")
        start = g % n
        period = 1 + F.floor((n - start) / (3 + g % 8))
        place = lambda i: F.when(i < start, i).otherwise(start + F.pmod(i - start, period)).cast("int")
        return F.array_join(F.transform(w, lambda _, i: F.get(w, place(i))), " ")

    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.lit("")))[0]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def digests(found):
    """doc_id, n_runs, the run of greatest length / period, and hashes of all runs and of the collapsed text."""
    none = F.struct(*(F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")))

    def better(best, run):
        a, b = run["length"] * best["period"], best["length"] * run["period"]
        tie = (a == b) & ((run["start"] < best["start"]) | ((run["start"] == best["start"]) & (run["period"] < best["period"])))
        return F.when(best["start"].isNull() | (a > b) | tie, run).otherwise(best)

    best = F.aggregate("runs", none, better)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
