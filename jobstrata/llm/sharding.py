"""Shards of nearly equal size by minimax contiguous partition over ordered atomic groups."""

from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobstrata.llm.shared import saved

#: Bits of the group key that the first histogram and every refinement resolve.
FIRST_BITS, NEXT_BITS = 12, 8
#: Cells that one round refines.
REFINED = 64


def _sized(docs):
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"))


def _greedy(cells, capacity, divisible):
    """Cuts (cell numbers) of the greedy fill. With `divisible`, a cell of several groups may be split anywhere.

    A cell that no shard can hold makes the fill infeasible: None.
    """
    cuts, held = [], 0
    for number, (_, _, size, groups, _) in enumerate(cells):
        if divisible and groups > 1:
            over = held + size - capacity
            while over > 0:
                cuts.append(number)
                held, over, size = 0, over - capacity, over
            held += size
        elif size > capacity:
            return None
        elif held + size > capacity:
            cuts.append(number)
            held = size
        else:
            held += size
    return cuts


def _smallest(cells, shards, low, high, divisible):
    """Binary search of the smallest capacity that needs at most `shards` shards."""
    while low < high:
        middle = (low + high) // 2
        cuts = _greedy(cells, middle, divisible)
        if cuts is not None and len(cuts) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def _open_cells(cells, low, high):
    """Cells of several groups in which a cut may fall for a capacity from low to high."""
    early, late = _greedy_forced(cells, low), _greedy(cells, high, True)
    found = set()
    for number, stop in enumerate(late):
        start = min(early[number] if number < len(early) else stop, stop)
        found.update(range(max(0, start - 1), stop + 1))
    return [n for n in sorted(found) if cells[n][3] > 1]


def _greedy_forced(cells, capacity):
    cuts, held = [], 0
    for number, cell in enumerate(cells):
        if held and held + cell[2] > capacity:
            cuts.append(number)
            held = 0
        held += cell[2]
    return cuts


def _share(sizes, parts):
    """Equal share of the sizes over the parts; what is larger than a share takes a part of its own."""
    total = sum(sizes)
    for size in sorted(sizes, reverse=True):
        if parts == 1 or size * parts <= total:
            break
        total, parts = total - size, parts - 1
    return total / parts


def _even(cells, capacity, shards):
    """Cuts (cell numbers) nearest to equal shares of what is left, within the capacity and the number of shards.

    Where one large cell sets the capacity, filling every shard up to it would leave the last ones empty.
    """
    sums = [0, *accumulate(c[2] for c in cells)]
    need, ends = [0] * (len(cells) + 1), [0] * len(cells)
    for i in range(len(cells) - 1, -1, -1):
        ends[i] = bisect_right(sums, sums[i] + capacity) - 1
        need[i] = 1 + need[ends[i]]
    cuts, start = [], 0
    for left in range(shards - 1, 0, -1):
        if start == len(cells):
            break
        aim = sums[start] + _share([c[2] for c in cells[start:]], left + 1)
        stop = bisect_right(sums, aim) - 1
        if stop < len(cells) and sums[stop + 1] - aim < aim - sums[stop]:
            stop += 1
        first = bisect_left(need, -left, start + 1, key=lambda x: -x)  # the rest must fit into the shards left
        start = min(max(stop, first, start + 1), ends[start])
        cuts.append(start)
    return [c for c in cuts if c < len(cells)]


def _histogram(groups, spans):
    """Cells (low key, high key, size, groups, bits) of the spans (first bits of the keys, their number, bits to resolve)."""
    wanted = defaultdict(list)
    for prefix, known, bits in spans:
        wanted[known, bits].append(prefix)
    cell = F.lit(None)
    for (known, bits), prefixes in wanted.items():
        here = F.shiftright("key", 64 - known).isin(prefixes) if known else F.lit(True)
        cell = F.when(here, F.struct(F.shiftright("key", 64 - bits).alias("at"), F.lit(bits).alias("bits"))).otherwise(cell)
    rows = (groups.select(cell.alias("cell"), "bytes").where("cell is not null")
            .groupBy("cell.at", "cell.bits").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups")).collect())
    return [(r["at"] << (64 - r["bits"]), ((r["at"] + 1) << (64 - r["bits"])) - 1, r["bytes"], r["groups"], r["bits"])
            for r in rows]


def cut_keys(groups, shards):
    """First keys of the shards 1, 2, … in a partition whose largest shard is as small as it can be.

    The driver sees histograms only: 4096 cells of the key range, then 256 cells for each of at most REFINED cells a round.
    Cells taken as atomic bound the capacity from above, cells taken as divisible from below. Cells of several groups above the lower
    bound (fewer than there are shards) are resolved first, then those in which a cut can still fall; refinement ends when both bounds
    meet, which single groups force at the latest.
    """
    cells = sorted(_histogram(groups, [(0, 0, FIRST_BITS)]))
    if not cells:
        return []
    while True:
        total = sum(c[2] for c in cells)
        low = _smallest(cells, shards, max(-(-total // shards), max([0, *(c[2] for c in cells if c[3] == 1)])), total, True)
        high = _smallest(cells, shards, low, total, False)
        if low == high:
            return [cells[n][0] for n in _even(cells, high, shards)]
        chosen = ([n for n, c in enumerate(cells) if c[3] > 1 and c[2] > low] or _open_cells(cells, low, high)
                  or [max(range(len(cells)), key=lambda n: (cells[n][3] > 1, cells[n][2]))])
        chosen = sorted(chosen, key=lambda n: -cells[n][2])[:REFINED]
        fine = _histogram(groups, [(cells[n][0] >> (64 - cells[n][4]), cells[n][4], min(64, cells[n][4] + NEXT_BITS)) for n in chosen])
        dropped = set(chosen)
        cells = sorted([c for n, c in enumerate(cells) if n not in dropped] + fine)


def shard_documents(docs, shards=16, buckets=4096):
    """Every document with its shard and its place there; the largest shard is as small as it can be.

    Groups are equal texts (equal 64-bit hashes), ordered by hash and never split, so the partition is the
    same wherever the rows stand. Sizes are UTF-8 bytes plus one. A null text counts as empty; a null
    doc_id is numbered like any other; repeated rows are rows. An empty table gives no rows. Extra
    columns are ignored. Within the smallest possible maximum, cuts come nearest to equal shares; with fewer groups than shards
    the last shards stay empty.

    `buckets` splits the numbering of each shard into windows of equal expected size, whatever the copies.
    """
    rows = saved(_sized(docs))
    cuts = cut_keys(saved(rows.groupBy("key").agg(F.sum("size").alias("bytes"))), shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= cut).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return (rows.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
