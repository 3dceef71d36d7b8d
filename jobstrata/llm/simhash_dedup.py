"""Near-duplicates by SimHash fingerprints: pigeonhole blocks, then verified Hamming distance."""

import re
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from jobstrata.llm import arrays
from jobstrata.llm.components import components
from jobstrata.llm.shared import saved

BITS, SHINGLE, SEED = 64, 3, 42
#: Fingerprints are cut into BLOCKS; a pair with `distance` different bits agrees on BLOCKS - distance of them at least.
BLOCKS = 5
#: Fingerprints of a key beyond which its members meet by their neighbourhoods instead of pairwise.
CROWD = 32
#: Fingerprints that a task reads at least, where there are so many.
NODES = 200_000
#: Bytes of one text that are cut into words at once.
CHUNK = 1 << 20

_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _shingles(text):
    """The shingles of a text, repeats included, in lists of bounded size."""
    text, start, tail, few = text.lower(), 0, [], True
    while start < len(text):
        found = _WHITE.search(text, start + CHUNK)
        stop = found.start() if found else len(text)
        words = tail + text[start:stop].split()
        if len(words) >= SHINGLE:
            few = False
            yield list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
        tail, start = words[1 - SHINGLE:], stop
    if few and tail:
        yield [b" ".join(tail)]


def _fingerprint(text):
    """Bit b is set if more than half of the shingles' hashes have it; a text without words has none."""
    ones, total = np.zeros(BITS, np.int64), 0
    for shingles in _shingles(text):
        digests = b"".join(map(xxh64_digest, shingles, repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
        total += len(shingles)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs):
    """doc_id and the fingerprint of every row's whole text, as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            values = [_fingerprint(t) if (t := x.as_py()) else 0 for x in texts]
            yield arrays.record_batch(schema, batch.column("doc_id"), values)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint long")


def block_masks(blocks, distance):
    """One mask for each choice of `blocks - distance` blocks, as signed longs."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    cells = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(cells, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _neighbourhoods(crowded, distance):
    """Links among fingerprints of which many share a key, without pairing them.

    Every fingerprint goes to all values within half the distance of it. Two within `distance` meet at a value between
    them, and all that meet at a value are within `distance` of each other, so each is linked to the smallest there. A
    value gathers at most as many different fingerprints as it has such neighbours, whatever the data: 65 at two bits.
    """
    flips = [0]
    for near in range(1, distance // 2 + 1):
        flips += [sum(1 << b for b in bits) for bits in combinations(range(BITS), near)]
    signed = [x - (1 << BITS) if x >> (BITS - 1) else x for x in flips]
    around = crowded.select("fp", F.explode(F.transform(F.array(*map(F.lit, signed)), lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    low = around.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last").select("at", "a")
    return around.join(low, "at").where("fp > a").select("a", F.col("fp").alias("b"))


def links(nodes, distance=2, blocks=BLOCKS, crowd=CROWD):
    """Pairs (a, b) of different fingerprints whose closure links all that differ in `distance` bits or less.

    `nodes` has each fingerprint once, as fp. Fingerprints meet on every choice of `blocks - distance` blocks. Keys that up to
    `crowd` fingerprints share give pairs, verified by their distance; the members of larger ones meet in `_neighbourhoods`, which
    needs an even distance. A pair shares a small key, or both are in large ones, so no link is lost.
    """
    if distance % 2 or not 0 < distance < blocks:
        raise ValueError("distance must be even, above zero and below the number of blocks")
    masks = block_masks(blocks, distance)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks))))
    keyed = nodes.select("fp", keys.alias("k")).select("fp", "k.choice", "k.bits")
    # kept for itself, so that both sides of the join are plain shuffles and the members of a hot key are split
    sizes = saved(keyed.groupBy("choice", "bits").agg(F.count("*").alias("held")).where("held > 1"), NODES)
    shared = saved(keyed.join(sizes, ["choice", "bits"]).select("fp", "choice", "bits", "held"))
    few = shared.where(F.col("held") <= crowd)
    pairs = (few.select("choice", "bits", F.col("fp").alias("a")).join(few.select("choice", "bits", F.col("fp").alias("b")), ["choice", "bits"])
             .where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b"))
    return pairs.union(_neighbourhoods(shared.where(F.col("held") > crowd).select("fp").distinct(), distance))


def near_copies(docs, distance=2):
    """Every row's doc_id, fingerprint (16 hex digits) and component_id.

    Words are runs outside ASCII white space with A-Z lowered; a text's shingles are its sequences of three words, repeats
    included, or the whole sequence if it has fewer. Fingerprints that differ in `distance` bits or less are linked; component_id is
    the smallest doc_id that links reach. Null and empty texts and texts without words have fingerprint zero and are linked
    like any other. Rows with a null id get their fingerprint, link nothing and have a null component. Rows that share an id
    are answered each by its own text; repeated rows get the same answer. An empty table gives no rows; other columns are ignored.

    Equal fingerprints are one node, so exact copies cost one row each.
    """
    base = saved(fingerprints(docs))
    nodes = saved(base.where("doc_id is not null").groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    found = saved(components(links(nodes.select("fp"), distance)))
    joined = nodes.join(found.withColumnRenamed("node", "fp"), "fp")
    lowest = joined.groupBy("component").agg(F.min("first").alias("lowest"))
    linked = joined.select("fp", "component").join(lowest, "component").select("fp", "lowest")
    # kept for itself, so that both sides of the last join are plain shuffles and the rows of a hot fingerprint are split
    named = saved(nodes.join(linked, "fp", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("lowest", "first").alias("component_id")), NODES)
    return base.join(named, "fingerprint", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), BITS // 4, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
