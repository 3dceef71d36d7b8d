"""Near-duplicates by MinHash signatures and a multi-index Hamming join, confirmed on whole shingle sets."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobstrata.llm import arrays
from jobstrata.llm.components import components
from jobstrata.llm.shared import saved

SHINGLE = 5
#: Signatures have COORDINATES values of 16 bits, in chunks of CHUNK; ERRORS of a chunk may differ. By pigeonhole a pair
#: with at most COORDINATES / CHUNK * 2 - 1 = 15 different values agrees on a chunk but for one value. At a
#: similarity of 0.85, all eight chunks have two errors or more with probability 2e-8.
COORDINATES, CHUNK, ERRORS = 32, 4, 1

#: Pairs, links and named nodes that a task reads at least, where there are so many.
PAIRS = 100_000

_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(column):
    """Sorted hashes of the different shingles of all texts in a row, and the offsets of the texts."""
    data, offsets = arrays.utf8(column)
    data = arrays.lower_ascii(data)
    starts, ends, firsts = arrays.words(data, offsets)
    hashes = arrays.word_hashes(data, starts, ends)
    counts = np.diff(firsts)
    prefix = arrays.running(hashes)
    many = np.flatnonzero(counts > 0)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    rows = np.concatenate([[0], np.cumsum(sizes)])
    begins = np.arange(rows[-1]) - np.repeat(rows[:-1] - firsts[:-1], sizes)
    stops = begins + np.repeat(np.minimum(counts, SHINGLE), sizes)
    values = arrays.span_hash(prefix, begins, stops)
    for row in many.tolist():
        values[rows[row]:rows[row + 1]].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[rows[:-1][sizes > 0]] = True
    done = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], done[rows]


def _keys(values, rows):
    """The keys of every set: each chunk of the signature with each of its values left out."""
    full = np.flatnonzero(np.diff(rows))
    starts = rows[:-1][full]
    signature = np.zeros((len(full), COORDINATES), np.uint64)
    for j, factor in enumerate(_MULTIPLIERS):
        x = values * factor
        x ^= x >> np.uint64(32)
        x *= _MIX
        signature[:, j] = (np.minimum.reduceat(x, starts) * _MIX) >> np.uint64(48) if len(full) else 0
    keys = np.zeros((len(full), COORDINATES), np.uint64)
    for j in range(COORDINATES):
        chunk = [c for c in range(j - j % CHUNK, j - j % CHUNK + CHUNK) if c != j]
        keys[:, j] = np.uint64(j) << np.uint64(48)
        for place, c in enumerate(chunk):
            keys[:, j] |= signature[:, c] << np.uint64(16 * place)
    return full, keys


def signatures(docs):
    """doc_id, n_shingles, a 128-bit hash of the shingle set (h1, h2) and the keys of its signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                        ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in arrays.pieces(batches, "text"):
            values, rows = shingle_sets(batch.column("text"))
            full, keys = _keys(values, rows)
            h1, h2 = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
            if len(full):
                h1[full] = np.add.reduceat(arrays.mix(values), rows[:-1][full])
                h2[full] = np.add.reduceat(arrays.mix(values ^ _MIX), rows[:-1][full])
            sizes = np.zeros(len(batch), np.int64)
            sizes[full] = COORDINATES
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                             pa.array(arrays.signed(keys.reshape(-1)), pa.int64()))
            yield arrays.record_batch(schema, batch.column("doc_id"), np.diff(rows), arrays.signed(h1), arrays.signed(h2), lists)
        arrays.release()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def confirmed(pairs, texts, percent):
    """The pairs (a, b) whose whole shingle sets share `percent` of their union or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for part in arrays.pieces(batches, "text_a", "text_b"):
            (x, of_x), (y, of_y) = (shingle_sets(part.column(c)) for c in ("text_a", "text_b"))
            row_x, row_y = arrays.owners(of_x), arrays.owners(of_y)
            salt = arrays.mix(np.arange(len(part), dtype=np.uint64))
            both = np.isin(x ^ salt[row_x], y ^ salt[row_y])
            common = np.bincount(row_x[both], minlength=len(part))
            union = np.diff(of_x) + np.diff(of_y) - common
            yield part.select(["a", "b"]).filter(pa.array(100 * common >= percent * union)).cast(schema)
        arrays.release()

    left, right = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), texts.select(
        F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _labelled(nodes, found):
    """Rows with a column rep and the component of that node, itself where it has no link."""
    return nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))


def _shingles(texts, rows):
    """One row for each text of the rows and different shingle, with its component and the size of its set.

    Made from the texts whenever they are needed: the texts are a fraction of their shingles.
    """
    schema = pa.schema([("rep", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("shingle", pa.int64())])

    def run(batches):
        for batch in arrays.pieces(batches, "text"):
            values, at = shingle_sets(batch.column("text"))
            owner = pa.array(arrays.owners(at))
            yield arrays.record_batch(schema, batch.column("rep").take(owner), batch.column("component").take(owner),
                                      np.repeat(np.diff(at), np.diff(at)), arrays.signed(values))
        arrays.release()

    return texts.join(rows.select("rep", "component").distinct(), "rep").select("rep", "component", "text").mapInArrow(
        run, "rep long, component long, n long, shingle long")


def _mixed(rows):
    """The rows (key, …, component) of keys that still hold several components."""
    several = rows.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last")
    return rows.join(several.select("key"), "key")


def _narrowed(rows, texts, percent):
    """The rows (key, rep, component) whose text may have a link to another component, with n and common.

    n counts the text's shingles, common those that some other component holds; a partner B of A shares at most
    common of them. So the similarity is at most common / (n + n_B - common), and n_B is no less than the
    smallest n of the key. Rows that stay below `percent` drop out, then keys with one component left. No link is lost.
    """
    placed = _shingles(texts, rows)
    spread = placed.groupBy("shingle").agg(F.min("component").alias("first"), F.max("component").alias("last"))
    counted = (placed.join(spread.where("first < last"), "shingle").groupBy("rep", "n").agg(F.count("*").alias("common")))
    rows = rows.select("key", "rep", "component").join(counted, "rep")
    smallest = rows.groupBy("key").agg(F.min("n").alias("least"))
    near = rows.join(smallest, "key").where((100 + percent) * F.col("common") >= percent * (F.col("n") + F.col("least")))
    return _mixed(near.select("key", "rep", "component", "n", "common"))


def _stars(votes):
    """Each node with the two nodes that most of its keys name."""
    most = Window.partitionBy("a").orderBy(F.desc("votes"), "b")
    counted = votes.groupBy("a", "b").agg(F.count("*").alias("votes"))
    return counted.withColumn("place", F.row_number().over(most)).where("place <= 2").select("a", "b")


def _middles(rows):
    """The most central node of each key, as center, and its component, as other.

    Central is the node that meets most others in its keys: the text that copies were made from, or the copy nearest
    to it. So it has links to more of the key than the smallest node has.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("held"))
    weights = rows.join(sizes, "key").groupBy("rep").agg(F.sum("held").alias("weight"))
    best = rows.join(weights, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), "component")).alias("best"))
    return best.select("key", (-F.col("best.minus")).alias("center"), F.col("best.component").alias("other"))


def _central(rows):
    """Pairs of each node with the most central node of its key, where that is of another component."""
    return _stars(rows.join(_middles(rows), "key").where("component <> other").select(F.col("rep").alias("a"), F.col("center").alias("b")))


def _placed(rows, texts):
    """The rows (key, rep, component, n) with inside and outside: the shingles that some other component holds, apart
    by whether the most central node of the key holds them too.

    They are gathered by text and compared with the center's set, so there is a row for each text and center and none for each shingle of those.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("rep", "center", "inside", "outside")])

    def run(batches):
        for part in arrays.pieces(batches, "text"):
            values, at = shingle_sets(part.column("text"))
            lists = part.column("shared")
            shared, sizes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(part)), sizes)
            salt = arrays.mix(np.arange(len(part), dtype=np.uint64))
            held = np.isin(shared ^ salt[owner], values ^ salt[arrays.owners(at)])
            inside = np.bincount(owner[held], minlength=len(part))
            yield arrays.record_batch(schema, part.column("rep"), part.column("center"), inside, sizes - inside)
        arrays.release()

    rows = saved(rows.select("key", "rep", "component", "n").join(_middles(rows).select("key", "center"), "key"), PAIRS)
    sets = _shingles(texts, rows)
    spread = sets.groupBy("shingle").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last")
    shared = sets.join(spread.select("shingle"), "shingle").groupBy("rep").agg(F.collect_list("shingle").alias("shared"))
    counted = (rows.select("rep", "center").distinct().join(shared, "rep")
               .join(texts.select(F.col("rep").alias("center"), "text"), "center").select("rep", "center", "shared", "text")
               .mapInArrow(run, "rep long, center long, inside long, outside long"))
    return rows.join(counted, ["rep", "center"]).select("key", "rep", "component", "n", "inside", "outside")


def _pairs(rows, percent):
    """Pairs of different components within the bound, each from the first key that both have, so none comes twice.

    What two nodes share lies inside the most central node of the key or outside of it: at most the smaller inside and
    the smaller outside. A copy that has no link to the center lacks too much inside, so it meets only those
    that may share its own changes; without the split it would meet every member of a large group of copies.
    """
    number, every = F.shiftright("key", 48), range(COORDINATES)
    wide = rows.groupBy("rep").agg(*(F.max(F.when(number == j, F.col("key"))).alias(f"key{j}") for j in every))
    rows = rows.join(wide, "rep")
    names = ["rep", "component", "n", "inside", "outside", *(f"key{j}" for j in every)]
    a, b = (rows.select("key", *(F.col(c).alias(f"{c}_{side}") for c in names)) for side in "ab")
    first = F.coalesce(*(F.when(F.col(f"key{j}_a") == F.col(f"key{j}_b"), F.lit(j)) for j in every))
    most = F.least("inside_a", "inside_b") + F.least("outside_a", "outside_b")
    return (a.join(b, "key").where(F.col("component_a") < F.col("component_b"))
            .where((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
            .where(first == number).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct())


def near_duplicates(docs, percent=85):
    """Every row's doc_id, n_shingles, component_id and kept.

    Words are runs outside ASCII white space, with A-Z lowered; a text's set holds its different five-word
    shingles, or the whole sequence if it has fewer words. Texts whose sets share `percent` of their union
    are linked; component_id is the smallest doc_id that links reach, kept marks it. Null texts and texts
    without words have no shingle and stand alone; so do rows with a null id, whose component is null and which
    are kept. Repeated rows get the same answer; rows that share an id count as one document. An empty
    table gives no rows; other columns are ignored.

    1. Equal sets are one node, so exact copies cost one row each.
    2. Nodes that agree on a key of the multi-index are candidates. Each is compared with the smallest nodes of
       its key groups (the two that most keys name), never with the whole group.
    3. Where a key group still holds several components, its nodes are compared with its most central text.
    4. Where it holds several even so, nodes that cannot reach another component for
       want of common shingles drop out, twice; pairs between what is left of different components, and within
       a bound that counts apart what the central text holds, are compared exactly. Pairs inside a component are never made.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = saved(signatures(text))
    # sets and names are kept for themselves, so that both sides of their joins are plain shuffles and copies of one text are split
    sets = saved(base.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), PAIRS)
    keyed = (base.join(sets, ["h1", "h2"]).where("doc_id = rep").select("rep", F.explode("keys").alias("key")))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = saved(keyed.join(shared.select("key", "low"), "key").select("key", "rep", "low"))
    stars = _stars(members.where("rep > low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    texts = saved(text.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")
                  .select(F.col("doc_id").alias("rep"), "text"))
    links = saved(confirmed(stars, texts, percent), PAIRS)
    found = saved(components(links), PAIRS)

    rows = saved(_mixed(_labelled(members.select("key", "rep"), found)))
    links = saved(links.union(confirmed(saved(_central(rows), PAIRS), texts, percent)), PAIRS)
    found = saved(components(links), PAIRS)
    rows = _mixed(_labelled(rows.select("key", "rep"), found))
    rows = saved(_narrowed(saved(rows), texts, percent))
    rows = saved(_narrowed(rows, texts, percent))
    pairs = _pairs(_placed(rows, texts), percent)
    found = components(links.union(confirmed(saved(pairs, PAIRS), texts, percent)))

    named = saved(_labelled(sets, found).select("h1", "h2", "component"), PAIRS)
    return base.join(named, ["h1", "h2"], "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
