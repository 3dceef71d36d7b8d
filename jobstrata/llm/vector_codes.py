"""Product codes of vectors: codebooks refined by rounds, nearest entries found by Orchard's search."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from jobstrata.llm import arrays
from jobstrata.llm.shared import saved

#: Consecutive parts of a vector, entries of each part's codebook, and rounds of refinement.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are floor(SCALE * x), held within LARGEST so that squared distances stay whole numbers of 64 bits.
SCALE, LARGEST = 256, 1 << 28


class Orchard:
    """Nearest entries of all parts' codebooks (parts x entries x width, whole numbers).

    Each entry has a list of all entries of its part by distance. A search follows the list of the best entry so far; a nearer
    one (or an equally near one of lower index) makes it jump to that one's list. Entries are marked when seen. It ends beyond
    twice the current distance: an entry further from the current one is further from the vector too.
    """

    def __init__(self, books):
        self.books = books.astype(np.int64)
        parts, entries, _ = books.shape
        apart = np.stack([((b[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) for b in self.books])
        order = np.argsort(apart, axis=2, kind="stable")
        self.lists = order.reshape(parts * entries, entries)
        self.reach = np.take_along_axis(apart, order, axis=2).reshape(parts * entries, entries)
        self.flat = self.books.reshape(parts * entries, -1)

    def nearest(self, vectors):
        """Index of the nearest entry of every part and its squared distance, for vectors of shape rows x parts x width."""
        rows, parts, width = vectors.shape
        entries = self.books.shape[1]
        points = vectors.reshape(rows * parts, width)
        base = np.tile(np.arange(parts) * entries, rows)
        current = np.zeros(rows * parts, np.int64)
        best = ((points - self.flat[base]) ** 2).sum(axis=1)
        seen = np.zeros((rows * parts, entries), bool)
        seen[:, 0] = True
        turn = np.zeros(rows * parts, np.int64)
        active = np.arange(rows * parts)
        while len(active):
            listed = base[active] + current[active]
            at = turn[active]
            active = active[self.reach[listed, at] <= 4 * best[active]]
            entry = self.lists[base[active] + current[active], turn[active]]
            turn[active] += 1
            fresh = ~seen[active, entry]
            look, entry = active[fresh], entry[fresh]
            seen[look, entry] = True
            distance = ((points[look] - self.flat[base[look] + entry]) ** 2).sum(axis=1)
            nearer = (distance < best[look]) | ((distance == best[look]) & (entry < current[look]))
            jump = look[nearer]
            current[jump], best[jump], turn[jump] = entry[nearer], distance[nearer], 0
            active = active[turn[active] < entries]
        return current.reshape(rows, parts), best.reshape(rows, parts)


def usable(vectors):
    """vec_id, embedding and label of the rows whose vector and components are neither null nor without bound."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
            .where(F.col("embedding").isNotNull()).where(finite))


def _cut(column, parts, width):
    """The whole-numbered parts of all vectors (rows x parts x width), padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = np.asarray(column.flatten()), np.cumsum(np.asarray(column.value_lengths()))
    out = np.zeros((len(column), parts * width), np.int64)
    whole = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64)
    sizes = np.diff(np.concatenate([[0], ends]))
    if (sizes == parts * width).all():
        out[:] = whole.reshape(out.shape)
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - (ends - sizes)[row]] = whole
    return out.reshape(len(column), parts, width)


def _first_books(kept, parts, width, entries):
    """The parts of the vectors of the smallest ids; of rows that share an id, of the smallest vector."""
    ids = kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    first = (kept.join(F.broadcast(ids), kept["vec_id"].eqNullSafe(ids["vec_id"]), "left_semi").groupBy("vec_id")
             .agg(F.min("embedding").alias("embedding")).orderBy(F.col("vec_id").asc_nulls_last()))
    column = pa.array([r.embedding for r in first.collect()], pa.list_(pa.float64()))
    return np.ascontiguousarray(_cut(column, parts, width).transpose(1, 0, 2))


def _refined(kept, books):
    """The codebooks whose entries are replaced by the floors of the means of the parts nearest to them."""
    parts, entries, width = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        search = Orchard(books)
        counts = np.zeros(parts * entries, np.int64)
        sums = np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            vectors = _cut(batch.column("embedding"), parts, width)
            cell = (search.nearest(vectors)[0] + np.arange(parts) * entries).reshape(-1)
            counts += np.bincount(cell, minlength=len(counts))
            np.add.at(sums, cell, vectors.reshape(-1, width))
        used = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].reshape(-1)))
        yield arrays.record_batch(schema, used // entries, used % entries, counts[used], lists)

    partial = kept.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"sum{i}") for i in range(width)))
    out = books.copy()
    for r in total.collect():  # parts x entries rows at most
        out[r.part, r.entry] = [int(r[f"sum{i}"]) // r.n for i in range(width)]
    return out


def learn(kept, parts=PARTS, entries=ENTRIES, rounds=ROUNDS):
    """Codebooks (parts x entries x width) of the usable rows; None if there are none.

    They begin with the vectors of the smallest ids, and have fewer entries where there are fewer ids. The width is that of the longest vector, its
    length raised to a multiple of the parts; shorter vectors count as padded with zeros. Each round assigns every vector and
    sums in the map tasks; the driver sees one sum for each entry.
    """
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).head().n
    if longest is None:
        return None
    books = _first_books(kept, parts, max(1, -(-longest // parts)), entries)
    for _ in range(rounds):
        books = _refined(kept, books)
    return books


def digest(books):
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(kept, books):
    """vec_id, label, code (an entry of each part as two hex digits) and error (squared distances summed over the parts)."""
    parts, _, width = books.shape
    schema = pa.schema([("vec_id", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches):
        search = Orchard(books)
        for batch in batches:
            codes, distances = search.nearest(_cut(batch.column("embedding"), parts, width))
            text = codes.astype(np.uint8).tobytes().hex()
            names = [text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            coded = arrays.record_batch(schema, batch.column("vec_id"), names, distances.sum(axis=1))
            yield pa.RecordBatch.from_arrays([*coded.columns, batch.column("label")], names=[*schema.names, "label"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "embedding", "label").mapInArrow(run, f"vec_id long, code string, error long, label {label}")


def compress(vectors, parts=PARTS, entries=ENTRIES, rounds=ROUNDS):
    """Every usable row's vec_id, code, error, label_error and codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component take no part. Components are floor(256 * x), within 2^28
    either way. Vectors are cut into `parts` equal consecutive parts (see `learn` for vectors of other lengths) and each part
    is named by the nearest entry of its codebook, of equally near ones the lowest. label_error sums the errors of all rows of
    the row's label, null labels together. A null vec_id is a row like any other, last in order; rows that share an id are coded each by
    its own vector; repeated rows count as often as they come. An empty table gives no rows; other columns are ignored.
    """
    kept = usable(vectors)
    books = learn(kept, parts, entries, rounds)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
                           F.lit("").alias("codebooks_sha256"))
    coded = saved(encode(kept, books))
    totals = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, coded["label"].eqNullSafe(totals["of_label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
