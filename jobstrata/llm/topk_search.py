"""Exact top-k inner-product search by a three-phase uniform threshold over slices of the components."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobstrata.llm.shared import saved

#: Slices of the components (the nodes of the algorithm), rows of a candidate and of a query block, and how
#: many times k a local list holds.
SLICES, CANDIDATES, QUERIES, LISTED = 2, 8192, 1024, 4


def usable(vectors):
    """vec_id and whole-numbered components: floor(256 * x). One row an id (the smallest vector, if rows share one)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
            .select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x)).alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def _part(number, slices):
    """The components of a slice."""
    size = F.size("v")
    start, stop = F.floor(size * number / slices).cast("int"), F.floor(size * (number + 1) / slices).cast("int")
    return F.slice("v", start + 1, stop - start)


def _matrix(column, rows):
    values = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten())
    return values.reshape(rows, -1) if len(values) else np.zeros((rows, 0), np.int64)


def _scores(queries, candidates):
    """Exact inner products; in doubles where these hold them exactly."""
    bound = np.abs(queries).max(initial=0) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    kind = np.float64 if bound < 2**52 else object
    return queries.astype(kind) @ candidates.astype(kind).T


def _blocks(candidates, queries, slices, sides):
    """Both sides by slice, length and block; every query block meets every candidate block of its length."""
    number, of_queries = sides
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("slice"), _part(i, slices).alias("part")) for i in range(slices))))

    def dealt(df, key, own, all_of, other, count):
        return (df.withColumn("p", parts).select(
            F.col("p.slice").alias("slice"), F.size("v").alias("dim"), F.col("p.part").alias("part"), *key,
            F.pmod(F.xxhash64(key[0]), F.lit(all_of)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(other)))

    left = dealt(candidates, ["vec_id"], "cb", number, "qb", of_queries)
    right = dealt(queries, [c for c in queries.columns if c != "v"], "qb", of_queries, "cb", number)
    keys = ["slice", "dim", "cb", "qb"]
    return left.groupBy(keys).cogroup(right.groupBy(keys))


def _each(left, right, choose):
    """Rows (query_id, vec_id) that `choose` finds in the score rows of a few queries at a time."""
    ids, names = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
    if not len(ids) or not len(names):
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64())})
    candidates, queries = _matrix(left.column("part"), len(ids)), _matrix(right.column("part"), len(names))
    out = []
    for start in range(0, len(names), 128):
        own = names[start:start + 128, None] == ids[None, :]
        q, c = choose(_scores(queries[start:start + 128], candidates), own, start)
        out.append((names[start + q], ids[c]))
    q, c = (np.concatenate([o[i] for o in out]) for i in (0, 1))
    return pa.table({"query_id": q, "vec_id": c})


def top_k(vectors, k=5, every=50, slices=SLICES):
    """query_id, rank, vec_id, score: the k best candidates of every query, whose id is divisible by `every`.

    The score is the inner product of the whole-numbered vectors, ties go to the smaller vec_id, all other rows
    are candidates; a query with fewer than k gets all. Vectors that are null or hold a null or a non-finite
    component take no part, nor do null ids; a query meets vectors of its own length only. Rows that share
    an id count as the smallest of their vectors. An empty table gives no rows; other columns are ignored.
    A score beyond 64 bits ends the job with an arithmetic error.

    Of equal vectors the k + 1 smallest ids are kept, since no query can need more. Each slice of the components
    is a node. Phase 1: the best local scores of every node name candidates, whose totals are resolved; the
    k-th best is a cutoff that no answer falls below. Phase 2: every node reports what has a local score of
    cutoff / slices or more; what no node reports stays below the cutoff. Phase 3: totals of the reported
    pairs are resolved exactly and ranked. Work is dealt by blocks of both sides, so no task or driver holds more.
    """
    copies = Window.partitionBy("v").orderBy("vec_id")
    everything = saved(usable(vectors))
    queries = everything.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    candidates = saved(everything.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1).drop("place"))
    sides = [max(1, -(-df.count() // size)) for df, size in ((candidates, CANDIDATES), (queries, QUERIES))]

    def listed(key, left, right):
        def choose(scores, own, start):
            scores[own] = -np.inf if scores.dtype == float else -(1 << 200)
            size = min(LISTED * k, scores.shape[1])
            best = np.argsort(-scores, axis=1, kind="stable")[:, :size] if scores.dtype == object else (
                np.argpartition(-scores, size - 1, axis=1)[:, :size])
            q, place = np.nonzero(~np.take_along_axis(own, best, axis=1))
            return q, best[q, place]

        return _each(left, right, choose)

    def reported(key, left, right):
        cutoff = right.column("cutoff").to_numpy(zero_copy_only=False).astype(float)

        def choose(scores, own, start):
            low = cutoff[start:start + len(scores), None]
            return np.nonzero(~own & (np.isnan(low) | (slices * scores >= low)))

        return _each(left, right, choose)

    def resolved(pairs):
        return (pairs.distinct().join(candidates, "vec_id").join(queries.withColumnRenamed("v", "q"), "query_id")
                .select("query_id", "vec_id", F.aggregate(
                    F.zip_with("v", "q", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x).alias("score")))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(scores):
        return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    pairs = "query_id long, vec_id long"
    first = _blocks(candidates, queries, slices, sides).applyInArrow(listed, pairs)
    cutoffs = ranked(resolved(saved(first))).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("cutoff"))
    asked = saved(queries.join(cutoffs, "query_id", "left"))
    second = _blocks(candidates, asked, slices, sides).applyInArrow(reported, pairs)
    return ranked(resolved(saved(second))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
