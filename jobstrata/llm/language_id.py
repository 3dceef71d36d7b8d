"""Language identification with bit-sliced Bloom filters over character n-grams."""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobstrata.llm import arrays

#: n-grams of letters with the word's edges, slots of the filter, hash functions.
SIZES, SLOTS, HASHES = (3, 4), 1 << 19, 2
#: Bounds of what is learned: labelled documents by language (whole texts), n-grams by language and size, and
#: the share of the highest rate among languages from which an n-gram belongs to a language.
SAMPLE_DOCS, GRAMS, SHARE = 2000, 15_000, 0.25

_SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


@lru_cache(maxsize=1)
def _letters():
    """Lower-case form of every letter's code point; zero for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def _grams(column):
    """Hashes of the n-grams of all texts with their row number, by n-gram size."""
    texts = [t or "" for t in column.to_pylist()]
    joined = "\n" + "\n".join(texts) + "\n"
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    for size in SIZES:
        starts = np.arange(max(0, len(codes) - size + 1))
        inner = np.ones(len(starts), bool)  # only the first and the last place may be an edge
        for i in range(1, size - 1):
            inner &= codes[i:len(starts) + i] > 0
        if size > 2:
            starts = starts[inner]
        value = np.full(len(starts), size, np.uint64)
        for i in range(size):
            value = value * np.uint64(0x100000001B3) + codes[starts + i]
        # a gram belongs to the text of its second place
        yield size, arrays.mix(value), np.searchsorted(ends, starts + 1, side="right")


def _slots(hashes, number):
    return (arrays.mix(hashes ^ _SEEDS[number]) % np.uint64(SLOTS)).astype(np.int64)


class Filters:
    """One Bloom filter a language, sliced: every slot holds a bit of each language, 64 languages a plane."""

    def __init__(self, languages):
        self.languages = sorted(languages)
        self.planes = np.zeros((-(-len(self.languages) // 64) or 1, SLOTS), np.uint64)

    def add(self, language, hashes):
        number = self.languages.index(language)
        bit = np.uint64(1) << np.uint64(number % 64)
        for k in range(HASHES):
            self.planes[number // 64, _slots(hashes, k)] |= bit

    def close(self):
        """The chance by language that a strange n-gram is found, from the filling of its filter."""
        filled = [np.count_nonzero(self.planes[n // 64] >> np.uint64(n % 64) & np.uint64(1)) / SLOTS
                  for n in range(len(self.languages))]
        self.chance = np.array(filled) ** HASHES
        return self

    def predict(self, column):
        """Language and score of every text: the highest share of n-grams found, less chance hits."""
        rows, count = len(column), len(self.languages)
        found, total = np.zeros((rows, count)), np.zeros(rows)
        for _, hashes, owner in _grams(column):
            total += np.bincount(owner, minlength=rows)[:rows]
            slots = [_slots(hashes, k) for k in range(HASHES)]
            for p, plane in enumerate(self.planes):
                hit = plane[slots[0]]
                for s in slots[1:]:
                    hit &= plane[s]
                for n in range(64 * p, min(count, 64 * p + 64)):
                    has = (hit >> np.uint64(n % 64) & np.uint64(1)).astype(bool)
                    found[:, n] += np.bincount(owner[has], minlength=rows)[:rows]
        if not count:
            return ["und"] * rows, np.zeros(rows)
        share = np.clip((found / np.maximum(total, 1)[:, None] - self.chance) / (1 - self.chance), 0, 1)
        best = share.argmax(axis=1)
        known = total > 0
        return ([self.languages[b] if k else "und" for b, k in zip(best, known)],
                np.where(known, share[np.arange(rows), best], 0.0))


def fit(docs):
    """Filters from labelled texts (doc_id, text, lang): documents of each language, bounded by SAMPLE_DOCS.

    Which documents: the first by a hash of the id. A first cut by that hash, from the counts of the languages, lets
    about four times as many through, so the exact choice moves few texts. N-grams are counted on the
    executors; the driver takes a count a language and at most GRAMS n-grams of each size and language.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return Filters([]).close()
    space = 1 << 30
    cut = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(space, 4 * SAMPLE_DOCS * space // r.n))])
    place = F.xxhash64("doc_id")
    order = Window.partitionBy("lang").orderBy(place, F.xxhash64("text"))
    sample = (known.where(F.pmod(place, F.lit(space)) < F.try_element_at(cut, F.col("lang")))
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_DOCS))
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in arrays.pieces(batches, "text"):
            langs = batch.column("lang").dictionary_encode()
            codes = np.asarray(langs.indices).astype(np.int64)
            for size, hashes, owner in _grams(batch.column("text")):
                unique, inverse = np.unique(hashes, return_inverse=True)
                pair, n = np.unique(inverse * len(langs.dictionary) + codes[owner], return_counts=True)
                yield arrays.record_batch(
                    schema, langs.dictionary.take(pa.array(pair % len(langs.dictionary))).cast(pa.string()),
                    np.full(len(pair), size, np.int32), arrays.signed(unique)[pair // len(langs.dictionary)], n)
        arrays.release()

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, size int, gram long, n long").groupBy(
        "lang", "size", "gram").agg(F.sum("n").alias("n"))
    frequent = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    top = (counted.withColumn("place", F.row_number().over(frequent)).where(F.col("place") <= GRAMS)
           .select("lang", "size", "gram", "n").toPandas())
    filters = Filters(set(top["lang"]))
    top["rate"] = top["n"] / top.groupby(["lang", "size"])["n"].transform("sum")
    top = top[top["rate"] >= SHARE * top.groupby(["size", "gram"])["rate"].transform("max")]
    for language, rows in top.groupby("lang"):
        filters.add(language, rows["gram"].to_numpy(np.int64).view(np.uint64))
    return filters.close()


def held_out(doc_id):
    """Whether a document belongs to the third that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def prediction(spark, filters):
    """The UDF text -> (lang_pred, score); SLOTS words for each 64 languages go to every executor."""
    shared = spark.sparkContext.broadcast(filters)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        parts = [shared.value.predict(batch.column("text"))
                 for batch in arrays.pieces([pa.RecordBatch.from_arrays([texts], ["text"])], "text")]
        arrays.release()
        return pa.StructArray.from_arrays(
            [pa.array([lang for langs, _ in parts for lang in langs], pa.string()),
             pa.array(np.concatenate([np.zeros(0), *(scores for _, scores in parts)]), pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs, filters):
    """Every row's doc_id, lang_pred and score, from its whole text alone.

    Null texts and texts without a letter are `und` with score 0. A text whose n-grams no language knows gets
    the first language by name, with score 0; ties go the same way. Without learned languages all is `und`.
    Null ids and repeated rows pass as they are; other columns are ignored.
    """
    predict = prediction(docs.sparkSession, filters)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), predict(F.col("text").cast("string")).alias("p"))
            .select("doc_id", "p.lang_pred", "p.score"))


def learn(docs):
    """Filters from the documents that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
