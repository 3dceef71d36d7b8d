"""Repeated passages by a sparse suffix array over minimiser positions."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from jobstrata.llm import arrays
from jobstrata.llm.shared import saved

#: Shortest repeated passage in words, and the words by which suffixes are sorted first.
PASSAGE, PREFIX = 50, 20
#: Repeated prefixes that a task reads at least, where there are so many.
KEYS = 200_000


def _text(docs):
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null and text is not null")


def _hashed(column):
    """Running hash over the word hashes of a column, and the word number at each text offset."""
    data, offsets = arrays.utf8(column)
    starts, ends, firsts = arrays.words(data, offsets)
    return arrays.running(arrays.word_hashes(data, starts, ends)), firsts


def minimisers(order, width):
    """Place of the smallest of each `width` neighbouring values, the leftmost if several are."""
    best, reach = np.arange(len(order)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(order[right] < order[left], right, left)
        reach += step
    return best


def suffixes(docs, passage=PASSAGE, prefix=PREFIX):
    """The retained suffixes: h (hash of the first `prefix` words), s (hash of the whole segment), doc_id, start, windows.

    A window is a run of `passage` words. Its suffix starts at the smallest prefix hash inside, which depends
    on the window's words only, so equal windows keep suffixes at equal places. Neighbouring windows with the
    same suffix form a segment: `windows` windows from word `start` on.
    """
    schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])
    width = passage - prefix + 1

    def run(batches):
        for batch in arrays.pieces(batches, "text"):
            running, firsts = _hashed(batch.column("text"))
            total = firsts[-1]
            if total < passage:
                continue
            at = np.arange(total - prefix + 1)
            order = arrays.span_hash(running, at, at + prefix)
            chosen = minimisers(order, width)
            owner = arrays.owners(firsts)[:len(chosen)]
            inside = np.arange(len(chosen)) + passage <= firsts[1:][owner]
            begin = np.flatnonzero(inside)
            if not len(begin):
                continue
            place, row = chosen[begin], owner[begin]
            fresh = np.ones(len(begin), bool)
            fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(fresh)
            count = np.diff(np.append(first, len(begin)))
            start, place, row = begin[first], place[first], row[first]
            segment = arrays.span_hash(running, start, start + count + passage - 1)
            yield arrays.record_batch(schema, arrays.signed(order[place]), arrays.signed(segment), batch.column("doc_id").take(pa.array(row)),
                                      (start - firsts[row]).astype(np.int32), count.astype(np.int32))
        arrays.release()

    return _text(docs).mapInArrow(run, "h long, s long, doc_id long, start int, windows int")


def _extended(docs, wanted, passage):
    """All windows of the wanted segments: their suffix, window hash and place."""
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32())])

    def run(batches):
        for batch in arrays.pieces(batches, "text"):
            running, firsts = _hashed(batch.column("text"))
            segments = batch.column("segments")
            rows = np.repeat(np.arange(len(batch)), np.diff(np.asarray(segments.offsets)))
            flat = segments.flatten()
            h, start, windows = (np.asarray(flat.field(n)) for n in ("h", "start", "windows"))
            which = np.repeat(np.arange(len(h)), windows)
            begin = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = begin + firsts[rows[which]]
            yield arrays.record_batch(schema, h[which], arrays.signed(arrays.span_hash(running, at, at + passage)),
                                      batch.column("doc_id").take(pa.array(rows[which])), begin.astype(np.int32))
        arrays.release()

    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "windows")).alias("segments"))
    return _text(docs).join(by_doc, "doc_id").mapInArrow(run, "h long, w long, doc_id long, start int")


def repeats(docs, passage=PASSAGE, prefix=PREFIX):
    """Word intervals (doc_id, start, stop, later) that occur twice or more; `later` if an earlier place has them too.

    Suffixes are sorted by prefix and segment, so that equal ones are neighbours: equal segments repeat as
    a whole. Where a prefix has different segments, one of each is extended to the left and to the right,
    window by window, and windows are compared in the same way; what they share is repeated, too. Earlier
    means the smaller (doc_id, place). Hot passages are aggregated to their first and last place before
    anything is joined.
    """
    place, mark = F.struct("doc_id", "start"), F.xxhash64("doc_id", "start")
    every = suffixes(docs, passage, prefix)  # read twice rather than kept: most prefixes occur once
    # kept for itself, so that both sides of the join are plain shuffles and a hot prefix is split
    twice = saved(every.groupBy("h").agg(F.min(mark).alias("one"), F.max(mark).alias("other")).where("one <> other").select("h"), KEYS)
    found = saved(every.join(twice, "h"))
    segments = found.groupBy("h", "s").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.min("windows").alias("windows"))
    marks = saved(segments.join(segments.groupBy("h").agg(F.count("*").alias("kinds")), "h"))
    wanted = marks.where("kinds > 1").select("h", "low.doc_id", "low.start", "windows")
    windows = saved(_extended(docs, wanted, passage))
    shared = windows.groupBy("h", "w").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high")
    whole = found.join(marks.where("low < high").select("h", "s", "low"), ["h", "s"]).select(
        "doc_id", "start", (F.col("start") + F.col("windows") + passage - 1).alias("stop"), (place != F.col("low")).alias("later"))
    partly = windows.join(shared.select("h", "w", "low"), ["h", "w"]).select(
        "doc_id", "start", (F.col("start") + passage).alias("stop"), (place != F.col("low")).alias("later"))
    return whole.union(partly)


def _merged(intervals):
    """Sorted intervals with overlaps and neighbours joined."""
    start = F.struct(F.array().cast("array<struct<start:int,stop:int>>").alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"))

    def closed(a):
        return F.when(a["stop"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["stop"].alias("stop")))))

    def step(a, x):
        return F.when((a["stop"] >= 0) & (x["start"] <= a["stop"]), F.struct(
            a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["stop"], x["stop"]).alias("stop"))).otherwise(
            F.struct(closed(a).alias("done"), x["start"].alias("start"), x["stop"].alias("stop")))

    return F.aggregate(F.array_sort(intervals), start, step, closed)


def spans(found):
    """One row for each document with repeats: doc_id, repeated and cut, lists of word intervals (start, stop)."""
    interval = F.struct("start", "stop")
    lists = found.distinct().groupBy("doc_id").agg(
        F.collect_list(interval).alias("repeated"), F.collect_list(F.when(F.col("later"), interval)).alias("cut"))
    return lists.select("doc_id", _merged(F.col("repeated")).alias("repeated"), _merged(F.col("cut")).alias("cut"))


def repeated_passages(docs, passage=PASSAGE, prefix=PREFIX):
    """Rows (doc_id, kind, start_word, end_word, n_words) of the documents that hold repeated passages.

    Words are runs outside ASCII white space, compared as they stand; a passage is repeated if its words
    occur in a row at another place, in another document or in the same one. Kind `repeat`: the longest stretches of
    words that lie in repeated passages; kind `cut`: of words in passages that occur before (smaller doc_id, then place).
    Documents without repeats, with fewer words than a passage, null texts and null ids give no rows; nor
    does an empty table. Rows that share an id are one document, so a repeated row is no repeat. Other columns are ignored.
    """
    rows = spans(repeats(docs, passage, prefix))
    tagged = [F.transform(F.col(column), _tag(kind)) for column, kind in (("repeated", "repeat"), ("cut", "cut"))]
    return rows.select("doc_id", F.explode(F.concat(*tagged)).alias("p")).select(
        "doc_id", "p.kind", "p.start_word", "p.end_word", (F.col("p.end_word") - F.col("p.start_word")).alias("n_words"))


def _tag(kind):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].cast("long").alias("start_word"), x["stop"].cast("long").alias("end_word"))


def without_repeats(docs, passage=PASSAGE, prefix=PREFIX):
    """The documents with the words of later copies cut out of their texts; texts left without a word are dropped.

    All columns of `docs` return; a column n_chars is counted anew where a text is cut. Rows with a null text or id and
    texts without repeats stay as they are.
    """
    cuts = spans(repeats(docs, passage, prefix)).where(F.size("cut") > 0).select(F.col("doc_id").alias("_cut_id"), F.col("cut").alias("_cut"))

    @F.pandas_udf("string")
    def remove(texts: pd.Series, spans_of: pd.Series) -> pd.Series:
        out = []
        for text, cut in zip(texts, spans_of):
            if not isinstance(text, str):
                out.append(None)
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, _, _ = arrays.words(raw, np.array([0, len(raw)]))
            bounds = np.append(starts, len(raw)).tolist()
            kept, last = [], 0
            for span in cut:
                kept.append(raw[last:bounds[span["start"]]])
                last = bounds[span["stop"]]
            out.append(np.concatenate([*kept, raw[last:]]).tobytes().decode())
        arrays.release()
        return pd.Series(out)

    joined = docs.join(cuts, F.col("doc_id").cast("long") == F.col("_cut_id"), "left").withColumn(
        "_left", remove(F.when(F.col("_cut").isNotNull(), F.col("text")), "_cut"))
    changed = {"text": F.coalesce("_left", "text")}
    if "n_chars" in docs.columns:
        counted = F.length("_left").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("_left").isNotNull(), counted).otherwise(F.col("n_chars"))
    return joined.where(F.col("_left").isNull() | F.col("_left").rlike(r"[^\x20\x09-\x0D]")).withColumns(changed).select(docs.columns)
