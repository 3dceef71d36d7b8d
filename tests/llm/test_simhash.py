"""SimHash near-duplicates against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from jobstrata.llm import simhash_dedup
from jobstrata.llm.queries import QUERIES
from tests.llm import brute


def answered(rows):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in rows}


def expected(docs):
    prints = [(i, brute.fingerprint(t)) for i, t in docs]
    linked = brute.fingerprint_components(prints)
    return {i: (f"{f:016x}", linked[i]) for i, f in prints}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op11_simhash_near_dedup"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and answered(rows) == expected(docs)


def near_texts(size):
    """Long copies with few words changed, so that fingerprints differ in few bits, and short texts."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(900)}" for _ in range(400)] for _ in range(3)]
    out = []
    for number in range(size):
        w = list(base[number % 3])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append((number + 5, " ".join(w)))
    return out + [(1000 + i, " ".join(f"s{i}" for _ in range(i))) for i in range(6)] + [(0, "A  b\tC\x0bd"), (2000, "a b c d"), (3, None), (4, " \n")]


def test_near_copies_equal_brute_force(spark):
    docs = near_texts(90)
    got = answered(simhash_dedup.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = expected(docs)
    assert got == want and got[0] == got[2000] and got[3] == got[4] == ("0" * 16, 3)
    sizes = [list(v[1] for v in want.values()).count(c) for c in {v[1] for v in want.values()}]
    assert max(sizes) > 5 and sizes.count(1) > 5


@pytest.mark.parametrize("crowd", [0, 3, 32])
def test_links_of_crowded_keys(spark, crowd):
    """Fingerprints that differ in a few bits of one block: all share keys. Linked as if all were compared."""
    rng = random.Random(9)
    values = {rng.getrandbits(12) ^ (rng.getrandbits(8) << 56) for _ in range(150)} | {0, 1, 3, 7, 1 << 63, (1 << 63) | 1, (1 << 64) - 1}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    found = simhash_dedup.components(simhash_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp long"), crowd=crowd)).collect()
    group = {r.node: r.component for r in found}
    want = brute.fingerprint_components([(s, v) for s, v in signed.items()])
    assert {s: group.get(s, s) for s in signed} == want
    assert 3 < len(set(want.values())) < len(want)


def test_neighbourhoods_are_bounded(spark):
    """All values of 12 bits are near each other; no value gathers more than its 65 neighbours, and all are one class."""
    nodes = spark.range(4096).select(F.col("id").alias("fp"))
    pairs = simhash_dedup._neighbourhoods(nodes, 2)
    assert pairs.count() <= 65 * 4096
    assert {r.component for r in simhash_dedup.components(pairs).collect()} == {0}


def test_long_texts_are_cut(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(3000))
    whole = simhash_dedup._fingerprint(text.encode())
    for chunk in (1, 7, 64, 5000):
        monkeypatch.setattr(simhash_dedup, "CHUNK", chunk)
        assert simhash_dedup._fingerprint(text.encode()) == whole
        for short in (b"", b" ", b"a", b" a \n b ", b"a b  c"):
            assert simhash_dedup._fingerprint(short) % (1 << 64) == brute.fingerprint(short.decode())
    assert whole % (1 << 64) == brute.fingerprint(text)


def test_hash_is_that_of_spark(spark):
    """Spark's xxhash64 has the same seed, so a text of one shingle has its hash as fingerprint."""
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string").withColumn("h", F.lower(F.lpad(F.hex(F.xxhash64("text")), 16, "0")))
    assert simhash_dedup.near_copies(df).head().fingerprint == df.head().h


def test_edges(edge_docs, no_docs):
    rows = simhash_dedup.near_copies(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {i for i, r in by_id.items() if r.component_id == 1} >= {1, 2, 13}
    assert by_id[4].fingerprint == by_id[5].fingerprint == by_id[6].fingerprint == "0" * 16 and by_id[6].component_id == 4
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert simhash_dedup.near_copies(no_docs).count() == 0
