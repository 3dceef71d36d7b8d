"""Periodic runs against brute force."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from jobstrata.llm import periodic_runs
from jobstrata.llm.queries import QUERIES
from tests.llm import brute


def drawn(rng, size, letters):
    w = [rng.randrange(1, letters + 1) for _ in range(size)]
    for _ in range(rng.randrange(3)):
        if size > 8:
            a, p = rng.randrange(size), rng.randrange(1, 7)
            for i in range(a, min(size, a + rng.randrange(50))):
                w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize(("exponent", "shortest"), [(2, 2), (3, 4), (4, 6)])
def test_runs_equal_brute_force(exponent, shortest):
    rng = random.Random(exponent)
    for _ in range(600):
        w = drawn(rng, rng.randrange(70), rng.choice([1, 2, 3, 6, 50]))
        assert [tuple(r) for r in periodic_runs.runs(w, exponent, shortest).tolist()] == brute.runs(w, exponent, shortest)


def test_tree_answers_common_prefixes():
    rng = random.Random(2)
    for letters in (1, 2, 4, 40):
        w = drawn(rng, 90, letters)
        tree = periodic_runs.SuffixTree(w)
        i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(91), np.arange(91)))
        i, j = i[i != j], j[i != j]

        def common(a, b):
            n = 0
            while max(a, b) + n < 90 and w[a + n] == w[b + n]:
                n += 1
            return n

        assert tree.common(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]
        suffixes = sorted(range(91), key=lambda x: w[x:])
        assert np.argsort(tree.rank).tolist() == suffixes


@pytest.mark.parametrize(("exponent", "shortest"), [(2, 2), (3, 5), (4, 6)])
def test_find_runs_equals_brute_force(spark, exponent, shortest):
    rng = random.Random(11)
    docs = [(i, rng.choice(["", " ", "\n\t"]) + "  ".join(f"w{x}" for x in drawn(rng, rng.randrange(160), rng.choice([2, 4, 60, 900]))))
            for i in range(250)]
    got = {r.doc_id: r for r in periodic_runs.find_runs(spark.createDataFrame(docs, "doc_id long, text string"), exponent, shortest).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        w = brute.words(text)
        want = brute.runs(w, exponent, shortest)
        assert [tuple(x) for x in got[i].runs] == want
        assert got[i].collapsed == brute.collapsed(w, want) and got[i].n_words == len(w)


def expected(doc_id, text):
    w = brute.periodic_tail(doc_id, text)
    found = brute.runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(brute.collapsed(w, found).encode()).hexdigest())


def test_query_equals_brute_force(spark, sf_dir):
    """Texts of up to 1200 words against brute force over every period; of longer ones, the row count."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = QUERIES["op12_periodic_runs"](spark, sf_dir)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r) for r in df.collect()}
    assert len(got) == len(docs)
    short = [(i, t) for i, t in docs if len(brute.words(t)) <= 1200]
    want = {i: expected(i, t) for i, t in short}
    assert len(want) > 150 and {i: got[i] for i in want} == want
    assert sum(row[1] > 0 for row in want.values()) > 10


def test_edges(spark, edge_docs, no_docs):
    rows = periodic_runs.find_runs(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[4].n_words == by_id[5].n_words == by_id[6].n_words == 0 and by_id[4].runs == [] and by_id[4].collapsed == ""
    assert [tuple(r) for r in by_id[9].runs] == [(1, 20_000, 1)] and by_id[9].collapsed == "x" * 50_000 + " tok"
    assert periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_periodic_tails(no_docs))).count() == 0
    digests = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_periodic_tails(edge_docs))).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.runs_sha256 and r.collapsed_sha256 for r in digests) and len(digests) == len(rows)
    assert all(r.start is None and r.runs_sha256 == empty for r in digests if r.n_runs == 0)
