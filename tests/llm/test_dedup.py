"""Near-duplicates and repeated passages against brute force."""

import random

import pytest

from jobstrata.llm.components import components
from jobstrata.llm.near_dedup import near_duplicates
from jobstrata.llm.suffix_dedup import minimisers, repeated_passages, without_repeats
from tests.llm import brute


def family(seed, size):
    """Copies of a few texts with more and more words changed, so that some links hold and others do not."""
    rng = random.Random(seed)
    out = []
    for number in range(size):
        base = random.Random(number % 4)
        text = [f"w{base.randint(0, 500)}" for _ in range(150)]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 10, 20])):
            text[rng.randrange(len(text))] = f"n{rng.randint(0, 10**6)}"
        out.append((number, " ".join(text)))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_lose_no_link(spark, percent):
    docs = family(percent, 150)
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()}
    want = brute.near_components(docs, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) and r.n_shingles == len(brute.shingles(dict(docs)[i])) for i, r in got.items())
    assert 4 < len(set(want.values())) < 130


def test_near_duplicate_edges(edge_docs, no_docs):
    rows = near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {i for i, r in by_id.items() if r.component_id == 1} == {1, 2, 3, 12, 13}
    assert by_id[4].n_shingles == by_id[5].n_shingles == by_id[6].n_shingles == 0 and by_id[4].kept and by_id[5].kept
    assert by_id[8].n_shingles == 1 and by_id[7].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    above = {}

    def top(i):
        while above.get(i, i) != i:
            i = above[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in nodes}


def repeats_of(rows, kind):
    out = {}
    for r in rows:
        if r.kind == kind:
            out.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    return {i: sorted(x) for i, x in out.items()}


def test_repeated_passages(spark):
    rng = random.Random(5)
    shared = [[f"s{k}x{i}" for i in range(n)] for k, n in enumerate((49, 50, 51, 80, 130))]
    docs = []
    for number in range(60):
        text = []
        for _ in range(3):
            text += [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 60))]
            piece = rng.choice(shared)
            cut = rng.choice([0, 0, 5, 40])
            text += piece[cut:] if rng.random() < 0.8 else piece + piece
        docs.append((number, rng.choice([" ", "\n", "  "]).join(text)))
    docs.append((100, "again " * 200))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = repeated_passages(frame).collect()
    repeat, cut = brute.repeated_words(docs)
    assert repeats_of(rows, "repeat") == {i: brute.stretches(x) for i, x in repeat.items()}
    assert repeats_of(rows, "cut") == {i: brute.stretches(x) for i, x in cut.items() if x}
    left = {r.doc_id: brute.words(r.text) for r in without_repeats(frame).collect()}
    want = {i: [w for k, w in enumerate(brute.words(t)) if k not in cut.get(i, ())] for i, t in docs}
    assert left == {i: w for i, w in want.items() if w}


def test_passage_edges(edge_docs, no_docs):
    rows = repeated_passages(edge_docs).collect()
    assert {r.doc_id for r in rows if r.kind == "repeat"} == {1, 3, 9, 12, 13}
    assert repeats_of(rows, "repeat")[12] == [(3, 123)]
    assert 1 not in repeats_of(rows, "cut") and repeats_of(rows, "cut")[13] == [(0, 120)]
    left = without_repeats(edge_docs)
    assert left.columns == edge_docs.columns
    texts = {r.doc_id: r for r in left.collect() if r.doc_id is not None}
    assert brute.words(texts[12].text) == "intro words here and a tail".split() and texts[12].n_chars == len(texts[12].text)
    assert 13 not in texts and texts[4].text is None and texts[5].text == ""
    assert repeated_passages(no_docs).count() == 0 and without_repeats(no_docs).count() == 0


def test_minimisers():
    import numpy as np

    order = np.random.default_rng(0).integers(0, 20, 300).astype(np.uint64)
    for width in (1, 2, 7, 31):
        want = [i + int(np.argmin(order[i:i + width])) for i in range(len(order) - width + 1)]
        assert minimisers(order, width).tolist() == want
