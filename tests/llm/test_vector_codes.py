"""Product codes of vectors against brute force."""

import random

import numpy as np
import pytest

from jobstrata.llm import vector_codes
from jobstrata.llm.queries import ORACLES, QUERIES
from tests.compare import compare
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, code string, entry int, part int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 1, 1, 1) for i, v, label in rows], SCHEMA)


def test_orchard_finds_the_lowest_of_the_nearest():
    rng = np.random.default_rng(3)
    for spread in (2, 5, 200):
        books = rng.integers(-spread, spread + 1, (4, 40, 3))
        points = rng.integers(-spread - 1, spread + 2, (300, 4, 3))
        index, distance = vector_codes.Orchard(books).nearest(points)
        every = ((points[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        assert (index == every.argmin(axis=2)).all() and (distance == every.min(axis=2)).all()


def test_query_equals_sql(spark, con, sf_dir):
    assert compare(spark, con, "op13_vector_codes", QUERIES["op13_vector_codes"], ORACLES["op13_vector_codes"], sf_dir) == ""


@pytest.mark.parametrize("size", [5, 64, 300])
def test_codes_equal_brute_force(spark, size):
    rng = random.Random(size)
    rows = [(rng.randrange(10 * size) if n > 3 else n, [rng.choice([0.0, 0.01, -0.4, rng.uniform(-1, 1)]) for _ in range(32)],
             rng.choice([None, 1, 2])) for n in range(size)]
    rows += rows[:3]  # repeated rows
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want, digest = brute.vector_codes([(i, v) for i, v, _ in rows])
    got = vector_codes.compress(frame(spark, rows)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted((rows[n][0], *c) for n, c in want.items())
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = {}
    for n, (_, error) in want.items():
        sums[rows[n][2]] = sums.get(rows[n][2], 0) + error
    assert {r.label_error for r in got} == set(sums.values()) and sum(r.error for r in got) == sum(sums.values())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5] * 16
    rows = [(1, good, 1), (1, good, 1), (2, None, 1), (3, [nan] * 16, 1), (4, [0.1] * 15 + [inf], 1), (5, [None] + [0.1] * 15, 1),
            (None, [0.25] * 16, None), (6, [3e38] * 16, 2), (7, [], 2), (8, [0.5] * 10, None), (9, [-0.5] * 20, 2)]
    got = vector_codes.compress(frame(spark, rows)).collect()
    assert sorted((r.vec_id for r in got), key=str) == [1, 1, 6, 7, 8, 9, None]
    assert all(len(r.code) == 32 for r in got) and len({r.codebooks_sha256 for r in got}) == 1
    assert vector_codes.compress(frame(spark, rows[2:6])).count() == 0
    assert vector_codes.compress(frame(spark, [])).count() == 0
