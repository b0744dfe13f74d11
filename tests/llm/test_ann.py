"""Nearest-neighbour search where the table is larger than the sample, and for odd ids."""

from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import spann

from . import brute


def _found(df, **options):
    got = defaultdict(list)
    for r in spann.search(df, lambda i: i % 20 == 0, **options).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("kind", ["clusters", "random", "copies"])
def test_more_rows_than_the_sample(spark, kind):
    rng, n = np.random.default_rng(6), 3000
    centres = rng.normal(size=(40, 24))
    x = {"clusters": centres[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 24)), "random": rng.normal(size=(n, 24)), "copies": centres[rng.integers(0, 40, n)]}[kind]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = _found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list_rows=32, sample_rows=300, block=500)
    want, hits = brute.nearest(rows, 20, lambda i: i % 20 == 0), 0
    assert got.keys() == want.keys()
    for q, mine in got.items():
        assert len(mine) == 20 and len({v for v, _ in mine}) == 20
        assert all(s == float((x[q] * x[v]).sum()) for v, s in mine)
        assert mine == sorted(mine, key=lambda r: (-r[1], r[0]))
        hits += sum(s >= want[q][-1][1] for _, s in mine)
        if kind == "copies":  # ties go to the smaller id
            assert [v for v, s in mine if s > want[q][-1][1]] == [v for v, s in want[q] if s > want[q][-1][1]]
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_repeated_and_null_ids(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 8))
    once = [(i, v.tolist()) for i, v in enumerate(x)]
    rows = once + [once[0]] * 300 + [once[7]] * 50 + [(None, x[3].tolist())] * 30
    got = _found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list_rows=16, sample_rows=100)
    want = brute.nearest(once, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    assert all(len({v for v, _ in mine}) == 20 for mine in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_the_degree_is_bounded():
    near = np.zeros((500, 4), np.int64)  # all name the first four: a hub
    near[:] = [0, 1, 2, 3]
    wide = spann.linked(near, 4)
    assert wide.shape[1] <= 9
    assert all((i + 1) % 500 in wide[i] for i in range(500))
