"""Exact search against all products."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from namesieve.llm import catalog, metric_tree

SF = "/root/testdata/sf0.001"


def plain(rows, k, every):
    """Rows (id, vector); the k best of each query as (query, rank, id, score)."""
    rows = [(i, v) for i, v in rows if v is not None and None not in v]
    out = []
    asked = {}
    for i, v in rows:
        if i is not None and i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    for i, v in asked.items():
        hits = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for j, w in rows if j != i and len(w) == len(v)]
        out += [(i, n + 1, j, -s) for n, (s, _, _, j) in enumerate(sorted(hits, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def searched(spark, rows, k, every):
    table = spark.createDataFrame(rows, "key long, v array<long>").selectExpr("*", "1 AS id", "2 AS region", "3 AS score")
    found = metric_tree.top_k(table, table["key"] % every == 0, k, "key", "v")
    return sorted((tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_ties_nulls_lengths_repeats_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-3, 4, (300, 3)))]
    rows += [(i, [1, 1, 1]) for i in range(300, 400)] + [(10, [2, 2, 2]), (10, [2, 2, 2]), (None, [3, 3, 3]), (None, [3, 3, 3])]
    rows += [(500, None), (510, [1, None, 2]), (520, []), (521, []), (530, [4]), (531, [5]), (540, [1, 2])]
    assert searched(spark, rows, 5, 10) == plain(rows, 5, 10)
    assert searched(spark, rows[:0], 5, 10) == [] and searched(spark, [(1, [1])], 5, 10) == []


def test_components_that_no_double_holds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-(2**30), 2**30, (120, 4)))]
    assert searched(spark, rows, 3, 7) == plain(rows, 3, 7)


def test_a_region_of_many_pages(spark):
    rng = np.random.default_rng(7)
    near = rng.integers(-2, 3, (9000, 6)) + [50, 0, 0, 0, 0, 0]
    rows = [(i, v.tolist()) for i, v in enumerate(near)]
    assert searched(spark, rows, 5, 900) == plain(rows, 5, 900)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 8]), st.sampled_from([1, 5, 40]), st.booleans())
def test_page_search(seed, dim, k, clustered):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    x = rng.integers(-9, 10, (n, dim)) + (rng.integers(-90, 90, (4, dim))[rng.integers(0, 4, n)] if clustered else 0)
    longest = float((x * x).sum(1).max())
    space = metric_tree.Space([x[0].tolist()], longest, int(np.abs(x).max()))
    pivot = x[0].astype(float)
    dist = space.between(x.astype(float), pivot[None])[:, 0]
    page = metric_tree.Page(space, pivot, np.arange(n), x, dist)
    products = x @ x[-1]
    expected = [(-s, i) for s, i in sorted((-s, i) for i, s in enumerate(products.tolist()) if i != n - 1)[:k]]
    floors = [None] + ([expected[-1][0]] if len(expected) == k else [])
    for floor in floors:
        ids, scores = page.search(n - 1, x[-1], floor, k)
        assert sorted(zip(scores.tolist(), ids.tolist()), key=lambda p: (-p[0], p[1])) == expected


def test_stored_distances_save_computing_them():
    rng = np.random.default_rng(8)
    x = np.rint(rng.standard_normal((60, 16)) * 100)[rng.integers(0, 60, 4000)] + rng.integers(-3, 4, (4000, 16))
    x = np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * 256).astype(np.int64)
    space = metric_tree.Space([x[0].tolist()], float((x * x).sum(1).max()), 256)
    page = metric_tree.Page(space, None, np.arange(4000), x, np.zeros(4000))
    for i in range(0, 4000, 100):
        page.search(i, x[i], None, 5)
    assert page.computed < 40 * 4000 / 4


@pytest.mark.parametrize("k", [5])
def test_query_equals_all_products(spark, k):
    rows = []
    for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist():
        v = r["embedding"]
        ok = v is not None and all(c is not None and math.isfinite(c) for c in v)
        rows.append((r["vec_id"], [math.floor(256 * c) for c in v] if ok else None))
    got = sorted((tuple(r) for r in catalog.op13_metric_tree(spark, SF).collect()), key=repr)
    assert got == plain(rows, k, 50) and got
