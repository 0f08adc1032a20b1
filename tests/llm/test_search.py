"""Top-k search against brute force, and the queries next to their SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import cover_tree, queries

from .conftest import SMALL


def brute(rows, k):
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(64 * x) for x in v]
            clean[i] = min(clean.get(i, v), v)
    width = max(map(len, clean.values()))
    full = {i: np.array(v + [0] * (width - len(v)), object) for i, v in clean.items()}
    out = set()
    for q in full:
        if q % 5 == 0:
            scored = sorted((-int(full[q] @ v), i) for i, v in full.items() if i != q)[:k]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("block, cell, leaves", [(8192, 32768, 128), (4, 9, 16)])
def test_top_k_against_brute_force(spark, monkeypatch, block, cell, leaves):
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", block)
    monkeypatch.setattr(cover_tree, "DATA_CELL", cell)
    r = random.Random(2)
    centres = [[r.gauss(0, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in centres[i % 5]]) for i in range(150)]
    rows += [(i, list(centres[0])) for i in range(150, 190)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (505, [1.0, 2.0]), (7, [0.0] * 6), rows[3], (None, [1.0] * 6), (510, [1e12] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (3, 400):
        got = cover_tree.top_k(cover_tree.quantised(frame, "vec_id", "embedding"), F.col("id") % 5 == 0, k, max_leaves=leaves)
        assert {tuple(x) for x in got.collect()} == brute(rows, k)


def test_pairs_are_pruned():
    r = np.random.default_rng(0)
    centres = r.normal(0, 400, (20, 4))
    points = np.concatenate([c + r.normal(0, 3, (50, 4)) for c in centres]).astype(np.int64)
    tree = cover_tree.Tree(points, 32)
    leaf = tree.leaf_of(points)
    away = np.linalg.norm(points - tree.leaves[leaf], axis=1)
    radius = tree.radii({int(x): float(away[leaf == x].max()) for x in np.unique(leaf)})
    score = points @ points.T
    kth = np.sort(score, axis=1)[:, -11]
    worst = np.full(len(tree.parent), np.inf)
    for x in np.unique(leaf):
        node = tree.first_leaf + int(x)
        while node >= 0:
            worst[node] = min(worst[node], kth[leaf == x].min())
            node = tree.parent[node]
    left = set(tree.pairs(radius, radius, worst))
    assert len(left) < 0.5 * len(np.unique(leaf)) ** 2
    for q in range(0, len(points), 37):
        for x in np.flatnonzero(score[q] >= kth[q]):
            assert (int(leaf[q]), int(leaf[x])) in left


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cover_tree.top_k(cover_tree.quantised(frame, "vec_id", "embedding"), F.col("id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert cover_tree.top_k(cover_tree.quantised(one, "vec_id", "embedding"), F.col("id") % 5 == 0).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_next_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
