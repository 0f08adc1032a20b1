"""Exact top-k search by inner product, with a cover tree over queries and data together.

The tree's centres come from a bounded sample: each level is a net in which centres are
further apart than the level's radius, and a centre's parent is its nearest centre one
level up. Every row, query or data, belongs to its nearest leaf, and each node knows the
covering radius of the rows below it. For a query node with centre a and radius r and a
data node with centre b and radius s no score is above a.b + r|b| + s|a| + rs. The pair is
pruned, with all pairs below it, if that is under the worst k-th score of the node's
queries, of which the sample gives a lower bound. The pairs of leaves that are left
say which blocks of queries meet which cells of data; there each pair of leaves is
bounded again by the queries' k-th scores so far, and what remains is multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage

SAMPLE_ROWS = 4096
MAX_LEAVES = 128
STEP = 1.3
QUERY_BLOCK = 8192
DATA_CELL = 32768


class Tree:
    """``centres`` of all nodes, level by level; ``parent`` (root: -1); the last level's nodes are the leaves."""

    def __init__(self, points: np.ndarray, max_leaves: int = MAX_LEAVES):
        x = points.astype(np.float64)
        radius = float(np.sqrt(((x - x[0]) ** 2).sum(1).max())) if len(x) else 0.0
        chosen, levels = [0], [[0]]
        while radius > 0:
            radius /= STEP
            near = np.min([((x - x[c]) ** 2).sum(1) for c in chosen], axis=0)
            wider = list(chosen)
            while len(wider) <= max_leaves and near.max() > radius ** 2:
                far = int(np.argmax(near))
                wider.append(far)
                near = np.minimum(near, ((x - x[far]) ** 2).sum(1))
            if len(wider) > max_leaves or near.max() == 0:
                break
            if len(wider) > len(chosen):
                levels.append(wider)
            chosen = wider
        self.centres = x[[i for level in levels for i in level]]
        self.parent, before = [-1], 0
        for above, level in zip(levels[:-1], levels[1:]):
            for i in level:
                self.parent.append(before + int(np.argmin(((x[above] - x[i]) ** 2).sum(1))))
            before += len(above)
        self.first_leaf = before
        self.leaves = self.centres[before:]
        self.children: list[list[int]] = [[] for _ in self.parent]
        for node, parent in enumerate(self.parent):
            if parent >= 0:
                self.children[parent].append(node)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        x = points.astype(np.float64)
        return np.argmin((self.leaves ** 2).sum(1)[None, :] - 2 * (x @ self.leaves.T), axis=1)

    def radii(self, of_leaf: dict[int, float]) -> np.ndarray:
        """Covering radius of every node from the leaves' radii; -1 without rows."""
        out = np.full(len(self.parent), -1.0)
        for leaf, radius in of_leaf.items():
            node = self.first_leaf + leaf
            out[node] = max(out[node], radius)
            reach, up = radius, node
            while self.parent[up] >= 0:
                parent = self.parent[up]
                reach = float(np.linalg.norm(self.centres[node] - self.centres[parent])) + radius
                out[parent] = max(out[parent], reach)
                up = parent
        return out

    def pairs(self, query_radius: np.ndarray, data_radius: np.ndarray, worst: np.ndarray) -> list[tuple[int, int]]:
        """Leaf pairs that a top-k list may need; ``worst``: per node the worst k-th score of its queries."""
        norm = np.linalg.norm(self.centres, axis=1)
        left, todo = [], [(0, 0)]
        while todo:
            q, x = todo.pop()
            if query_radius[q] < 0 or data_radius[x] < 0:
                continue
            most = self.centres[q] @ self.centres[x] + query_radius[q] * norm[x] + data_radius[x] * norm[q] + query_radius[q] * data_radius[x]
            if most < worst[q] - 1e-6 * (1 + abs(most)):
                continue
            down_q, down_x = self.children[q], self.children[x]
            if not down_q and not down_x:
                left.append((q - self.first_leaf, x - self.first_leaf))
            elif down_q and (not down_x or query_radius[q] >= data_radius[x]):
                todo += [(c, x) for c in down_q]
            else:
                todo += [(q, c) for c in down_x]
        return left


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()] if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they are exact there."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def quantised(df: DataFrame, key: str, vector: str, factor: float = 64.0) -> DataFrame:
    """(id, v): floor(factor * component) as long. One row per id (the least vector); incomplete vectors and ids are left out."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * factor).cast("long"))
    return df.filter(F.col(key).isNotNull() & x.isNotNull() & finite).select(F.col(key).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def top_k(rows: DataFrame, is_query, k: int = 20, sample_rows: int = SAMPLE_ROWS, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query with all rows but its own.

    ``rows`` has (id, v) as ``quantised`` gives them, ``is_query`` is a condition on id. Equal
    scores go to the smaller id. A query with fewer than k candidates gets all; an empty
    table gives an empty table; vectors of unequal length are filled up with zeros.
    """
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = cut_lineage(rows, "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], result)
    share = min(1.0, sample_rows / n)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 24)) < int(share * (1 << 24)) + 1).orderBy("id").limit(2 * sample_rows).toArrow()
    if sample.num_rows == 0:
        sample = rows.orderBy("id").limit(1).toArrow()
    sample_ids, sample_v = sample.column("id").to_numpy(), _matrix(sample.column("v"), width)
    tree = Tree(sample_v, max_leaves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            leaf = tree.leaf_of(v) if len(v) else np.zeros(0, np.int64)
            away = np.linalg.norm(v - tree.leaves[leaf], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "is_query")), pa.array(leaf.astype(np.int32)), pa.array(away), _bound(batch, v)],
                                             names=["id", "v", "is_query", "leaf", "away", "kth"])

    def _bound(batch: pa.RecordBatch, v: np.ndarray) -> pa.Array:
        """A lower bound of a query's k-th score, from the sample's rows; null: none."""
        out = [None] * len(v)
        pick = np.flatnonzero(batch.column("is_query").to_numpy(zero_copy_only=False))
        ids = batch.column("id").to_numpy()
        for at in range(0, len(pick), 512):
            some = pick[at:at + 512]
            score = _products(v[some], sample_v)
            usable = score.shape[1] - np.isin(ids[some], sample_ids)
            score[ids[some][:, None] == sample_ids[None, :]] = np.iinfo(np.int64).min
            if score.shape[1] >= k:
                kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                for i, value, count in zip(some.tolist(), kth.tolist(), usable.tolist()):
                    out[i] = value if count >= k else None
        return pa.array(out, pa.int64())

    placed = cut_lineage(rows.withColumn("is_query", is_query).mapInArrow(place, "id long, v array<long>, is_query boolean, leaf int, away double, kth long"), "placed")
    of_leaf = placed.groupBy("leaf").agg(
        F.count("*").alias("n"), F.max("away").alias("radius"), F.count_if("is_query").alias("queries"),
        F.max(F.when(F.col("is_query"), F.col("away"))).alias("query_radius"),
        F.min(F.when(F.col("is_query"), F.coalesce("kth", F.lit(-(1 << 63))))).alias("worst")).collect()  # at most max_leaves rows
    data_radius = tree.radii({r["leaf"]: r["radius"] for r in of_leaf})
    asking = [r for r in of_leaf if r["queries"]]
    query_radius = tree.radii({r["leaf"]: r["query_radius"] for r in asking})
    worst = np.full(len(tree.parent), np.inf)
    for r in asking:
        node = tree.first_leaf + r["leaf"]
        while node >= 0:
            worst[node] = min(worst[node], r["worst"])
            node = tree.parent[node]
    pairs = tree.pairs(query_radius, data_radius, worst)

    def packed(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
        """Leaf -> (first part, parts): small leaves share a part, a large one is dealt over several."""
        out, part, held = {}, 0, 0
        for leaf in sorted(sizes):
            if held and held + sizes[leaf] > most:
                part, held = part + 1, 0
            parts = max(1, -(-sizes[leaf] // most))
            out[leaf] = (part, parts)
            part, held = (part + parts, 0) if parts > 1 else (part, held + sizes[leaf])
        return out

    blocks = packed({r["leaf"]: r["queries"] for r in asking}, QUERY_BLOCK)
    cells = packed({r["leaf"]: r["n"] for r in of_leaf}, DATA_CELL)
    meets: dict[tuple[int, int], None] = {}
    for q, x in pairs:
        for b in range(blocks[q][0], blocks[q][0] + blocks[q][1]):
            for c in range(cells[x][0], cells[x][0] + cells[x][1]):
                meets[b, c] = None
    kind = "part int, to array<string>, leaf int, first int, parts int"

    def routes(place_of: dict, side: int) -> DataFrame:
        to: dict[int, list[str]] = {}
        for pair in meets:
            to.setdefault(pair[side], []).append(f"{pair[0]}/{pair[1]}")
        table = [(p, to.get(p, []), leaf, first, parts) for leaf, (first, parts) in place_of.items() for p in range(first, first + parts)]
        return spark.createDataFrame(table, kind)

    def dealt(source: DataFrame, place_of: dict, side: int) -> DataFrame:
        """Rows to the pairs of parts that they take part in; a bounded table says which."""
        spread = spark.createDataFrame([(leaf, first, parts) for leaf, (first, parts) in place_of.items()], "leaf int, first int, parts int")
        part = (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int")
        return source.join(spread, "leaf").withColumn("part", part).drop("first", "parts").join(
            routes(place_of, side).select("part", "to").distinct(), "part").withColumn("pair", F.explode("to")).drop("part", "to")

    queries = dealt(placed.filter("is_query").select("id", "v", "leaf", "away", "kth"), blocks, 0)
    data = dealt(placed.select(*(F.col(c).alias(c) for c in ("id", "v", "leaf", "away"))), cells, 1)
    norm = np.linalg.norm(tree.leaves, axis=1)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("leaf"), right.sort_by("leaf")
        q, x = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
        q_id, x_id = left.column("id").to_numpy(), right.column("id").to_numpy()
        q_leaf, x_leaf = left.column("leaf").to_numpy(), right.column("leaf").to_numpy()
        q_away, x_away = left.column("away").to_numpy(), right.column("away").to_numpy()
        low = np.iinfo(np.int64).min
        kth = np.array([low if v is None else v for v in left.column("kth").to_pylist()], np.int64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_id]
        for a in np.unique(q_leaf):
            rows_a = np.flatnonzero(q_leaf == a)
            bounds = []
            for b in np.unique(x_leaf):
                rows_b = np.flatnonzero(x_leaf == b)
                r, s = q_away[rows_a].max(), x_away[rows_b].max()
                bounds.append((tree.leaves[a] @ tree.leaves[b] + r * norm[b] + s * norm[a] + r * s, rows_b))
            for most, rows_b in sorted(bounds, key=lambda m: -m[0]):
                open_rows = rows_a[kth[rows_a].astype(np.float64) <= most + 1e-6 * (1 + abs(most))]
                for at in range(0, len(open_rows), 256):
                    some = open_rows[at:at + 256]
                    score = _products(q[some], x[rows_b])
                    score_ok = (score >= kth[some][:, None]) & (q_id[some][:, None] != x_id[rows_b][None, :])
                    for i, row in enumerate(some.tolist()):
                        pick = np.flatnonzero(score_ok[i])
                        if not len(pick):
                            continue
                        s, d = np.concatenate((best[row][0], score[i][pick])), np.concatenate((best[row][1], x_id[rows_b][pick]))
                        if len(s) > k:
                            order = np.lexsort((d, -s))[:k]
                            s, d = s[order], d[order]
                        best[row] = (s, d)
                        if len(s) == k:
                            kth[row] = max(kth[row], int(s.min()))
        sizes = [len(s) for s, _ in best]
        return pa.table({"query_id": np.repeat(q_id, sizes), "vec_id": np.concatenate([np.zeros(0, np.int64), *(d for _, d in best)]),
                         "score": np.concatenate([np.zeros(0, np.int64), *(s for s, _ in best)])})

    found = queries.groupBy("pair").cogroup(data.groupBy("pair")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
