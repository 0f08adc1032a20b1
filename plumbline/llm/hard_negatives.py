"""Hard negatives for contrastive training, scored exactly by the method of the Four Russians.

Vectors are rows of integers. The dimensions are cut into groups of eight. For an anchor,
the 256 sums over subsets of a group's components are a table; a candidate's components
are cut into bit planes, so each plane of a group is one byte, which says which subset of
the anchor's components the plane adds. Looked up for all groups, shifted by the plane and
added (the sign's plane is subtracted), the table entries make the full inner product,
without a multiplication. A candidate is only its bit planes from then on: at nine bits a
component, 72 bytes for 64 dimensions.

Anchors and candidates meet in blocks. Positives are searched among candidates of the
anchor's label only; negatives among all others, between bounds that the positive's score
sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .columns import vector_matrix

GROUP = 8
#: Anchors and candidates of a block; of each that are scored at a time.
ANCHORS, CANDIDATES = 2048, 16384
ANCHORS_AT_ONCE, CANDIDATES_AT_ONCE = 256, 512

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def planes_of(v: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of two's complement, packed: (rows, planes, groups) bytes; bit i of a byte is dimension i of its group."""
    return np.stack([np.packbits(((v >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)], axis=1)


def tables_of(anchors: np.ndarray, kind) -> np.ndarray:
    """Subset sums of every group of components: (groups, 256, anchors)."""
    a = anchors.astype(kind).reshape(len(anchors), -1, GROUP)
    out = np.zeros((a.shape[1], 1 << GROUP, len(anchors)), kind)
    for i in range(GROUP):
        out[:, 1 << i:2 << i] = out[:, :1 << i] + a[:, :, i].T[:, None, :]
    return out


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors) from the anchors' tables and the candidates' planes."""
    planes = packed.shape[1]
    total = np.zeros((len(packed), tables.shape[2]), tables.dtype)
    for p in range(planes - 1, -1, -1):
        part = tables[0][packed[:, p, 0]]
        for g in range(1, packed.shape[2]):
            part += tables[g][packed[:, p, g]]
        total += total
        total = total - part if p == planes - 1 else total + part
    return total


def kind_for(bits: int, other_bits: int, width: int):
    """The narrowest integers that hold every partial sum; Python's own beyond 64 bits."""
    need = bits + other_bits + max(1, width - 1).bit_length()
    return np.int32 if need <= 31 else np.int64 if need <= 63 else object


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", factor: float = 256.0) -> DataFrame:
    """(id, label, v): floor(factor * component) as long, at the ends of a long beyond them. Rows with a null or non-finite part are left out.

    One row per id: the least (label, v).
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * factor).cast("long"))
    kept = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & finite)
    return kept.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v")).groupBy("id").agg(
        F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _packed(column: pa.Array, planes: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(column), planes, -1)


def _blocks(left: pa.Table, right: pa.Table, planes: int, bits: int, width: int):
    """(rows of anchors, rows of candidates, scores) piece by piece."""
    anchors = vector_matrix(left.column("v"), width)
    packed = _packed(right.column("packed"), planes)
    kind = kind_for(planes, bits, width)
    for a in range(0, len(anchors), ANCHORS_AT_ONCE):
        tables = tables_of(anchors[a:a + ANCHORS_AT_ONCE], kind)
        for c in range(0, len(packed), CANDIDATES_AT_ONCE):
            found = scores(tables, packed[c:c + CANDIDATES_AT_ONCE])
            if kind is object:
                found = np.clip(found, LOW, HIGH).astype(np.int64)
            yield a, c, found.T


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has (id, label, v) as ``quantised`` gives them; ``is_anchor`` is a condition on
    id. An anchor's positives are its first rows of the same label by score, ties to the
    smaller id; a positive's negatives are the first rows of another label of which 100
    times the score lies between the two per cents of the positive's. Neither is cut short
    but by what there is. Vectors of unequal length are filled up with zeros; scores beyond
    a long count as its ends. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = cut_lineage(rows.withColumn("anchor", is_anchor), "labelled")
    longest = F.max(F.size("v"))
    least, most, width = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), longest).first()
    if width is None:
        return spark.createDataFrame([], result)
    width = max(GROUP, -(-width // GROUP) * GROUP)
    planes = max((least or 0).bit_length() if (least or 0) >= 0 else (-(least or 0) - 1).bit_length(), (most or 0).bit_length()) + 1
    bits = planes

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = planes_of(vector_matrix(batch.column("v"), width), planes).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in data], pa.binary())], names=["id", "label", "packed"])

    packed = cut_lineage(rows.select("id", "label", "v").mapInArrow(pack, "id long, label long, packed binary"), "planes")
    of_label = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors"))
    cut = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("long")
    parts = of_label.select("label", cut("rows", CANDIDATES).alias("cells"), cut("anchors", ANCHORS).alias("blocks"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    pair = lambda label, b, c: F.concat_ws("/", *[x.cast("string") for x in (label, b, c)])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    anchors = rows.filter("anchor").select("id", "label", "v")
    a = anchors.join(parts, "label").withColumn("b", place("blocks")).withColumn("c", every("cells"))
    c = packed.join(parts.filter("blocks > 0"), "label").withColumn("c", place("cells")).withColumn("b", every("blocks"))
    a, c = (x.withColumn("pair", pair(F.col("label"), F.col("b"), F.col("c"))) for x in (a, c))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of one cell for each anchor, itself left out."""
        a_id, c_id = left.column("id").to_numpy(), right.column("id").to_numpy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in a_id]
        worst = np.full(len(a_id), LOW)
        for at, ct, found in _blocks(left, right, planes, bits, width):
            ids = c_id[ct:ct + found.shape[1]]
            able = (found >= worst[at:at + len(found), None]) & (a_id[at:at + len(found), None] != ids[None, :])
            for i in np.flatnonzero(able.any(1)).tolist():
                pick = np.flatnonzero(able[i])
                best[at + i] = s, d = _first(np.concatenate((best[at + i][0], found[i, pick])), np.concatenate((best[at + i][1], ids[pick])), positives)
                if len(s) == positives:
                    worst[at + i] = s[-1]
        sizes = [len(s) for s, _ in best]
        return pa.table({"anchor_id": np.repeat(a_id, sizes), "positive_id": np.concatenate([np.zeros(0, np.int64), *(d for _, d in best)]),
                         "positive_score": np.concatenate([np.zeros(0, np.int64), *(s for s, _ in best)])})

    near = a.select("pair", "id", "v").groupBy("pair").cogroup(c.select("pair", "id", "packed").groupBy("pair")).applyInArrow(
        nearest, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives).drop("n")
    # At most ``positives`` of each anchor.
    wanted = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_score", "positive_id"))).alias("near"))
    asking = cut_lineage(anchors.join(wanted, F.col("id") == F.col("anchor_id")).select(
        "id", "label", "v", F.col("near.positive_id").alias("positive_ids"), F.col("near.positive_score").alias("positive_scores")), "asking")

    blocks, cells = (max(1, -(-frame.count() // size)) for frame, size in ((asking, ANCHORS), (packed, CANDIDATES)))
    a = asking.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    c = packed.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(cells))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    a, c = (x.withColumn("pair", F.concat_ws("/", F.col("b").cast("string"), F.col("c").cast("string"))).drop("b", "c") for x in (a, c))
    low, high = percent

    def negative(left: pa.Table, right: pa.Table) -> pa.Table:
        """The first rows of one cell between the bounds of each anchor and positive."""
        a_id, c_id = left.column("id").to_numpy(), right.column("id").to_numpy()
        a_label, c_label = left.column("label").to_numpy(), right.column("label").to_numpy()
        near_ids, near_scores = left.column("positive_ids").to_pylist(), left.column("positive_scores").to_pylist()
        bounds = [[(-(-low * s // 100), high * s // 100) for s in some] for some in near_scores]
        best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in some] for some in near_ids]
        least = np.array([min((b for b, _ in some), default=HIGH) for some in bounds], object)
        top = np.array([max((b for _, b in some), default=LOW) for some in bounds], object)
        least, top = np.clip(least, LOW, HIGH).astype(np.int64), np.clip(top, LOW, HIGH).astype(np.int64)
        for at, ct, found in _blocks(left, right, planes, bits, width):
            rows_a = slice(at, at + len(found))
            ids, labels = c_id[ct:ct + found.shape[1]], c_label[ct:ct + found.shape[1]]
            able = (found >= least[rows_a, None]) & (found <= top[rows_a, None]) & (a_label[rows_a, None] != labels[None, :])
            for i in np.flatnonzero(able.any(1)).tolist():
                pick = np.flatnonzero(able[i])
                s, d = found[i, pick], ids[pick]
                for j, (lo, hi) in enumerate(bounds[at + i]):
                    held = best[at + i][j]
                    if len(held[0]) == negatives:
                        lo = max(lo, int(held[0][-1]))
                    ok = (s >= lo) & (s <= hi)
                    if ok.any():
                        best[at + i][j] = _first(np.concatenate((held[0], s[ok])), np.concatenate((held[1], d[ok])), negatives)
        out = [(x, p, q, int(n), int(m)) for x, ps, qs, some in zip(a_id.tolist(), near_ids, near_scores, best) for p, q, (ms, ns) in zip(ps, qs, some) for n, m in zip(ns, ms)]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), columns)})

    found = a.groupBy("pair").cogroup(c.groupBy("pair")).applyInArrow(negative, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= cut
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]
