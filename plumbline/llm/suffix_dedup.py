"""Removing repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered through the first ``depth`` (100) bytes only, most significant digit
first, and a group of suffixes that is down to one member needs no further pass. What is
still equal after the last pass are exactly the repeated windows.

To make the first pass small, the digits are read from a landmark on instead of from the
suffix's first byte: among the 24-byte strings in a window, the one with the least hash.
Equal windows have the same landmark at the same place, so ordering by (landmark, place,
rest) puts them together as ordering by their bytes does, and neighbouring windows that
share a landmark travel as one record (a run of about 39 windows).

1. Digit 1, the landmark, deals the runs to buckets; digit 2 is the whole run. A run that
   equals an earlier one repeats in all its windows. A landmark with a single run is done.
2. Only landmarks with several different runs go on (the ends of repeated passages, and
   copies around an edit). Their bytes are fetched, and digit 3 is each window through its
   full depth.

Hot groups: a map task keeps the first of equal runs and reports the others at once, so
copies collapse before the shuffle. A landmark with very many different runs (one passage
in a large part of all documents) is found on a sample; its windows are dealt one by one
by their full depth, where they again collapse or spread. That changes the way, never the
result. Positions are compared by 128 bits of hash (two polynomial hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .columns import lean, slices, text_bytes
from .packing import CHUNK, OUT_AT_ONCE, Hashes, by_bucket, dealt, hashes_of_rows, mix, pack

DEPTH = 100
LANDMARK = 24

#: Low bits of a key that hold the position in a chunk.
PLACE_BITS = 26
LONGEST = (1 << PLACE_BITS) - (1 << 16)

#: Records that a map task collects before it deals them.
RECORDS_AT_ONCE = 250_000

#: Hot landmarks: of the documents in the sample (one in SAMPLE_STEP, all of a small
#: table), so many have different runs of it. There are at most HOT_SHARE times a
#: document's mean number of landmarks, so the list is small enough to ship.
SAMPLE_STEP, SAMPLE_LEAST, HOT_LEAST, HOT_SHARE = 16, 20_000, 64, 20_000

RUN = np.dtype([("mark", "<u8"), ("run", "<u8"), ("doc", "<i8"), ("twin", "<u4"), ("first", "<u4"), ("place", "u1"), ("more", "u1")])
PIECE = np.dtype([("mark", "<u8"), ("doc", "<i8"), ("twin", "<u4"), ("first", "<u4"), ("place", "u1"), ("more", "u1")])

def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have, low = 1, key
    while 2 * have <= width:
        low = np.minimum(low[:len(low) - have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def runs_of(chunk: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int, landmark: int) -> dict[str, np.ndarray] | None:
    """Runs of windows of the texts at ``starts`` in ``chunk``: text, first window, landmark's place, further windows, hashes."""
    if len(chunk) < depth:
        return None
    one = Hashes(chunk, 0)
    marks = one.sliding(landmark)
    place = np.arange(len(marks), dtype=np.uint64)
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    least = _least((marks & ~low_bits) | place, depth - landmark + 1)
    counts = np.maximum(sizes - depth + 1, 0)
    if not counts.any():
        return None
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = np.cumsum(counts) - counts
    window = np.arange(len(text)) - begin[text] + starts[text]
    at = (least[window] & low_bits).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((fresh[1:], [len(at)])) - 1
    first, stop, at = window[fresh], window[last] + depth, at[fresh]
    two = Hashes(chunk, 1)
    shape = ((at - first) * 256 + (window[last] - first)).astype(np.uint64)
    return {"text": text[fresh], "first": first, "place": at - first, "more": window[last] - first, "mark": marks[at],
            "run": two.of(first, stop) ^ mix(shape + np.uint64(1)), "one": one, "two": two}


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a batch in ascending order, about CHUNK bytes at a time: bytes, rows, starts, sizes, offset in the text.

    A text of more than LONGEST bytes comes in parts that overlap by one window.
    """
    for part in slices([batch], "text", CHUNK):
        body, offsets = text_bytes(part.column("text"))
        at = 0
        if len(offsets) == 2 and offsets[1] > LONGEST:
            while at < offsets[1]:
                end = min(int(offsets[1]), at + LONGEST)
                yield part, body[at:end], np.zeros(1, np.int64), np.array([end - at]), at
                if end == offsets[1]:
                    break
                at = end - DEPTH + 1
        else:
            yield part, body, offsets[:-1], np.diff(offsets), 0


def _spans(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and touching spans of a document become one."""
    if not len(doc):
        return doc, twin, start, stop
    order = np.lexsort((start, twin, doc))
    doc, twin, start, stop = doc[order], twin[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])))
    group = np.cumsum(other)
    wide = int(stop.max()) + 2  # running maximum within a document
    reach = np.maximum.accumulate(stop + group * wide) - group * wide
    fresh = other | np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(fresh)
    end = np.concatenate((at[1:], [len(at) and len(start)])) - 1
    return doc[at], twin[at], start[at], reach[end]


MARKS = "doc long, twin long, start int, stop int, place int"


def _marks(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, stop: np.ndarray, place: np.ndarray | None = None) -> pa.RecordBatch:
    place = np.full(len(doc), -1, np.int32) if place is None else place.astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc.astype(np.int64)), pa.array(twin.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(place)],
        names=["doc", "twin", "start", "stop", "place"])


def _first_of_equal(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records by (mark, run, doc, twin, first), and which of them repeat an earlier place.

    The same place of the same document can come twice (its row repeats, or parts of a
    long text overlap); it counts once.
    """
    order = np.lexsort((records["first"], records["twin"], records["doc"], records["run"], records["mark"]))
    records = records[order]
    same = np.zeros(len(records), bool)
    same[1:] = (records["mark"][1:] == records["mark"][:-1]) & (records["run"][1:] == records["run"][:-1])
    place = same.copy()
    for name in ("doc", "twin", "first"):
        place[1:] &= records[name][1:] == records[name][:-1]
    return records[~place], same[~place]


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with the same id and text are one document; texts under one id are told apart by crc32 (null id: before all others)."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.crc32(value.cast("binary")).alias("twin"), value.alias("text"))


def hot_landmarks(texts: DataFrame, depth: int, landmark: int) -> np.ndarray:
    """Landmarks with very many different runs, from a sample of documents (see the constants above)."""
    n = texts.count()
    wanted = max(n // SAMPLE_STEP, min(n, SAMPLE_LEAST))
    if n:
        texts = texts.filter(F.pmod(F.xxhash64("doc", "twin"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, wanted / n)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found = [np.zeros((0, 2), np.uint64)]
            for _part, chunk, starts, sizes, _ in _chunks(whole):
                r = runs_of(chunk, starts, sizes, depth, landmark)
                if r:
                    found.append(np.stack([r["mark"], r["run"]], 1))
            both = np.unique(np.concatenate(found), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["mark", "run"])

    counted = texts.mapInArrow(lean(run), "mark long, run long").distinct().groupBy("mark").count()
    least = max(HOT_LEAST, wanted // HOT_SHARE)
    return np.sort(counted.filter(F.col("count") >= least).select("mark").toArrow().column("mark").to_numpy().astype(np.int64).view(np.uint64))


def _to_buckets(texts: DataFrame, hot: np.ndarray, depth: int, landmark: int, buckets: int) -> DataFrame:
    """Runs of all texts, packed by bucket; runs that repeat an earlier one of the same batch as spans (kind 1)."""

    def settle(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        records, again = _first_of_equal(np.concatenate(found))
        if len(records):
            yield from dealt(0, records[~again], records["mark"][~again], buckets)
        if again.any():
            x = records[again]
            doc, twin, start, stop = _spans(x["doc"], x["twin"], x["first"], x["first"].astype(np.int64) + x["more"] + depth)
            spans = np.zeros(len(doc), RUN)
            spans["doc"], spans["twin"], spans["first"], spans["run"] = doc, twin, start, stop
            yield from dealt(1, spans, mix(doc.view(np.uint64)), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found, held = [np.zeros(0, RUN)], 0
            for part, chunk, starts, sizes, offset in _chunks(whole):
                r = runs_of(chunk, starts, sizes, depth, landmark)
                if not r:
                    continue
                doc, twin = part.column("doc").to_numpy(), part.column("twin").to_numpy()
                is_hot = np.isin(r["mark"], hot) if len(hot) else np.zeros(len(r["mark"]), bool)
                for single in (False, True):
                    pick = np.flatnonzero(is_hot == single)
                    if not len(pick):
                        continue
                    first, place, more, row = (r[c][pick] for c in ("first", "place", "more", "text"))
                    mark, code = r["mark"][pick], r["run"][pick]
                    if single:  # every window for itself
                        n = more + 1
                        back = np.repeat(np.arange(len(pick)), n)
                        step = np.arange(len(back)) - (np.cumsum(n) - n)[back]
                        first, row, place, more = first[back] + step, row[back], place[back] - step, np.zeros(len(back), np.int64)
                        mark, code = r["one"].of(first, first + depth), r["two"].of(first, first + depth)
                    out = np.zeros(len(mark), RUN)
                    out["mark"], out["run"], out["doc"], out["twin"] = mark, code, doc[row], twin[row]
                    out["first"], out["place"], out["more"] = first - starts[row] + offset, place, more
                    found.append(out)
                    held += len(out)
                if held >= RECORDS_AT_ONCE:
                    yield from settle(found)
                    found, held = [np.zeros(0, RUN)], 0
            yield from settle(found)

    return texts.mapInArrow(lean(run), "bucket int, kind int, records binary")


def _sort_runs(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_bucket(batches, {0: RUN, 1: RUN}):
            spans = block[1]
            yield _marks(spans["doc"], spans["twin"], spans["first"], spans["run"].astype(np.int64))
            records, again = _first_of_equal(block[0])
            x = records[again]
            yield _marks(*_spans(x["doc"], x["twin"], x["first"], x["first"].astype(np.int64) + x["more"] + depth))
            x = records[~again]  # different runs: a landmark that has several goes on
            same = np.zeros(len(x) + 1, bool)
            same[1:-1] = x["mark"][1:] == x["mark"][:-1]
            x = x[same[1:] | same[:-1]]
            yield _marks(x["doc"], x["twin"], x["first"], x["first"].astype(np.int64) + x["more"] + depth, x["place"])

    return run


def _cut_pieces(landmark: int, buckets: int):
    """From texts with their open runs to the runs' bytes, packed by landmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            found: dict[int, list] = {}
            held = 0

            def out() -> pa.RecordBatch:
                keys = sorted(found)
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([b"".join(found[k]) for k in keys], pa.binary())], names=["bucket", "records"])

            for doc, twin, data, starts, stops, places in zip(*(batch.column(c) for c in ("doc", "twin", "packed", "starts", "stops", "places"))):
                body = np.frombuffer(unpack.decompress(data.as_py()), np.uint8)
                start, stop, place = (np.array(v.values.to_numpy()) for v in (starts, stops, places))
                at = start.astype(np.int64) + place
                around = body[at[:, None] + np.arange(landmark)]
                mark = hashes_of_rows(around, 0)
                for i in range(len(start)):
                    key = int(mark[i])
                    head = np.array((key, doc.as_py(), twin.as_py(), start[i], place[i], 0), PIECE)
                    found.setdefault(key % buckets, []).append(head.tobytes() + int(stop[i] - start[i]).to_bytes(4, "little") + body[start[i]:stop[i]].tobytes())
                held += int((stop - start).sum()) + len(start) * (PIECE.itemsize + 4)
                if held >= OUT_AT_ONCE:
                    yield out()
                    found, held = {}, 0
            yield out()

    return run


def _sort_windows(depth: int):
    """Every window of the open runs through its full depth: later ones of equal windows as spans."""

    def settle(heads: list[np.ndarray], bodies: list[bytes]) -> pa.RecordBatch:
        head = np.concatenate([np.zeros(0, PIECE), *heads])
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        chunk, begin = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes) - sizes
        n = sizes - depth + 1
        back = np.repeat(np.arange(len(head)), n)
        step = np.arange(len(back)) - (np.cumsum(n) - n)[back]
        at = begin[back] + step
        x = np.zeros(len(back), RUN)
        x["mark"], x["run"] = Hashes(chunk, 0).of(at, at + depth), Hashes(chunk, 1).of(at, at + depth)
        for c in ("doc", "twin"):
            x[c] = head[c][back]
        x["first"] = head["first"][back] + step
        x, again = _first_of_equal(x)
        x = x[again]
        return _marks(*_spans(x["doc"], x["twin"], x["first"], x["first"].astype(np.int64) + depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, bodies, total, before = [], [], 0, None
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("records")):
                if bucket != before and total > 2 * CHUNK:
                    yield settle(heads, bodies)
                    heads, bodies, total = [], [], 0
                before, data, at = bucket, data.as_py(), 0
                while at < len(data):
                    size = int.from_bytes(data[at + PIECE.itemsize:at + PIECE.itemsize + 4], "little")
                    heads.append(np.frombuffer(data, PIECE, 1, at))
                    at += PIECE.itemsize + 4
                    bodies.append(data[at:at + size])
                    at += size
                total += len(data)
        yield settle(heads, bodies)

    return run


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, landmark: int = LANDMARK) -> tuple[DataFrame, DataFrame]:
    """Spans of bytes that an earlier window of ``depth`` bytes repeats: (doc, twin, start, stop), and the packed texts.

    Spans of one document can overlap. See ``remove_repeats`` for the cases.
    """
    spark = df.sparkSession
    buckets = max(512, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = _keyed(df, key, text)
    packed = texts.mapInArrow(lean(pack), "doc long, twin long, packed binary")
    hot = hot_landmarks(texts, depth, landmark)
    dealt = _to_buckets(texts, hot, depth, landmark, buckets).repartition("bucket").sortWithinPartitions("bucket")
    marks = cut_lineage(dealt.mapInArrow(lean(_sort_runs(depth)), MARKS), "runs")
    opened = marks.filter("place >= 0").groupBy("doc", "twin").agg(
        F.collect_list(F.struct("start", "stop", "place")).alias("runs")).select(
        "doc", "twin", F.col("runs.start").alias("starts"), F.col("runs.stop").alias("stops"), F.col("runs.place").alias("places"))
    pieces = packed.dropDuplicates(["doc", "twin"]).join(opened, ["doc", "twin"]).mapInArrow(lean(_cut_pieces(landmark, buckets)), "bucket int, records binary")
    ends = pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_sort_windows(depth)), MARKS)
    return marks.filter("place < 0").drop("place").unionByName(ends.drop("place")), packed


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each byte that a ``depth``-byte string covers which also starts earlier.

    Earlier: in a document with a smaller key, or before in the same document. Overlapping
    occurrences count, matches never cross documents, and strings are judged on the
    input. Returns the key, ``kept`` (binary, the remaining bytes), ``removed`` (the
    maximal removed spans, array of start and stop), ``n_bytes`` and the columns in
    ``carry``.

    Null and empty texts, and texts shorter than ``depth``, lose nothing. A null key comes
    before all others. Rows that repeat key and text are one document and get the same
    result; different texts under one key are ordered by their crc32. An empty table
    gives an empty table, and further columns are ignored.
    """
    spans, _packed = repeated_spans(df, key, text, depth)
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    packed = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.crc32(value.cast("binary")).alias("twin"),
                       F.struct(F.col(key), *(F.col(f"`{c}`") for c in carry)).alias("own"), value.alias("text"))
    own = packed.schema["own"].dataType.simpleString()
    packed = packed.mapInArrow(lean(pack), f"doc long, twin long, own {own}, packed binary")
    listed = spans.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).select(
        "doc", "twin", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, removed, sizes, done = [], [], [], 0

            def out(upto: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [batch.column("own").slice(done, upto - done), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                     pa.array(sizes, pa.int64())], names=["own", "kept", "removed", "n_bytes"])

            held = 0
            for i, (data, starts, stops) in enumerate(zip(*(batch.column(c) for c in ("packed", "starts", "stops")))):
                if held >= OUT_AT_ONCE:
                    yield out(i)
                    kept, removed, sizes, done, held = [], [], [], i, 0
                body = unpack.decompress(data.as_py())
                sizes.append(len(body))
                held += len(body)
                spans, rest, at = [], [], 0
                if starts.is_valid:
                    start, stop = starts.values.to_numpy(), stops.values.to_numpy()
                    same = np.zeros(len(start), np.int64)
                    _, _, start, stop = _spans(same, same, start, stop)
                    for a, b in zip(start.tolist(), stop.tolist()):
                        spans.append({"start": a, "stop": b})
                        rest.append(body[at:a])
                        at = b
                rest.append(body[at:])
                kept.append(b"".join(rest))
                removed.append(spans)
            yield out(batch.num_rows)

    out = packed.join(listed, ["doc", "twin"], "left").mapInArrow(
        lean(run), f"own {own}, kept binary, removed array<struct<start:int,stop:int>>, n_bytes long")
    return out.select("own.*", "kept", "removed", "n_bytes")
