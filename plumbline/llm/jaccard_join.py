"""Exact Jaccard links between documents on word n-grams, by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes; it is cut into fragments, and
a document's set falls into the same cuts.

Candidates. Two linked sets (Jaccard J >= t) differ in at most D = (|A|+|B|)(1-t)/(1+t)
n-grams. For a high t the order is cut into slices, in one of which they differ in at most
d, and of that slice's d + 3 fragments three at least are equal: a key is made of every
fragment with three n-grams or more, and of every three of the thinner ones. Numbers of
slices and fragments follow from the size class of the set; a set also makes the keys of
the classes that larger partners can be in.

For a lower t fragments would be too thin. There the order puts n-grams that are common
in a sample last. Each differing n-gram stands between at most two neighbours among those
in common, so of the first D + 1 pairs of neighbours one is undisturbed: its n-grams are
neighbours in both sets, within the first D + 2 + n - ceil(t n) of n. These pairs are the
keys. (Under 0.75 single n-grams of the first n - ceil(t n) + 1 are.) Which n-grams count
as common ones changes how many candidates there are, never which links are found.

Links. Documents that share keys, directly or over others, form a family. Within it the
partial overlaps of all pairs are counted fragment by fragment as products of incidence
matrices and summed per pair, which decides every link exactly. Only a spanning star of
the links leaves the task. A large family is split into blocks that meet two by two; what
is joined to the family's main component by then need not meet again.

Copies of a set are one class from the start. Ties are merged twice, by key and then by
document, so that a near copy with hundreds of keys is tied once and not in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .columns import lean, slices, text_bytes
from .components import components
from .packing import CHUNK, OUT_AT_ONCE, Hashes, by_bucket, dealt, forest, mix, pack

#: Documents and n-grams of a block: two blocks meet in one task.
BLOCK_DOCS = 512
BLOCK_GRAMS = 1_000_000

#: Columns of an incidence matrix at a time.
FRAGMENT_COLUMNS = 4096

#: From this similarity on, keys are made of whole fragments.
HIGH = 88

#: See ``common_grams``.
SAMPLE_STEP, SAMPLE_LEAST, COMMON_LEAST, COMMON_SHARE = 16, 20_000, 16, 1000

#: Keys that a map task collects before it deals them.
KEYS_AT_ONCE = 400_000

#: Documents of a reducing task's forest.
TIES_HELD = 1_000_000

KEY = np.dtype([("key", "<u8"), ("doc", "<i8")])

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _gram_hashes(body: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of every text (fewer words: all of them as one)."""
    chunk = _LOWER[body]
    inside = ~_WHITE[chunk]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    at_text = offsets[:-1][offsets[:-1] < len(chunk)]
    edge[at_text] = inside[at_text]
    starts = np.flatnonzero(edge)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at_end = offsets[1:][offsets[1:] > 0] - 1
    last[at_end] = inside[at_end]
    word = Hashes(chunk, 0).of(starts, np.flatnonzero(last) + 1)
    bounds = np.searchsorted(starts, offsets)
    gram = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for i in range(words):
        gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + word[i:i + len(gram)])
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = hi - lo
        if n >= words:
            out.append(np.unique(gram[lo:hi - words + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for h in word[lo:hi]:
                short = mix(short * np.uint64(0xC2B2AE3D27D4EB4F) + h)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Fragments:
    """Keys from fragments of the order, for a high similarity: size classes and cuts (see above)."""

    def __init__(self, percent: int):
        self.percent, self.lows, self.most_fragments = percent, [1], 32
        self.threes = {n: np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3) for n in range(12)}

    def size_class(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * 5 // 4))
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def cuts(self, number: int) -> tuple[int, int]:
        """Slices, and fragments of a slice, of a size class; (0, 0): different sets can't be linked."""
        largest = self.lows[number + 1] - 1
        differ = 2 * largest * (100 - self.percent) // (100 + self.percent)
        if differ == 0:
            return 0, 0
        parts = -(-differ // (self.most_fragments - 3))
        return parts, differ // parts + 3

    def keys(self, grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        if not n:
            return np.zeros(0, np.uint64)
        highest = self.size_class(n * 100 // self.percent)
        found = []
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(0x632BE59BD9B4E019)))))
        for number in range(self.size_class(n), highest + 1):
            parts, each = self.cuts(number)
            if not parts:
                continue
            total = parts * each
            where = ((grams >> np.uint64(32)) * np.uint64(total)) >> np.uint64(32)
            ends = np.searchsorted(where, np.arange(total + 1, dtype=np.uint64))
            size = np.diff(ends)
            code = mix((sums[ends[1:]] - sums[ends[:-1]]) + (np.arange(total, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                       + np.uint64((number + 1) * 0xC2B2AE3D27D4EB4F % 2 ** 64))
            fat = size >= 3 if each > 8 else np.zeros(total, bool)
            found.append(code[fat])
            thin = np.flatnonzero(~fat)
            of = thin // each
            bounds = np.searchsorted(of, np.arange(parts + 1))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo >= 3:
                    three = self.threes.get(hi - lo)
                    if three is None:
                        three = np.array(list(combinations(range(hi - lo), 3)), np.int64)
                    x = code[thin[lo:hi]][three]
                    found.append(mix(mix(mix(x[:, 0]) + x[:, 1]) + x[:, 2]))
        return np.concatenate([np.zeros(0, np.uint64), *found])


def prefix_keys(grams: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """Keys from the first n-grams of the order (see above): of two neighbours, or of one below 75 per cent."""
    n = len(grams)
    if 100 * n < percent * (n + 1):  # no different set is near enough
        return grams[:0]
    if len(common):
        last = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
        grams = np.concatenate((grams[~last], grams[last]))
    lacking = n - (percent * n + 99) // 100
    if percent < 75:
        return grams[:lacking + 1]
    differ = (n + 100 * n // percent) * (100 - percent) // (100 + percent)
    first = grams[:differ + lacking + 2]
    return mix(first[:-1] * np.uint64(0x9E3779B97F4A7C15) + first[1:])


def common_grams(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of n-grams that many documents hold, from a sample: they go to the end of the order.

    The sample is one document in SAMPLE_STEP, SAMPLE_LEAST at least. An n-gram counts as
    common from COMMON_LEAST documents, or one in COMMON_SHARE, of the sample, so there are
    at most COMMON_SHARE times a document's mean number of n-grams of them.
    """
    n = texts.count()
    wanted = max(n // SAMPLE_STEP, min(n, SAMPLE_LEAST))
    if n:
        texts = texts.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, wanted / n)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found = [np.zeros(0, np.uint64)]
            for batch in slices([whole], "text", CHUNK):
                found += _gram_hashes(*text_bytes(batch.column("text")), words)
            gram, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(count.astype(np.int64))], names=["gram", "n"])

    held = texts.mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    most = held.filter(F.col("n") >= max(COMMON_LEAST, wanted // COMMON_SHARE)).select("gram").toArrow()
    return np.sort(most.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def _sketch(words: int):
    """Per document: size of its set, and two sums that tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "text", CHUNK):
                sets = _gram_hashes(*text_bytes(batch.column("text")), words)
                sums = [[int(mix(g ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for g in sets] for salt in (0x1234567, 0x89ABCDEF)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array([len(g) for g in sets], pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())],
                    names=["key", "n", "s1", "s2"])

    return run


def _deal_keys(words: int, percent: int, common: np.ndarray, buckets: int):
    """Keys of all sets, packed by bucket; of sets in hand that share a key the first stands for all, and the others are tied to it (kind 1)."""

    def settle(docs: list, keys: list) -> Iterator[pa.RecordBatch]:
        x = np.zeros(sum(map(len, keys)), KEY)
        if not len(x):
            return
        x["key"], x["doc"] = np.concatenate(keys), np.repeat(np.array(docs, np.int64), [len(k) for k in keys])
        x, again, head = _by_key(x)
        yield from dealt(0, x[~again], x["key"][~again], buckets)
        ties = _spanning(_ties(x, again, head))
        if len(ties):
            yield from dealt(1, ties, mix(ties["key"]), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments = Fragments(percent) if percent >= HIGH else None
        for whole in batches:
            docs, keys, held = [], [], 0
            for batch in slices([whole], "text", CHUNK):
                docs += batch.column("key").to_pylist()
                keys += [fragments.keys(g) if fragments else prefix_keys(g, common, percent) for g in _gram_hashes(*text_bytes(batch.column("text")), words)]
                held += sum(map(len, keys[len(docs) - batch.num_rows:]))
                if held >= KEYS_AT_ONCE:
                    yield from settle(docs, keys)
                    docs, keys, held = [], [], 0
            yield from settle(docs, keys)

    return run


def _by_key(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = x[np.lexsort((x["doc"], x["key"]))]
    again = np.zeros(len(x), bool)
    again[1:] = x["key"][1:] == x["key"][:-1]
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(x)))) if len(x) else np.zeros(0, np.int64)
    return x, again, head


def _ties(x: np.ndarray, again: np.ndarray, head: np.ndarray) -> np.ndarray:
    """(lesser doc as key, doc) of every record that shares its key with an earlier one."""
    out = np.zeros(int(again.sum()), KEY)
    out["key"], out["doc"] = x["doc"][head[again]].view(np.uint64), x["doc"][again]
    return out[out["key"].view(np.int64) != out["doc"]]


def _spanning(ties: np.ndarray) -> np.ndarray:
    """As few ties as connect the same documents."""
    low, doc = forest(ties["key"].view(np.int64), ties["doc"])
    out = np.zeros(len(low), KEY)
    out["key"], out["doc"] = low.view(np.uint64), doc
    return out


def _forests(batches: Iterator[pa.RecordBatch], make) -> Iterator[np.ndarray]:
    """One spanning forest of the ties of all blocks of a task (several where it has more than TIES_HELD documents)."""
    held = np.zeros(0, KEY)
    for block in by_bucket(batches, {0: KEY, 1: KEY}):
        held = _spanning(np.concatenate([held, *make(block)]))
        if len(held) > TIES_HELD:
            yield held
            held = held[:0]
    yield held


def _tie_keys(buckets: int):
    """From keys to ties, packed by document: a document is tied once in each task that has a key of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ties in _forests(batches, lambda block: (block[1], _ties(*_by_key(block[0])))):
            if len(ties):
                yield from dealt(1, ties, mix(ties["doc"].view(np.uint64)), buckets)

    return run


def _tie_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All ties of a document meet here, so it leaves once, whatever the number of its keys and of tasks."""
    for ties in _forests(batches, lambda block: (block[1],)):
        yield pa.RecordBatch.from_arrays([pa.array(ties["doc"].copy()), pa.array(ties["key"].view(np.int64).copy())], names=["a", "b"])


def _sets(words: int):
    """The hashes of each packed text, once for every block that it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            docs, blocks, sets, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(blocks, pa.string()), pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], names=["block", "doc", "grams"])

            for doc, data, to in zip(batch.column("doc"), batch.column("packed"), batch.column("blocks")):
                body = np.frombuffer(unpack.decompress(data.as_py()), np.uint8)
                blob = _gram_hashes(body, np.array([0, len(body)]), words)[0].tobytes()
                for block in to.as_py():  # a document of a large family goes to many: they don't leave at once
                    docs.append(doc.as_py())
                    blocks.append(block)
                    sets.append(blob)
                    held += len(blob)
                    if held >= OUT_AT_ONCE:
                        yield out()
                        docs, blocks, sets, held = [], [], [], 0
            yield out()

    return run


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For every set the first one that it is linked with, directly or over others of these."""
    m, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0 if 100 * both >= percent * (sizes.sum() - both) else 1])
    row = np.repeat(np.arange(m), sizes)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((m, m), np.float32)
    total = int(shared.sum())
    for lo in range(0, total, FRAGMENT_COLUMNS):  # partial overlaps, one fragment of the order at a time
        a, b = np.searchsorted(column, (lo, lo + FRAGMENT_COLUMNS))
        part = np.zeros((m, min(FRAGMENT_COLUMNS, total - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        overlap += part @ part.T
    link = 100 * overlap.astype(np.float64) >= percent * (sizes[:, None] + sizes[None, :] - overlap)
    link &= (sizes > 0)[:, None] & (sizes > 0)[None, :]
    label = np.arange(m)
    while True:
        least = np.where(link, label[None, :], m).min(1)
        least = np.minimum(label, least)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _link_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        before = None

        def settle() -> pa.RecordBatch:
            docs = np.array(sorted(held), np.int64)
            first = linked([held[d] for d in docs.tolist()], percent) if len(docs) > 1 else np.arange(len(docs))
            tied = first != np.arange(len(docs))
            return pa.RecordBatch.from_arrays([pa.array(docs[tied]), pa.array(docs[first[tied]])], names=["a", "b"])

        for batch in batches:
            for block, doc, grams in zip(batch.column("block").to_pylist(), batch.column("doc").to_pylist(), batch.column("grams")):
                if block != before:
                    yield settle()
                    held = {}
                before = block
                held[doc] = np.frombuffer(grams.as_buffer(), np.uint64)
        yield settle()

    return run


def _links(packed: DataFrame, to: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) found in the blocks that ``to`` (doc, blocks) sends the documents to."""
    sets = packed.join(to.hint("merge"), "doc").mapInArrow(lean(_sets(words)), "block string, doc long, grams binary")
    return sets.repartition("block").sortWithinPartitions("block").mapInArrow(lean(_link_blocks(percent)), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row: components of links with 100 |A and B| >= percent |A or B|.

    A set holds the distinct ``words``-word n-grams of the whole text (A-Z lowered, words
    without white space); a text with fewer words is one n-gram; an empty or null text has
    the empty set and is linked with nothing. ``component_id`` is the smallest key that
    links reach, the row's own included. Rows that share a key count as one node of the
    graph, also if their texts differ (each text is compared for itself); a row without a
    key has a null component and takes no part. An empty table gives an empty table;
    further columns are ignored.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"similarity must be 1 to 100 per cent, not {percent}")
    spark = df.sparkSession
    buckets = max(512, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    members = cut_lineage(texts.mapInArrow(lean(_sketch(words)), "key long, n long, s1 long, s2 long"), "members")
    taking = members.filter("n > 0 AND key IS NOT NULL")
    of_key = taking.groupBy("key").agg(F.min(F.struct("n", "s1", "s2")).alias("one"), F.max(F.struct("n", "s1", "s2")).alias("other"))
    if not of_key.filter("one <> other").isEmpty():
        return _by_text(texts, words, percent).select(F.col("key").alias(key), "n_shingles", "component_id")
    classes = cut_lineage(taking.groupBy("n", "s1", "s2").agg(F.min("key").alias("doc")), "classes")
    # Copies share all their keys, so it does no harm that they make them too: a class is in its family.
    keyed = texts.filter("key IS NOT NULL")
    common = np.zeros(0, np.uint64) if percent >= HIGH else common_grams(keyed, words)
    dealt_keys = keyed.mapInArrow(lean(_deal_keys(words, percent, common, buckets)), "bucket int, kind int, records binary")
    packed_rows = "bucket int, kind int, records binary"
    in_buckets = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket")
    by_doc = in_buckets(dealt_keys).mapInArrow(lean(_tie_keys(buckets)), packed_rows)
    ties = in_buckets(by_doc).mapInArrow(lean(_tie_docs), "a long, b long")
    families = cut_lineage(components(ties).select(F.col("id").alias("doc"), F.col("component").alias("family"))
                           .join(classes.groupBy("doc").agg(F.sum("n").alias("n")), "doc"), "families")

    size = families.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("long")
    placed = families.join(size.select("family", blocks.alias("k")), "family").withColumn("block", F.pmod(F.xxhash64("doc"), "k"))
    # The first block meets every other one; a family of one or two blocks is done with that.
    name = lambda *c: F.concat_ws("/", *[x.cast("string") for x in c])
    to = placed.select("doc", F.when(F.col("k") == 1, F.array(name(F.col("family"))))
                       .when(F.col("block") == 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("k") - 1), lambda j: name(F.col("family"), j)))
                       .otherwise(F.array(name(F.col("family"), F.col("block")))).alias("blocks"))
    packed = texts.select(F.col("key").alias("doc"), "text").filter("doc IS NOT NULL").mapInArrow(lean(pack), "doc long, packed binary")
    links = cut_lineage(_links(packed, to, words, percent), "links")
    joined = components(links)
    large = placed.filter("k > 2")
    if not large.isEmpty():
        state = large.join(joined, F.col("doc") == F.col("id"), "left").select("doc", "family", "k", F.coalesce("component", "doc").alias("part"))
        state = cut_lineage(state, "large")
        counts = state.groupBy("family", "part").agg(F.count("*").alias("m"))
        main = counts.groupBy("family").agg(F.max_by("part", F.struct("m", "part")).alias("main"))
        state = state.join(main, "family")
        left = state.filter("part <> main").groupBy("family").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("r"))
        place = state.join(left, "family").withColumn("r", F.least("r", "k")).withColumn("i", F.pmod(F.xxhash64("doc", F.lit(7)), "r")).withColumn("block", F.pmod(F.xxhash64("doc"), "k"))
        every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        all_docs = F.transform(every("r"), lambda i: name(F.col("family"), i, F.col("block")))
        strays = F.transform(every("k"), lambda j: name(F.col("family"), F.col("i"), j))
        to = place.select("doc", F.when(F.col("part") == F.col("main"), all_docs).otherwise(F.array_union(all_docs, strays)).alias("blocks"))
        links = cut_lineage(links.unionByName(_links(packed, to, words, percent)), "links")
        joined = components(links)
    of_class = classes.join(joined, F.col("doc") == F.col("id"), "left").select("n", "s1", "s2", F.coalesce("component", "doc").alias("component"))
    member = taking.select("key", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"]).select("key", "component").distinct()
    return members.select("key", "n").join(member, "key", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def _by_text(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``near_duplicates`` where a key has several texts: each (key, text) is a node by its 64-bit hash, and a key ties its nodes' components together."""
    rows = cut_lineage(texts.withColumn("node", F.when(F.col("key").isNotNull(), F.xxhash64("key", "text"))), "texts")
    found = near_duplicates(rows, key="node", words=words, percent=percent).distinct()
    of_row = cut_lineage(rows.select("key", "node").join(found.filter("node IS NOT NULL"), "node"), "nodes")
    least = of_row.groupBy("component_id").agg(F.min("key").alias("least"))
    joined = components(of_row.join(least, "component_id").select(F.col("key").alias("a"), F.col("least").alias("b")))
    keyed = of_row.join(joined, F.col("key") == F.col("id"), "left").select("key", "n_shingles", F.coalesce("component", "key").alias("component_id"))
    bare = rows.filter("key IS NULL").mapInArrow(lean(_sketch(words)), "key long, n long, s1 long, s2 long").select(
        "key", F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))
    return keyed.unionByName(bare)
