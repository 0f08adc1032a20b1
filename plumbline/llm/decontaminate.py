"""Benchmark passages in training texts, found by spaced-seed hashing.

A seed is a window of words of which a fixed mask ignores some positions, so a hit
survives substituted words that fall on ignored positions. Every alignment that the
verification accepts, with ten matching words or more, holds a seed of one mask at least
(shown by a search of all patterns, see the tests), so seeding loses nothing. An item of
fewer words must match as a whole, so its seed is a window of all its words. Seeds of all
benchmark items form an index; every window of a training text is looked up (a bitmap of fixed size answers nearly all of them). A hit gives an alignment of
a text and an item, and the alignment is then verified word by word: its best segment,
where a match counts 1 and a substitution -2, must have enough matching words.

The index is held by the tasks only up to INDEX_ROWS seeds; a larger benchmark is taken
in as many passes over the texts as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import keyed_text, lean, slices, text_bytes, text_hash
from .packing import CHUNK, mix
from .words import Words

#: 1 is compared, 0 is ignored. Every accepted segment with MIN_MATCHED matches has the ones of some mask among its matches.
MASKS = ("1110111", "110100111", "110011011", "101010111", "1010010111", "110000100111")
INDEX_ROWS = 2_000_000
BITMAP_BITS = 24
MIN_MATCHED = 10
#: Seeds found in texts that are held before repeats of an alignment go.
HITS_AT_ONCE = 500_000
#: Stand for the seed before the first one.
FIRST_OF_ITEM, FIRST_OF_TEXT = np.uint64(1), np.uint64(2)
#: An item of one word is no passage.
LEAST_WORDS = 2


def seeds(word: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window under one mask."""
    n = max(0, len(word) - len(mask) + 1)
    code = np.full(n, int(mask, 2), np.uint64)
    for i, used in enumerate(mask):
        if used == "1":
            code = (code * np.uint64(0x9E3779B97F4A7C15)) ^ mix_fast(word[i:i + n])
    return mix(code)


def mix_fast(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(29))


class Index:
    """Sorted seeds of benchmark items, with where they stand."""

    def __init__(self, items: list[tuple[int, np.ndarray]], masks: tuple[str, ...]):
        self.items = items
        sizes = {len(word) for _id, word in items}
        whole = {n: "1" * n for n in sizes if LEAST_WORDS <= n < MIN_MATCHED}
        self.masks = (*(masks if max(sizes, default=0) >= MIN_MATCHED else ()), *whole.values())
        codes, where = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
        for number, (_id, word) in enumerate(items):
            for mask in masks if len(word) >= MIN_MATCHED else [whole[len(word)]] if len(word) in whole else []:
                code = seeds(word, mask)
                codes.append(code)
                where.append(np.stack([np.full(len(code), number), np.arange(len(code))], 1))
        code, at = np.concatenate(codes), np.concatenate(where)
        before = np.concatenate(([FIRST_OF_ITEM], code[:-1])) if len(code) else code
        before[at[:, 1] == 0] = FIRST_OF_ITEM
        order = np.lexsort((before, code))
        self.code, self.before, self.at = code[order], before[order], at[order]
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[(self.code >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True

    def alignments(self, word: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Distinct (text, item, place of the item's first word among the words) that share a seed, sorted.

        A seed whose predecessors agree too lies on an alignment that the predecessors
        have shown, so only the first seed of a diagonal is taken: repetitive texts and
        items give text plus item rows, not text times item.
        """
        ways = np.zeros((0, 3), np.int64)
        for mask in self.masks:
            code = seeds(word, mask)
            maybe = np.flatnonzero(self.bitmap[(code >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
            maybe = maybe[text[maybe] == text[maybe + len(mask) - 1]]
            first, last = (np.searchsorted(self.code, code[maybe], side) for side in ("left", "right"))
            maybe, first, last = (x[last > first] for x in (maybe, first, last))
            if not len(maybe):
                continue
            before = np.where((maybe > 0) & (text[maybe - 1] == text[maybe]), code[maybe - 1], FIRST_OF_TEXT)
            low, high = (_within(self.before, first, last, before, right) for right in (False, True))
            at = np.concatenate((maybe, maybe))
            start, n = np.concatenate((first, high)), np.concatenate((low - first, last - high))
            total = np.cumsum(n)
            done = 0
            while done < len(at):
                end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + HITS_AT_ONCE, side="right")))
                some = n[done:end]
                back = np.repeat(np.arange(done, end), some)
                row = start[back] + np.arange(len(back)) - np.repeat(np.cumsum(some) - some, some)
                ways = np.unique(np.concatenate((ways, np.stack([text[at[back]], self.at[row, 0], at[back] - self.at[row, 1]], 1))), axis=0)
                done = end
        return ways


def _within(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search for each ``wanted`` in its own sorted stretch [low, high) of ``values``."""
    low, high = low.copy(), high.copy()
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) // 2
        up = values[middle] <= wanted[live] if right else values[middle] < wanted[live]
        low[live[up]] = middle[up] + 1
        high[live[~up]] = middle[~up]


def best_segment(same: np.ndarray) -> tuple[int, int, int]:
    """(start, stop, matches) of the segment with the highest score: 1 for a match, -2 for a substitution."""
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    low = np.minimum.accumulate(sums)
    stop = int(np.argmax(sums - low))
    start = int(np.argmin(sums[:stop + 1]))
    return start, stop, int(same[start:stop].sum())


FOUND = "key long, twin long, item long, text_start int, item_start int, n_words int, n_matched int"


def _search(index: Index, min_matched: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "text", CHUNK):
                w = Words(*text_bytes(batch.column("text")), symbols=False, characters=True)
                ways = index.alignments(w.hash, w.text)
                rows = []
                if len(ways):
                    keys, twins = batch.column("key"), batch.column("twin")
                    for t, i, shift in ways.tolist():
                        own, (name, word) = (int(w.bounds[t]), int(w.bounds[t + 1])), index.items[i]
                        lo, hi = max(own[0], shift), min(own[1], shift + len(word))
                        start, stop, matched = best_segment(w.hash[lo:hi] == word[lo - shift:hi - shift])
                        if matched >= min(min_matched, len(word)):
                            rows.append((keys[t].as_py(), twins[t].as_py(), name, lo + start - own[0], lo + start - shift, stop - start, matched))
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64()] * 3 + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "twin", "item", "text_start", "item_start", "n_words", "n_matched"])

    return run


def _found(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           masks: tuple[str, ...] = MASKS, min_matched: int = MIN_MATCHED, index_rows: int = INDEX_ROWS) -> DataFrame:
    """Every verified overlap: (key, hash of the text, item) and where it is."""
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    # A word and its space take two characters at least, a character of a script without spaces is a word.
    total = items.agg(F.coalesce(F.sum(F.length("text") + F.length(F.regexp_replace("text", r"[\x00-\x7F]", ""))), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) * len(masks) // (2 * index_rows)))
    found = None
    for number in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == number).orderBy("item", "text").toArrow()
        texts = part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string())
        w = Words(*text_bytes(texts), symbols=False, characters=True)
        index = Index([(i, w.hash[a:b]) for i, a, b in zip(part.column("item").to_pylist(), w.bounds[:-1], w.bounds[1:])], masks)
        now = keyed_text(df, key, text).withColumn("twin", text_hash("text")).mapInArrow(lean(_search(index, min_matched)), FOUND)
        found = now if found is None else found.unionByName(now)
    return found


def overlaps(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
             masks: tuple[str, ...] = MASKS, min_matched: int = MIN_MATCHED, index_rows: int = INDEX_ROWS) -> DataFrame:
    """One row per (key, item) with its best verified overlap: where it starts, in words, its length and its matching words.

    Words are runs of letters and digits, A-Z lowered, and single characters of scripts
    without spaces. An item of fewer than ten words is found where all its words are, an
    item of one word never; ``min_matched`` under ten may miss segments of fewer matches. Null and empty texts and items have no overlap. Rows that share a key count
    together, a repeated item counts once, ties go to the earliest place. An empty table on
    either side gives an empty result; further columns are ignored.
    """
    found = _found(df, benchmark, key, text, item, item_text, masks, min_matched, index_rows)
    best = F.max_by(F.struct("text_start", "item_start", "n_words", "n_matched"), F.struct("n_matched", -F.col("n_words"), -F.col("text_start"), -F.col("item_start")))
    return found.groupBy("key", "item").agg(best.alias("b")).select(F.col("key").alias(key), F.col("item").alias(item), "b.*")


def clean(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``df`` without a verified overlap, all their columns kept. Each row is judged by its own text, also without a key or under a shared one."""
    hit = _found(df, benchmark, key, text, **options).select(F.col("key").alias("__hit"), F.col("twin").alias("__twin")).distinct()
    return df.join(hit, F.col(key).cast("long").eqNullSafe(F.col("__hit")) & (text_hash(text) == F.col("__twin")), "left_anti")
