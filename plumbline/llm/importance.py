"""Resampling documents towards a target distribution by hashed word n-grams.

Dictionary. An Aho-Corasick automaton holds frequent words, each between two delimiters,
so only whole words match. A word's payload is its CRC-32 and its length in one number;
a scan of a text emits the payloads of its words. The crc of a run of words follows from
the payloads of adjacent words alone: appending bytes is a linear map of the crc, one per
length, kept as four tables of 256 entries. So no n-gram is ever spelt out.

Which words are in the dictionary is learnt from a bounded sample and decides only the
time: the crc of any other word is computed where it stands.

Two scans: the first counts the features of all documents and of the target per bucket,
the second sums each document's gains. Noise from a hash of the id makes a draw without
replacement of the highest scores (Gumbel).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import row_numbers
from ..runtime import cut_lineage
from .columns import keyed_text, slices, text_bytes
from .packing import CHUNK

#: Bounds of the dictionary: documents of the sample, and words.
SAMPLE_ROWS, DICTIONARY_WORDS = 4000, 60_000

#: Words of up to so many bytes have a table of their own for the crc.
TABLE_LENGTH = 48

#: Rows of a range when documents are ranked.
RANK_ROWS = 50_000

#: Lower case; bytes that stand in no word become a space.
NORMAL = np.full(256, 0x20, np.uint8)
NORMAL[48:58] = np.arange(48, 58)
NORMAL[97:123] = NORMAL[65:91] = np.arange(97, 123)
NORMAL[128:] = np.arange(128, 256)

_BYTE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
_SPACE = np.uint32(zlib.crc32(b" "))


def _after_zero(crc: np.ndarray) -> np.ndarray:
    """The part of a crc that a further byte leaves: linear in the crc."""
    return (crc >> np.uint32(8)) ^ _BYTE[crc & np.uint32(255)]


def _tables() -> np.ndarray:
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])
    out = [now]
    for _ in range(TABLE_LENGTH):
        out.append(now := _after_zero(now))
    return np.stack(out).reshape(-1)


_TABLES = _tables()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The crc's part after ``length`` further bytes."""
    at = np.minimum(length, TABLE_LENGTH) << 10
    out = _TABLES[at + (crc & np.uint32(255))]
    for i in (1, 2, 3):
        out ^= _TABLES[at + 256 * i + ((crc >> np.uint32(8 * i)) & np.uint32(255))]
    rest = length - TABLE_LENGTH
    far = np.flatnonzero(rest > 0)
    if len(far):
        out[far] = shifted(out[far], rest[far])
    return out


class Dictionary:
    """Automaton over words (bytes as characters) between delimiters."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton()
        for word in words:
            self.automaton.add_word(f" {word.decode('latin-1')} ", len(word) << 32 | zlib.crc32(word))
        self.empty = not words
        if words:
            self.automaton.make_automaton()

    def scan(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(crc, length) of every word of the texts, and how many words stand before each text."""
        spaced = np.full(len(body) + len(offsets), 0x20, np.uint8)
        spaced[np.arange(len(body)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = NORMAL[body]
        inside = np.zeros(len(spaced) + 1, bool)
        inside[:-1] = spaced != 0x20
        edge = np.flatnonzero(inside[1:] != inside[:-1])  # the first one is a delimiter
        start, stop = edge[0::2] + 1, edge[1::2] + 1
        crc, length = np.zeros(len(start), np.uint32), stop - start
        data = spaced.tobytes()
        known = np.zeros(len(start), bool)
        if not self.empty and len(start):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
            word = np.searchsorted(stop, found[:, 0])
            crc[word] = (found[:, 1] & 0xFFFFFFFF).astype(np.uint32)
            known[word] = True
        other = np.flatnonzero(~known)
        crc[other] = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(start[other].tolist(), stop[other].tolist())), np.uint32, len(other))
        return crc, length, np.searchsorted(start, offsets + np.arange(len(offsets)))


_DICTIONARIES: dict[int, Dictionary] = {}


def dictionary(words: bytes) -> Dictionary:
    """The dictionary of words joined by spaces, made once in each Python worker."""
    name = hash(words)
    if name not in _DICTIONARIES:
        _DICTIONARIES.clear()
        _DICTIONARIES[name] = Dictionary(words.split(b" ") if words else [])
    return _DICTIONARIES[name]


def buckets_of(crc: np.ndarray, length: np.ndarray, bounds: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, bucket) of all runs of 1, 2, ... ``longest`` words that lie within a text."""
    last = np.repeat(bounds[1:], np.diff(bounds))  # one past the text's last word
    run, first = crc, np.arange(len(crc))
    for n in range(1, longest + 1):
        if n > 1:
            keep = first + (n - 1) < last[first]
            first = first[keep]
            end = first + (n - 1)
            run = shifted(_after_zero(run[keep]) ^ _SPACE, length[end]) ^ crc[end]
        yield first, run % np.uint32(buckets)


def frequent_words(df: DataFrame, sample_rows: int = SAMPLE_ROWS, words: int = DICTIONARY_WORDS) -> bytes:
    """The most frequent words of about ``sample_rows`` documents, joined by spaces."""
    n = df.count()
    if not n or not words:
        return b""
    sample = df.filter(F.pmod(F.xxhash64("key", F.length("text")), F.lit(1 << 24)) < int((1 << 24) * min(1.0, sample_rows / n)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            body, offsets = text_bytes(batch.column("text"))
            spaced = np.insert(NORMAL[body], offsets[1:-1], 0x20)
            found, count = np.unique(np.array(spaced.tobytes().split(), object), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.binary()), pa.array(count, pa.int64())], names=["word", "n"])

    held = sample.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    most = held.filter("n > 1 AND length(word) <= 64").orderBy(F.desc("n"), "word").limit(words).toArrow()
    return b" ".join(most.column("word").to_pylist())


def bucket_counts(df: DataFrame, words: bytes, longest: int, buckets: int) -> np.ndarray:
    """Features per bucket over all texts; at most ``buckets`` rows leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", CHUNK):
            crc, length, bounds = dictionary(words).scan(*text_bytes(batch.column("text")))
            for _, found in buckets_of(crc, length, bounds, longest, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    found = df.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: thousandths of the logarithm of its share in the target over its share in the corpus, each count plus one."""
    size, total_s, total_t = len(corpus), int(corpus.sum()), int(target.sum())
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (total_s + size) / ((s + 1) * (total_t + size)))) for s, t in pairs], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, words: bytes, longest: int) -> DataFrame:
    """(key, n_words, n_features, weight): the sum of a text's gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            crc, length, bounds = dictionary(words).scan(*text_bytes(batch.column("text")))
            n = np.diff(bounds)
            features, weight = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for i, (first, found) in enumerate(buckets_of(crc, length, bounds, longest, len(gain))):
                sums = np.concatenate(([0], np.cumsum(gain[found])))
                at = np.searchsorted(first, bounds)
                weight += sums[at[1:]] - sums[at[:-1]]
                features += np.maximum(n - i, 0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n.astype(np.int64)), pa.array(features), pa.array(weight)], names=["key", "n_words", "n_features", "weight"])

    return df.mapInArrow(run, "key long, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20,
             seed: int = 42, buckets: int = 10_000, longest: int = 3, sample_rows: int = SAMPLE_ROWS, words: int = DICTIONARY_WORDS) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row; ``rank`` is null where a row is not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` per cent (rounded down) with
    the highest scores are drawn, ties to the smaller key. A null or empty text has no
    features and weight 0. A null key is kept: its noise is that of an empty id, and it
    comes last among ties. Rows that share a key are scored each by its own text; equal
    rows take neighbouring ranks. An empty target leaves only the corpus to weigh by; an
    empty table gives an empty one. Further columns are ignored.
    """
    if not 0 <= percent <= 100 or longest < 1 or buckets < 1:
        raise ValueError("percent must be 0 to 100, longest and buckets 1 or more")
    docs = keyed_text(df, key, text)
    wanted = target.select(F.lit(None).cast("long").alias("key"), F.coalesce(F.col(target_text).cast("string"), F.lit("")).alias("text"))
    known = frequent_words(docs, sample_rows, words)
    gain = gains(bucket_counts(docs, known, longest, buckets), bucket_counts(wanted, known, longest, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    drawn = F.floor(-1000.0 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    scored = cut_lineage(weigh(docs, gain, known, longest).withColumn("score", F.col("weight") + drawn), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    order = F.struct((-F.col("score")).alias("high"), F.col("key").isNull().alias("last"), "key")
    ranked = row_numbers(able, [], order, "rank", spread=True, min_rows=RANK_ROWS)
    rank = F.when(F.col("rank") <= draw, F.col("rank").cast("long"))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(rest).select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")
