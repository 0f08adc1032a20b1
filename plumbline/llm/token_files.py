"""Token ids in Parquet files that can be read selectively.

One row per document, in ascending order of the key: its tokens as a list column, its
length, and where it starts in the file's own run of tokens. Row groups are kept small
and carry page indexes, so a range of keys reads few pages of tokens, and a question
about lengths or offsets reads no tokens at all. Ids repeat a lot within a row group, so
they are dictionary encoded (ids of a 49k vocabulary take two bytes); ``delta`` writes
DELTA_BINARY_PACKED pages instead, for ids without repetition.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import keyed_text

#: Words that one Python worker remembers.
MAX_WORDS = 700_000
#: Symbols that are split off the end of a word.
MARKS = ".,;:!?*$%&#|"

SCHEMA = "key long, part int, start_in_part long, n_tokens int, tokens array<int>"


#: A word that is one run of letters to the library, whatever its version of Unicode.
LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+").fullmatch


class WordEncoder:
    """The tokenizers library, asked once for each word.

    Its model folds case and drops white space before the merges, so no token reaches
    over a space or a line feed, and a text's ids are those of its words in order. A run
    of the symbols in MARKS after a letter or digit is split off likewise. A text that
    spells an added token (in any case) is given to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True

    def _spells_added(self, text: str) -> bool:
        return any(token in text or token.lower() in text for token in self.added)

    def _ask(self, words: list[str]) -> None:
        """Plain words are asked for many at a time: each is one run of letters, whose last id is one that ends a run."""
        plain = [word for word in words if LETTERS(word)]
        for at in range(0, len(plain), 1024):
            some = plain[at:at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            data, begin = ids.tobytes(), 0
            for word, end in zip(some, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
                self.known[word] = data[begin:end]
                begin = end
        other = [word for word in words if not LETTERS(word)]
        for at in range(0, len(other), 4096):
            some = other[at:at + 4096]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[word] = array("i", found.ids).tobytes()

    def encode(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        plain = [_plain(text) for text in texts]
        whole = {i: array("i", self.tokenizer.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids).tobytes() for i, text in enumerate(plain) if self._spells_added(text)}
        words = [[] if i in whole else text.replace("\n", " ").split(" ") for i, text in enumerate(plain)]
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        known = self.known
        new = set(chain.from_iterable(words)).difference(known)
        parts = {word: stem for word in new if (stem := word.rstrip(MARKS)) and stem != word and stem.isascii() and stem[-1].isalnum()}
        ends = {word[len(stem):] for word, stem in parts.items()}
        self._ask([w for w in new.union(parts.values(), ends) if w not in parts and w not in known])
        for word, stem in parts.items():
            known[word] = known[stem] + known[word[len(stem):]]
        last = [] if end is None else [array("i", [end]).tobytes()]
        per_text = [b"".join([whole.get(i, b""), *map(known.__getitem__, w), *last]) for i, w in enumerate(words)]
        sizes = np.fromiter(map(len, per_text), np.int64, len(per_text)) // 4
        return np.frombuffer(b"".join(per_text), np.int32), sizes


def _plain(text: str) -> str:
    """Lower case, where that is the same before and after the library's normalisation: characters up to U+00FF."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_sorted(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 1) -> DataFrame:
    """Tokens of every whole text in ascending order of ``key``, partition by partition.

    The texts are dealt by ranges of the key and sorted before they are tokenised, so the
    tokens are never shuffled. A null text is empty (it still gets ``end_id``), a null key
    comes first, rows that share a key are ordered by their text.
    """
    ordered = keyed_text(df, key, text).repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, start = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids, sizes = tool.encode(batch.column("text").to_pylist(), end_id)
                ends = np.cumsum(sizes)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(start + ends - sizes),
                     pa.array(sizes.astype(np.int32)), tokens], names=["key", "part", "start_in_part", "n_tokens", "tokens"])
                start += int(ends[-1]) if len(ends) else 0

    return ordered.mapInArrow(run, SCHEMA)


def write(tokens: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000) -> None:
    """Write token rows as Parquet. ``encoding`` is ``dictionary`` or ``delta``.

    Statistics and column and offset indexes are written for every page.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
               "parquet.page.size.row.check.min": 100, "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
               "parquet.dictionary.page.size": 1 << 20, "compression": "zstd"}
    if encoding == "delta":
        options["parquet.writer.version"] = "PARQUET_2_0"
    tokens.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows with ``low`` <= key <= ``high``; the page indexes keep the other pages unread."""
    found = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        found = found.filter(F.col("key") >= low)
    if high is not None:
        found = found.filter(F.col("key") <= high)
    return found.select(*columns) if columns else found


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Where each part's tokens start among all tokens: a row per file, from the lengths alone."""
    parts = read(spark, path, columns=["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Read files back: key, part, start_in_part, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            sizes = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "part", "start_in_part")), sizes, pa.array(sums, pa.int64())],
                names=["key", "part", "start_in_part", "n_tokens", "ids_crc32"])

    return read(spark, path, columns=["key", "part", "start_in_part", "tokens"]).mapInArrow(
        run, "key long, part int, start_in_part long, n_tokens long, ids_crc32 long")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start among all tokens, length and checksum."""
    return checksums(spark, path).join(part_starts(spark, path), "part").select(
        "key", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
