"""Language of a text, by a bit-sliced Bloom filter over byte n-grams.

A slot of the filter holds one bit for each language, in as many machine words as that takes. The slots of an n-gram, combined by
AND, are the set of all languages that contain it (or seem to: each language's false
positive rate follows from how many of its bits are set). A text's count for a language
is the number of its n-grams with that language's bit, less the false positives to expect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import crc32_of_id, slices, text_bytes
from .packing import CHUNK, mix
from .words import KIND, LOWER

GRAMS = (3, 5)
SLOT_BITS = 21
HASHES = 3
#: Rows of one language that are learnt from (a sample by hash of the id where there are more).
SAMPLE_ROWS = 4000
#: An n-gram belongs to a language if so large a part of its rows (two at least) holds it.
LEAST_SHARE = 0.004

_LETTERS = np.where(KIND == 1, LOWER, 32).astype(np.uint8)
_LETTERS[48:58] = 32


def grams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) for every n-gram that holds a letter; everything that isn't a letter is one space, also at both ends."""
    n = len(offsets) - 1
    clean = np.full(len(body) + 2 * n, 32, np.uint8)
    text = np.repeat(np.arange(n), np.diff(offsets))
    clean[np.arange(len(body)) + 2 * text + 1] = _LETTERS[body]
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    keep = np.ones(len(clean), bool)
    keep[1:] = (clean[1:] != 32) | (clean[:-1] != 32) | (owner[1:] != owner[:-1])
    clean, owner = clean[keep], owner[keep]
    texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    value = np.zeros(len(clean), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        m = len(clean) - k + 1
        if m <= 0:
            break
        value = (value[:m] << np.uint64(8)) | clean[k - 1:].astype(np.uint64)
        if k in GRAMS:
            inside = owner[:m] == owner[k - 1:]
            texts.append(owner[:m][inside])
            found.append(value[inside])
    return np.concatenate(texts), np.concatenate(found)


def slots(gram: np.ndarray) -> Iterator[np.ndarray]:
    h = mix(gram)
    step = (mix(gram + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Filter:
    """Languages (in ascending order) and, per word of 64 languages and slot, their bits."""

    def __init__(self, languages: list[str], of_language: list[np.ndarray]):
        self.languages = languages
        width = next((w for w in (8, 16, 32) if len(languages) <= w), 64)
        self.bits = np.zeros((-(-len(languages) // width), 1 << SLOT_BITS), f"u{width // 8}")
        one = self.bits.dtype.type
        for number, values in enumerate(of_language):
            for at in slots(values):
                self.bits[number // width, at] |= one(1 << number % width)
        fill = np.array([np.count_nonzero(self.bits[i // width] & one(1 << i % width)) / self.bits.shape[1] for i in range(len(languages))])
        self.false = fill ** HASHES

    def counts(self, text: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the corrected number of n-grams, and each text's number of n-grams."""
        total = np.bincount(text, minlength=n)
        places, width = list(slots(gram)), 8 * self.bits.itemsize
        hits = np.zeros((n, len(self.languages)))
        for word, bits in enumerate(self.bits):
            mask = bits[places[0]]
            for at in places[1:]:
                mask &= bits[at]
            for i in range(word * width, min(len(self.languages), (word + 1) * width)):
                hits[:, i] = np.bincount(text, (mask >> mask.dtype.type(i % width)) & mask.dtype.type(1), n)
        return np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false)), total


def train(rows: DataFrame, key: str, text: str, lang: str, sample_rows: int = SAMPLE_ROWS) -> Filter | None:
    """The filter from rows with a text and a language, at most about ``sample_rows`` of each language; None without rows."""
    known = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not n:
        return None
    languages = sorted(n)
    place = {name: i for i, name in enumerate(languages)}
    share = F.element_at(F.map_from_arrays(F.lit(languages), F.lit([min(1.0, sample_rows / n[name]) for name in languages])), F.col("lang"))
    picked = known.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 24)) < (share * (1 << 24)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "text", CHUNK):
                number = np.array([place[x] for x in batch.column("lang").to_pylist()])
                text, gram = grams(*text_bytes(batch.column("text")))
                once = np.unique(gram << np.uint64(24) | text.astype(np.uint64))  # a gram has 40 bits, a slice under 2^24 rows
                of = number[(once & np.uint64(0xFFFFFF)).astype(np.int64)].astype(np.uint64)
                pair, count = np.unique(once >> np.uint64(24) << np.uint64(24) | of, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((pair & np.uint64(0xFFFFFF)).astype(np.int32)), pa.array((pair >> np.uint64(24)).astype(np.int64)), pa.array(count.astype(np.int64))], names=["number", "gram", "n"])

    held = picked.mapInArrow(run, "number int, gram long, n long").groupBy("number", "gram").agg(F.sum("n").alias("n"))
    least = F.get(F.lit([max(2.0 if min(n[x], sample_rows) > 20 else 1.0, LEAST_SHARE * min(n[x], sample_rows)) for x in languages]), F.col("number"))
    got = held.filter(F.col("n") >= least).select("number", "gram").toArrow()
    number, gram = got.column("number").to_numpy(), got.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(number, kind="stable")
    found = Filter(languages, np.split(gram[order], np.searchsorted(number[order], np.arange(1, len(languages)))))
    found.usual = max(languages, key=lambda x: (n[x], x))
    return found


def predict(df: DataFrame, learnt: Filter | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score). ``und`` (score 0) for a text that is null or has no letter, and if nothing was learnt.

    The score is the language's share of all corrected counts. Equal counts go to the
    first language in order; a text whose n-grams are all unknown gets the most usual
    language of the training rows with score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        names = np.array(learnt.languages, object) if learnt else None
        for whole in batches:
            for batch in slices([whole], "text", CHUNK):
                body, offsets = text_bytes(batch.column("text").fill_null(""))
                n = batch.num_rows
                lang, score = np.full(n, "und", object), np.zeros(n)
                if learnt:
                    counts, _ = learnt.counts(*grams(body, offsets), n)
                    total, best = counts.sum(1), counts.argmax(1)
                    lang = np.where(total > 0, names[best], learnt.usual)
                    score = np.where(total > 0, counts.max(1) / np.maximum(total, 1e-12), 0.0)
                    none = np.array([not (t and letter(t)) for t in batch.column("text").to_pylist()])
                    lang[none], score[none] = "und", 0.0
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["key", "lang_pred", "score"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, lang_pred string, score double").withColumnRenamed("key", key)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, held_out, lang_pred, score) of every row.

    Rows whose crc32(key as text) modulo ``folds`` is ``held_out`` are never learnt from;
    only the text is an input of a prediction. Repeated rows get equal predictions, an
    empty table gives an empty table, further columns are ignored.
    """
    aside = F.pmod(crc32_of_id(key), F.lit(folds)) == held_out
    learnt = train(df.filter(~aside), key, text, lang, sample_rows)
    return predict(df, learnt, key, text).select(key, aside.alias("held_out"), "lang_pred", "score")
