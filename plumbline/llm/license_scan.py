"""License notices in texts: fixed phrases, and short notices with spelling errors.

A notice that may have e errors is cut into e + 1 pieces; one of them at least stands
in the text unchanged (pigeonhole). All pieces of all notices are searched at once by an
Aho-Corasick automaton, each hit gives a window where the whole notice could be, and the
regex library's bounded-error matching verifies it and gives the errors and the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import keyed_text

# The phrases and labels of the base rule.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Short notices, their labels and the errors they may have.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2", 3),
    ("released under the mit license", "mit", 2),
    ("licensed under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person", "mit", 4),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("mozilla public license version 2 0", "mpl-2", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("free and unencumbered software released into the public domain", "unlicense", 4),
    ("all rights reserved", "all-rights-reserved", 1),
)

# Words are runs of these bytes; A-Z are lowered first.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ".encode(), label, len(p.split())) for p, label in phrases.items()]
        self.notices = [(text, label, errors, regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={errors}}}")) for text, label, errors in notices]
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for number, (text, _label, errors) in enumerate(notices):
            cuts = [round(i * len(text) / (errors + 1)) for i in range(errors + 2)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                pieces.setdefault(text[a:b], []).append((number, a, b))
        self.pieces = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.pieces.add_word(piece, uses)
        self.pieces.make_automaton()

    def base(self, line: bytes) -> list[tuple[int, str, int]]:
        """(first byte, label, words) of every place of a phrase in words joined by single spaces."""
        found = []
        for phrase, label, n in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, label, n))
                at = line.find(phrase, at + 1)
        return found

    def fuzzy(self, line: str) -> list[tuple[int, int, str, int, int]]:
        """(start, stop, label, errors, length of the notice) of every notice within its errors."""
        windows: dict[int, list[list[int]]] = {}
        for end, uses in self.pieces.iter(line):
            for number, a, b in uses:
                text, _label, errors, _pattern = self.notices[number]
                lo, hi = max(0, end + 1 - b - errors), end + 1 - b + len(text) + errors
                own = windows.setdefault(number, [])
                if own and lo <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        found = []
        for number, own in windows.items():
            text, label, _errors, pattern = self.notices[number]
            for lo, hi in own:
                part = line[lo:hi]
                for m in pattern.finditer(part):
                    found.append((lo + m.start(), lo + m.end(), label, sum(m.fuzzy_counts), len(text)))
        return found

    def scan(self, text: str) -> tuple:
        words = text.encode().translate(_TABLE).split()
        line = b" " + b" ".join(words) + b" "
        base = self.base(line)
        first = last = None
        if base:
            at, before, seen = sorted(b[0] for b in base), 0, 0
            places = []
            for place in at:  # a place's word is the number of spaces before it
                seen += line.count(b" ", before, place)
                before = place
                places.append(seen)
            first, last = places[0], places[-1]
        labels = {label for _, label, _ in base}
        flat, spans, best, own = line.decode("latin-1"), [], 1.0 if base else 0.0, set()
        for start, stop, label, errors, length in self.fuzzy(flat):
            own.add(label)
            best = max(best, 1 - errors / length)
            spans.append({"label": label, "first_word": flat.count(" ", 0, start + 1) - 1, "last_word": max(flat.count(" ", 0, start + 1), flat.count(" ", 0, stop)) - 1, "errors": errors})
        return len(words), len(base), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | own)), best, spans


_SCANNER: list[Scanner] = []

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,first_word:int,last_word:int,errors:int>>")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its words, the places of the base phrases, the labels, the best likeness and the spans of notices.

    ``score`` is 1 if a base phrase stands in the text, else the highest 1 - errors /
    length of a verified notice, else 0. Null and empty texts have no words, empty labels,
    null first and last word and score 0. Repeated rows are scanned each for itself; an
    empty table gives an empty table; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in batches:
            found = [_SCANNER[0].scan(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found)) or [()] * 8
            span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("errors", pa.int32())]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), span]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return keyed_text(df, key, text).mapInArrow(run, f"key long, {SCHEMA}").withColumnRenamed("key", key)
