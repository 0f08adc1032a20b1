"""Words of many texts at once, as positions and hashes in one array of bytes."""

from __future__ import annotations

import numpy as np

from .packing import Hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space 0, letters, digits and all bytes of other scripts 1, symbols 2.
KIND = np.full(256, 2, np.uint8)
KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1

#: Code points of scripts that are written without spaces: Thai and Lao, Tibetan, Myanmar, Khmer, Tai scripts, Chinese and Japanese.
UNSPACED = ((0x0E00, 0x0F00), (0x0F00, 0x10A0), (0x1780, 0x1800), (0x1950, 0x1AB0), (0x2E80, 0x3130), (0x3190, 0xA4D0), (0xA9E0, 0xAA80), (0xF900, 0xFB00), (0xFF00, 0xFFA0),
            (0x1AFF0, 0x1B170), (0x20000, 0x323B0))
#: Their punctuation, which counts as symbols.
UNSPACED_SYMBOLS = ((0x3000, 0x3005), (0x3008, 0x3021), (0x3030, 0x3031), (0xFF00, 0xFF10), (0xFF1A, 0xFF21), (0xFF3B, 0xFF41), (0xFF5B, 0xFF66), (0x104A, 0x1050), (0x17D4, 0x17DB), (0x0E4F, 0x0E50), (0x0E5A, 0x0E5C),
                    (0x0F04, 0x0F15), (0x30FB, 0x30FC))


def unspaced(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bytes, whether it is a symbol) of every character of a script without spaces."""
    lead = np.flatnonzero(body >= 0xE0)
    size = np.where(body[lead] >= 0xF0, 4, 3)
    lead, size = lead[lead + size <= len(body)], size[lead + size <= len(body)]
    point = body[lead].astype(np.int64) & np.where(size == 4, 0x07, 0x0F)
    for i in (1, 2, 3):
        more = i < size
        point = np.where(more, point << 6 | body[np.minimum(lead + i, len(body) - 1)] & 0x3F, point)
    within = lambda ranges: np.any([(point >= a) & (point < b) for a, b in ranges], axis=0)
    keep = within(UNSPACED)
    return lead[keep], size[keep], within(UNSPACED_SYMBOLS)[keep]


class Words:
    """Runs of bytes of one kind, never across two texts: ``start``, ``stop``, ``kind``, ``hash`` (A-Z lowered), and ``bounds`` per text.

    With ``characters`` each character of a script without spaces is a word of its own.
    """

    def __init__(self, body: np.ndarray, offsets: np.ndarray, symbols: bool = True, characters: bool = False):
        kind = KIND[body]
        single = unspaced(body) if characters else None
        if characters:
            at, size, symbol = (x[single[2]] for x in single)
            for i in range(4):
                kind[at[i < size] + i] = 2
        if not symbols:
            kind = np.where(kind == 2, 0, kind).astype(np.uint8)
        fresh = np.ones(len(body) + 1, bool)
        fresh[1:-1] = kind[1:] != kind[:-1]
        fresh[offsets] = True
        if characters:
            fresh[single[0]] = fresh[single[0] + single[1]] = True
        edge = np.flatnonzero(fresh)
        first, after = edge[:-1], edge[1:]
        solid = kind[first] > 0 if len(first) else np.zeros(0, bool)
        self.start, self.stop = first[solid], after[solid]
        self.kind = kind[self.start] if len(self.start) else np.zeros(0, np.uint8)
        self.hash = Hashes(LOWER[body], 0).of(self.start, self.stop) if len(body) else np.zeros(0, np.uint64)
        self.bounds = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
