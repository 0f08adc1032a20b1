"""Hashes of substrings, and packed records that are dealt to buckets.

A record of a few numbers is much smaller than a row. A map task packs its records into
one row per bucket; the reducing task reads its buckets whole and sorts the records.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

from .columns import slices

#: Bytes that are hashed at a time.
CHUNK = 1 << 19

#: Records that a reducing task sorts at a time (at least one bucket).
SORT_AT_ONCE = 400_000

#: Bytes of rows that leave a task in one batch (one row at least).
OUT_AT_ONCE = 1 << 22

#: Hashes are pairs of polynomials modulo this prime, so no structure of a text makes two hashes meet (powers of two as moduli do, for the Thue-Morse word).
PRIME = (1 << 31) - 1
_P = np.uint64(PRIME)
_BASES = ((1_412_379_037, 784_193_329), (1_930_112_849, 362_437_181))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes whose products with powers can be summed without a remainder.
SUMMED = 1 << 24


def _folded(x: np.ndarray) -> np.ndarray:
    """The same residue, nearer to the prime: below 2^31 + 4 from below 2^62 in two steps."""
    high = x >> np.uint64(31)
    x &= _P
    x += high
    return x


def _run_of_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have, step = 1, base
    while have < n:  # doubled each time
        more = min(have, n - have)
        out[have:have + more] = out[:more] * np.uint64(step) % _P
        have, step = have + more, step * step % PRIME
    return out.astype(np.uint32)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """b^j and b^-j for j < n."""
    found = _POWERS.get(base)
    if found is None or len(found[0]) < n:
        n = max(n, CHUNK + (1 << 17))
        found = _run_of_powers(base, n), _run_of_powers(pow(base, -1, PRIME), n)
        if n <= 4 * CHUNK:
            _POWERS[base] = found
    return found


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hash of any substring of a chunk, from prefix sums of byte times power; two polynomials make 62 bits."""

    def __init__(self, chunk: np.ndarray, pair: int):
        self.sides = []
        value = chunk.astype(np.uint64) + np.uint64(1)
        for base in _BASES[pair]:
            up, down = powers(base, len(chunk) + 1)
            sums = np.zeros(len(chunk) + 1, np.uint64)
            np.multiply(value, up[:len(chunk)], out=sums[1:])
            for at in range(1, len(sums), SUMMED):  # whole for all but very long chunks
                part = sums[at:at + SUMMED]
                part[0] += sums[at - 1] % _P
                np.cumsum(part, out=part)
                if len(sums) > SUMMED:
                    part %= _P
            self.sides.append((sums, down))

    def _hash(self, pick) -> np.ndarray:
        out = None
        for sums, down in self.sides:
            stop, start, power = pick(sums, down)
            x = stop - start
            x += _P
            x = _folded(_folded(x))
            x *= power
            x = _folded(_folded(x))
            x[x >= _P] -= _P
            out = x if out is None else out << np.uint64(31) | x
        return mix(out)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self._hash(lambda sums, down: (sums[stop], sums[start], down[start]))

    def sliding(self, length: int) -> np.ndarray:
        n = len(self.sides[0][0]) - length
        return self._hash(lambda sums, down: (sums[length:], sums[:n], down[:n]))


def hashes_of_rows(rows: np.ndarray, pair: int) -> np.ndarray:
    """What ``Hashes`` gives for each row of a matrix of bytes (of fewer than SUMMED columns)."""
    value, out = rows.astype(np.uint64) + np.uint64(1), None
    for base in _BASES[pair]:
        x = (value * powers(base, rows.shape[1])[0][:rows.shape[1]]).sum(1, dtype=np.uint64) % _P
        out = x if out is None else out << np.uint64(31) | x
    return mix(out)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b): each node but the least of its tree with that least one."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        x, y = label[u], label[v]
        open_ = x != y
        if not open_.any():
            break
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above
    below = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[below]], ids[below]


def dealt(kind: int, records: np.ndarray, key: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed records, one row for each bucket that has any."""
    bucket = (key >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.concatenate((at, [len(records)])).astype(np.int64) * records.dtype.itemsize
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(records.tobytes())])
    yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int32)), data.cast(pa.binary())], names=["bucket", "kind", "records"])


def by_bucket(batches: Iterable[pa.RecordBatch], types: dict[int, np.dtype]) -> Iterator[dict[int, np.ndarray]]:
    """Whole buckets, about SORT_AT_ONCE records at a time, from rows that are sorted by bucket."""
    held: dict[int, list] = {k: [] for k in types}
    n, before = 0, None
    for batch in batches:
        for bucket, kind, data in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("records")):
            if bucket != before and n >= SORT_AT_ONCE:
                yield {k: np.concatenate([np.zeros(0, t), *held[k]]) for k, t in types.items()}
                held, n = {k: [] for k in types}, 0
            before = bucket
            records = np.frombuffer(data.as_buffer(), types[kind])
            held[kind].append(records)
            n += len(records)
    yield {k: np.concatenate([np.zeros(0, t), *held[k]]) for k, t in types.items()}


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        names = [n for n in whole.schema.names if n != "text"]
        for batch in slices([whole], "text", OUT_AT_ONCE):
            packed = [tool.compress((v.as_py() or "").encode()) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(packed, pa.binary())], names=[*names, "packed"])
