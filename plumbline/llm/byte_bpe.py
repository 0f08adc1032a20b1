"""Byte-level BPE as a transducer, and its streaming inverse.

The merges of a rank file are compiled into a finite-state transducer that reads bytes
and writes token ids. It is determinised lazily: a state is made the first time that a
text needs it.

Why a transducer exists. Let e(w) be the encoding of w. A sequence of tokens is an
encoding exactly if every two neighbours are the encoding of their own concatenation
(no merge ever crosses the boundary between them). So e(w c) ends in one token t, and
what stands before it is e of the shorter text. A state therefore holds, for every
position that a longer token may still start from, the node of that token's prefix in
the vocabulary's trie and the last token up to the position. The output of a step is the
last token of the text read so far; following these back from where all ways on agree
gives the tokens. Only positions within the longest token stay open, so the lookahead is
bounded.

Decoding is a table of bytes per token, followed by an incremental UTF-8 state machine
that holds back at most three bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import lean, slices

ROOT, START = 0, -1

#: Text that is encoded at a time.
BATCH_BYTES = 4 << 20

#: A prefix with at most so many longer tokens is followed only if one of them fits.
FEW = 12

#: States and memorised pieces of one Python worker; beyond them it starts anew.
MAX_STATES = 160_000
MAX_PIECES = 300_000
MAX_PAIRS = 250_000

#: Marks a word at the start of a line.
APART = "\0"

#: Symbols that often follow a word, and a word that is one run of letters whatever the version of Unicode.
MARKS = ".,;:!?*$%&#|"
LETTERS = re.compile(r"\0?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Tokens in a trie, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.edges: dict[int, int] = {}
        self.token_at: list[int] = [START]
        self.inner: list[bool] = [False]
        self.depth: list[int] = [0]
        self.below: list[tuple[int, ...]] = [()]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                below = self.edges.get(key)
                if below is None:
                    below = self.edges[key] = len(self.token_at)
                    self.token_at.append(START)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                    self.below.append(())
                    self.inner[node] = True
                if len(self.below[node]) <= FEW:
                    self.below[node] += (rank,)
                node = below
            self.token_at[node] = rank
        self._spines: dict[int, tuple[list, list] | None] = {}
        self._fits: dict[int, bool] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """The plain definition: merge the lowest rank, leftmost first. For short texts."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of the last merge that makes ``token``; None if merging never makes it."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                return None
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def spines(self, rank: int) -> tuple[list, list] | None:
        """The growing parts of a token at its left and at its right end, as (bytes, rank when made)."""
        found = self._spines.get(rank, 0)
        if found != 0:
            return found
        token = self.bytes_of[rank]
        if len(token) == 1:
            found = [(token, -1)], [(token, -1)]
        else:
            halves = self._halves(token)
            left = halves and self.spines(self.ranks[halves[0]])
            right = halves and self.spines(self.ranks[halves[1]])
            found = (left[0] + [(token, rank)], right[1] + [(token, rank)]) if left and right else None
        self._spines[rank] = found
        return found

    def fits(self, before: int, rank: int) -> bool:
        """True if no merge crosses the boundary between two tokens (before = START: rank stands first)."""
        key = before << 24 | rank
        known = self._fits.get(key)
        if known is not None:
            return known
        if len(self._fits) > MAX_PAIRS:
            self._fits.clear()
        self._fits[key] = fit = self._fit(before, rank)
        return fit

    def forget(self) -> None:
        self._fits.clear()

    def may_fit(self, before: int, node: int) -> bool:
        """False if every token that the prefix can still grow into is ruled out by what stands before."""
        longer = self.below[node]
        return len(longer) > FEW or any(self.fits(before, rank) for rank in longer)

    def _fit(self, before: int, rank: int) -> bool:
        own = self.spines(rank)
        if own is None:
            return False
        if before == START:
            return True
        left, right, i, j = self.spines(before)[1], own[0], 0, 0
        never = 1 << 60
        while True:
            grows_left = left[i + 1][1] if i + 1 < len(left) else never
            grows_right = right[j + 1][1] if j + 1 < len(right) else never
            crossing = self.ranks.get(left[i][0] + right[j][0], never)
            if crossing < never and crossing < grows_left and crossing <= grows_right:
                return False
            if grows_left == grows_right == never:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1


class Encoder:
    """Splits a text by the pattern and runs each match through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        import regex

        self.vocabulary, self.max_states, self.max_pieces = Vocabulary(ranks), max_states, max_pieces
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        """Give back what was learnt from texts; it is learnt anew when a text needs it."""
        self._restart()
        self.vocabulary.forget()
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _restart(self) -> None:
        self.number: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.moves: dict[int, int] = {}  # state and byte -> last token and next state
        self.start = self._state(array("i", (ROOT, START)).tobytes())

    def _state(self, items: bytes) -> int:
        number = self.number.get(items)
        if number is None:
            number = self.number[items] = len(self.states)
            self.states.append(items)
        return number

    def _step(self, state: int, byte: int) -> int:
        """Make the transition that no text has needed so far: the last token of the longer text, and the next state."""
        v = self.vocabulary
        items, alive, last = array("i", self.states[state]), array("i"), START
        for at in range(0, len(items), 2):
            before = items[at + 1]
            below = v.edges.get(items[at] << 8 | byte)
            if below is None:
                continue
            rank = v.token_at[below]
            if rank != START and last == START and v.fits(before, rank):
                last = rank
            if v.inner[below] and v.may_fit(before, below):
                alive.extend((below, before))
        if last == START:
            raise ValueError(f"no token for byte {byte}; the ranks must hold every byte")
        alive.extend((ROOT, last))
        made = self.moves[state << 8 | byte] = last << 32 | self._state(alive.tobytes())
        return made

    def _settled(self, state: int, lasts: list[int]) -> int:
        """Up to which byte all ways on agree: their chains of tokens have met there."""
        items = array("i", self.states[state])
        at = {len(lasts) - self.vocabulary.depth[items[k]] for k in range(0, len(items), 2)}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(max(0, far - self.length[lasts[far - 1]]))
        return at.pop()

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.vocabulary.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._restart()
        out: list[int] = []
        lasts: list[int] = []
        state, moves = self.start, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) > 2 * self.max_states:  # one endless match
                    kept = self.states[state]
                    self._restart()
                    state, moves = self._state(kept), self.moves
                move = self._step(state, byte)
            lasts.append(move >> 32)
            state = move & 0xFFFFFFFF
            if len(lasts) > 4096:  # write what is settled: memory stays bounded by the lookahead
                settled = self._settled(state, lasts)
                out += self._back(lasts, settled)
                del lasts[:settled]
        return out + self._back(lasts, len(lasts))

    def _back(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(lasts[end - 1])
            end -= self.length[lasts[end - 1]]
        out.reverse()
        return out

    def _matches(self, text: str) -> bytes:
        known, out = self.pieces, []
        for match in self.pattern.findall(text):
            ids = known.get(match)
            if ids is None:
                ids = array("i", self.piece(match.encode())).tobytes()
                if len(match) < 64:
                    known[match] = ids
            out.append(ids)
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of what stands between two lone spaces; APART in front: at the start of a line, without the space."""
        known = self.words
        stem = word.rstrip(MARKS)
        if LETTERS(stem):
            ids = known.get(stem)
            if ids is None:
                ids = array("i", self.piece((stem[1:] if stem[0] == APART else " " + stem).encode())).tobytes()
                if len(stem) < 64:
                    known[stem] = ids
            if stem != word:
                ids += self._matches(word[len(stem):])
        else:
            ids = self._matches(word[1:] if word[0] == APART else " " + word)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers.

        No match reaches over a space or line feed that stands alone between two other
        characters (a match only takes one space in front), so the text can be cut
        there, and equal cuts need one walk. Behind a run of letters a match ends too.
        """
        if not text:
            return b""
        for memory in (self.words, self.pieces):
            if len(memory) > self.max_pieces:
                memory.clear()
        if text.replace("\n", " ").split(" ") != text.split() or APART in text:  # white space side by side, at an end, or of another kind
            return self._matches(text)
        words = (APART + text).replace("\n", f" \n {APART}").split(" ")
        known = self.words
        if "\n" not in known:
            known["\n"] = self._matches("\n")
        long = {}
        for word in set(words).difference(known):
            (known if len(word) < 64 else long)[word] = self._word(word)
        if long:
            return b"".join([long[w] if w in long else known[w] for w in words])
        return b"".join(map(known.__getitem__, words))


#: Bytes that may follow the start of a character: (first allowed, last allowed, continuation bytes).
def _lead(byte: int) -> tuple[int, int, int]:
    if byte < 0x80:
        return 0, 0, 0
    if 0xC2 <= byte <= 0xDF:
        return 0x80, 0xBF, 1
    if 0xE0 <= byte <= 0xEF:
        return (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF), 2
    if 0xF0 <= byte <= 0xF4:
        return (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF), 3
    return 0, 0, -1


class Utf8Stream:
    """Takes bytes in any cuts, gives characters as soon as they are whole; ill-formed bytes become U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(tail: bytes) -> bool:
        """True if ``tail`` is the start of a character that needs more bytes."""
        low, high, needed = _lead(tail[0])
        if needed < 1 or len(tail) > needed:
            return False
        for byte in tail[1:]:
            if not low <= byte <= high:
                return False
            low, high = 0x80, 0xBF
        return True

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in (1, 2, 3):
            if back <= len(data) and self._open(data[-back:]):
                cut = len(data) - back
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], bytes_of: list[bytes], block: int = 8192) -> Iterator[str]:
    """Text of a stream of ids, block by block."""
    stream, ids = Utf8Stream(), list(ids)
    for at in range(0, len(ids), block):
        yield stream.feed(b"".join(map(bytes_of.__getitem__, ids[at:at + block])))
    yield stream.end()


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_TABLES: dict[str, list[bytes]] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker: its states serve all later tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def byte_table(path: str) -> list[bytes]:
    if path not in _TABLES:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _TABLES[path] = table
    return _TABLES[path]


def _lists(found: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
           keep: bool = True) -> DataFrame:
    """Adds ``ids`` (array<int>): the tokens of each whole text; and ``decoded``, if named: the text that these ids stand for.

    ``ranks`` is the path of a rank file that every executor can read. A null text counts
    as empty, an empty text has an empty array, a column that is called like a new one
    already is replaced, repeated rows are encoded each for itself, and an empty table
    gives an empty table. Encoding and decoding in one step need one Python worker.
    A worker keeps the states it has made for its later tasks; where other work follows
    in the same workers, ``keep=False`` gives that memory back at the end of each task.
    """
    df = df.drop(*(c for c in (ids, decoded) if c in df.columns and c != text))
    extra = [f"`{ids}` array<int>"] + ([f"`{decoded}` string"] if decoded else [])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, table = encoder(ranks, pattern), byte_table(ranks) if decoded else []
        try:
            for batch in slices(batches, text, BATCH_BYTES):
                found = [tool.encode(value or "") for value in batch.column(text).to_pylist()]
                columns, names = [*batch.columns, _lists(found)], [*batch.schema.names, ids]
                if decoded:
                    back = ["".join(decode_stream(np.frombuffer(one, np.int32).tolist(), table)) for one in found]
                    columns, names = [*columns, pa.array(back, pa.string())], [*names, decoded]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            if not keep:
                tool.forget()

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, ranks: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text`` (string) decoded from ``ids``; null or empty ids give an empty text."""
    df = df.drop(text) if text in df.columns and text != ids else df
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = ["".join(decode_stream(one.values.to_numpy(zero_copy_only=False).tolist(), table)) if one.is_valid else "" for one in batch.column(ids)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(lean(run), schema)


def digests(df: DataFrame, key: str = "doc_id", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Count of the ids, sha256 of the ids as text and sha256 of the decoded bytes."""
    return df.select(
        F.col(key), F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col(text), "UTF-8"), 256).alias("decoded_sha256"))
