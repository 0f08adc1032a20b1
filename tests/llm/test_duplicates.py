"""Repeated windows and Jaccard links against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import jaccard_join, packing, queries, suffix_dedup
from plumbline.llm.components import components

from .conftest import ODD, SMALL


def brute_windows(docs, depth):
    """docs: (order, bytes) in ascending order."""
    seen, out = set(), []
    for data in docs:
        covered = bytearray(len(data))
        for s in range(len(data) - depth + 1):
            w = data[s:s + depth]
            if w in seen:
                covered[s:s + depth] = b"\1" * depth
            seen.add(w)
        out.append((bytes(c for c, k in zip(data, covered) if not k), sum(covered), len([x for x in bytes(covered).split(b"\0") if x])))
    return out


def made_documents():
    r = random.Random(5)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(60)]
    passage = " ".join(r.choice(words) for _ in range(40))
    docs = []
    for i in range(120):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 80)))
        if i % 3 == 0:
            text += " " + passage[r.randint(0, 20):] + " " + " ".join(r.choice(words) for _ in range(20))
        if i % 7 == 0 and docs:
            other = r.choice(docs).split(" ")
            other[r.randrange(len(other))] = "changed"
            text = " ".join(other)
        docs.append(text)
    docs += ["", "a" * 99, "a" * 100, "a" * 101, "ab" * 400, "é" * 80, "é" * 80, docs[3], docs[3]]
    return docs


@pytest.mark.parametrize("hot_least", [64, 2])
@pytest.mark.parametrize("depth, landmark", [(100, 24), (30, 8)])
def test_repeats_against_brute_force(spark, monkeypatch, hot_least, depth, landmark):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", hot_least)
    monkeypatch.setattr(suffix_dedup, "LANDMARK", landmark)
    docs = made_documents()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    spans, _ = suffix_dedup.repeated_spans(frame, depth=depth, landmark=landmark)
    removed = defaultdict(set)
    for r in spans.collect():
        removed[r.doc].update(range(r.start, r.stop))
    for i, (_kept, n, _runs) in enumerate(brute_windows([d.encode() for d in docs], depth)):
        assert len(removed[i]) == n, i


def test_suffix_query(spark):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    expected = brute_windows([b for _, b in rows], 100)
    got = {r.doc_id: r for r in queries.op7_suffix_dedup(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for (doc, data), (kept, n, runs) in zip(rows, expected):
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), n, runs, hashlib.sha256(kept).hexdigest())


def test_suffix_odd_rows(spark, odd_docs, no_docs):
    found = suffix_dedup.remove_repeats(odd_docs, carry=("score", "key")).collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found}
    texts = [b"No id here at all.", *((t or "").encode() for t in ODD[:-1])]
    for doc, (kept, n, _runs) in zip([None, *range(len(ODD) - 1)], brute_windows(texts, 100)):
        assert bytes(by_id[doc].kept) == kept and sum(s.stop - s.start for s in by_id[doc].removed) == n
    assert by_id[len(ODD) - 1].n_bytes == 220000 and len(by_id[len(ODD) - 1].kept) == 11
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def brute_links(docs, words, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        sets[i] = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (2, 60)])
@pytest.mark.parametrize("block", [1024, 3])
def test_links_against_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    r = random.Random(words)
    base = [" ".join(f"w{r.randint(0, 40)}" for _ in range(n)) for n in (4, 9, 12, 14, 20, 25, 40, 80, 150)]
    docs = []
    for i in range(150):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"v{r.randint(0, 9)}"
        docs.append(" ".join(w))
    docs = list(enumerate([*docs, "", "  ", "one", "One", "one two", "one  TWO"]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(frame, words=words, percent=percent).collect()}
    assert got == brute_links(docs, words, percent)


def test_jaccard_query(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in queries.op9_jaccard_join(spark, SMALL).collect()}
    assert got == brute_links(docs, 3, 90)


def test_jaccard_odd_rows(spark, odd_docs, no_docs):
    rows = jaccard_join.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[17].component_id == 16 and by_id[0].component_id == 0 and by_id[None].component_id is None and by_id[1].n_shingles == 0
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_one_key_with_two_texts_joins_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "other words here and some more")]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_one_key_with_two_near_texts(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (2, " ".join([*a, "more"])), (2, " ".join(b)), (3, " ".join([*b, "more"])), (3, " ".join([*b, "more"])), (4, "other words"), (None, "other words"), (5, None)]
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert [x[:2] for x in got] == [(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 4), (5, 5)]
    assert [x[2] for x in got] == [56, 56, 57, 57, 57, 1, 0]


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_thue_morse_words_differ(spark):
    one = thue_morse(10)
    two = one.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"{one} x y z"), (2, f"{two} x y z"), (3, one), (4, two), (5, f"{one} x y z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(frame, words=3, percent=90).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    cut = brute_windows([t.encode() for _, t in docs], 100)
    for r, (kept, n, _runs) in zip(sorted(suffix_dedup.remove_repeats(frame).collect(), key=lambda r: r.doc_id), cut):
        assert bytes(r.kept) == kept and sum(s.stop - s.start for s in r.removed) == n


def test_hashes_of_long_chunks(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(5000) * 2, np.uint8)
    want = packing.Hashes(data, 1)
    monkeypatch.setattr(packing, "SUMMED", 700)
    got = packing.Hashes(data, 1)
    start, stop = np.array([0, 3, 699, 10, 5010]), np.array([1, 900, 701, 5000, 10000])
    assert (got.of(start, stop) == want.of(start, stop)).all() and got.of(start, stop)[3] == got.of(start, stop)[4]
    assert (got.sliding(24) == packing.hashes_of_rows(np.lib.stride_tricks.sliding_window_view(data, 24), 1)).all()


def test_forest():
    r = random.Random(3)
    for n in (0, 1, 40, 400):
        links = [(r.randrange(300), r.randrange(300)) for _ in range(n)]
        low, doc = packing.forest(np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64))
        least = {x: x for link in links for x in link}
        for _ in range(n):
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        assert dict(zip(doc.tolist(), low.tolist())) == {x: y for x, y in least.items() if x != y} and len(set(doc.tolist())) == len(doc)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200


def test_no_task_sends_much_at_once(monkeypatch):
    """A document of a large family goes to many blocks, and texts are packed, cut and dealt, without one batch that holds all of it."""
    import pyarrow as pa

    words = " ".join(f"w{i}" for i in range(300))
    texts = [f"d{i} {words}" for i in range(40)]
    most = max(map(len, texts))
    for module in (packing, jaccard_join, suffix_dedup):
        monkeypatch.setattr(module, "OUT_AT_ONCE", 20_000)
    monkeypatch.setattr(suffix_dedup, "RECORDS_AT_ONCE", 500)
    rows = pa.RecordBatch.from_pydict({"doc": list(range(40)), "twin": [0] * 40, "text": texts})
    packed = list(packing.pack(iter([rows])))
    assert len(packed) > 2 and sum(b.num_rows for b in packed) == 40
    whole = pa.Table.from_batches(packed).combine_chunks().to_batches()[0]
    blocks = pa.array([[f"f/{j}" for j in range(30)]] * 40)
    sets = list(jaccard_join._sets(5)(iter([whole.append_column("blocks", blocks)])))
    one = len(jaccard_join._gram_hashes(*(lambda t: (np.frombuffer(t, np.uint8), np.array([0, len(t)])))(texts[0].encode()), 5)[0]) * 8
    assert sum(b.num_rows for b in sets) == 1200 and max(b.num_rows for b in sets) * one <= 20_000 + one
    got = {(b, d) for x in sets for b, d in zip(x.column("block").to_pylist(), x.column("doc").to_pylist())}
    assert len(got) == 1200
    kept = {"f": None}

    class Texts:
        def mapInArrow(self, run, schema):
            kept["f"] = run

    suffix_dedup._to_buckets(Texts(), np.zeros(0, np.uint64), 100, 24, 4)
    chunk = suffix_dedup.CHUNK
    monkeypatch.setattr(suffix_dedup, "CHUNK", 4 * most)
    dealt = [b for b in kept["f"](iter([rows])) if b.num_rows]
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    assert len(dealt) > 2
