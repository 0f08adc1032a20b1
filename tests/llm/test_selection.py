"""Importance resampling, hard negatives and source mixing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import curriculum, hard_negatives, importance, queries

from .conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute_resample(docs, target, percent=5, least=20):
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        n, fs = features(text)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {r[0]: i + 1 for i, r in enumerate(able[:len(able) * percent // 100])}
    return {(k, f, w, s, ranks.get(k)) for k, n, f, w, s in out}


def test_crc_composition():
    r = random.Random(3)
    words = [bytes(r.choice(b"abcz09\xc3\xa9") for _ in range(n)) for n in (1, 2, 3, 47, 48, 49, 96, 97, 500, 3)]
    crc, length = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    for n, (first, found) in enumerate(importance.buckets_of(crc, length, np.array([0, 4, 4, 10]), 3, 1 << 31), 1):
        want = [(i, zlib.crc32(b" ".join(words[i:i + n])) % (1 << 31)) for i in range(10) if (i < 4) == (i + n - 1 < 4) and i + n <= 10]
        assert list(zip(first.tolist(), found.tolist())) == want


@pytest.mark.parametrize("words", [0, 3, 60_000])
def test_resampling_against_brute_force(spark, odd_docs, words, monkeypatch):
    monkeypatch.setattr(importance, "RANK_ROWS", 40)
    r = random.Random(5)
    vocabulary = ["Alpha", "beta", "gamma", "x" * 70, "été", "漢字", "the", "of", "9"]
    docs = [(100 + i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(200)]
    frame = odd_docs.select("doc_id", "text", "lang", F.lit(1).alias("weight")).unionByName(
        spark.createDataFrame([(k, t, "en", 1) for k, t in docs], "doc_id long, text string, lang string, weight int"))
    rows = [tuple(x) for x in frame.select("doc_id", "text").collect()]
    target = ["the ALPHA of beta", None, "", "gamma-9 the of", "été " * 30]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "doc_id long, text string")
    got = importance.resample(frame, wanted, percent=30, words=words).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert len(got) == len(rows)
    once = list(dict.fromkeys(rows))
    want = brute_resample(rows, target, 30)
    repeated = {k for k, c in Counter(k for k, _ in rows).items() if c > 1}
    assert {tuple(x) for x in got if x[0] not in repeated} == {x for x in want if x[0] not in repeated}
    assert len({tuple(x)[:4] for x in got}) == len(once)
    assert sorted(x[4] for x in got if x[4]) == list(range(1, sum(features(t)[0] >= 20 for _, t in rows) * 30 // 100 + 1))


def test_resampling_empty(spark, odd_docs, no_docs):
    assert importance.resample(no_docs, odd_docs).count() == 0
    assert importance.resample(odd_docs, no_docs).count() == odd_docs.count()


def test_resampling_query(spark):
    read = lambda t: [tuple(x) for x in spark.read.parquet(f"{SMALL}/{t}.parquet").collect()]
    want = brute_resample([(x[0], x[1]) for x in read("documents")], [x[1] for x in read("benchmark")])
    got = {tuple(x) for x in queries.queries()["op11_importance_resampling"](spark, SMALL).collect()}
    assert got == want


def brute_negatives(rows, every, positives=5, negatives=3):
    clean = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            clean[i] = min(clean.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    out = set()
    for a, (label, v) in clean.items():
        if a % every:
            continue
        near = sorted((-dot(v, w), i) for i, (other, w) in clean.items() if i != a and other == label)[:positives]
        far = sorted((-dot(v, w), i) for i, (other, w) in clean.items() if other != label)
        for s, p in near:
            able = [(n, i) for n, i in far if -50 * s <= -100 * n <= -95 * s][:negatives]
            out |= {(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(able)}
    return out


@pytest.mark.parametrize("anchors, candidates", [(2048, 16384), (3, 20)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, anchors, candidates):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", candidates)
    r = random.Random(8)
    centre = [[r.gauss(0, 0.5) for _ in range(11)] for _ in range(3)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in centre[i % 3]], i * i % 4) for i in range(160)]
    rows += [(200 + i, list(centre[0]), 5 + i % 2) for i in range(30)]  # ties
    rows += [(400, None, 1), (405, [1.0, None], 1), (410, [float("nan")] * 11, 1), (415, [1.0], None), (420, [], 1), (425, [1.0, -2.0], 2), (430, [float("inf")], 1), (None, [1.0], 1), rows[10], (15, [0.0] * 11, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("packed", F.lit(1)).withColumn("pair", F.lit("x"))
    got = hard_negatives.mine(hard_negatives.quantised(frame), F.col("id") % 5 == 0).collect()
    assert {tuple(x) for x in got} == brute_negatives(rows, 5) and len(got) == len(brute_negatives(rows, 5))


def test_four_russians_scores():
    r = np.random.default_rng(1)
    for low, high, planes in ((-3, 4, 3), (-160, 160, 9), (-2 ** 40, 2 ** 40, 41)):
        a, c = r.integers(low, high, (7, 24)), r.integers(low, high, (9, 24))
        kind = hard_negatives.kind_for(planes, planes, 24)
        got = hard_negatives.scores(hard_negatives.tables_of(a, kind), hard_negatives.planes_of(c, planes))
        assert (got == c.astype(object) @ a.astype(object).T).all()


def test_hard_negatives_large_and_empty(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert hard_negatives.mine(hard_negatives.quantised(spark.createDataFrame([], schema)), F.col("id") % 5 == 0).count() == 0
    rows = [(0, [1e12, 3.0], 1), (1, [1e12, 1.0], 1), (2, [0.9e12, 0.0], 2), (3, [-1e12, 0.0], 2)]
    got = hard_negatives.mine(hard_negatives.quantised(spark.createDataFrame(rows, schema)), F.col("id") == 0).collect()
    assert [tuple(x)[:4] for x in got] == [(0, 1, 1, 2)] or got == []  # scores beyond a long count as its ends
    alone = spark.createDataFrame([(0, [1.0], 1)], schema)
    assert hard_negatives.mine(hard_negatives.quantised(alone), F.col("id") == 0).count() == 0


def test_mixing_targets_and_order(spark, odd_docs):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40))), s) for i in range(400) for s in [r.choice(["a", "b", "c", "d", None, ""])]]
    rows += [(900, "big " * 3000, "huge"), (901, None, "nothing"), (None, "no id", "a"), (None, "no id", "a"), (902, "Z", "Ä")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("range", F.lit(1))
    mixed = curriculum.mix(frame, ranges=8)
    got = mixed.collect()
    assert sorted(mixed.columns) == ["doc_id", "size", "source", "source_size", "taken", "target", "visits"]
    assert Counter((x["doc_id"], x["size"], x["source"]) for x in got) == Counter((i, len((t or "").split()), s) for i, t, s in rows)
    size = Counter()
    for i, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(size)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for x in got:
        assert x["source_size"] == size[x["source"]] and x["target"] == pytest.approx(target[x["source"]])
        assert 0 <= x["taken"] <= 2 * x["size"] and x["taken"] == sum(v["words"] for v in x["visits"])
        assert all(0 <= v["position"] <= 1 for v in x["visits"])
        taken[x["source"]] += x["taken"]
    assert all(taken[s] == math.floor(target[s] + 0.5) for s in size)
    order = curriculum.training_order(mixed).collect()
    assert [x["position"] for x in order] == sorted(x["position"] for x in order)
    assert sum(x["words"] for x in order) == sum(taken.values())
    assert Counter(map(str, got)) == Counter(map(str, curriculum.mix(frame.repartition(7), ranges=3).collect()))
    # Words up to a time follow the integral of the schedule, within one document.
    for s, schedule in ((names[0], (1.0, 1.0, 1.0)), ("huge", None), (names[1], (0.25, 1.0, 1.75)), (names[2], (1.75, 1.0, 0.25))):
        if schedule and target[s]:
            half = (schedule[0] + schedule[1]) / 2 / (schedule[0] / 2 + schedule[1] + schedule[2] / 2)
            early = sum(x["words"] for x in order if x["source"] == s and x["position"] < 0.5)
            assert abs(early - half * target[s]) <= 41


def test_mixing_odd_and_empty(spark, odd_docs, no_docs):
    assert curriculum.mix(no_docs).count() == 0
    got = curriculum.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    nothing = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(x["size"], x["target"], x["taken"]) for x in curriculum.mix(nothing).collect()] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        curriculum.mix(odd_docs, share=3.0)


def test_mixing_is_native(spark):
    plan = queries.queries()["op13_source_mixing"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
