"""Quality, language, licenses, decontamination and HTML: held-out accuracy, brute force and odd rows."""

import re
import zlib

import numpy as np
import pytest

from plumbline.llm import decontaminate, html_content, html_labelled, language_id, license_scan, quality, queries

from .conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = queries.op6_quality(spark, MIDDLE).collect()
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = np.array([s for s, q in held if q == 1]), np.array([s for s, q in held if q == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.9


def test_quality_never_reads_held_out_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (15, 0), (7, None), (99, 1)], "doc_id long, quality int")
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(no_docs, labels).count() == 0
    assert {r.score for r in quality.classify(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_ftrl_learns_and_stays_sparse():
    model = quality.Model(l1=0.05)
    for _ in range(50):
        model.learn(np.array([1, 3]), np.array([1.0, 0.01]), 1)
        model.learn(np.array([2, 3]), np.array([1.0, 0.01]), 0)
    w = model.weights()
    assert w[1] > 0.5 and w[2] < -0.5 and np.count_nonzero(w) <= 4


def test_language_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, MIDDLE).collect()
    assert len(rows) == len(lang) and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_language_odd_rows(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in language_id.identify(odd_docs).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[14].lang_pred == rows[15].lang_pred == "und" and rows[0].score == 0
    assert rows[16].lang_pred == "en" and len(rows) == odd_docs.distinct().count()
    assert language_id.identify(no_docs).count() == 0


def test_more_languages_than_a_machine_word_or_a_byte_holds(spark):
    r = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for i in range(270):
        words = ["".join(r.choice(letters, 8)) for _ in range(6)]
        rows += [(8 * i + j, " ".join(r.permutation(words)), f"l{i:03d}") for j in range(8)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: x for i, _t, x in rows}
    right = [x.lang_pred == lang[x.doc_id] for x in got]
    assert len(got) == len(rows) and sum(right) / len(right) > 0.98


def test_filter_counts_are_corrected():
    r = np.random.default_rng(1)
    own = r.integers(0, 1 << 40, 400_000, dtype=np.uint64)
    f = language_id.Filter(["a", "b"], [own, np.zeros(0, np.uint64)])
    other = r.integers(0, 1 << 40, 50_000, dtype=np.uint64)
    counts, total = f.counts(np.zeros(len(other), np.int64), other, 1)
    assert total[0] == len(other) and f.false[0] > 0.01 and counts[0][0] < 0.01 * len(other)
    inside, _ = f.counts(np.zeros(1000, np.int64), own[:1000], 1)
    assert inside[0][0] == pytest.approx(1000)


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        q = phrase.split()
        for j in range(len(w) - len(q) + 1):
            if w[j:j + len(q)] == q:
                places.append(j)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base_of(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_license_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = queries.op8_license_scan(spark, MIDDLE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert base_of(r) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score == 1) if r.n_base else (0 <= r.score <= 1)


def test_license_cases(spark, odd_docs, no_docs):
    texts = ["Under the MIT License under the mit license", "CC-BY-NC cc by nc", "Licensd under the Apache Licence, Version 2.0!", "relesed under the mit licence",
             "GNU Genral Public License", "nothing of the kind", "the mit licenses under", "Apache License, Version 2.0. 2", "under" + " " * 3 + "the\nmit.license"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [base_of(r) for r in rows] == [brute_base(t) for t in texts]
    assert [r.labels for r in rows[2:6]] == ["apache-2", "mit", "gpl", ""] and all(0 < r.score < 1 for r in rows[2:5])
    span = rows[3].spans[0]
    assert (span.label, span.first_word, span.last_word, span.errors) == ("mit", 0, 4, 2)
    assert len(license_scan.scan(odd_docs).collect()) == odd_docs.count() and license_scan.scan(no_docs).count() == 0


def test_leaks_with_substitutions(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    items = [" ".join(r.choice(words, 30)) for _ in range(40)]
    docs, truth = [], set()
    for i in range(200):
        text = list(r.choice(words, 120))
        if i % 4 == 0:
            item = items[(i // 4) % 40].split()
            for at in r.choice(30, i % 3, replace=False):
                item[at] = "other"
            text[50:50] = item
            truth.add((i, (i // 4) % 40))
        docs.append((i, " ".join(text)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate.overlaps(frame, bench).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == truth and all(x.text_start in range(50, 56) for x in rows)
    several = decontaminate.overlaps(frame, bench, index_rows=200).collect()
    assert sorted(map(tuple, several)) == sorted(map(tuple, rows))
    assert decontaminate.clean(frame, bench).count() == 200 - len({d for d, _ in truth})


def missed_alignment(masks, least):
    """The shortest segment of matches (1) and substitutions (0) that the verification accepts and no mask meets, or None.

    Inside a best segment no sum from its start is negative and the last is larger than all before.
    """
    masks = [int(m, 2) for m in masks]
    keep = (1 << max(m.bit_length() for m in masks) - 1) - 1
    states = {(0, 0, 0, 0): ""}
    for last, matched, total, most in (queue := list(states)):
        way, full = states[last, matched, total, most], last << 1 | 1
        after = []
        if total >= 2:
            after.append((last << 1 & keep, matched, total - 2, most))
        if not any(full & m == m for m in masks):
            if total + 1 > most and matched + 1 >= least:
                return way + "1"
            after.append((full & keep, min(least, matched + 1), total + 1, max(most, total + 1)))
        for state in after:
            if state not in states:
                states[state] = way + "01"[state[0] & 1]
                queue.append(state)
    return None


def test_masks_meet_every_accepted_alignment():
    assert missed_alignment(("1111110111", "1101101111", "1011111011", "1111011101"), 10) is not None
    assert missed_alignment(decontaminate.MASKS, decontaminate.MIN_MATCHED) is None


def brute_overlaps(docs, items, least):
    """Best accepted segment of every text and item, from the verification of every alignment."""
    out = set()
    for d, text in docs:
        for i, item in items:
            a, b = np.array(text.split()), np.array(item.split())
            found = []
            for shift in range(1 - len(b), len(a)):
                lo, hi = max(0, shift), min(len(a), shift + len(b))
                start, stop, matched = decontaminate.best_segment(a[lo:hi] == b[lo - shift:hi - shift])
                if matched >= min(least, len(b)):
                    found.append((matched, -(stop - start), -(lo + start), -(lo + start - shift)))
            if found:
                matched, n, at, place = max(found)
                out.add((d, i, -at, -place, -n, matched))
    return out


def test_leaks_against_every_alignment(spark):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(words, n))) for i, n in enumerate([10, 11, 15, 15, 20, 30, 59])]
    docs = []
    for i, item in items:
        changes = [range(start, 99, step) for step in (3, 4, 5) for start in range(step)]
        changes += [r.choice(len(item.split()), k, replace=False) for k in (0, 1, 2, 3, 4, 4, 5, 6)]
        for change in changes:
            passage = [f"other{j}" if j in set(change) else w for j, w in enumerate(item.split())]
            cut = int(r.integers(0, 3))
            docs.append((len(docs), " ".join([*r.choice(words, 5), *passage[cut:], *r.choice(words, 5)])))
    want = brute_overlaps(docs, items, 10)
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 60


def test_short_items_and_scripts_without_spaces(spark):
    items = [(0, "What is heat?"), (1, "two words"), (2, "one two three four five six seven eight nine"), (3, "今天天气怎么样？"),
             (4, "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。"), (5, "ภาษาไทยไม่มีช่องว่างระหว่างคำ"), (6, "alone"), (7, "𠀀𠀁𠀂")]
    docs = [(0, "So what IS heat, then"), (1, "what is the heat"), (2, "Two-words!"), (3, "zero one two three four five six seven eight nine ten"),
            (4, "one two three four six five seven eight nine"), (5, "他问：今天天气怎么样。我说很好"), (6, "今天天气很好"), (7, "昔、吾輩は犬である。名前はまだ無い。どこで生れたかとんと見当がつかぬという。"),
            (8, "เขาพูดว่าภาษาไทยไม่มีช่องว่างระหว่างคำครับ"), (9, "left alone"), (10, "ab𠀀𠀁𠀂cd"), (11, "two"), (12, "words two")]
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    rows = {(x.doc_id, x.item_id): x for x in decontaminate.overlaps(frame, bench).collect()}
    assert set(rows) == {(0, 0), (2, 1), (3, 2), (5, 3), (7, 4), (8, 5), (10, 7)}
    assert tuple(rows[3, 2])[2:] == (1, 0, 9, 9) and tuple(rows[5, 3])[2:] == (2, 0, 7, 7)
    assert {r.doc_id for r in decontaminate.clean(frame, bench).collect()} == {1, 4, 6, 9, 11, 12}


def test_leak_query_finds_every_whole_passage(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontaminate(spark, MIDDLE).collect()}
    assert got == {(d, i) for i, b in items for d, t in docs if b in t}


def test_leaks_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(0, None), (1, ""), (2, "short item"), (3, "The same text. " * 6), (3, "The same text. " * 6), (None, "x")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(odd_docs, bench).collect()} == {(16, 3), (17, 3)}
    cleaned = decontaminate.clean(odd_docs, bench)
    assert cleaned.columns == odd_docs.columns and cleaned.count() == odd_docs.count() - 3
    assert decontaminate.overlaps(no_docs, bench).count() == 0 and decontaminate.overlaps(odd_docs, bench.limit(0)).count() == 0


PAGES = [
    ("<body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><article><h1>Stone  bridge</h1><p>One &amp; two.<br>Three&nbsp;four</p><div class='ad'>Buy now</div>"
     "<p>Last <b>bo</b>ld.</p></article></main><aside>Other news</aside><footer>&copy; 2020</footer></body>", "Stone bridge One & two. Three four Last bold."),
    ("<div id=menu><ul><li><a href=1>A</a></li><li><a href=2>B</a></li></ul></div><div class='content'><p>The river runs past the town, and then on.</p><p>It ends there.</p></div>"
     "<div class='sidebar'><p>Popular posts of the week.</p></div><div class=footer>Imprint</div>", "The river runs past the town, and then on. It ends there."),
    ("<article><p>Text here.</p></article><section id='comments'><h2>Comments</h2><div class='comment'><p>I like this very much, thanks.</p></div></section>"
     "<form class='newsletter'><label>Mail</label><input></form><div class='cookie-notice'><p>We use cookies.</p></div>", "Text here."),
    ("<script>var a='<article>no</article>';</script><style>p{}</style><article><p>Yes.<p>More.</article>", "Yes. More."),
]


def test_html_layouts():
    model = html_content.trained()
    assert [model.text(source) for source, _ in PAGES] == [text for _, text in PAGES]


def test_html_on_unseen_labelled_pages():
    model, right, total = html_content.trained(), 0, 0
    for seed in range(5000, 5100):
        page = html_content.Page(html_labelled._Writer(seed).page())
        for label, p, size in zip(page.labels(), model.marginals(page), page.size):
            if size:
                total += 1
                right += (label == html_content.ARTICLE) == (p[html_content.ARTICLE] >= 0.5)
    assert right / total > 0.97


def test_marginals_equal_enumeration():
    from itertools import product

    model = html_content.trained()
    page = html_content.Page("<body><nav><a>x</a></nav><div class=content><p>Some words here.</p><p>y</p></div></body>")
    feats, n = page.features(), len(page.tag)
    weight = np.zeros((n, 3))
    for states in product(range(3), repeat=n - 1):
        s = (0, *states)
        w = 1.0
        for node in range(n):
            for f in feats[node]:
                w *= model.node[f][s[node]] if f in model.node else 1.0
            if node:
                w *= model.edge.get(page.tag[node], model.edge["*"])[s[page.parent[node]]][s[node]]
        for node in range(n):
            weight[node, s[node]] += w
    assert np.allclose(np.array(model.marginals(page)), weight / weight.sum(1, keepdims=True), atol=1e-9)


def test_html_query(spark):
    import html as H

    pages = {r.page_id: r for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    rows = queries.op1_html_content(spark, MIDDLE).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.S)[1]
        want = " ".join(" ".join(H.unescape(x) for x in re.split(r"<(?:/?p|/?h1|br)>", re.sub(r"</?b>", "", inner))).split())
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_html_odd_rows(spark):
    odd = [None, "", "<", "a < b", "<p", "<article", "<!-- open", "<article><p>x", "</p></p>", "<article>" * 3000 + "deep", "<a" * 2000, "<p class='unclosed>x", "&#0;&bogus;&amp"]
    frame = spark.createDataFrame([(i, None, h, "text", 3) for i, h in enumerate(odd)], "page_id long, url string, html string, text string, n_chars int")
    rows = {r.page_id: r for r in html_content.extract(frame).collect()}
    assert len(rows) == len(odd) and rows[0].text == "" and rows[7].text == "x" and rows[0].n_chars == 0
    assert html_content.extract(frame.limit(0)).count() == 0


def test_alignments_are_those_of_all_hits():
    r = np.random.default_rng(4)
    for vocabulary in (1, 2, 3, 40):
        items = [(i, r.integers(1, 1 + vocabulary, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for i, n in enumerate((2, 9, 10, 14, 30, 31))]
        index = decontaminate.Index(items, decontaminate.MASKS)
        word = r.integers(1, 1 + vocabulary, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        text = np.sort(r.integers(0, 6, 300))
        want = set()
        for i, own in items:
            for mask in decontaminate.MASKS if len(own) >= 10 else ["1" * len(own)]:
                mine, theirs = decontaminate.seeds(own, mask), decontaminate.seeds(word, mask)
                for p in range(len(theirs)):
                    if text[p] == text[p + len(mask) - 1]:
                        want |= {(int(text[p]), i, p - int(q)) for q in np.flatnonzero(mine == theirs[p])}
        # A diagonal that goes on from a hit of the same mask is known from there.
        assert {tuple(x) for x in index.alignments(word, text).tolist()} == want


def test_repetitive_texts_in_bounded_memory():
    import tracemalloc

    item = np.full(200, 7, np.uint64)
    index = decontaminate.Index([(0, item)], decontaminate.MASKS)
    word, text = np.full(350_000, 7, np.uint64), np.zeros(350_000, np.int64)
    tracemalloc.start()
    ways = index.alignments(word, text)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert 350_000 <= len(ways) <= 350_200


def test_words_of_equal_polynomials_are_no_passage(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y")], "doc_id long, text string")
    items = spark.createDataFrame([(5, f"x {one} y")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.overlaps(docs, items).collect()] == [1]


BODY = "<h1>A long title</h1><p>The first paragraph has some words in it.</p><p>The second one says a little more than that.</p>"
TEXT = "A long title The first paragraph has some words in it. The second one says a little more than that."


@pytest.mark.parametrize("page", [
    f"<body>{BODY}</body>",
    f"<html><head><title>t</title></head><body><div>{BODY}</div></body></html>",
    f"<body><div><div>{BODY}</div></div></body>",
    f"<body><table><tr><td>{BODY}</td></tr></table></body>",
    f"<body><div class='css-1q8xz7k'>{BODY}</div></body>",
    f"<body>{TEXT}</body>",
    f"<body><nav><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul></nav><div>{BODY}</div><footer>Copyright 2020</footer></body>",
    f"<body><div class='menu'><a href=x>Home</a> <a href=y>News</a></div>{BODY}<div class='footer'>All rights reserved</div></body>",
])
def test_pages_without_a_known_container(page):
    assert html_content.trained().text(page) == TEXT


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</section>" * 40_000, "<span>" * 40_000 + "<p>x</p></b>" * 40_000, "<canvas>" * 60_000 + "x", "<ul><li><ul>" + "<div>" * 20_000 + "<li>y</li>" * 20_000,
                                  "<svg>" * 60_000, "<td>" * 100_000])
def test_long_pages_take_linear_time(page):
    import time

    begin = time.time()
    html_content.Page(page)
    assert time.time() - begin < 5
