"""The corpus pipeline, stage by stage, against plain Python."""

import corpus_pipeline
import pytest

from plumbline.llm import byte_bpe
from plumbline.runtime import cut_lineage

from .conftest import SMALL
from .test_duplicates import brute_links, brute_windows


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SMALL), name)
        out.append(docs)
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "suffix_dedup", "decontamination", "byte_bpe"]
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_stage_drops_junk_only(spark, stages):
    kept = rows_of(stages[1])
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        assert (r.doc_id in kept) == (r.quality == 1)


def test_near_duplicates_stage(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    links = brute_links([(i, r.text) for i, r in before.items()], 5, 80)
    assert set(after) == {i for i, (_n, c) in links.items() if c == i}


def test_suffix_stage(stages):
    before, after = sorted(rows_of(stages[2]).items()), rows_of(stages[3])
    for (i, _r), (kept, _n, _runs) in zip(before, brute_windows([r.text.encode() for _, r in before], 100)):
        if kept:
            assert after[i].text == kept.decode("utf-8", "ignore") and after[i].n_chars == len(after[i].text)
        else:
            assert i not in after


def test_decontamination_stage(spark, stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for i, r in before.items():
        assert (i in after) == (not any(x in r.text for x in items))


def test_tokens_stage_and_run(spark, stages):
    tokens, texts = rows_of(stages[5]), rows_of(stages[4])
    assert set(tokens) == set(texts) and all(r.exact for r in tokens.values())
    import public_tokenizers as P

    tool = byte_bpe.byte_table(P.path("byte_bpe_50k.tiktoken"))
    assert all(b"".join(tool[x] for x in r.ids).decode() == texts[i].text for i, r in tokens.items())
    assert {i: r.n_tokens for i, r in rows_of(corpus_pipeline.run(spark, SMALL)).items()} == {i: r.n_tokens for i, r in tokens.items()}


def test_stages_judge_rows_without_an_id_or_under_a_shared_one(spark, stages):
    judged = stages[0].join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    good, bad = [[r.text for r in judged.filter(f"quality = {q} AND length(text) BETWEEN 200 AND 2000").orderBy("doc_id").limit(2).collect()] for q in (1, 0)]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    texts = lambda df: sorted((r.doc_id or -1, r.text) for r in df.collect())
    docs = stages[0].select("doc_id", "text").unionByName(frame([(None, good[0]), (None, bad[0]), (10**9, good[1]), (10**9, bad[1])]))
    kept = corpus_pipeline.keep_quality(spark, docs, SMALL).filter("doc_id IS NULL OR doc_id = 1000000000")
    assert texts(kept) == [(-1, good[0]), (10**9, good[1])]
    rows = [(None, "a leak " + item), (None, "clean text"), (5, item), (5, "another clean text")]
    assert texts(corpus_pipeline.decontaminated(spark, frame(rows), SMALL)) == [(-1, "clean text"), (5, "another clean text")]
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, one), (None, one + " more"), (None, two), (5, two), (5, three), (5, three), (6, three + " more"), (7, "")]
    kept = texts(corpus_pipeline.drop_near_duplicates(spark, frame(rows), SMALL))
    assert len(kept) == 4 and kept[0][0] == -1 and kept[0][1] in (one, one + " more") and kept[1:] == [(5, two), (5, three), (7, "")]


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, SMALL), name)
    assert docs.count() == 0
