"""The pipeline's stages, one after the other, against brute force on what each was given."""

from collections import Counter

import pytest
from conftest import DATA
from samples import cut_repeats, words
from test_jaccard import expected

import corpus_pipeline
from alleloom.llm import classifier
from alleloom.llm.common import cut, table


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, DATA, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, DATA), name)
        out.append(docs)
    return out


def test_stages_keep_the_columns_of_documents(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
    assert [d.count() > 0 for d in steps] == [True] * 6


def test_only_texts_that_are_predicted_bad_go(steps):
    spark = steps[0].sparkSession
    scored = classifier.score(steps[0], classifier.train(steps[0], table(spark, DATA, "labels"))).collect()
    assert Counter(r["doc_id"] for r in steps[1].collect()) == Counter(r["doc_id"] for r in scored if r["score"] >= 0.3)
    good = table(spark, DATA, "labels").where("quality = 1").join(steps[0], "doc_id")
    assert good.join(steps[1], "doc_id", "left_semi").count() >= 0.95 * good.count()


def test_one_document_of_each_near_duplicate_group_stays(steps):
    """Groups link at Jaccard similarity 0.8 of five-word shingles, by comparing all texts with all."""
    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    assert Counter(r["doc_id"] for r in steps[2].collect()) == expected(rows)


def test_near_duplicates_without_ids(spark):
    from alleloom.llm.pipeline_stages import keep_one_of_each

    one, two = " ".join(f"one{i}" for i in range(50)), " ".join(f"two{i}" for i in range(50))
    rows = [(None, one), (None, one), (None, two), (7, "some other words"), (7, "some other words"), (9, None), (8, None)]
    got = keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert Counter(map(tuple, got.collect())) == Counter([(None, one), (None, two), (7, "some other words"), (8, None)])


def test_repeats_are_cut_from_what_was_kept(steps):
    rows = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in steps[3].collect()}
    for (i, t), w in zip(rows.items(), cut_repeats(list(rows.values())), strict=True):
        text = w[4].decode("utf-8", "ignore") if w[1] else t
        if w[1] and not text.strip():
            assert i not in got
        else:
            assert got[i][0] == text and (not w[1] or got[i][1] == len(text))


def test_documents_with_benchmark_passages_go(steps):
    before, after = ({r["doc_id"] for r in s.collect()} for s in steps[3:5])
    assert after < before
    items = [" ".join(words(r["text"].lower())) for r in table(steps[0].sparkSession, DATA, "benchmark").collect()]
    whole = {r["doc_id"] for r in steps[3].collect() if any(x in " ".join(words(r["text"].lower())) for x in items)}
    assert whole and not whole & after and len(before - after) < 0.1 * len(before)


def test_every_document_left_is_packed(steps):
    assert Counter((r["doc_id"], r["n_tokens"]) for r in steps[5].collect()) == Counter((r["doc_id"], len(words(r["text"])) + 1) for r in steps[4].collect())
