import random

import numpy as np

from reviewops.llm import cotraining
from reviewops.llm.queries import QUERIES
from tests.llm.conftest import sorted_rows


def test_scores_tell_good_from_bad(spark, small):
    rows = QUERIES["op10_quality_classifier"](spark, small).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(0 <= p <= 1 for r in rows for p in (r.p_text, r.p_page, r.score))
    good = [r.score for r in rows if truth.get(r.doc_id) == 1]
    bad = [r.score for r in rows if truth.get(r.doc_id) == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert sorted_rows(rows) == sorted_rows(QUERIES["op10_quality_classifier"](spark, small).collect())


def test_views_teach_each_other(spark):
    """Held-out documents without any labelled word are judged right, as the other view knows their source."""
    random.seed(2)
    docs, labels = [], []
    for i in range(900):
        good = i % 2
        labelled = i < 60
        theme = 0 if labelled else 1 + i % 3 // 2
        text = " ".join(f"{'good' if good else 'bad'}{theme}x{random.randint(0, 6)}" for _ in range(12)) + " common words here"
        docs.append((i, text, f"{'fine' if good else 'poor'}{i % 4}", "en", len(text)))
        if labelled:
            labels.append((i, good))
    schema = "key bigint, text string, source string, lang string, length bigint"
    df = spark.createDataFrame(docs, schema)
    model = cotraining.learn(df, spark.createDataFrame(labels, "key bigint, good int"), rounds=6, sure=0.7)
    blind = spark.createDataFrame([(i, t, None, None, None) for i, t, *_ in docs if i >= 60], schema)
    rows = cotraining.scored(blind, model).select("key", "quality.text").collect()
    assert np.mean([(r.text >= 0.5) == r.key % 2 for r in rows]) > 0.95


def test_odd_tables(spark, nasty, empty):
    docs = spark.read.parquet(f"{nasty}/documents.parquet").selectExpr("doc_id as key", "text", "source", "lang", "n_chars as length", "kept as quality")
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, 1), (None, 1), (99, None)], "key bigint, good int")
    for given in (labels, labels.limit(0), labels.where("good = 1")):
        rows = cotraining.scored(docs, cotraining.learn(docs, given)).collect()
        assert len(rows) == docs.count() and all(0 <= r.quality.score <= 1 for r in rows)


def test_rare_source_is_learned_from_unlabelled_documents(spark):
    """One document in five thousand comes from a source without any label; its text view teaches what the source is worth."""
    random.seed(3)
    docs, labels = [], []
    for i in range(15_000):
        good, rare, labelled = i % 2, i % 5000 in (2, 3), i < 80
        source = ("gem" if good else "dump") if rare and not labelled else f"{'fine' if good else 'poor'}{i % 4}" if labelled else f"new{i % 3}"
        text = " ".join(f"{'good' if good else 'bad'}x{random.randint(0, 6)}" for _ in range(12)) + " common words here"
        docs.append((i, text, source, "en", len(text)))
        if labelled:
            labels.append((i, good))
    df = spark.createDataFrame(docs, "key bigint, text string, source string, lang string, length bigint").repartition(5)
    model = cotraining.learn(df, spark.createDataFrame(labels, "key bigint, good int"), rounds=2, share=0.5)
    pages = spark.createDataFrame([(1, None, "gem", "en", 80), (2, None, "dump", "en", 80), (3, None, "never seen", "en", 80)], df.schema)
    chances = {r.key: r.quality.page for r in cotraining.scored(pages, model).collect()}
    assert chances[1] > chances[3] + 0.002 and chances[3] > chances[2] + 0.002, chances
