"""Evaluation on a held-out split, as one chain from reviews to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewops.fixed_values import TOPIC_KEYWORDS, TOPICS
from reviewops.functions.text import mentions_any
from reviewops.operators import features, metrics, models, sentiment


def with_whole_word_predictions(df: DataFrame) -> DataFrame:
    """Second opinion on topics: keywords as whole words only, in ``pred_<topic>``."""
    lowered = df.withColumn("_lower", F.lower("review_text"))
    return lowered.withColumns({f"pred_{t}": mentions_any(F.col("_lower"), words, word_boundary=True) for t, words in TOPIC_KEYWORDS.items()}).drop("_lower")


def labelled(df: DataFrame) -> DataFrame:
    """Reviews with predicted and star-given sentiment and with both topic opinions; only rated reviews have a truth."""
    return (df.transform(sentiment.with_sentiment).transform(sentiment.with_rating_sentiment)
            .transform(with_whole_word_predictions))


def evaluation_report(df: DataFrame, seed: int = 42, test_size: float = 0.2) -> DataFrame:
    """Topic F1 and sentiment accuracy on the test part of the split."""
    split = features.split_train_test(df.filter(F.col("rating").isNotNull()), test_size, seed)
    summary = metrics.model_summary(labelled(split.filter("is_test")), TOPICS)
    return summary.agg(
        F.max(F.when(F.col("model") == "Topic", F.col("macro_f1"))).alias("topic_macro_f1"),
        F.max(F.when(F.col("model") == "Sentiment", F.col("accuracy"))).alias("sentiment_accuracy"),
        F.lit("lexicon").alias("method"), F.max("n").alias("n_test"))


def model_report(df: DataFrame, kind: str = "forest", test_size: float = 0.2, **options) -> DataFrame:
    """Train on keyword labels, predict the test part, report per topic."""
    split = features.split_train_test(df, test_size)
    train = models.train_forest if kind == "forest" else models.train_boosted
    model = train(split.filter(~F.col("is_test")), **options)
    predicted = model.with_probabilities(split.filter("is_test"))
    return metrics.topic_report(predicted, TOPICS)
