"""Sentiment columns on reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewops.functions import lexicon
from reviewops.functions.numbers import half_even


def with_sentiment(df: DataFrame, column: str = "review_text") -> DataFrame:
    """Add ``sentiment_score`` and ``sentiment_label``."""
    return (df.withColumn("sentiment_score", lexicon.sentiment_score(F.col(column)))
            .withColumn("sentiment_label", lexicon.sentiment_label(F.col("sentiment_score"))))


def with_opinion(df: DataFrame, column: str = "review_text") -> DataFrame:
    """Add ``polarity`` and ``subjectivity``."""
    return df.withColumns({"polarity": lexicon.polarity(F.col(column)), "subjectivity": lexicon.subjectivity(F.col(column))})


def with_rating_sentiment(df: DataFrame) -> DataFrame:
    """Add the score and labels that follow from the star rating."""
    return df.withColumns({"star_score": lexicon.stars_to_score(F.rint("rating")),
                           "true_label": lexicon.rating_label(F.col("rating")),
                           "star_label": lexicon.sentiment_label(lexicon.stars_to_score(F.rint("rating")))})


def with_ensemble(df: DataFrame, weights: tuple[float, float, float] = (0.33, 0.33, 0.34)) -> DataFrame:
    """Add the ensemble of lexicon score, star score and polarity, their agreement and the consensus label."""
    parts = [F.col(c) for c in ("sentiment_score", "star_score", "polarity")]
    return (df.withColumn("ensemble_score", half_even(lexicon.ensemble_score(*parts, weights), 4))
            .withColumn("agreement", half_even(lexicon.score_agreement(*parts), 4))
            .withColumn("consensus_label", lexicon.sentiment_label(lexicon.ensemble_score(*parts, weights))))


def sentence_sentiment(df: DataFrame, column: str = "review_text") -> DataFrame:
    """Sentences per review by polarity, and their mean polarity."""
    scored = df.withColumn("_p", lexicon.sentence_polarities(F.col(column)))
    n = F.size("_p")
    negative, positive = F.size(F.filter("_p", lambda p: p < -0.1)), F.size(F.filter("_p", lambda p: p > 0.1))
    total = F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + p)
    return scored.withColumns({
        "sentence_count": n, "negative_sentences": negative, "positive_sentences": positive,
        "neutral_sentences": n - negative - positive,
        "avg_polarity": F.coalesce(half_even(F.try_divide(total, n), 4), F.lit(0.0))}).drop("_p")
