"""Rule-based sentiment columns over the valence lexicon.

Each score is a pure column: words are looked up in constant hash sets inside the
row, so scoring neither shuffles nor explodes the text. Valences are integers in
hundredths, which makes every sum exact and independent of order.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

from reviewops.fixed_values import LEXICON, NEGATION_FACTOR, NEGATION_REACH, NEGATIONS, SCORE_ALPHA
from reviewops.functions.numbers import half_even
from reviewops.functions.text import alphabetic_words, clean_text, is_blank, let, sentences


@lru_cache(maxsize=None)
def _levels() -> tuple[tuple[int, int, tuple[str, ...]], ...]:
    return tuple((valence, subjectivity, tuple(words)) for valence, subjectivity, words in LEXICON)


def word_valence(word: Column) -> Column:
    """Valence in hundredths, 0 for words outside the lexicon."""
    out = F
    for valence, _, words in _levels():
        out = out.when(word.isin(*words), valence)
    return out.otherwise(0)


def word_subjectivity(word: Column) -> Column:
    """Subjectivity in hundredths, NULL for words outside the lexicon."""
    out = F
    for _, subjectivity, words in _levels():
        out = out.when(word.isin(*words), subjectivity)
    return out


def is_opinion_word(word: Column) -> Column:
    return word.isin(*[w for _, _, words in _levels() for w in words])


def sentiment_score(text: Column) -> Column:
    """Score in [-1, 1]: signed word valences, normalised by s / sqrt(s² + 15).

    A word with a negation among the three words before it counts reversed and
    weakened. Blank text scores 0.
    """
    def signed(words: Column) -> Column:
        def value(word: Column, i: Column) -> Column:
            first = F.greatest(i - NEGATION_REACH, F.lit(0))
            negated = F.exists(F.slice(words, first + 1, i - first), lambda w: w.isin(NEGATIONS))
            return F.when(is_opinion_word(word), word_valence(word) * F.when(negated, NEGATION_FACTOR).otherwise(100)).otherwise(0)

        return F.aggregate(F.transform(words, value), F.lit(0).cast("long"), lambda acc, v: acc + v) / 10_000.0

    def normalised(total: Column) -> Column:
        return half_even(total / F.sqrt(total * total + float(SCORE_ALPHA)), 4)

    total = let(F.split(clean_text(text), " "), signed)
    return F.when(is_blank(text), 0.0).otherwise(let(total, normalised))


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.3, "positive").when(score < -0.3, "negative").otherwise("neutral")


def stars_to_score(stars: Column) -> Column:
    """1-5 stars to [-1, 1]; unknown counts as three stars."""
    return (F.coalesce(stars.cast("double"), F.lit(3.0)) - 3.0) / 2.0


def star_label_to_score(label: Column) -> Column:
    """Labels such as "4 stars" to [-1, 1]; an unknown label counts as three stars."""
    return stars_to_score(F.nullif(F.regexp_extract(F.lower(label), r"^([1-5]) stars?$", 1), F.lit("")).cast("int"))


def rating_label(rating: Column) -> Column:
    """Truth label of a star rating."""
    return F.when(rating >= 3.5, "positive").when(rating < 2.5, "negative").otherwise("neutral")


def opinion_words(text: Column) -> Column:
    return F.filter(alphabetic_words(text), is_opinion_word)


def _mean_of(words: Column, hundredths, scale: float) -> Column:
    def mean(ws: Column) -> Column:
        total = F.aggregate(ws, F.lit(0), lambda acc, w: acc + hundredths(w))
        return F.when(F.size(ws) == 0, 0.0).otherwise(half_even(F.try_divide(total, F.size(ws)) / scale, 4))

    return let(words, mean)


def polarity(text: Column) -> Column:
    """Mean valence of the opinion words, scaled to [-1, 1]; 0 without any."""
    return _mean_of(opinion_words(text), word_valence, 400.0)


def subjectivity(text: Column) -> Column:
    """Mean subjectivity of the opinion words in [0, 1]; 0 without any."""
    return _mean_of(opinion_words(text), word_subjectivity, 100.0)


def subjective_words(text: Column) -> Column:
    """Words whose subjectivity exceeds one half, in text order."""
    return F.filter(alphabetic_words(text), lambda w: F.coalesce(word_subjectivity(w) > 50, F.lit(False)))


def sentence_polarities(text: Column) -> Column:
    return F.transform(sentences(text), polarity)


def ensemble_score(first: Column, second: Column, third: Column,
                   weights: tuple[float, float, float] = (0.33, 0.33, 0.34)) -> Column:
    return first * weights[0] + second * weights[1] + third * weights[2]


def score_agreement(first: Column, second: Column, third: Column) -> Column:
    """1 minus the population standard deviation of the scores, at least 0."""
    mean = (first + second + third) / 3.0
    spread = F.sqrt((F.pow(first - mean, F.lit(2)) + F.pow(second - mean, F.lit(2)) + F.pow(third - mean, F.lit(2))) / 3.0)
    return 1.0 - F.when(spread > 1.0, 1.0).otherwise(spread)
