"""Word statistics of texts and of groups of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewops.fixed_values import STOP_WORDS
from reviewops.functions import lexicon, text
from reviewops.functions.numbers import half_even, share
from reviewops.operators.groups import first_n, ranked, with_group_size


def content_words(column: Column) -> Column:
    return text.remove_words(text.alphabetic_words(column), STOP_WORDS)


def token_profile(df: DataFrame, column: str = "review_text") -> DataFrame:
    """Token and word counts, mean word length and vocabulary richness of each text."""
    prepared = df.withColumns({"_words": text.alphabetic_words(F.col(column)), "token_count": F.size(text.all_tokens(F.col(column)))})
    prepared = prepared.withColumn("_content", text.remove_words(F.col("_words"), STOP_WORDS))
    letters = F.aggregate("_words", F.lit(0), lambda acc, w: acc + F.length(w))
    unique = F.size(F.array_distinct("_content"))
    return prepared.withColumns({
        "word_count": F.size("_words"), "non_stop_word_count": F.size("_content"), "unique_words": unique,
        "avg_word_length": F.coalesce(half_even(share(letters, F.size("_words")), 4), F.lit(0.0)),
        "vocabulary_richness": F.coalesce(half_even(share(unique, F.size("_content")), 4), F.lit(0.0)),
    }).drop("_words", "_content")


def sentence_profile(df: DataFrame, column: str = "review_text") -> DataFrame:
    """Number of sentences and mean tokens per sentence."""
    count = F.size(text.sentences(F.col(column)))
    return df.withColumns({
        "sentence_count": count,
        "avg_sentence_length": F.coalesce(half_even(share(F.size(text.all_tokens(F.col(column))), count), 4), F.lit(0.0))})


def _top_counts(items: DataFrame, keys: Sequence[str], item: str, n: int) -> DataFrame:
    counts = items.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("frequency"))
    return first_n(counts, keys, [F.desc("frequency"), F.asc(item)], n, "rank")


def word_frequency(df: DataFrame, keys: Sequence[str], n: int = 10, column: str = "review_text") -> DataFrame:
    """The ``n`` most frequent content words per hotel or any other group of texts."""
    words = df.select(*keys, F.explode(content_words(F.col(column))).alias("word"))
    return _top_counts(words, keys, "word", n)


def _words_of_several(placed: DataFrame, key: str, n: int, column: str) -> DataFrame:
    """``word_frequency`` of keys that several texts of ``with_group_size`` share."""
    words = placed.where("_rows > 1").select(key, F.inline(text.counted(content_words(F.col(column)))).alias("word", "_n"))
    counts = words.groupBy(key, "word").agg(F.sum("_n").alias("frequency"))
    return ranked(counts, [key], [F.desc("frequency"), F.asc("word")]).filter(F.col("rank") <= n)


def review_word_frequency(df: DataFrame, key: str = "review_id", n: int = 10, column: str = "review_text") -> DataFrame:
    """The ``n`` most frequent content words of each text.

    Texts move once, to where their key belongs. The words of a text are counted in its row; only texts that share
    their key are taken apart into rows, to be counted together.
    """
    placed = with_group_size(df.select(key, column), key)
    top = text.most_frequent(text.counted(content_words(F.col(column))), n)
    alone = placed.where("_rows = 1").select(key, F.posexplode(top).alias("_at", "_top")).select(
        key, F.col("_top.item").alias("word"), F.col("_top.n").alias("frequency"), (F.col("_at") + 1).alias("rank"))
    return alone.unionByName(_words_of_several(placed, key, n, column))


def keywords(df: DataFrame, keys: Sequence[str], n: int = 15, column: str = "review_text") -> DataFrame:
    """Keyword list per key, most frequent first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return word_frequency(df, keys, n, column).groupBy(*keys).agg(F.transform(ordered, lambda k: k.word).alias("keywords"))


def collocations(df: DataFrame, keys: Sequence[str] = ("Hotel_Name",), n: int = 10, column: str = "review_text") -> DataFrame:
    """The most frequent pairs of neighbouring words, both of them content words."""
    words = F.transform(text.alphabetic_words(F.col(column)), lambda w: F.when(~w.isin(STOP_WORDS), w))  # stop words leave a gap
    pairs = df.select(*keys, F.explode(F.array_compact(text.adjacent_pairs(words))).alias("pair"))
    return _top_counts(pairs, keys, "pair", n)


def text_analysis(df: DataFrame, key: str = "review_id", column: str = "review_text") -> DataFrame:
    """All per-text statistics in one row: opinion, sentences, tokens and keywords."""
    placed = with_group_size(df.select(key, column), key)
    own = F.transform(text.most_frequent(text.counted(content_words(F.col(column))), 15), lambda c: c.item)
    tokens = token_profile(placed, column).select(
        key, lexicon.polarity(F.col(column)).alias("polarity"), lexicon.subjectivity(F.col(column)).alias("subjectivity"),
        F.size(text.sentences(F.col(column))).alias("sentence_count"), "token_count", "word_count", "non_stop_word_count",
        "unique_words", "avg_word_length", "vocabulary_richness", lexicon.subjective_words(F.col(column)).alias("subjective_words"),
        F.when(F.col("_rows") == 1, own).alias("_own"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word")))
    words = _words_of_several(placed, key, 15, column).groupBy(key).agg(F.transform(ordered, lambda k: k.word).alias("_shared"))
    # texts without a key have no keywords
    own = F.when(F.col(key).isNotNull(), F.col("_own"))
    return tokens.join(words, key, "left").withColumn("keywords", F.coalesce(own, "_shared", F.array().cast("array<string>"))).drop("_own", "_shared")
