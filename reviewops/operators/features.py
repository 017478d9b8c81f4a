"""Term weights, train/test split and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewops.fixed_values import STOP_WORDS
from reviewops.functions import text
from reviewops.functions.numbers import half_even
from reviewops.operators.groups import ranked, with_group_size
from reviewops.session import kept

BUCKET_DIGITS = 4  # hex digits of the draw key that name a bucket: 65536 buckets


# --- TF-IDF as joins and aggregates -----------------------------------------

def _terms(column: Column, ngrams: int, stop_words: Sequence[str]) -> Column:
    tokens = text.term_tokens(column)
    if stop_words:
        tokens = text.remove_words(tokens, stop_words)
    return tokens if ngrams == 1 else text.let(tokens, lambda t: F.concat(t, text.adjacent_pairs(t)))


def term_counts(df: DataFrame, key: str, column: str, ngrams: int = 2, stop_words: Sequence[str] = ()) -> DataFrame:
    """(document, term, tf).

    Texts are spread by document before they are taken apart: a text is smaller than
    its terms, and every later step per document finds its rows in place. Terms are counted
    in the row of their text; only rows that share a document are added up.
    """
    texts = with_group_size(df.select(F.col(key).alias("doc"), F.col(column).alias("_text")), "doc")
    counts = F.inline(text.counted(_terms(F.col("_text"), ngrams, stop_words))).alias("term", "tf")
    several = texts.where("_rows > 1").select("doc", counts).groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
    return texts.where("_rows = 1").select("doc", counts).unionByName(several)


def vocabulary(counts: DataFrame, documents: Column, max_terms: int = 10_000, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """Terms found in enough but not too many documents, the most frequent ``max_terms`` of them."""
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_tf"))
    return (terms.filter((F.col("df") >= min_df) & (F.col("df") <= documents * max_df))
            .orderBy(F.desc("corpus_tf"), F.asc("term")).limit(max_terms))


def tfidf(df: DataFrame, key: str, column: str = "review_text", ngrams: int = 2, max_terms: int = 10_000, min_df: int = 2,
          max_df: float = 0.95, sublinear: bool = True, stop_words: Sequence[str] = ()) -> DataFrame:
    """L2-normalised weights (doc, term, weight) with smooth inverse document frequency.

    The vocabulary holds at most ``max_terms`` rows, so it is broadcast to the counts.
    """
    counts = term_counts(df, key, column, ngrams, stop_words)
    documents = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    terms = vocabulary(counts, documents, max_terms, min_df, max_df)
    idf = F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0
    tf = 1.0 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = counts.join(F.broadcast(terms), "term").select("doc", "term", (tf * idf).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("raw") / norm).alias("weight"))


def mean_tfidf_terms(df: DataFrame, key: str, column: str = "review_text", max_terms: int = 100, n: int = 20) -> DataFrame:
    """Terms of the highest mean weight over all documents; documents without the term count as 0."""
    weights = tfidf(df, key, column, ngrams=1, max_terms=max_terms, min_df=1, max_df=1.0, sublinear=False, stop_words=STOP_WORDS)
    documents = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    means = weights.groupBy("term").agg(half_even(F.sum("weight") / documents, 6).alias("mean_weight"))
    return means.orderBy(F.desc("mean_weight"), "term").limit(n)


# --- sampling and splitting -------------------------------------------------

def draw_key(column: str, seed: int) -> Column:
    """Pseudo-random but reproducible order key of a row: the same on every engine, run and layout."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def sample_rows(df: DataFrame, n: int, key: str = "review_id", seed: int = 42) -> DataFrame:
    """``n`` rows in random but reproducible order."""
    return df.orderBy(draw_key(key, seed), key).limit(n)


def strata(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``stars`` to ``stratum``; one stratum 0 if a rating is missing or a class has fewer than two rows.

    The rows are counted in ``counted`` where it is given: the same stars, cheaper to read.
    """
    sizes = (df if counted is None else counted).groupBy("stars").agg(F.count(F.lit(1)).alias("n"))
    usable = sizes.agg(F.min(F.when(F.col("stars").isNull(), 0).otherwise(F.col("n"))) >= 2).scalar()
    return df.withColumn("stratum", F.when(usable, F.col("stars")).otherwise(0))


def split_train_test(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "review_id") -> DataFrame:
    """Mark each row in ``is_test``: per stratum exactly round(test_size * rows) rows, drawn by key.

    A stratum is never sorted as a whole. Rows are counted per key bucket; the
    running count finds the bucket in which the quota ends, and only the rows of
    that one bucket per stratum are ranked to find the last key drawn. Then every
    row compares its key with that limit. Counting and ranking read a narrow table
    of stars and keys, written once, so that reviews are read twice in all.
    """
    stars = F.rint("rating").cast("int")
    draw = F.concat(draw_key(key, seed), F.lit(":"), F.col(key).cast("string"))
    narrow = strata(kept(df.select(stars.alias("stars"), draw.alias("_draw")), "split-keys"))
    bucketed = narrow.select("stars", "stratum", "_draw", F.substring("_draw", 1, BUCKET_DIGITS).alias("_bucket"))
    counts = bucketed.groupBy("stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    in_stratum = Window.partitionBy("stratum")
    running = F.sum("_n").over(in_stratum.orderBy("_bucket"))
    quota = F.rint(F.sum("_n").over(in_stratum) * test_size).cast("long")
    last = (counts.withColumn("_before", running - F.col("_n")).withColumn("_take", quota - F.col("_before"))
            .filter((F.col("_take") > 0) & (F.col("_take") <= F.col("_n"))).select("stratum", "_bucket", "_take"))
    # At most one row per stratum, and strata are star ratings: a proven bound.
    edge = bucketed.join(F.broadcast(last), ["stratum", "_bucket"])
    limits = (ranked(edge, ["stratum", "_bucket"], [F.col("_draw")], "_rank")
              .filter(F.col("_rank") == F.col("_take")).select("stratum", F.col("_draw").alias("_limit")))
    # One row: the limit of each stratum, at most one per star rating.
    limit_of = limits.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "_limit")))).scalar()
    marked = strata(df.withColumn("stars", stars), narrow.select("stars")).withColumn("_limits", limit_of)
    return (marked.withColumn("is_test", F.coalesce(draw <= F.try_element_at("_limits", F.col("stratum")), F.lit(False)))
            .drop("_limits", "stars"))
