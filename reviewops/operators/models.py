"""Topic models: one classifier per topic on shared term features.

Words, their frequencies, the topics that can be trained and the classifiers are taken from all rows. The library
looks for the values that trees may split at in some 10,000 rows; where a class is rare, its rows are given to it several times,
with their weight shared out, so that a topic of twenty examples among a million rows is told by its words.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewops.fixed_values import TOPICS
from reviewops.functions import text
from reviewops.functions.numbers import half_even
from reviewops.operators import forests
from reviewops.operators.topics import flag
from reviewops.session import add_line, kept, stored_lines

_LOADERS = {"forest": RandomForestClassificationModel, "boosted": GBTClassificationModel}

#: The library finds split values in so many rows. Of these, one in ``_RARE`` is of the rarer class at least.
_SPLIT_ROWS, _RARE = 10_000, 10
#: Rows to a partition of those that trees grow on, and rows that several topics at a time may lay out together.
_PART_ROWS, _ROWS_AT_ONCE = 100_000, 4_000_000
#: A word or pair in a larger share of the texts is no feature.
MAX_DF = 0.95


def word_pipeline(column: str = "review_text", max_terms: int = 10_000, min_df: float = 2, max_df: float = MAX_DF) -> Pipeline:
    """Counts of unaccented words and word pairs, and in how many texts each occurs.

    ``max_df`` of 1 or more is a number of texts, less is a share of them. To learn of how many texts, fitting
    would store the words of all of them as objects, hundreds of megabytes a task, so training gives a number.
    """
    lower = f"lower(coalesce({column}, ''))"  # of ASCII alone there is no accent to look for, character by character
    plain = (f"SELECT *, CASE WHEN octet_length({column}) = char_length({column}) THEN {lower} "
             f"ELSE translate({lower}, '{text.ACCENTED}', '{text.UNACCENTED}') END AS _plain FROM __THIS__")
    return Pipeline(stages=[
        SQLTransformer(statement=plain),
        RegexTokenizer(inputCol="_plain", outputCol="_words", gaps=False, pattern=r"\b[a-z][a-z]+\b", toLowercase=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=max_terms, minDF=min_df, maxDF=max_df),
        IDF(inputCol="_counts", outputCol="_weights"),
    ])


def weighted(df: DataFrame, words: PipelineModel) -> DataFrame:
    """Add ``features``: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), brought to length 1.

    The built-in weighting has neither the logarithm of tf nor the smoothing; both are done here for
    a batch of vectors at once, on the list of all their entries.
    """
    model = words.stages[5]
    idf = np.log((1.0 + model.numDocs) / (1.0 + np.asarray(model.docFreq))) + 1.0

    @F.arrow_udf(VectorUDT())
    def weigh(size: pa.Array, indices: pa.Array, values: pa.Array) -> pa.Array:
        raw = (1.0 + np.log(values.flatten().to_numpy())) * idf[indices.flatten().to_numpy()]
        lengths = np.concatenate(([0], np.cumsum(indices.value_lengths().to_numpy()))).astype(np.int32)
        sparse = [pa.array(np.zeros(len(size), dtype=np.int8)), size, pa.ListArray.from_arrays(pa.array(lengths), indices.flatten()),
                  pa.ListArray.from_arrays(pa.array(lengths), pa.array(raw))]
        return pa.StructArray.from_arrays(sparse, names=["type", "size", "indices", "values"])

    entries = words.transform(df).withColumn("_entries", F.unwrap_udt("_counts"))
    raw = entries.withColumn("_raw", weigh("_entries.size", "_entries.indices", "_entries.values"))
    scaled = Normalizer(inputCol="_raw", outputCol="features").transform(raw)
    return scaled.drop("_plain", "_words", "_pairs", "_terms", "_counts", "_weights", "_entries", "_raw")


@dataclass
class TopicModel:
    """Features and one binary classifier per topic that had examples."""

    kind: str
    features: PipelineModel
    classifiers: dict[str, object] = field(default_factory=dict)
    training: dict[str, float] = field(default_factory=dict)  # accuracy of each topic on the rows it was fitted on

    @property
    def vocabulary(self) -> list[str]:
        return self.features.stages[4].vocabulary

    def with_probabilities(self, df: DataFrame) -> DataFrame:
        """Add ``p_<topic>``, the probability of the topic, and ``pred_<topic>``; 0 and false for untrained topics."""
        out = self._scored(weighted(df, self.features))
        missing = [t for t in TOPICS if t not in self.classifiers]
        return out.withColumns({f"p_{t}": F.lit(0.0) for t in missing} | {f"pred_{t}": F.lit(False) for t in missing}).drop("features")

    def _scored(self, df: DataFrame) -> DataFrame:
        return self._with_votes(df) if self.kind == "forest" and self.classifiers else self._with_predictions(df)

    def _with_votes(self, df: DataFrame) -> DataFrame:
        """What the library's forests predict, from all trees of all topics at once."""
        spark = df.sparkSession
        with ThreadPoolExecutor(len(self.classifiers)) as pool:
            trees = list(pool.map(inheritable_thread_target(spark)(lambda m: forests.trees_of(spark, m)), self.classifiers.values()))
        out = df.withColumn("_votes", forests.votes(trees, len(self.vocabulary)))
        pairs = {t: (F.col("_votes")[2 * i], F.col("_votes")[2 * i + 1]) for i, t in enumerate(self.classifiers)}
        return out.withColumns({f"p_{t}": F.coalesce(F.try_divide(for_, against + for_), F.lit(0.0)) for t, (against, for_) in pairs.items()}
                               | {f"pred_{t}": for_ > against for t, (against, for_) in pairs.items()}).drop("_votes")

    def _with_predictions(self, df: DataFrame) -> DataFrame:
        out = df
        for topic, model in self.classifiers.items():
            model.setRawPredictionCol("_raw").setProbabilityCol("_probability").setPredictionCol("_prediction")
            out = (model.transform(out)
                   .withColumn(f"p_{topic}", vector_to_array("_probability")[1])
                   .withColumn(f"pred_{topic}", F.col("_prediction") > 0)
                   .drop("_raw", "_probability", "_prediction"))
        return out

    def with_labels(self, df: DataFrame, column: str = "predicted_topics") -> DataFrame:
        """Add the array of predicted topics; ["none"] where there is none."""
        return self.with_probabilities(df).withColumn(column, predicted_labels())

    def feature_importance(self, spark: SparkSession, topic: str, n: int = 20) -> DataFrame:
        """The ``n`` most important terms of a topic. The vocabulary is bounded, so it is ranked at the driver."""
        if topic not in self.classifiers:
            raise ValueError(f"topic {topic!r} was not trained")
        weights = self.classifiers[topic].featureImportances
        terms = self.vocabulary
        ranked = sorted(((terms[int(i)], float(v)) for i, v in zip(weights.indices, weights.values)), key=lambda x: (-x[1], x[0]))
        return spark.createDataFrame([(topic, i + 1, t, v) for i, (t, v) in enumerate(ranked[:n])],
                                     "topic string, rank int, term string, importance double")

    def save(self, path: str) -> None:
        """Store the model below ``path``. Each version has a folder of its own, and the line that names it is added last:
        a reader finds the last complete version, whatever becomes of a later one."""
        spark = SparkSession.getActiveSession()
        version = uuid.uuid4().hex
        self.features.write().save(f"{path}/{version}/features")
        for topic, model in self.classifiers.items():
            model.write().save(f"{path}/{version}/{topic}")
        earlier = stored_lines(spark, f"{path}/manifest", _MANIFEST)
        add_line(spark, f"{path}/manifest", _MANIFEST, (len(earlier) + 1, version, self.kind, list(self.classifiers), json.dumps(self.training)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        """The last version stored; it may have no trained topic."""
        versions = stored_lines(spark, f"{path}/manifest", _MANIFEST)
        if not versions:
            raise FileNotFoundError(f"no model is stored in {path}")
        last = max(versions, key=lambda r: (r.number, r.version))
        folder = f"{path}/{last.version}"
        return cls(last.kind, PipelineModel.load(f"{folder}/features"), {t: _LOADERS[last.kind].load(f"{folder}/{t}") for t in last.topics},
                   json.loads(last.training))


_MANIFEST = "number int, version string, kind string, topics array<string>, training string"


def training_shares(counts, topics: Sequence[str], max_rows: float) -> dict[str, tuple[float, float]]:
    """For each topic that has both examples and others: the share of each (examples, others) that a bound of ``max_rows`` lets in."""
    half, n = max_rows / 2, counts["n"]
    return {t: (min(1.0, half / counts[t]), min(1.0, half / (n - counts[t]))) for t in topics if 0 < counts[t] < n}


def _copies(examples: float, others: float) -> tuple[int, int]:
    """How often each example and each other row is given to the library, which looks for split values in a few rows of all."""
    rows, least = examples + others, min(examples, others)
    copies = 1 if rows <= _SPLIT_ROWS else max(1, math.ceil(rows / (_RARE * least)))
    return (copies, 1) if examples <= others else (1, copies)


def _train(df: DataFrame, kind: str, classifier, topics: Sequence[str], max_terms: int, min_df: float, max_rows: int | None) -> TopicModel:
    # Fitting reads the texts several times: they are cleaned and tagged once, and written.
    draw = F.pmod(F.xxhash64("review_id" if "review_id" in df.columns else "review_text", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    texts = kept(df.select("review_text", *[flag(t) for t in topics], draw.alias("_draw")), "training-texts")
    counts = texts.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(flag(t)).alias(t) for t in topics]).first()
    words = word_pipeline(max_terms=max_terms, min_df=min_df, max_df=MAX_DF * counts["n"]).fit(texts)
    shares = training_shares(counts, topics, math.inf if max_rows is None else max_rows)  # without a bound, all rows of both classes

    def share(t: str) -> Column:
        return F.when(F.col(flag(t)), shares[t][0]).otherwise(shares[t][1])

    def balance(t: str) -> Column:
        """Half of all weight for each class, as if no row were missing."""
        return F.when(F.col(flag(t)), counts["n"] / (2.0 * counts[t])).otherwise(counts["n"] / (2.0 * (counts["n"] - counts[t])))

    used = texts
    if max_rows is not None:
        drawn = F.lit(False)
        for t in shares:
            drawn = drawn | (F.col("_draw") < share(t))
        used = texts.where(drawn)
    # All classifiers read the same vectors, so these are written once and the lineage ends there.
    ready = kept(weighted(used, words).select("features", "_draw", *[flag(t) for t in shares]), "training-vectors")
    most = counts["n"] if max_rows is None else min(counts["n"], len(shares) * max_rows)
    parts = max(1, min(ready.sparkSession.sparkContext.defaultParallelism, most // 10_000), -(-most // _PART_ROWS))
    ready = ready.repartition(parts).cache()

    def fit(t: str) -> object:
        a, b = _copies(shares[t][0] * counts[t], shares[t][1] * (counts["n"] - counts[t]))
        copies = F.when(F.col(flag(t)), a).otherwise(b)
        weight = (balance(t) if kind == "forest" else F.lit(1.0)) / share(t) / copies
        rows = ready.where(F.col("_draw") < share(t)).select(
            "features", F.col(flag(t)).cast("double").alias("label"), weight.alias("weight"), copies.alias("_copies"))
        if max(a, b) > 1:
            rows = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
        return classifier.copy().fit(rows.select("features", "label", "weight"))

    model = TopicModel(kind, words)
    # One thread a topic waits for Spark's jobs. The library lays out a value for each term of each row, so topics of many rows take turns.
    threads = max(1, min(len(shares), _ROWS_AT_ONCE // max(1, counts["n"] if max_rows is None else min(counts["n"], max_rows))))
    with ThreadPoolExecutor(threads) as pool:
        for t, fitted in zip(shares, pool.map(inheritable_thread_target(df.sparkSession)(fit), shares)):
            model.classifiers[t] = fitted
    if shares:
        def fitted_on(t: str) -> Column:
            return F.when(F.col("_draw") < share(t), 1 / share(t)).otherwise(0.0)

        right = model._scored(ready).agg(*[(F.sum(F.when(F.col(f"pred_{t}") == F.col(flag(t)), fitted_on(t)).otherwise(0.0)) / F.sum(fitted_on(t))).alias(t)
                                           for t in shares]).first()
        model.training = {t: right[t] for t in shares}
    ready.unpersist()
    return model


def train_forest(df: DataFrame, trees: int = 200, depth: int = 30, seed: int = 42, max_terms: int = 10_000,
                 min_df: float = 2, topics: Sequence[str] = TOPICS, max_rows: int | None = None) -> TopicModel:
    """Random forests with balanced class weights on the topic flags of ``df``.

    Trees grow to depth 30, the deepest the library allows, on all reviews. A caller may ask for a bound: those of a topic are then fitted on
    about ``max_rows`` reviews, half of them its examples, picked by a hash of their id and weighted by the inverse of the share picked.
    """
    return _train(df, "forest", RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight"),
                  topics, max_terms, min_df, max_rows)


def train_boosted(df: DataFrame, rounds: int = 100, depth: int = 6, rate: float = 0.1, subsample: float = 0.8, seed: int = 42,
                  max_terms: int = 10_000, min_df: float = 2, topics: Sequence[str] = TOPICS, max_rows: int | None = None) -> TopicModel:
    """Boosted trees on the topic flags of ``df``; topics without examples are skipped. Fitted and weighted as ``train_forest`` says, without balancing."""
    return _train(df, "boosted", GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed, weightCol="weight"),
                  topics, max_terms, min_df, max_rows)


def predicted_labels(topics: Sequence[str] = TOPICS, prefix: str = "pred_") -> Column:
    labels = F.array_compact(F.array(*[F.when(F.col(f"{prefix}{t}"), F.lit(t)) for t in topics]))
    return F.when(F.size(labels) == 0, F.array(F.lit("none"))).otherwise(labels)


def prediction_confidence(topics: Sequence[str] = TOPICS) -> Column:
    """Mean probability of the predicted topics; 0 without any."""
    chosen = F.array_compact(F.array(*[F.when(F.col(f"pred_{t}"), F.col(f"p_{t}")) for t in topics]))
    total = F.aggregate(chosen, F.lit(0.0), lambda acc, p: acc + p)
    return F.coalesce(half_even(F.try_divide(total, F.size(chosen)), 4), F.lit(0.0))
