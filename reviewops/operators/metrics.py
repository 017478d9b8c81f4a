"""Evaluation of predicted labels. Every report is one aggregate over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from reviewops.functions.numbers import exact_mean, half_even, share

SENTIMENT_LABELS = ["negative", "neutral", "positive"]


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(share(a, b), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))


def _score_columns(keys: Sequence[str]) -> dict[str, Column]:
    """Precision, recall, F1 per class from the columns tp_, predicted_ and actual_."""
    out = {}
    for k in keys:
        p, r = _ratio(F.col(f"tp_{k}"), F.col(f"predicted_{k}")), _ratio(F.col(f"tp_{k}"), F.col(f"actual_{k}"))
        out |= {f"p_{k}": p, f"r_{k}": r, f"f_{k}": _f1(p, r), f"s_{k}": F.col(f"actual_{k}")}
    return out


def _mean(columns: Sequence[Column]) -> Column:
    return reduce(add, columns) / float(len(columns))


def _weighted(columns: Sequence[Column], weights: Sequence[Column]) -> Column:
    return _ratio(reduce(add, [c * w for c, w in zip(columns, weights)]), reduce(add, weights))


def _counts(tests: Mapping[str, tuple[Column, Column]]) -> list[Column]:
    out = []
    for k, (actual, predicted) in tests.items():
        out += [F.count_if(actual & predicted).alias(f"tp_{k}"), F.count_if(predicted).alias(f"predicted_{k}"),
                F.count_if(actual).alias(f"actual_{k}")]
    return out


def _class_tests(truth: str, predicted: str, labels: Sequence[str]) -> dict[str, tuple[Column, Column]]:
    return {l: (F.coalesce(F.col(truth) == l, F.lit(False)), F.coalesce(F.col(predicted) == l, F.lit(False))) for l in labels}


def _row(name: str, label: str, p: Column, r: Column, f: Column, s: Column) -> Column:
    return F.struct(F.lit(label).alias(name), half_even(p, 4).alias("precision"), half_even(r, 4).alias("recall"),
                    half_even(f, 4).alias("f1"), s.cast("long").alias("support"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(half_even(F.avg(F.col(truth).eqNullSafe(F.col(predicted)).cast("double")), 4).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str, labels: Sequence[str] = SENTIMENT_LABELS) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    scores = df.agg(*_counts(_class_tests(truth, predicted, labels))).withColumns(_score_columns(labels))
    p, r, f, s = ([F.col(f"{m}_{l}") for l in labels] for m in "prfs")
    support = reduce(add, s)
    rows = [_row("label", l, *cols) for l, *cols in zip(labels, p, r, f, s)]
    rows += [_row("label", "Macro Avg", _mean(p), _mean(r), _mean(f), support),
             _row("label", "Weighted Avg", _weighted(p, s), _weighted(r, s), _weighted(f, s), support)]
    return scores.select(F.inline(F.array(*rows)))


def _macro_over_seen(metric: str, labels: Sequence[str]) -> Column:
    """Macro average over the classes that occur as truth or as prediction."""
    seen = [((F.col(f"predicted_{l}") + F.col(f"actual_{l}")) > 0).cast("double") for l in labels]
    return half_even(_weighted([F.col(f"{metric}_{l}") for l in labels], seen), 4)


def sentiment_metrics(df: DataFrame, truth: str, predicted: str, labels: Sequence[str] = SENTIMENT_LABELS) -> DataFrame:
    """Accuracy and macro-averaged precision, recall and F1 in one row."""
    counts = df.agg(*_counts(_class_tests(truth, predicted, labels)), F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col(truth).eqNullSafe(F.col(predicted))).alias("right"))
    return counts.withColumns(_score_columns(labels)).select(
        half_even(_ratio(F.col("right"), F.col("n")), 4).alias("accuracy"), _macro_over_seen("p", labels).alias("precision"),
        _macro_over_seen("r", labels).alias("recall"), _macro_over_seen("f", labels).alias("f1"), "n")


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence[str] = SENTIMENT_LABELS) -> DataFrame:
    """Rows per (actual, predicted) over the full grid, and their share of the actual class."""
    cells = {f"{a}_{p}": F.count_if((F.col(truth) == a) & (F.col(predicted) == p)) for a in labels for p in labels}
    counts = df.agg(*[c.alias(k) for k, c in cells.items()])
    rows = []
    for a in labels:
        total = reduce(add, [F.col(f"{a}_{p}") for p in labels])
        rows += [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"{a}_{p}").alias("n"),
                          half_even(_ratio(F.col(f"{a}_{p}"), total), 4).alias("share")) for p in labels]
    return counts.select(F.inline(F.array(*rows)))


# --- several labels per row, as flag columns --------------------------------

def _flag_tests(topics: Sequence[str], truth: str, predicted: str) -> dict[str, tuple[Column, Column]]:
    return {t: (F.col(f"{truth}{t}"), F.col(f"{predicted}{t}")) for t in topics}


def multilabel_f1(df: DataFrame, topics: Sequence[str], truth: str = "has_", predicted: str = "pred_") -> DataFrame:
    """Macro, micro and weighted F1 over flag columns."""
    scores = df.agg(*_counts(_flag_tests(topics, truth, predicted))).withColumns(_score_columns(topics))
    f, s = ([F.col(f"{m}_{t}") for t in topics] for m in "fs")
    tp, pred, act = (reduce(add, [F.col(f"{m}_{t}") for t in topics]) for m in ("tp", "predicted", "actual"))
    return scores.select(half_even(_mean(f), 4).alias("macro_f1"), half_even(_f1(_ratio(tp, pred), _ratio(tp, act)), 4).alias("micro_f1"),
                         half_even(_weighted(f, s), 4).alias("weighted_f1"))


def topic_report(df: DataFrame, topics: Sequence[str], truth: str = "has_", predicted: str = "pred_") -> DataFrame:
    """Accuracy, precision, recall, F1 and support per topic, with a macro row."""
    tests = _flag_tests(topics, truth, predicted)
    right = [F.count_if(a == p).alias(f"right_{t}") for t, (a, p) in tests.items()]
    scores = df.agg(*_counts(tests), *right, F.count(F.lit(1)).alias("n")).withColumns(
        _score_columns(topics) | {f"a_{t}": _ratio(F.col(f"right_{t}"), F.col("n")) for t in topics})
    p, r, f, s, a = ([F.col(f"{m}_{t}") for t in topics] for m in "prfsa")

    def row(label: str, acc: Column, *rest: Column) -> Column:
        return F.struct(F.lit(label).alias("topic"), half_even(acc, 4).alias("accuracy"), half_even(rest[0], 4).alias("precision"),
                        half_even(rest[1], 4).alias("recall"), half_even(rest[2], 4).alias("f1"), rest[3].cast("long").alias("support"))

    rows = [row(t, *cols) for t, *cols in zip(topics, a, p, r, f, s)]
    rows.append(row("Macro Average", _mean(a), _mean(p), _mean(r), _mean(f), reduce(add, s)))
    return scores.select(F.inline(F.array(*rows)))


def topic_confusion(df: DataFrame, topics: Sequence[str], truth: str = "has_", predicted: str = "pred_") -> DataFrame:
    """2 x 2 counts per topic."""
    tests = _flag_tests(topics, truth, predicted)
    counts = df.agg(*_counts(tests), F.count(F.lit(1)).alias("n"))
    rows = []
    for t in topics:
        tp, pred, act = F.col(f"tp_{t}"), F.col(f"predicted_{t}"), F.col(f"actual_{t}")
        rows.append(F.struct(F.lit(t).alias("topic"), (F.col("n") - pred - act + tp).alias("tn"), (pred - tp).alias("fp"),
                             (act - tp).alias("fn"), tp.alias("tp")))
    return counts.select(F.inline(F.array(*rows)))


def mean_absolute_error(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(half_even(exact_mean(F.abs(F.col(truth) - F.col(predicted))), 4).alias("mae"), F.count(truth).alias("n"))


def model_summary(df: DataFrame, topics: Sequence[str], truth: str = "true_label", predicted: str = "sentiment_label",
                  flag_truth: str = "has_", flag_predicted: str = "pred_") -> DataFrame:
    """One line per model: sentiment against the star labels, topics against the topic flags. One pass for both."""
    tests = _flag_tests(topics, flag_truth, flag_predicted)
    rights = {"right": F.col(truth).eqNullSafe(F.col(predicted))} | {f"right_{t}": a == p for t, (a, p) in tests.items()}
    counts = df.agg(*_counts(_class_tests(truth, predicted, SENTIMENT_LABELS) | tests), F.count(F.lit(1)).alias("n"),
                    *[F.count_if(c).alias(k) for k, c in rights.items()])
    scores = counts.withColumns(_score_columns([*SENTIMENT_LABELS, *topics]))

    def row(model: str, method: str, accuracy: Column, macro_f1: Column) -> Column:
        return F.struct(F.lit(model).alias("model"), F.lit(method).alias("method"), F.col("n"),
                        half_even(accuracy, 4).alias("accuracy"), macro_f1.alias("macro_f1"))

    return scores.select(F.inline(F.array(
        row("Sentiment", "lexicon", _ratio(F.col("right"), F.col("n")), _macro_over_seen("f", SENTIMENT_LABELS)),
        row("Topic", "keyword", _mean([_ratio(F.col(f"right_{t}"), F.col("n")) for t in topics]),
            half_even(_mean([F.col(f"f_{t}") for t in topics]), 4)))))
