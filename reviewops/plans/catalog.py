"""Every registered query: a function of (session, table folder).

Reviews come from the order tables (``tables.order_reviews``) or are the documents
themselves (``tables.document_reviews``); all queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reviewops.fixed_values import TOPIC_KEYWORDS, TOPICS
from reviewops.functions import dates, lexicon, numbers, text
from reviewops.operators import (causes, cleaning, features, filters, impact, keywords, metrics, models, planning, profiles,
                                 sentiment, textstats, topics)
from reviewops.plans import evaluation, reports
from reviewops.session import kept, new_path
from reviewops.sources import report, reviews, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Comparable column types: whole numbers as bigint, dates as text, arrays joined."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, " | ")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(function(spark, sf_dir))

    QUERIES[function.__name__] = run
    return function


class TextFolder(str):
    """A table folder whose documents are the reviews."""


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return tables.text_reviews(spark, sf) if isinstance(sf, TextFolder) else tables.order_reviews(spark, sf)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_reviews(raw(spark, sf))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return topics.add_topics(clean(spark, sf))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return tables.document_reviews(spark, sf)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment.with_rating_sentiment(sentiment.with_sentiment(clean(spark, sf)))


def ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment.with_ensemble(sentiment.with_opinion(scored(spark, sf)))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Rated reviews with sentiment and topic truth and predictions."""
    return evaluation.labelled(tagged(spark, sf).filter(F.col("rating").isNotNull()))


# --- sources ----------------------------------------------------------------

@query
def loaded_reviews(spark, sf):
    return reviews.canonical_reviews(raw(spark, sf)).select(
        "review_id", "Hotel_Name", "Review_Date", "Reviewer_Score", "Negative_Review", "Positive_Review", "Hotel_Address")


@query
def uploaded_reviews(spark, sf):
    """An upload with other column names, five-star scores and a single text column."""
    r = raw(spark, sf)
    upload = r.select(F.col("Hotel_Name").alias("Property"), F.col("Review_Date").alias(" Reviewed_At "),
                      (F.col("Reviewer_Score") / 2).cast("string").alias("STARS"), F.col("Negative_Review").alias("Comment"))
    return reviews.normalise_columns(upload)


def _written(spark, sf, fmt):
    """Reviews written as a file upload would bring them, and read again."""
    path = new_path(spark, f"upload-{fmt}")
    rows = raw(spark, sf)
    writer = rows.write.format(fmt)
    (writer.options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="") if fmt == "csv" else writer).save(path)
    return reviews.read_reviews(spark, path, fmt).select(
        F.col("review_id").cast("bigint").alias("review_id"), "Hotel_Name", "Review_Date", "Reviewer_Score", "Negative_Review", "Positive_Review", "Hotel_Address")


@query
def uploaded_csv(spark, sf):
    return _written(spark, sf, "csv")


@query
def uploaded_json(spark, sf):
    return _written(spark, sf, "json")


@query
def uploaded_parquet(spark, sf):
    return _written(spark, sf, "parquet")


@query
def one_hotel(spark, sf):
    return filters.for_hotel(raw(spark, sf), " NATION_7 ")


@query
def dataset_check(spark, sf):
    return reviews.validate_reviews(raw(spark, sf))


# --- cleaning and scalars ---------------------------------------------------

@query
def deduplicated(spark, sf):
    return cleaning.distinct_rows(raw(spark, sf))


@query
def clean_reviews(spark, sf):
    return clean(spark, sf)


@query
def placeholder_flags(spark, sf):
    return cleaning.distinct_rows(raw(spark, sf)).select(
        "review_id", text.is_placeholder(F.col("Negative_Review")).alias("no_negative"),
        text.is_placeholder(F.col("Positive_Review")).alias("no_positive"))


@query
def cleaned_documents(spark, sf):
    return documents(spark, sf).select("review_id", text.clean_text(F.col("review_text")).alias("clean"),
                                       text.preprocess_text(F.col("review_text")).alias("preprocessed"))


@query
def document_tokens(spark, sf):
    tokens = text.tokenize(text.clean_text(F.col("review_text")))
    both = text.let(tokens, lambda t: F.struct(F.size(t).alias("tokens"), F.array_join(text.remove_words(t, textstats.STOP_WORDS), " ").alias("content")))
    found = documents(spark, sf).select("review_id", both.alias("_both"), text.word_count(F.col("review_text")).alias("words"))
    return found.select("review_id", "_both.tokens", "words", "_both.content")


@query
def negation_flags(spark, sf):
    both = clean(spark, sf).select("review_id", "review_text", F.lit("review").alias("kind")).unionByName(
        documents(spark, sf).select("review_id", "review_text", F.lit("document").alias("kind")))
    return both.select("kind", "review_id", text.has_negation(F.col("review_text")).alias("negated"))


@query
def shortened_documents(spark, sf):
    return documents(spark, sf).select("review_id", text.truncate_words(F.col("review_text"), 100).alias("excerpt"))


@query
def parsed_dates(spark, sf):
    """Order dates written in five formats (and one unreadable one), read back."""
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 6
    written = (F.when(kind == 0, F.date_format(day, "MM/dd/yyyy")).when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
               .when(kind == 2, F.concat(F.lit("  31/"), F.date_format(day, "MM/yyyy"))).when(kind == 3, F.date_format(day, "MMMM d, yyyy"))
               .when(kind == 4, F.date_format(day, "d MMMM yyyy")).otherwise("sometime in May"))
    read = dates.parse_date(F.col("written"))
    return tables.table(spark, sf, "orders").select("o_orderkey", written.alias("written")).select(
        "o_orderkey", "written", read.alias("day"), dates.year_month(read).alias("month"))


@query
def loaded_dates(spark, sf):
    """Order dates as exports write them: timestamps, slashes, dots, short month names, offsets."""
    day = F.col("o_orderdate")
    ways = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy/MM/dd", "MMM d, yyyy", "d MMM yyyy", "yyyyMMdd", "MM/dd/yyyy HH:mm", "MMMM d yyyy",
            "yyyy.M.d", "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'"]
    kind = F.col("o_orderkey") % (len(ways) + 1)
    written = F.lit("some day")
    for i, way in enumerate(ways):
        written = F.when(kind == i, F.date_format(day, way)).otherwise(written)
    return tables.table(spark, sf, "orders").select("o_orderkey", dates.load_date(written).alias("day"))


@query
def hotel_date_ranges(spark, sf):
    return profiles.date_ranges(clean(spark, sf))


# --- filters ----------------------------------------------------------------

@query
def recent_reviews(spark, sf):
    return filters.filter_recent(clean(spark, sf), "date", 12).select("review_id", "Hotel_Name", "date")


@query
def filtered_reviews(spark, sf):
    # read for the days of each hotel and for the reviews: cleaned once
    rows = kept(clean(spark, sf).select("review_id", "Hotel_Name", "date", "rating", "review_text"), "clean")
    return filters.apply_filters(rows, low=2.0, high=4.0, topics=["staff", "wifi"]).select(
        "review_id", "Hotel_Name", "date", "rating", "topics")


@query
def reviews_of_1998(spark, sf):
    return filters.date_between(clean(spark, sf), "1998-01-01", "1998-12-31").select("review_id", "date")


@query
def hotel_search(spark, sf):
    return filters.search_hotels(raw(spark, sf), "Tion_1")


@query
def hotel_choice(spark, sf):
    return filters.search_hotels(raw(spark, sf))


@query
def topic_samples(spark, sf):
    return filters.topic_samples(topics.long_topics(tagged(spark, sf)), 5, 350, worst_only=True)


@query
def issue_samples(spark, sf):
    shown = filters.topic_samples(topics.long_topics(tagged(spark, sf)), 3, 200)
    return shown.withColumn("stars", numbers.star_text(F.col("rating")))


# --- topics -----------------------------------------------------------------

@query
def topic_tags(spark, sf):
    return tagged(spark, sf).select("review_id", "topics", *[topics.flag(t) for t in TOPICS])


@query
def document_topics(spark, sf):
    return topics.add_topics(documents(spark, sf)).select("review_id", "topics")


@query
def document_topics_whole_words(spark, sf):
    return topics.add_topics(documents(spark, sf), word_boundary=True).select("review_id", "topics")


@query
def dictionary_topics(spark, sf):
    """The topics of ``document_topics``, by a keyword table instead of fixed lists."""
    table = keywords.keyword_table(TOPIC_KEYWORDS, spark)
    return keywords.dictionary_topics(documents(spark, sf), table)


@query
def dictionary_matches(spark, sf):
    """Documents that quote a benchmark text: of each item, how many of its runs of three words they hold."""
    words = F.filter(F.split(F.lower("text"), r"[\s]+"), lambda w: w != "")
    three = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, F.lit(3)), " "))
    items = tables.table(spark, sf, "benchmark").select("item_id", words.alias("w")).where(F.size("w") > 2)
    table = items.select("item_id", F.explode(F.array_distinct(three)).alias("keyword"))
    found = keywords.keyword_matches(documents(spark, sf), table)
    return found.groupBy("review_id", "item_id").agg(F.count(F.lit(1)).alias("runs"))


@query
def topic_stats(spark, sf):
    return topics.topic_stats(tagged(spark, sf)).drop("topic_order")


@query
def topic_prevalence(spark, sf):
    return topics.topic_prevalence(tagged(spark, sf))


@query
def topic_cooccurrence(spark, sf):
    return topics.topic_cooccurrence(tagged(spark, sf))


@query
def topic_breakdown(spark, sf):
    return topics.topic_breakdown(tagged(spark, sf), 5)


@query
def top_topics(spark, sf):
    return topics.top_topic(topics.topic_stats(tagged(spark, sf))).drop("topic_order")


@query
def corpus_rating_drop(spark, sf):
    return topics.corpus_rating_drop(tagged(spark, sf))


@query
def weak_labels(spark, sf):
    """Keyword labels as a training set: text and the union of both keyword opinions."""
    both = evaluation.with_whole_word_predictions(tagged(spark, sf))
    return both.select("review_id", "review_text", topics.union_labels(F.col("topics"), models.predicted_labels()).alias("labels"))


# --- profiles ---------------------------------------------------------------

@query
def hotel_list(spark, sf):
    return profiles.hotel_list(raw(spark, sf))


@query
def hotel_stats(spark, sf):
    """Stats of every nation name; nations without reviews show zeros."""
    names = tables.table(spark, sf, "nation").select(F.col("n_name").alias("Hotel_Name"))
    return profiles.hotel_stats(reviews.canonical_reviews(raw(spark, sf)), names)


@query
def hotel_summary(spark, sf):
    return profiles.hotel_summary(clean(spark, sf))


@query
def monthly_rating(spark, sf):
    return profiles.monthly_rating(clean(spark, sf))


@query
def monthly_complaint_rate(spark, sf):
    return impact.monthly_complaint_rate(tagged(spark, sf))


@query
def monthly_volume(spark, sf):
    return profiles.monthly_volume(clean(spark, sf))


@query
def last_month(spark, sf):
    return profiles.recent_snapshot(clean(spark, sf))


@query
def rating_change(spark, sf):
    return profiles.rating_change(clean(spark, sf))


@query
def top_hotels(spark, sf):
    return profiles.top_hotels(clean(spark, sf), 20)


@query
def column_profile(spark, sf):
    return profiles.column_profile(reviews.canonical_reviews(raw(spark, sf)))


@query
def numeric_describe(spark, sf):
    return profiles.describe(clean(spark, sf), {"rating": 3, "word_count": 1})


@query
def rating_histogram(spark, sf):
    return profiles.histogram(clean(spark, sf), "rating", 20)


@query
def word_count_histogram(spark, sf):
    counted = documents(spark, sf).withColumn("word_count", text.word_count(F.col("review_text")))
    return profiles.histogram(counted, "word_count", 40, clip=300)


@query
def topic_rating_histogram(spark, sf):
    return profiles.topic_rating_histogram(tagged(spark, sf))


@query
def sentiment_distribution(spark, sf):
    return profiles.label_distribution(scored(spark, sf))


@query
def sentiment_by_rating(spark, sf):
    return profiles.sentiment_by_rating(scored(spark, sf))


@query
def sentiment_by_nationality(spark, sf):
    return profiles.label_share_by(scored(spark, sf), "Reviewer_Nationality")


@query
def label_agreement(spark, sf):
    return profiles.agreement_rate(scored(spark, sf), "sentiment_label", "star_label")


@query
def ensemble_describe(spark, sf):
    return profiles.describe(ensemble(spark, sf), {"ensemble_score": 4, "agreement": 4})


# --- impact, trends, priorities ---------------------------------------------

@query
def impact_table(spark, sf):
    return impact.impact_table(tagged(spark, sf)).drop("topic_order").withColumns({
        "frequency_band": numbers.frequency_band(F.col("complaint_rate")), "impact_band": numbers.impact_band(F.col("impact"))})


@query
def topic_ranking(spark, sf):
    return impact.rank_topics_by_impact(impact.impact_table(tagged(spark, sf)))


@query
def trends(spark, sf):
    months = F.array_join(F.transform(F.array_sort(F.map_entries("monthly_data")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    return impact.trends(tagged(spark, sf)).withColumn("monthly_data", months)


@query
def all_issues(spark, sf):
    return impact.all_issues(tagged(spark, sf)).drop("topic_order")


@query
def ranked_issues(spark, sf):
    return impact.ranked_issues(tagged(spark, sf))


# --- causes and plans -------------------------------------------------------

@query
def root_causes(spark, sf):
    return causes.root_causes(tagged(spark, sf)).withColumn("confidence_band", numbers.confidence_band(F.col("confidence")))


@query
def document_root_causes(spark, sf):
    """Sources rarely hold cause words, so that most topics here rest on prior causes."""
    return causes.root_causes(topics.add_topics(documents(spark, sf)))


@query
def root_cause_evidence(spark, sf):
    # read for the causes and for their quotes: tagged once
    rows = kept(causes.add_causes(tagged(spark, sf)).select("review_id", "Hotel_Name", "review_text", "topics", "causes"), "causes")
    return causes.with_evidence(causes.root_causes(rows), rows).select("Hotel_Name", "topic", "cause", "evidence")


@query
def root_cause_table(spark, sf):
    return causes.display_causes(causes.strongest_fallback(causes.root_causes(topics.add_topics(documents(spark, sf)))))


def _plans(spark, sf):
    return planning.action_plans(causes.root_causes(tagged(spark, sf)), tables.hotel_rooms(spark, sf))


def _roi(spark, sf, **options):
    return reports.plan_returns(tagged(spark, sf), tables.hotel_rooms(spark, sf), **options)


@query
def action_plans(spark, sf):
    return _plans(spark, sf)


@query
def ranked_actions(spark, sf):
    return planning.rank_actions_by_confidence(_plans(spark, sf)).select(
        "Hotel_Name", "topic", "confidence_rank", "action", "root_cause", "confidence")


@query
def plan_costs(spark, sf):
    return planning.plan_costs(_plans(spark, sf))


@query
def roi(spark, sf):
    return _roi(spark, sf)


@query
def roi_default_inputs(spark, sf):
    return _roi(spark, sf, default_inputs=True, room_rate=200.0, occupancy=0.9)


@query
def roi_text(spark, sf):
    return planning.roi_text(_roi(spark, sf))


@query
def roi_breakdown(spark, sf):
    return planning.roi_breakdown(_roi(spark, sf))


@query
def hotel_report(spark, sf):
    return reports.hotel_report(tagged(spark, sf), 10, tables.hotel_rooms(spark, sf))


@query
def written_report(spark, sf):
    """Topic shares written as a report section, one hotel's rewritten, and all read again."""
    path = new_path(spark, "report")
    stats = topics.topic_stats(tagged(spark, sf)).drop("topic_order")
    folder, = report.write_report({"topic_stats": stats}, path)
    report.write_report({"topic_stats": report.read_report(spark, folder, "NATION_7")}, path)
    return report.read_report(spark, folder)


@query
def hotel_report_all(spark, sf):
    """All hotels, those without any complaint included."""
    rows = clean(spark, sf).select("review_id", "Hotel_Name", "date", "rating", "review_text").unionByName(tables.praise(spark, sf))
    return reports.hotel_report(topics.add_topics(rows), None, tables.hotel_rooms(spark, sf))


# --- sentiment --------------------------------------------------------------

@query
def sentiment_score(spark, sf):
    return scored(spark, sf).select("review_id", "sentiment_score", "sentiment_label", "star_score", "true_label")


@query
def star_labels(spark, sf):
    """Ratings as a star classifier words them, back to scores; what isn't such a label counts as three stars."""
    stars = F.rint("rating").cast("int")
    label = F.coalesce(F.concat(stars.cast("string"), F.when(stars == 1, " Star").otherwise(" stars")), F.lit("no label"))
    return clean(spark, sf).select("review_id", label.alias("label"), lexicon.star_label_to_score(label).alias("score"))


@query
def document_sentiment(spark, sf):
    return sentiment.with_sentiment(documents(spark, sf)).select("review_id", "sentiment_score", "sentiment_label")


@query
def ensemble_score(spark, sf):
    return ensemble(spark, sf).select("review_id", "ensemble_score", "agreement", "consensus_label")


@query
def opinion_scores(spark, sf):
    return sentiment.with_opinion(clean(spark, sf)).select("review_id", "polarity", "subjectivity")


@query
def sentence_sentiment(spark, sf):
    return sentiment.sentence_sentiment(documents(spark, sf)).drop("review_text")


@query
def subjective_words(spark, sf):
    return clean(spark, sf).select("review_id", lexicon.subjective_words(F.col("review_text")).alias("words"))


@query
def opinion_statistics(spark, sf):
    return profiles.opinion_statistics(sentiment.with_opinion(clean(spark, sf)))


# --- text statistics --------------------------------------------------------

@query
def token_profile(spark, sf):
    return textstats.token_profile(documents(spark, sf)).drop("review_text")


@query
def sentence_profile(spark, sf):
    return textstats.sentence_profile(documents(spark, sf)).drop("review_text")


@query
def review_word_frequency(spark, sf):
    return textstats.review_word_frequency(documents(spark, sf), "review_id", 10)


@query
def hotel_word_frequency(spark, sf):
    return textstats.word_frequency(clean(spark, sf), ["Hotel_Name"], 10)


@query
def source_keywords(spark, sf):
    return textstats.keywords(documents(spark, sf), ["Hotel_Name"], 15)


@query
def collocations(spark, sf):
    return textstats.collocations(documents(spark, sf), ["Hotel_Name"], 10)


@query
def text_analysis(spark, sf):
    return textstats.text_analysis(clean(spark, sf))


@query
def tfidf_top_terms(spark, sf):
    return features.mean_tfidf_terms(documents(spark, sf), "review_id")


@query
def tfidf_weights(spark, sf):
    weights = features.tfidf(documents(spark, sf), "review_id")
    return weights.select("doc", "term", numbers.half_even(F.col("weight"), 6).alias("weight"))


# --- split, samples, metrics ------------------------------------------------

@query
def train_test_split(spark, sf):
    rated = clean(spark, sf).filter(F.col("rating").isNotNull())
    return features.split_train_test(rated).select("review_id", "stratum", "is_test")


@query
def train_test_split_unrated(spark, sf):
    """Missing ratings: the split falls back to a single stratum."""
    return features.split_train_test(clean(spark, sf)).select("review_id", "stratum", "is_test")


@query
def split_overlap(spark, sf):
    """Reviews of the training part whose id is in the test part too: none."""
    split = kept(features.split_train_test(clean(spark, sf).filter(F.col("rating").isNotNull())).select("review_id", "is_test"), "split")
    shared = split.filter("is_test").select("review_id").join(split.filter("NOT is_test").select("review_id"), "review_id", "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("shared"))


@query
def random_sample(spark, sf):
    return features.sample_rows(clean(spark, sf), 2000).select("review_id", "Hotel_Name", "rating")


@query
def accuracy(spark, sf):
    return metrics.accuracy(judged(spark, sf), "true_label", "sentiment_label")


@query
def classification_report(spark, sf):
    return metrics.classification_report(judged(spark, sf), "true_label", "sentiment_label")


@query
def sentiment_metrics(spark, sf):
    return metrics.sentiment_metrics(judged(spark, sf), "true_label", "sentiment_label")


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(judged(spark, sf), "true_label", "sentiment_label")


@query
def multilabel_f1(spark, sf):
    return metrics.multilabel_f1(judged(spark, sf), TOPICS)


@query
def topic_report(spark, sf):
    return metrics.topic_report(judged(spark, sf), TOPICS)


@query
def topic_confusion(spark, sf):
    return metrics.topic_confusion(judged(spark, sf), TOPICS)


@query
def mean_absolute_error(spark, sf):
    return metrics.mean_absolute_error(judged(spark, sf), "star_score", "sentiment_score")


@query
def model_summary(spark, sf):
    return metrics.model_summary(judged(spark, sf), TOPICS)


@query
def evaluation_report(spark, sf):
    return evaluation.evaluation_report(tagged(spark, sf))


@query
def stored_evaluation(spark, sf):
    """The evaluation, written as a JSON file and read again."""
    found, path = evaluation.evaluation_report(tagged(spark, sf)), new_path(spark, "evaluation")
    report.write_metrics(found, path)
    return spark.read.schema(found.schema).json(path)


@query
def document_label_report(spark, sf):
    """Toxic documents, by their labels, told by negative sentiment."""
    return metrics.classification_report(_labelled_documents(spark, sf), "truth", "found")


@query
def document_label_accuracy(spark, sf):
    return metrics.accuracy(_labelled_documents(spark, sf), "truth", "found")


def _labelled_documents(spark, sf):
    labels = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"), F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("truth"))
    found = sentiment.with_sentiment(documents(spark, sf)).select("review_id", F.when(F.col("sentiment_score") < 0, "negative").otherwise("positive").alias("found"))
    return found.join(labels, "review_id")


#: Queries that also run over the texts of the documents, as ``text_<name>``.
OVER_TEXTS = ["topic_tags", "topic_samples", "issue_samples", "topic_stats", "impact_table", "trends", "ranked_issues", "root_causes",
              "root_cause_evidence", "action_plans", "sentiment_score", "opinion_scores", "subjective_words", "ensemble_score", "text_analysis",
              "hotel_word_frequency", "hotel_summary", "last_month", "weak_labels", "classification_report"]


def _over_texts(name: str) -> Query:
    return lambda spark, sf: QUERIES[name](spark, TextFolder(sf))


QUERIES.update({f"text_{name}": _over_texts(name) for name in OVER_TEXTS})


# --- trained models ---------------------------------------------------------

def _split_rows(spark, sf):
    """What models need of the rated reviews. These are cleaned and tagged once; the split reads them twice."""
    rated = tagged(spark, sf).filter(F.col("rating").isNotNull()).select("review_id", "review_text", "rating", *[topics.flag(t) for t in TOPICS])
    return kept(features.split_train_test(kept(rated, "rated-reviews")), "model-split")


def _model_report(spark, sf, kind):
    """Topics of a model fitted on the training part: its accuracy there, and its quality on the test part."""
    split = _split_rows(spark, sf)
    model = (models.train_forest if kind == "forest" else models.train_boosted)(split.filter(~F.col("is_test")))
    scored = model.with_probabilities(split.filter("is_test"))
    held_out = metrics.topic_report(scored, TOPICS)
    known = spark.createDataFrame([(t, t in model.classifiers, model.training.get(t)) for t in TOPICS], "topic string, trained boolean, train_accuracy double")
    return held_out.join(F.broadcast(known), "topic", "left").withColumn("train_accuracy", numbers.half_even(F.col("train_accuracy"), 4))


@query
def forest_report(spark, sf):
    return _model_report(spark, sf, "forest")


@query
def boosted_report(spark, sf):
    return _model_report(spark, sf, "boosted")


@query
def boosted_feature_importance(spark, sf):
    """The ten leading terms of every trained topic."""
    model = models.train_boosted(tagged(spark, sf))
    out = spark.createDataFrame([], "topic string, rank int, term string, importance double")
    for t in model.classifiers:
        out = out.unionAll(model.feature_importance(spark, t, 10))
    return out


@query
def model_labels(spark, sf):
    """Labels of the boosted model with their confidence, each topic's probability, and the union with the keyword labels."""
    rows = tagged(spark, sf)
    found = models.train_boosted(rows).with_labels(rows.select("review_id", "review_text", "topics"))
    return found.select("review_id", "topics", "predicted_topics", models.prediction_confidence().alias("confidence"),
                        topics.union_labels(F.col("topics"), F.col("predicted_topics")).alias("labels"),
                        *[numbers.half_even(F.col(f"p_{t}"), 4).alias(f"p_{t}") for t in TOPICS])


@query
def separable_topic(spark, sf):
    """One split of one tree tells complaints about the connection from all others, as they share a word: what it predicts for the test part."""
    split = _split_rows(spark, sf)
    model = models.train_forest(split.filter(~F.col("is_test")), trees=1, depth=1, topics=["wifi"])
    found = model.with_labels(split.filter("is_test"))
    return found.select("review_id", "predicted_topics", "p_wifi", models.prediction_confidence().alias("confidence"))


@query
def stored_model(spark, sf):
    """What a model predicts before and after it is stored and loaded again: rows scored and rows that differ, by topic."""
    split = _split_rows(spark, sf)
    model = models.train_forest(split.filter(~F.col("is_test")), trees=5, depth=4)
    path = new_path(spark, "model")
    model.save(path)
    again = models.TopicModel.load(spark, path)
    rows = split.filter("is_test").select("review_id", "review_text")
    before, after = model.with_probabilities(rows), again.with_probabilities(rows)
    after = after.select("review_id", *[F.col(f"p_{t}").alias(f"q_{t}") for t in TOPICS])
    both = before.join(after, "review_id")
    cells = [F.struct(F.lit(t).alias("topic"), F.lit(t in again.classifiers).alias("trained"), F.col("scored"), F.col(f"n_{t}").alias("changed")) for t in TOPICS]
    return both.agg(F.count(F.lit(1)).alias("scored"), *[F.count_if(F.col(f"p_{t}") != F.col(f"q_{t}")).alias(f"n_{t}") for t in TOPICS]).select(F.inline(F.array(*cells)))
