"""The same questions in plain SQL, for checking results with DuckDB.

Written on its own, row by row and with ordinary joins, not after the Spark plans.
"""

from __future__ import annotations

from reviewops import fixed_values as V
from reviewops.plans.catalog import OVER_TEXTS
from reviewops.sources import tables as D

SP = r"[\s\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return ", ".join(q(v) for v in values)


def r(x: str, d: int) -> str:
    """Half-even rounding in double arithmetic."""
    return f"(round_even(({x}) * 1e{d}, 0) / 1e{d} + 0e0)"


def mean(x: str, where: str = "true") -> str:
    """Mean over an exact decimal sum."""
    return f"((sum(({x})::DECIMAL(18,5)) FILTER (WHERE {where}))::DOUBLE / nullif(count({x}) FILTER (WHERE {where}), 0))"


def pct(a: str, b: str, d: int = 1) -> str:
    return r(f"({a})::DOUBLE / ({b})::DOUBLE * 100e0", d)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def alternatives(words) -> str:
    return "|".join(w.replace("'", "''").replace(".", r"\.").replace("/", r"\/") for w in words)


def hits(text: str, words) -> str:
    return f"regexp_matches(lower({text}), '{alternatives(words)}')"


def whole_hits(text: str, words) -> str:
    return rf"regexp_matches(lower({text}), '\b(?:{alternatives(words)})\b')"


def clean_sql(x: str) -> str:
    url = V.URL_PATTERN.replace("'", "''")
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{url}', ' ', 'g'), '[^a-z0-9'']+', ' ', 'g'))"


I20, I8, I12 = "(o_orderkey*7 + o_custkey) % 20 + 1", "(o_orderkey*5 + o_custkey) % 8 + 1", "(o_orderkey*3 + o_custkey) % 12 + 1"

BASE = f"""base AS MATERIALIZED (
  SELECT o_orderkey AS review_id, n_name AS Hotel_Name, concat('Street ', n_name) AS Hotel_Address,
    CASE WHEN o_orderkey % 97 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS Review_Date,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL
         ELSE CAST(40 + (o_orderkey*37) % 61 - 5*((o_orderkey*7 + o_custkey) % 4) AS DOUBLE) / 10 END AS Reviewer_Score,
    list_extract([{lst(D.NEGATIVE)}], CAST({I20} AS INT)) AS Negative_Review,
    list_extract([{lst(D.POSITIVE)}], CAST({I8} AS INT)) AS Positive_Review,
    list_extract([{lst(D.COUNTRIES)}], CAST({I12} AS INT)) AS Reviewer_Nationality
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
raw AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM base WHERE review_id % 50 = 0)"""

DAY = "CAST(try_strptime(Review_Date, '%m/%d/%Y') AS DATE)"


def _part(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ({lst(V.PART_PLACEHOLDERS)}) THEN '' ELSE trim({c}) END"


CLEAN = BASE + f""",
parts AS (SELECT *, {_part('Negative_Review')} AS n_part, {_part('Positive_Review')} AS p_part FROM (SELECT DISTINCT * FROM raw)),
clean AS MATERIALIZED (SELECT * EXCLUDE (n_part, p_part, Review_Date), {DAY} AS date, trim(n_part || ' ' || p_part) AS review_text,
  CASE WHEN Reviewer_Score IS NOT NULL THEN least(5e0, greatest(1e0, Reviewer_Score / 2)) END AS rating
  FROM parts WHERE n_part <> '' OR p_part <> '')"""

TOPIC_ROWS = "topic_names(topic, ord) AS (VALUES " + ", ".join(f"({q(t)}, {i})" for i, t in enumerate(V.TOPICS)) + ")"
FLAGS = ", ".join(f"{hits('review_text', w)} AS has_{t}" for t, w in V.TOPIC_KEYWORDS.items())
PICK = "CASE topic " + " ".join(f"WHEN {q(t)} THEN has_{t}" for t in V.TOPICS) + " END"


def long_ctes(source: str) -> str:
    return f"""tags AS MATERIALIZED (SELECT *, {FLAGS} FROM {source}),
{TOPIC_ROWS},
lng AS MATERIALIZED (SELECT g.*, topic, ord, {PICK} AS flag FROM tags g CROSS JOIN topic_names)"""


TAGS = CLEAN + ",\n" + long_ctes("clean")
DOCS = "docs AS MATERIALIZED (SELECT doc_id AS review_id, source AS Hotel_Name, text AS review_text FROM documents)"
DOC_TAGS = DOCS + ",\n" + long_ctes("docs")


def joined_topics(flag: str = "flag") -> str:
    return f"coalesce(string_agg(topic, ' | ' ORDER BY ord) FILTER (WHERE {flag}), '')"


ORACLES: dict[str, str] = {}


def add(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes}\n{select}"


# --- sources ----------------------------------------------------------------
add("loaded_reviews", BASE, f"""SELECT review_id, Hotel_Name, strftime({DAY}, '%Y-%m-%d') AS Review_Date, Reviewer_Score, Negative_Review,
  Positive_Review, Hotel_Address FROM raw""")
add("uploaded_reviews", BASE, f"""SELECT Hotel_Name, strftime({DAY}, '%Y-%m-%d') AS Review_Date,
  CASE WHEN (SELECT max(Reviewer_Score / 2) FROM raw) <= 5 THEN Reviewer_Score / 2 * 2 ELSE Reviewer_Score / 2 END AS Reviewer_Score,
  '' AS Negative_Review, Negative_Review AS Positive_Review, '' AS Hotel_Address FROM raw""")
add("one_hotel", BASE, "SELECT * FROM raw WHERE Hotel_Name = 'NATION_7'")
add("dataset_check", BASE, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", true AS present, count(*) AS rows, count(*) - count({c}) AS missing,
  {pct(f'count(*) - count({c})', 'count(*)', 2)} AS missing_pct FROM raw"""
    for c in ("Hotel_Name", "Negative_Review", "Positive_Review", "Reviewer_Score")))

# --- cleaning and scalars ---------------------------------------------------
add("deduplicated", BASE, "SELECT DISTINCT * FROM raw")
add("clean_reviews", CLEAN, """SELECT review_id, Hotel_Name, Hotel_Address, strftime(date, '%Y-%m-%d') AS Review_Date, Reviewer_Score,
  Negative_Review, Positive_Review, Reviewer_Nationality, review_text, strftime(date, '%Y-%m-%d') AS date, length(review_text) AS review_length,
  len(string_split(review_text, ' ')) AS word_count, rating FROM clean""")
_ph = lambda c: f"(trim({c}) = '' OR lower(trim({c})) IN ({lst(V.EMPTY_PLACEHOLDERS)}))"
add("placeholder_flags", BASE, f"""SELECT review_id, {_ph('Negative_Review')} AS no_negative, {_ph('Positive_Review')} AS no_positive
  FROM (SELECT DISTINCT * FROM raw)""")
add("cleaned_documents", DOCS, f"SELECT review_id, {clean_sql('review_text')} AS clean, {clean_sql('review_text')} AS preprocessed FROM docs")
add("document_tokens", DOCS, rf"""SELECT review_id, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS tokens,
  CASE WHEN regexp_full_match(review_text, '{SP}*') THEN 0 ELSE len(regexp_split_to_array({strip('review_text')}, '{SP}+')) END AS words,
  CASE WHEN c = '' THEN '' ELSE array_to_string([w FOR w IN string_split(c, ' ') IF w NOT IN ({lst(V.STOP_WORDS)})], ' ') END AS content
  FROM (SELECT *, {clean_sql('review_text')} AS c FROM docs)""")
_neg = "|".join(n.replace("'", "''") for n in V.NEGATIONS)
add("negation_flags", CLEAN + ", " + DOCS, rf"""SELECT kind, review_id, regexp_matches(review_text, '(?i)\b({_neg})\b') AS negated FROM (
  SELECT 'review' AS kind, review_id, review_text FROM clean UNION ALL SELECT 'document', review_id, review_text FROM docs)""")
add("shortened_documents", DOCS, rf"""SELECT review_id, CASE WHEN len(w) > 100 THEN array_to_string(w[1:100], ' ') || '...' ELSE review_text END AS excerpt
  FROM (SELECT *, regexp_split_to_array({strip('review_text')}, '{SP}+') AS w FROM docs)""")
add("parsed_dates", f"""written AS (SELECT o_orderkey, o_orderkey % 6 AS kind, o_orderdate, CASE o_orderkey % 6
    WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '  31/' || strftime(o_orderdate, '%m/%Y')
    WHEN 3 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 4 THEN strftime(o_orderdate, '%-d %B %Y') ELSE 'sometime in May' END AS written FROM orders),
  days AS (SELECT *, CASE WHEN kind IN (0, 1, 3, 4) THEN CAST(o_orderdate AS DATE)
    WHEN kind = 2 THEN CAST(try_strptime(trim(written), '%d/%m/%Y') AS DATE) END AS day FROM written)""",
    "SELECT o_orderkey, written, strftime(day, '%Y-%m-%d') AS day, strftime(day, '%Y-%m') AS month FROM days")
add("hotel_date_ranges", CLEAN, """SELECT Hotel_Name, strftime(min(date), '%b %Y') || ' – ' || strftime(max(date), '%b %Y') AS date_range,
  (year(max(date)) - year(min(date))) * 12 + month(max(date)) - month(min(date)) AS months FROM clean GROUP BY Hotel_Name""")

# --- filters ----------------------------------------------------------------
add("loaded_dates", "o AS (SELECT * FROM orders)", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 < 10 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM o""")
add("recent_reviews", CLEAN, """SELECT review_id, Hotel_Name, strftime(date, '%Y-%m-%d') AS date FROM clean
  JOIN (SELECT Hotel_Name, max(date) AS latest FROM clean GROUP BY 1) USING (Hotel_Name) WHERE date >= latest - INTERVAL 12 MONTH""")
add("filtered_reviews", TAGS, f"""SELECT review_id, Hotel_Name, strftime(date, '%Y-%m-%d') AS date, rating, {joined_topics()} AS topics FROM lng
  JOIN (SELECT Hotel_Name, max(date) AS latest, min(date) AS earliest FROM clean GROUP BY 1) USING (Hotel_Name)
  WHERE date >= greatest(earliest, CAST(latest - INTERVAL 365 DAY AS DATE)) AND rating >= 2 AND rating <= 4 AND (has_staff OR has_wifi)
  GROUP BY ALL""")
add("reviews_of_1998", CLEAN, "SELECT review_id, strftime(date, '%Y-%m-%d') AS date FROM clean WHERE year(date) = 1998")
add("hotel_search", BASE, "SELECT DISTINCT Hotel_Name FROM raw WHERE Hotel_Name LIKE '%TION\\_1%' ESCAPE '\\'")
add("hotel_choice", BASE, "SELECT DISTINCT Hotel_Name FROM raw")
add("topic_samples", TAGS, """SELECT Hotel_Name, topic, review_id, rating, substring(review_text, 1, 350) AS excerpt, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY Hotel_Name, topic ORDER BY review_id) AS rn FROM lng WHERE flag AND rating <= 3) WHERE rn <= 5""")
add("issue_samples", TAGS, """SELECT Hotel_Name, topic, review_id, rating, substring(review_text, 1, 200) AS excerpt, rn,
  repeat('⭐', CAST(greatest(1, least(5, round_even(rating, 0))) AS INT)) AS stars FROM (
  SELECT *, row_number() OVER (PARTITION BY Hotel_Name, topic ORDER BY review_id) AS rn FROM lng WHERE flag) WHERE rn <= 3""".replace(
    "repeat(", "CASE WHEN rating IS NOT NULL THEN repeat(").replace("AS INT)) AS stars", "AS INT)) END AS stars"))

# --- topics -----------------------------------------------------------------
add("topic_tags", TAGS, f"""SELECT review_id, {joined_topics()} AS topics, {', '.join(f'bool_or(has_{t}) AS has_{t}' for t in V.TOPICS)}
  FROM lng GROUP BY review_id""")
add("dictionary_topics", DOC_TAGS, "SELECT review_id, coalesce(string_agg(topic, ' | ' ORDER BY topic) FILTER (WHERE flag), '') AS topics FROM lng GROUP BY review_id")
add("dictionary_matches", r"""items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
runs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 2], ' ') AS keyword FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM items))""",
    "SELECT doc_id AS review_id, item_id, count(*) AS runs FROM documents JOIN runs ON contains(lower(text), keyword) GROUP BY ALL")
add("document_topics", DOC_TAGS, f"SELECT review_id, {joined_topics()} AS topics FROM lng GROUP BY review_id")
add("document_topics_whole_words", DOCS, "SELECT review_id, array_to_string([t FOR t IN [" + ", ".join(
    f"CASE WHEN {whole_hits('review_text', w)} THEN {q(t)} END" for t, w in V.TOPIC_KEYWORDS.items()) +
    "] IF t IS NOT NULL], ' | ') AS topics FROM docs")
add("topic_stats", TAGS, f"""SELECT Hotel_Name, topic, count(*) FILTER (WHERE flag) AS count, count(*) AS total,
  {pct('count(*) FILTER (WHERE flag)', 'count(*)')} AS percentage FROM lng GROUP BY 1, 2""")
add("topic_prevalence", TAGS, f"SELECT topic, {r('avg(flag::INT) * 100', 4)} AS complaint_rate FROM lng GROUP BY 1")
add("topic_cooccurrence", TAGS, """SELECT a.topic AS topic_a, b.topic AS topic_b,
  count(*) FILTER (WHERE a.flag AND b.flag AND a.topic <> b.topic) AS reviews FROM lng a JOIN lng b USING (review_id) GROUP BY 1, 2""")
add("topic_breakdown", TAGS, "SELECT Hotel_Name, " + ", ".join(pct(f"count(*) FILTER (WHERE has_{t})", "count(*)") + f" AS {t}" for t in V.TOPICS) +
    """ FROM tags WHERE Hotel_Name IN (SELECT Hotel_Name FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) GROUP BY 1""")
add("top_topics", TAGS, f"""SELECT Hotel_Name, topic, count, total, percentage FROM (
  SELECT *, row_number() OVER (PARTITION BY Hotel_Name ORDER BY percentage DESC, ord) AS rn FROM (
    SELECT Hotel_Name, topic, ord, count(*) FILTER (WHERE flag) AS count, count(*) AS total,
      {pct('count(*) FILTER (WHERE flag)', 'count(*)')} AS percentage FROM lng GROUP BY 1, 2, 3)) WHERE rn = 1""")
add("corpus_rating_drop", TAGS, f"""SELECT topic, {r(f'(SELECT {mean('rating')} FROM clean) - {mean('rating', 'flag')}', 4)} AS rating_drop
  FROM lng GROUP BY 1""")
WHOLE_PICK = "CASE topic " + " ".join(f"WHEN {q(t)} THEN {whole_hits('review_text', w)}" for t, w in V.TOPIC_KEYWORDS.items()) + " END"
add("weak_labels", TAGS, f"""SELECT review_id, review_text, coalesce(string_agg(topic, ' | ' ORDER BY topic) FILTER (WHERE flag OR {WHOLE_PICK}), 'none') AS labels
  FROM lng GROUP BY 1, 2""")

# --- profiles ---------------------------------------------------------------
add("hotel_list", BASE, "SELECT DISTINCT Hotel_Name FROM raw")
add("hotel_stats", BASE, f"""SELECT n_name AS Hotel_Name, count(review_id) AS total_reviews, coalesce({r(f'{mean('Reviewer_Score')}', 2)}, 0) AS avg_rating,
  coalesce(strftime(min({DAY}), '%Y-%m-%d'), 'N/A') AS start_date, coalesce(strftime(max({DAY}), '%Y-%m-%d'), 'N/A') AS end_date,
  CASE WHEN coalesce({r(f'{mean('Reviewer_Score')}', 2)}, 0) >= 8 THEN 'Good' WHEN coalesce({r(f'{mean('Reviewer_Score')}', 2)}, 0) >= 6 THEN 'Average' ELSE 'Poor' END AS label
  FROM nation LEFT JOIN raw ON n_name = Hotel_Name GROUP BY 1""")

LEX = "lex(word, val, subj) AS (VALUES " + ", ".join(f"({q(w)}, {v}, {s})" for v, s, ws in V.LEXICON for w in ws) + ")"


def sentiment_ctes(source: str) -> str:
    return rf"""{LEX},
tok AS MATERIALIZED (SELECT review_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (
  SELECT review_id, string_split({clean_sql('review_text')}, ' ') AS t FROM {source})),
negs AS (SELECT review_id, i FROM tok WHERE w IN ({lst(V.NEGATIONS)})),
valued AS (SELECT tok.review_id, tok.i, any_value(val) AS val, count(negs.i) AS n FROM tok JOIN lex ON w = word
  LEFT JOIN negs ON negs.review_id = tok.review_id AND negs.i BETWEEN tok.i - 3 AND tok.i - 1 GROUP BY 1, 2),
sums AS (SELECT review_id, sum(CASE WHEN n > 0 THEN val * -74 ELSE val * 100 END)::DOUBLE / 10000 AS s FROM valued GROUP BY 1),
sent AS MATERIALIZED (SELECT c.*, coalesce({r('s / sqrt(s * s + 15)', 4)}, 0) AS sentiment_score FROM {source} c LEFT JOIN sums USING (review_id))"""


def label(x: str) -> str:
    return f"CASE WHEN {x} > 0.3 THEN 'positive' WHEN {x} < -0.3 THEN 'negative' ELSE 'neutral' END"


TRUE_LABEL = "CASE WHEN rating >= 3.5 THEN 'positive' WHEN rating < 2.5 THEN 'negative' ELSE 'neutral' END"
STAR_SCORE = "(coalesce(round_even(rating, 0), 3) - 3) / 2e0"
SENT = CLEAN + ",\n" + sentiment_ctes("clean")
HEALTH = "CAST(floor(least({0} / 5 * 100, 100)) AS BIGINT)"


def _summary(sentiment_source: str) -> str:
    return f"""SELECT *, {HEALTH.format('avg_rating')} AS health_score, CASE WHEN {HEALTH.format('avg_rating')} >= 80 THEN 'good'
  WHEN {HEALTH.format('avg_rating')} >= 60 THEN 'fair' ELSE 'poor' END AS health_band FROM (
  SELECT Hotel_Name, count(*) AS total_reviews, {r(f'{mean('rating')}', 2)} AS avg_rating, {r(sentiment_source, 3)} AS avg_sentiment FROM (
    SELECT *, row_number() OVER (PARTITION BY Hotel_Name ORDER BY review_id) AS rn FROM sent) GROUP BY 1)"""


add("hotel_summary", SENT, _summary(mean('sentiment_score')))
add("monthly_rating", CLEAN, f"""SELECT Hotel_Name, month, {r('m', 4)} AS avg_rating, {r('avg(m) OVER (PARTITION BY Hotel_Name)', 4)} AS avg_line FROM (
  SELECT Hotel_Name, strftime(date, '%Y-%m') AS month, {mean('rating')} AS m FROM clean WHERE date IS NOT NULL GROUP BY 1, 2)""")
add("monthly_complaint_rate", TAGS, f"""SELECT Hotel_Name, strftime(date, '%Y-%m') AS month, topic, {pct('count(*) FILTER (WHERE flag)', 'count(*)')} AS complaint_rate
  FROM lng WHERE date IS NOT NULL GROUP BY 1, 2, 3""")
add("monthly_volume", CLEAN, """SELECT strftime(m, '%Y-%m') AS month, count(rating) AS reviews FROM (
  SELECT unnest(generate_series(date_trunc('month', min(date))::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM clean)
  LEFT JOIN clean ON date_trunc('month', date) = m GROUP BY 1""")
add("last_month", SENT, f"""SELECT Hotel_Name, count(*) AS reviews, {r(f'{mean('rating')}', 2)} AS avg_rating, {r(f'{mean('sentiment_score')}', 2)} AS avg_sentiment,
  round_even(avg((sentiment_score > 0.3)::INT) * 100, 0) AS positive_pct FROM sent
  JOIN (SELECT Hotel_Name, max(date) AS latest FROM clean GROUP BY 1) USING (Hotel_Name) WHERE date >= latest - INTERVAL 1 MONTH GROUP BY 1""")
add("rating_change", CLEAN, f"""SELECT Hotel_Name, overall_rating, recent_rating,
  CASE WHEN {r('recent_rating - overall_rating', 2)} >= 0 THEN '+' ELSE '' END || {r('recent_rating - overall_rating', 2)}::VARCHAR AS change FROM (
  SELECT Hotel_Name, {r(mean('rating'), 2)} AS overall_rating, {r(mean('rating', 'date >= latest - INTERVAL 1 MONTH'), 2)} AS recent_rating FROM clean
  JOIN (SELECT Hotel_Name, max(date) AS latest FROM clean GROUP BY 1) USING (Hotel_Name) GROUP BY 1)""")
add("top_hotels", CLEAN, f"SELECT Hotel_Name, count(rating) AS reviews, {r(f'{mean('rating')}', 2)} AS avg_rating FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_types = {"review_id": "bigint", "Hotel_Name": "string", "Hotel_Address": "string", "Review_Date": "date", "Reviewer_Score": "double",
          "Negative_Review": "string", "Positive_Review": "string", "Reviewer_Nationality": "string"}
add("column_profile", BASE + f", loaded AS (SELECT * REPLACE ({DAY} AS Review_Date) FROM raw)", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS missing, {pct(f'count(*) - count({c})', 'count(*)', 2)} AS missing_pct FROM loaded"""
    for c, t in _types.items()))


def _describe(c: str, source: str, d: int, name: str) -> str:
    qs = ", ".join(f"{r(f'quantile_cont({c}, {p})', d)} AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return f"""SELECT '{name}' AS "column", count({c}) AS count, {r(f'avg({c})', d)} AS mean, {r(f'stddev_samp({c})', d)} AS std, {r(f'min({c})', d)} AS min,
  {qs}, {r(f'max({c})', d)} AS max FROM {source}"""


COUNTED = CLEAN + ", counted AS (SELECT *, len(string_split(review_text, ' '))::DOUBLE AS word_count FROM clean)"
add("numeric_describe", COUNTED, _describe("rating", "counted", 3, "rating") + " UNION ALL " + _describe("word_count", "counted", 1, "word_count"))


def _histogram(ctes: str, value: str, source: str, bins: int) -> tuple[str, str]:
    return (ctes + f""", vals AS (SELECT {value} AS v FROM {source} WHERE {value} IS NOT NULL),
edge AS (SELECT min(v) AS lo, max(v) AS hi FROM vals), bins AS (SELECT unnest(range({bins})) AS bin),
placed AS (SELECT least(floor((v - lo) * {bins}e0 / (hi - lo)), {bins - 1})::BIGINT AS bin FROM vals, edge)""",
            f"""SELECT bin, {r(f'lo + (hi - lo) / {bins}e0 * bin', 4)} AS lower, {r(f'lo + (hi - lo) / {bins}e0 * (bin + 1)', 4)} AS upper, n AS count FROM (
  SELECT bins.bin, count(placed.bin) AS n FROM bins LEFT JOIN placed USING (bin) GROUP BY 1), edge""")


add("rating_histogram", *_histogram(CLEAN, "rating", "clean", 20))
add("word_count_histogram", *_histogram(DOCS, f"least(len(regexp_split_to_array({strip('review_text')}, '{SP}+')), 300)::DOUBLE", "docs", 40))
add("topic_rating_histogram", TAGS, """SELECT Hotel_Name, topic, least(floor((rating - 1) * 10e0 / 4), 9)::BIGINT AS bin,
  count(*) FILTER (WHERE flag) AS with_topic, count(*) FILTER (WHERE NOT flag) AS without_topic FROM lng WHERE rating IS NOT NULL GROUP BY 1, 2, 3""")
add("sentiment_distribution", SENT, f"""SELECT l AS label, count(review_id) AS reviews FROM (VALUES ('positive'), ('neutral'), ('negative')) v(l)
  LEFT JOIN sent ON {label('sentiment_score')} = l GROUP BY 1""")
add("sentiment_by_rating", SENT, f"""SELECT CAST(round_even(rating, 0) AS BIGINT) AS stars, {r(f'{mean('sentiment_score')}', 4)} AS avg_score, count(*) AS reviews
  FROM sent WHERE rating IS NOT NULL GROUP BY 1""")
add("sentiment_by_nationality", SENT, "SELECT Reviewer_Nationality, " + ", ".join(
    pct(f"count(*) FILTER (WHERE {label('sentiment_score')} = '{l}')", "count(*)", 4) + f" AS {l}" for l in ("positive", "neutral", "negative")) +
    " FROM sent WHERE Reviewer_Nationality IN (SELECT Reviewer_Nationality FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY 1")
add("label_agreement", SENT, f"""SELECT {r(f"avg(({label('sentiment_score')} = {label(STAR_SCORE)})::INT)", 4)} AS agreement_rate, count(*) AS reviews FROM sent""")


def opinion_ctes(source: str) -> str:
    return rf"""op AS MATERIALIZED (SELECT c.review_id, coalesce({r('avg(val) / 400e0', 4)}, 0) AS polarity, coalesce({r('avg(subj) / 100e0', 4)}, 0) AS subjectivity FROM {source} c
  LEFT JOIN (SELECT review_id, val, subj FROM (SELECT review_id, unnest(regexp_extract_all(lower(review_text), '\p{{L}}+')) AS w FROM {source}) JOIN lex ON w = word)
  USING (review_id) GROUP BY 1)"""


_s3 = ("sentiment_score", "star_score", "polarity")
_mean3 = "((" + " + ".join(_s3) + ") / 3e0)"
_sd3 = "sqrt((" + " + ".join(f"pow({s} - {_mean3}, 2)" for s in _s3) + ") / 3e0)"
ENSEMBLE = SENT + ",\n" + opinion_ctes("clean") + f""",
three AS (SELECT review_id, sentiment_score, {STAR_SCORE} AS star_score, polarity FROM sent JOIN op USING (review_id)),
ens AS (SELECT review_id, {r('sentiment_score * 0.33e0 + star_score * 0.33e0 + polarity * 0.34e0', 4)} AS ensemble_score, {r(f'1 - least({_sd3}, 1)', 4)} AS agreement,
  {label('(sentiment_score * 0.33e0 + star_score * 0.33e0 + polarity * 0.34e0)')} AS consensus_label FROM three)"""
add("ensemble_describe", ENSEMBLE, _describe("ensemble_score", "ens", 4, "ensemble_score") + " UNION ALL " + _describe("agreement", "ens", 4, "agreement"))

# --- impact, trends, priorities ---------------------------------------------
IMPACT = TAGS + f""",
imp AS MATERIALIZED (SELECT Hotel_Name, topic, ord, count(*) FILTER (WHERE flag) AS complaint_count, {pct('count(*) FILTER (WHERE flag)', 'count(*)')} AS complaint_rate,
  {r(f'{mean('rating', 'flag')}', 2)} AS avg_rating_with, {r(f'{mean('rating', 'NOT flag')}', 2)} AS avg_rating_without,
  coalesce({r(f'greatest({mean('rating', 'NOT flag')} - {mean('rating', 'flag')}, 0)', 2)}, 0) AS impact,
  avg(flag::INT) AS share, count(*) AS n_all FROM lng GROUP BY 1, 2, 3)"""


def _band(x: str, a: float, b: float) -> str:
    return f"CASE WHEN {x} >= {a} THEN 'high' WHEN {x} >= {b} THEN 'medium' ELSE 'low' END"


add("impact_table", IMPACT, f"""SELECT Hotel_Name, topic, complaint_count, complaint_rate, avg_rating_with, avg_rating_without, impact,
  {_band('complaint_rate', 30, 15)} AS frequency_band, {_band('impact', 1, 0.5)} AS impact_band FROM imp""")
add("topic_ranking", IMPACT, "SELECT Hotel_Name, topic, impact, row_number() OVER (PARTITION BY Hotel_Name ORDER BY impact DESC, ord) AS rank FROM imp")
TREND = IMPACT + f""",
mon AS (SELECT Hotel_Name, topic, ord, strftime(date, '%Y-%m') AS month, {r('avg(flag::INT) * 100', 1)} AS rate FROM lng
  JOIN (SELECT Hotel_Name, max(date) AS latest FROM clean GROUP BY 1) USING (Hotel_Name) WHERE date >= latest - INTERVAL 12 MONTH GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY Hotel_Name, topic ORDER BY month DESC) AS back FROM mon),
means AS (SELECT Hotel_Name, topic, ord, count(*) AS months, list_sum(list(rate ORDER BY month) FILTER (WHERE back <= 3)) / least(count(*), 3) AS recent,
  list_sum(list(rate ORDER BY month) FILTER (WHERE back BETWEEN 4 AND 6)) / 3e0 AS before,
  string_agg(month || '=' || rate::VARCHAR, ',' ORDER BY month) AS monthly_data FROM numbered GROUP BY 1, 2, 3),
tr AS MATERIALIZED (SELECT *, CASE WHEN recent - previous > 3 THEN 'INCREASING' WHEN recent - previous < -3 THEN 'DECREASING' ELSE 'STABLE' END AS trend
  FROM (SELECT *, CASE WHEN months >= 6 THEN before ELSE recent END AS previous FROM means))"""
ICON = "CASE trend WHEN 'INCREASING' THEN '↑' WHEN 'DECREASING' THEN '↓' ELSE '→' END"
add("trends", TREND, f"""SELECT Hotel_Name, topic, trend, {ICON} AS trend_icon, {r('recent', 1)} AS current_rate, {r('recent', 1)} AS recent_rate,
  {r('previous', 1)} AS previous_rate, {r('recent - previous', 1)} AS delta,
  CASE trend WHEN 'INCREASING' THEN 'Worsening' WHEN 'DECREASING' THEN 'Improving' ELSE 'Stable' END AS direction, monthly_data FROM tr""")
ISSUES = TREND + f""",
issues AS (SELECT *, CASE WHEN priority_score >= 60 THEN 'CRITICAL' WHEN priority_score >= 40 THEN 'HIGH' WHEN priority_score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS priority_category
  FROM (SELECT *, least({r("frequency * 0.4e0 + impact * 20e0 * 0.4e0 + CASE trend WHEN 'INCREASING' THEN 10 WHEN 'DECREASING' THEN 0 ELSE 5 END * 0.2e0", 1)}, 100) AS priority_score
    FROM (SELECT imp.Hotel_Name, imp.topic, imp.ord, complaint_rate AS frequency, impact, coalesce(tr.trend, 'STABLE') AS trend FROM imp LEFT JOIN tr USING (Hotel_Name, topic))))"""
add("all_issues", ISSUES, f"SELECT Hotel_Name, topic, frequency, impact, trend, {ICON} AS trend_icon, priority_score, priority_category FROM issues")
add("ranked_issues", ISSUES, f"""SELECT Hotel_Name, topic, frequency, impact, trend, {ICON} AS trend_icon, priority_score, priority_category, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY Hotel_Name ORDER BY priority_score DESC, ord) AS rank FROM issues WHERE frequency >= 5) WHERE rank <= 6""")

# --- causes and plans -------------------------------------------------------
CAUSE_ROWS = "cause_names(cause, cord, description) AS (VALUES " + ", ".join(
    f"({q(c)}, {i}, {q(V.CAUSE_DESCRIPTIONS[c])})" for i, c in enumerate(V.CAUSES)) + ")"
PRIOR_ROWS = "priors(topic, cause, idx) AS (VALUES " + ", ".join(f"({q(t)}, {q(c)}, {i})" for t, cs in V.CAUSE_PRIORS.items() for i, c in enumerate(cs)) + ")"
CAUSE_PICK = "CASE cause " + " ".join(f"WHEN {q(c)} THEN {hits('review_text', w)}" for c, w in V.CAUSE_KEYWORDS.items()) + " END"
CAUSE_CTES = f"""{CAUSE_ROWS}, {PRIOR_ROWS},
marked AS MATERIALIZED (SELECT review_id, Hotel_Name, topic, lower(review_text) AS t, cause, cord, {CAUSE_PICK} AS hit FROM lng CROSS JOIN cause_names WHERE flag),
rates AS (SELECT Hotel_Name, topic, cause, cord, count(*) AS total, count(*) FILTER (WHERE hit) AS hits,
  {pct('count(*) FILTER (WHERE hit)', 'count(*)')} AS confidence FROM marked GROUP BY ALL),
found AS (SELECT *, false AS fallback FROM rates WHERE confidence >= 10),
sparse AS (SELECT DISTINCT Hotel_Name, topic, total FROM rates WHERE (Hotel_Name, topic) NOT IN (SELECT (Hotel_Name, topic) FROM found)),
guessed AS (SELECT Hotel_Name, topic, cause, cord, total, NULL::BIGINT AS hits,
  greatest(CASE WHEN total <= 2 THEN 35e0 WHEN total <= 5 THEN 30e0 ELSE 25e0 END - 5 * idx, 15e0) AS confidence, true AS fallback
  FROM sparse JOIN priors USING (topic) JOIN cause_names USING (cause)),
causes AS MATERIALIZED (SELECT Hotel_Name, topic, total, hits, cause, confidence, fallback, description,
  row_number() OVER (PARTITION BY Hotel_Name, topic ORDER BY confidence DESC, cord) AS rank
  FROM (SELECT * FROM found UNION ALL BY NAME SELECT * FROM guessed) JOIN cause_names USING (cause, cord))"""
CAUSE = TAGS + ",\n" + CAUSE_CTES
DOC_CAUSE = DOC_TAGS + ",\n" + CAUSE_CTES
_cols = "Hotel_Name, topic, total, hits, cause, confidence, fallback, rank, description"
add("root_causes", CAUSE, f"""SELECT {_cols}, {_band('confidence', 60, 30)} AS confidence_band FROM causes""")
add("document_root_causes", DOC_CAUSE, f"SELECT {_cols} FROM causes")
KEYWORD_ROWS = "words(cause, kw, pos) AS (VALUES " + ", ".join(f"({q(c)}, {q(w)}, {i})" for c, ws in V.CAUSE_KEYWORDS.items() for i, w in enumerate(ws)) + ")"
add("root_cause_evidence", CAUSE + f""", {KEYWORD_ROWS},
firsts AS (SELECT *, row_number() OVER (PARTITION BY Hotel_Name, topic, cause ORDER BY review_id) AS rn FROM marked WHERE hit),
cut AS (SELECT Hotel_Name, topic, cause, rn, t, arg_min(kw, pos) AS kw FROM firsts JOIN words USING (cause) WHERE rn <= 3 AND contains(t, kw) GROUP BY 1, 2, 3, 4, 5),
quotes AS (SELECT Hotel_Name, topic, cause, string_agg('Guest wrote: "…' || trim(substring(t, greatest(instr(t, kw) - 40, 1),
    instr(t, kw) - greatest(instr(t, kw) - 40, 1) + length(kw) + 60)) || '…"', ' | ' ORDER BY rn) AS quoted FROM cut GROUP BY 1, 2, 3)""",
    f"""SELECT Hotel_Name, topic, cause, CASE WHEN fallback THEN replace({q(V.SPARSE_EVIDENCE[0])}, '%d', total::VARCHAR) || ' | ' || {q(V.SPARSE_EVIDENCE[1])}
  ELSE hits || ' of ' || total || ' reviews (' || confidence::VARCHAR || '%) contain ''' || lower(replace(cause, '_', ' ')) || ''' indicators.' ||
    coalesce(' | ' || quoted, '') END AS evidence FROM causes LEFT JOIN quotes USING (Hotel_Name, topic, cause)""")
add("root_cause_table", DOC_CAUSE, """SELECT Hotel_Name, topic, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(cause, '_')], ' ') AS root_cause,
  printf('%.0f%%', round_even(confidence, 0)) AS confidence, description, rank FROM causes WHERE NOT fallback OR rank = 1""")


def _cost(formula: str) -> str:
    f = formula
    for name, value in V.COST_CONSTANTS.items():
        f = f.replace(name, str(value))
    return f"({f})::DOUBLE"


PLAN = CAUSE + """,
tmpl(cause, timeframe, tord, action, cost_formula, timeline, expected_impact, aord) AS (VALUES """ + ", ".join(
    f"({q(c)}, {q(tf)}, {V.TIMEFRAMES.index(tf)}, {q(a)}, {q(f)}, {q(tl)}, {q(im)}, {i})"
    for i, (c, tf, a, f, tl, im) in enumerate(V.ACTION_TEMPLATES)) + f"""),
hotel_rooms AS (SELECT n_name AS Hotel_Name, 20 * count(*) AS rooms FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
act AS (SELECT c.*, coalesce(rooms, 100) AS rooms FROM (SELECT *, max(confidence) OVER (PARTITION BY Hotel_Name, topic) AS best FROM causes) c
  LEFT JOIN hotel_rooms USING (Hotel_Name) WHERE confidence >= 60 OR (best < 60 AND rank <= 3)),
plan AS MATERIALIZED (SELECT Hotel_Name, topic, row_number() OVER (PARTITION BY Hotel_Name, topic ORDER BY tord, rank, aord) AS step, timeframe, action,
  CASE cost_formula {' '.join(f'WHEN {q(f)} THEN {_cost(f)}' for f in sorted({t[3] for t in V.ACTION_TEMPLATES}))} END AS cost,
  timeline, expected_impact, cause AS root_cause, confidence, rooms FROM act JOIN tmpl USING (cause)),
costs AS MATERIALIZED (SELECT Hotel_Name, topic, {r("coalesce(sum(cost) FILTER (WHERE timeframe <> 'long_term'), 0)", 2)} AS one_time,
  {r("coalesce(sum(cost) FILTER (WHERE timeframe = 'long_term'), 0)", 2)} AS monthly,
  {r("coalesce(sum(cost) FILTER (WHERE timeframe <> 'long_term'), 0) + 3 * coalesce(sum(cost) FILTER (WHERE timeframe = 'long_term'), 0)", 2)} AS three_month_total,
  count(*) AS actions FROM plan GROUP BY 1, 2)"""


def gbp(x: str) -> str:
    return f"'£' || CASE WHEN {x} <= -0.5 THEN '-' ELSE '' END || format('{{:,}}', abs(round_even({x}, 0))::BIGINT)"


add("action_plans", PLAN, f"""SELECT Hotel_Name, topic, step, timeframe, action, cost, {gbp('cost')} AS cost_text, timeline, expected_impact, root_cause, confidence,
  rooms::BIGINT AS rooms FROM plan""")
add("ranked_actions", PLAN, """SELECT Hotel_Name, topic, row_number() OVER (PARTITION BY Hotel_Name, topic ORDER BY confidence DESC, step) AS confidence_rank,
  action, root_cause, confidence FROM plan""")
add("plan_costs", PLAN, "SELECT * FROM costs")


def roi_ctes(defaults: bool = False, rate: float = 150, occupancy: float = 0.65) -> str:
    share, impact = ("0.3e0", "0e0") if defaults else ("share", "impact")
    return PLAN + "," + f"""
inp AS (SELECT Hotel_Name, topic, (SELECT {mean('rating')} FROM clean c WHERE c.Hotel_Name = l.Hotel_Name) AS rating, avg(flag::INT) AS share,
  coalesce({r(f'greatest({mean('rating', 'NOT flag')} - {mean('rating', 'flag')}, 0)', 2)}, 0) AS impact FROM lng l GROUP BY 1, 2),
j AS (SELECT inp.*, coalesce(three_month_total, 0) AS inv, coalesce(rooms, 100) AS rooms, {r(f'{share} * 0.7e0 * {impact}', 2)} AS gain
  FROM inp LEFT JOIN costs USING (Hotel_Name, topic) LEFT JOIN hotel_rooms USING (Hotel_Name)),
k AS (SELECT *, least({occupancy}e0 + gain * 10e0 * 0.05e0, 0.95e0) AS occ FROM j),
m AS (SELECT *, rooms * {rate}e0 * 30e0 * {occupancy}e0 AS old_rev, rooms * {rate}e0 * 30e0 * occ AS new_rev FROM k),
roi AS MATERIALIZED (SELECT Hotel_Name, topic, rooms::BIGINT AS rooms, {r('rating', 2)} AS current_rating, {r('least(rating + gain, 5)', 2)} AS expected_rating, gain AS rating_improvement,
  {occupancy}e0 AS current_occupancy, {r('occ', 4)} AS expected_occupancy, {r('old_rev', 2)} AS current_revenue, {r('new_rev', 2)} AS improved_revenue,
  {r('new_rev - old_rev', 2)} AS monthly_increase, inv AS total_investment, {r('(new_rev - old_rev) * 3', 2)} AS returns_3_months,
  {r('(new_rev - old_rev) * 3 - inv', 2)} AS net_profit_3_months,
  CASE WHEN inv > 0 THEN {r('((new_rev - old_rev) * 3 - inv) / inv * 100', 1)} ELSE 0 END AS roi_percentage, new_rev - old_rev > 0 AS pays_back,
  CASE WHEN new_rev - old_rev > 0 THEN {r('inv / (new_rev - old_rev)', 1)} END AS payback_months FROM m)"""


add("roi", roi_ctes(), "SELECT * FROM roi")
add("roi_default_inputs", roi_ctes(True, 200, 0.9), "SELECT * FROM roi")
_p = lambda x: f"printf('%.1f%%', {r(x, 1)})"
add("roi_text", roi_ctes(), f"""SELECT Hotel_Name, topic, current_rating, expected_rating, rating_improvement, {_p('current_occupancy * 100')} AS current_occupancy,
  {_p('expected_occupancy * 100')} AS expected_occupancy, """ + ", ".join(f"{gbp(c)} AS {c}" for c in (
    "current_revenue", "improved_revenue", "monthly_increase", "total_investment", "returns_3_months", "net_profit_3_months")) +
    f""", {_p('roi_percentage')} AS roi_percentage, coalesce(payback_months::VARCHAR, 'never') AS payback_months FROM roi""")
add("roi_breakdown", roi_ctes(), """SELECT Hotel_Name, topic, 0::BIGINT AS position, 'Investment' AS item, 0e0 - total_investment AS amount FROM roi
  UNION ALL SELECT Hotel_Name, topic, 1, 'Revenue Uplift (3M)', returns_3_months FROM roi UNION ALL SELECT Hotel_Name, topic, 2, 'Net Profit', net_profit_3_months FROM roi""")
add("hotel_report", roi_ctes() + ",\n" + sentiment_ctes("clean") + f""",
chosen AS (SELECT Hotel_Name FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
stat AS (SELECT Hotel_Name, topic, ord, {pct('count(*) FILTER (WHERE flag)', 'count(*)')} AS complaint_rate FROM lng GROUP BY 1, 2, 3),
lead AS (SELECT Hotel_Name, arg_max(topic, complaint_rate * 100 - ord) AS topic, max(complaint_rate) AS complaint_rate FROM stat GROUP BY 1),
summ AS ({_summary(mean('sentiment_score'))})""", f"""SELECT Hotel_Name, topic, total_reviews, avg_rating, avg_sentiment, health_score, health_band,
  total_investment, rating_improvement, expected_rating, net_profit_3_months, roi_percentage, payback_months, complaint_rate, impact, coalesce(actions, 0) AS actions,
  CASE WHEN total_investment >= 1e6 THEN printf('£%.1fM', {r('total_investment / 1e6', 1)}) WHEN total_investment >= 1e3 THEN printf('£%.1fK', {r('total_investment / 1e3', 1)})
    ELSE printf('£%.0f', round_even(total_investment, 0)) END AS investment_text
  FROM chosen JOIN lead USING (Hotel_Name) JOIN summ USING (Hotel_Name) JOIN roi USING (Hotel_Name, topic) LEFT JOIN costs USING (Hotel_Name, topic)
  JOIN (SELECT Hotel_Name, topic, impact FROM inp) USING (Hotel_Name, topic)""")

PRAISED = CLEAN.replace("clean AS MATERIALIZED (", "guests AS MATERIALIZED (") + """,
clean AS MATERIALIZED (SELECT review_id, Hotel_Name, date, rating, review_text FROM guests
  UNION ALL SELECT -1 - s_suppkey, r_name, DATE '1998-01-01', 4e0, 'Lovely view' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ORACLES["hotel_report_all"] = ORACLES["hotel_report"].replace(CLEAN, PRAISED).replace("ORDER BY count(*) DESC, 1 LIMIT 10", "")

# --- sentiment --------------------------------------------------------------
add("sentiment_score", SENT, f"""SELECT review_id, sentiment_score, {label('sentiment_score')} AS sentiment_label, {STAR_SCORE} AS star_score, {TRUE_LABEL} AS true_label FROM sent""")
add("document_sentiment", DOCS + ",\n" + sentiment_ctes("docs"), f"SELECT review_id, sentiment_score, {label('sentiment_score')} AS sentiment_label FROM sent")
add("ensemble_score", ENSEMBLE, "SELECT * FROM ens")
OPINION = CLEAN + ",\n" + LEX + ",\n" + opinion_ctes("clean")
add("opinion_scores", OPINION, "SELECT * FROM op")
add("sentence_sentiment", DOCS + ",\n" + LEX + rf""",
sen AS (SELECT review_id, Hotel_Name, generate_subscripts(s, 1) AS i, unnest(s) AS sentence FROM (
  SELECT review_id, Hotel_Name, [x FOR x IN [{strip('y')} FOR y IN regexp_extract_all(review_text, '[^.!?]+[.!?]*')] IF x <> ''] AS s FROM docs)),
pol AS (SELECT review_id, i, coalesce({r('avg(val) / 400e0', 4)}, 0) AS p FROM (
  SELECT review_id, i, unnest(CASE WHEN len(ws) = 0 THEN [''] ELSE ws END) AS w FROM (SELECT *, regexp_extract_all(lower(sentence), '\p{{L}}+') AS ws FROM sen))
  LEFT JOIN lex ON w = word GROUP BY 1, 2)""",
    f"""SELECT d.review_id, Hotel_Name, count(p) AS sentence_count, count(*) FILTER (WHERE p < -0.1) AS negative_sentences, count(*) FILTER (WHERE p > 0.1) AS positive_sentences,
  count(p) - count(*) FILTER (WHERE p < -0.1) - count(*) FILTER (WHERE p > 0.1) AS neutral_sentences, coalesce({r('list_sum(list(p ORDER BY i)) / count(p)', 4)}, 0) AS avg_polarity
  FROM docs d LEFT JOIN pol USING (review_id) GROUP BY 1, 2""")
add("subjective_words", CLEAN + ",\n" + LEX, r"""SELECT c.review_id, coalesce(string_agg(word, ' | ' ORDER BY i), '') AS words FROM clean c LEFT JOIN (
  SELECT review_id, i, word FROM (SELECT review_id, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM (
    SELECT review_id, regexp_extract_all(lower(review_text), '\p{L}+') AS t FROM clean)) JOIN lex ON w = word AND subj > 50) USING (review_id) GROUP BY 1""")
add("opinion_statistics", OPINION, f"""SELECT {r('min(polarity)', 3)} AS min_polarity, {r('max(polarity)', 3)} AS max_polarity, {r(f'{mean('polarity')}', 3)} AS avg_polarity,
  {r(f'{mean('subjectivity')}', 3)} AS avg_subjectivity, count(*) FILTER (WHERE subjectivity < 0.5) AS objective, count(*) FILTER (WHERE subjectivity >= 0.5) AS subjective FROM op""")

# --- text statistics --------------------------------------------------------
STOPS = lst(V.STOP_WORDS)
PROFILE = rf"""prof AS (SELECT *, regexp_extract_all(lower(review_text), '\p{{L}}+') AS words,
  len(regexp_extract_all(lower(review_text), '\p{{L}}+|\p{{N}}+|[^\p{{L}}\p{{N}}\s]')) AS token_count,
  len([x FOR x IN [{strip('y')} FOR y IN regexp_extract_all(review_text, '[^.!?]+[.!?]*')] IF x <> '']) AS sentence_count FROM docs),
prof2 AS (SELECT *, [w FOR w IN words IF w NOT IN ({STOPS})] AS content FROM prof)"""
_token_cols = f"""token_count, len(words) AS word_count, len(content) AS non_stop_word_count, len(list_distinct(content)) AS unique_words,
  CASE WHEN len(words) = 0 THEN 0 ELSE {r('list_sum([length(w) FOR w IN words])::DOUBLE / len(words)', 4)} END AS avg_word_length,
  CASE WHEN len(content) = 0 THEN 0 ELSE {r('len(list_distinct(content))::DOUBLE / len(content)', 4)} END AS vocabulary_richness"""
add("token_profile", DOCS + ",\n" + PROFILE, f"SELECT review_id, Hotel_Name, {_token_cols} FROM prof2")
add("sentence_profile", DOCS + ",\n" + PROFILE, f"""SELECT review_id, Hotel_Name, sentence_count,
  CASE WHEN sentence_count = 0 THEN 0 ELSE {r('token_count::DOUBLE / sentence_count', 4)} END AS avg_sentence_length FROM prof""")


def _top_words(source: str, key: str, n: int) -> str:
    return rf"""top_words AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY frequency DESC, word) AS rank FROM (
  SELECT {key}, word, count(*) AS frequency FROM (SELECT {key}, unnest(regexp_extract_all(lower(review_text), '\p{{L}}+')) AS word FROM {source})
  WHERE word NOT IN ({STOPS}) GROUP BY 1, 2)) WHERE rank <= {n})"""


add("review_word_frequency", DOCS + ",\n" + _top_words("docs", "review_id", 10), "SELECT * FROM top_words")
add("hotel_word_frequency", CLEAN + ",\n" + _top_words("clean", "Hotel_Name", 10), "SELECT * FROM top_words")
add("source_keywords", DOCS + ",\n" + _top_words("docs", "Hotel_Name", 15), "SELECT Hotel_Name, string_agg(word, ' | ' ORDER BY rank) AS keywords FROM top_words GROUP BY 1")
add("collocations", DOCS + rf""",
seq AS (SELECT review_id, Hotel_Name, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM (SELECT *, regexp_extract_all(lower(review_text), '\p{{L}}+') AS t FROM docs)),
prs AS (SELECT a.Hotel_Name, a.w || ' ' || b.w AS pair, count(*) AS frequency FROM seq a JOIN seq b ON a.review_id = b.review_id AND b.i = a.i + 1
  WHERE a.w NOT IN ({STOPS}) AND b.w NOT IN ({STOPS}) GROUP BY 1, 2)""",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Hotel_Name ORDER BY frequency DESC, pair) AS rank FROM prs) WHERE rank <= 10")
add("text_analysis", OPINION + ", docs AS (SELECT * FROM clean),\n" + PROFILE + ",\n" + _top_words("clean", "review_id", 15) + r""",
sw AS (SELECT review_id, string_agg(word, ' | ' ORDER BY i) AS words FROM (SELECT review_id, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM (
    SELECT review_id, regexp_extract_all(lower(review_text), '\p{L}+') AS t FROM clean)) JOIN lex ON w = word AND subj > 50 GROUP BY 1)""",
    f"""SELECT prof2.review_id, polarity, subjectivity, sentence_count, {_token_cols}, coalesce(sw.words, '') AS subjective_words,
  coalesce(k.keywords, '') AS keywords FROM prof2 JOIN op USING (review_id) LEFT JOIN sw USING (review_id)
  LEFT JOIN (SELECT review_id, string_agg(word, ' | ' ORDER BY rank) AS keywords FROM top_words GROUP BY 1) k USING (review_id)""".replace(
        "len(words)", "len(prof2.words)").replace("IN words]", "IN prof2.words]"))


def tfidf_ctes(source: str, bigrams: bool, limit: int, min_df: int, max_df: float, sublinear: bool, stops: bool) -> str:
    keep = f" AND t NOT IN ({STOPS})" if stops else ""
    pairs = """UNION ALL SELECT a.review_id, a.w || ' ' || b.w FROM one a JOIN one b ON a.review_id = b.review_id AND b.i = a.i + 1""" if bigrams else ""
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return rf"""one AS MATERIALIZED (SELECT review_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS w FROM (SELECT review_id,
  [t FOR t IN regexp_extract_all(strip_accents(lower(review_text)), '[\p{{L}}\p{{N}}_]+') IF regexp_full_match(t, '[a-z]{{2,}}'){keep}] AS ts FROM {source})),
terms AS (SELECT review_id, w AS term FROM one {pairs}),
tfs AS MATERIALIZED (SELECT review_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
n AS (SELECT count(*)::DOUBLE AS n FROM {source}),
voc AS (SELECT term, count(*) AS df FROM tfs GROUP BY 1 HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT n FROM n) ORDER BY sum(tf) DESC, term LIMIT {limit}),
raw_w AS (SELECT review_id, term, {tf} * (ln((1 + n) / (1 + df)) + 1) AS w FROM tfs JOIN voc USING (term), n),
weights AS (SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight FROM raw_w)"""


add("tfidf_top_terms", DOCS + ",\n" + tfidf_ctes("docs", False, 100, 1, 1.0, False, True),
    f"SELECT term, {r('sum(weight) / (SELECT n FROM n)', 6)} AS mean_weight FROM weights GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
add("tfidf_weights", DOCS + ",\n" + tfidf_ctes("docs", True, 10000, 2, 0.95, True, False), f"SELECT review_id AS doc, term, {r('weight', 6)} AS weight FROM weights")

# --- split, samples, metrics ------------------------------------------------
DRAW = "md5('42:' || review_id::VARCHAR)"


def _split(source: str, stratum: str) -> str:
    return f"""SELECT review_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY d, review_id::VARCHAR) <= round_even(count(*) OVER (PARTITION BY stratum) * 0.2e0, 0) AS is_test
  FROM (SELECT review_id, {stratum} AS stratum, {DRAW} AS d FROM {source})"""


add("train_test_split", CLEAN + ", rated AS (SELECT * FROM clean WHERE rating IS NOT NULL)", _split("rated", "round_even(rating, 0)::BIGINT"))
add("train_test_split_unrated", CLEAN, _split("clean", "0::BIGINT"))
add("random_sample", CLEAN, f"SELECT review_id, Hotel_Name, rating FROM clean ORDER BY {DRAW}, review_id LIMIT 2000")
JUDGED = SENT + ",\n" + long_ctes("clean") + f""",
jud AS MATERIALIZED (SELECT *, {TRUE_LABEL} AS y, {label('sentiment_score')} AS p, {STAR_SCORE} AS star_score FROM sent WHERE rating IS NOT NULL),
two AS MATERIALIZED (SELECT review_id, topic, ord, flag AS y, {WHOLE_PICK} AS p FROM lng WHERE rating IS NOT NULL)"""


def per_class(rows: str, classes: str, y: str, p: str) -> str:
    return f"""cnt AS (SELECT l, any_value(o) AS o, count(*) FILTER (WHERE {y} AND {p}) AS tp, count(*) FILTER (WHERE {p}) AS pp, count(*) FILTER (WHERE {y}) AS ap,
    count(*) FILTER (WHERE ({y}) = ({p})) AS agree, count(*) AS n FROM {rows} GROUP BY 1),
pr AS (SELECT *, CASE WHEN pp = 0 THEN 0 ELSE tp::DOUBLE / pp END AS pre, CASE WHEN ap = 0 THEN 0 ELSE tp::DOUBLE / ap END AS rec FROM cnt),
cls AS (SELECT *, CASE WHEN pre + rec = 0 THEN 0 ELSE 2 * pre * rec / (pre + rec) END AS f FROM pr)"""


SENT_CLS = JUDGED + ",\n" + per_class("(SELECT jud.*, l, o FROM jud CROSS JOIN (VALUES ('negative', 0), ('neutral', 1), ('positive', 2)) v(l, o))", "", "y = l", "p = l")
TOPIC_CLS = JUDGED + ",\n" + per_class("(SELECT *, topic AS l, ord AS o FROM two)", "", "y", "p")
_w = lambda x: f"sum({x} * ap) / sum(ap)"
add("accuracy", JUDGED, f"SELECT {r('avg((y = p)::INT)', 4)} AS accuracy, count(*) AS n FROM jud")
add("classification_report", SENT_CLS, f"""SELECT l AS label, {r('pre', 4)} AS precision, {r('rec', 4)} AS recall, {r('f', 4)} AS f1, ap AS support FROM cls
  UNION ALL SELECT 'Macro Avg', {r('avg(pre)', 4)}, {r('avg(rec)', 4)}, {r('avg(f)', 4)}, sum(ap)::BIGINT FROM cls
  UNION ALL SELECT 'Weighted Avg', {r(_w('pre'), 4)}, {r(_w('rec'), 4)}, {r(_w('f'), 4)}, sum(ap)::BIGINT FROM cls""")
add("sentiment_metrics", SENT_CLS, f"""SELECT (SELECT {r('avg((y = p)::INT)', 4)} FROM jud) AS accuracy, {r('avg(pre)', 4)} AS precision, {r('avg(rec)', 4)} AS recall,
  {r('avg(f)', 4)} AS f1, (SELECT count(*) FROM jud) AS n FROM cls WHERE pp + ap > 0""")
add("confusion_matrix", JUDGED, f"""SELECT a AS actual, b AS predicted, count(review_id) AS n, coalesce({r('count(review_id)::DOUBLE / nullif(sum(count(review_id)) OVER (PARTITION BY a), 0)', 4)}, 0) AS share
  FROM (SELECT a.l AS a, b.l AS b FROM (VALUES ('negative'), ('neutral'), ('positive')) a(l) CROSS JOIN (VALUES ('negative'), ('neutral'), ('positive')) b(l))
  LEFT JOIN jud ON y = a AND p = b GROUP BY 1, 2""")
add("multilabel_f1", TOPIC_CLS, f"""SELECT {r('avg(f)', 4)} AS macro_f1, {r('2 * (sum(tp) / sum(pp)) * (sum(tp) / sum(ap)) / (sum(tp) / sum(pp) + sum(tp) / sum(ap))', 4)} AS micro_f1,
  {r(_w('f'), 4)} AS weighted_f1 FROM cls""")
add("topic_report", TOPIC_CLS, f"""SELECT l AS topic, {r('agree::DOUBLE / n', 4)} AS accuracy, {r('pre', 4)} AS precision, {r('rec', 4)} AS recall, {r('f', 4)} AS f1, ap AS support FROM cls
  UNION ALL SELECT 'Macro Average', {r('avg(agree::DOUBLE / n)', 4)}, {r('avg(pre)', 4)}, {r('avg(rec)', 4)}, {r('avg(f)', 4)}, sum(ap)::BIGINT FROM cls""")
add("topic_confusion", TOPIC_CLS, "SELECT l AS topic, n - pp - ap + tp AS tn, pp - tp AS fp, ap - tp AS fn, tp FROM cls")
add("mean_absolute_error", JUDGED, f"SELECT {r('avg(abs(star_score - sentiment_score))', 4)} AS mae, count(*) AS n FROM jud")
_models = f"""s_cls AS (SELECT avg(f) AS f1 FROM (SELECT CASE WHEN 2 * tp + (pp - tp) + (ap - tp) = 0 THEN 0 ELSE 2e0 * tp / (pp + ap) END AS f FROM (
  SELECT l, count(*) FILTER (WHERE y = l AND p = l) AS tp, count(*) FILTER (WHERE p = l) AS pp, count(*) FILTER (WHERE y = l) AS ap
  FROM {{0}} CROSS JOIN (VALUES ('negative'), ('neutral'), ('positive')) v(l) GROUP BY 1) WHERE pp + ap > 0)),
t_cls AS (SELECT avg(CASE WHEN pp + ap = 0 THEN 0 ELSE 2e0 * tp / (pp + ap) END) AS f1, avg(acc) AS acc FROM (
  SELECT topic, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE p) AS pp, count(*) FILTER (WHERE y) AS ap, avg((y = p)::INT) AS acc FROM {{1}} GROUP BY 1))"""
add("model_summary", JUDGED + ",\n" + _models.format("jud", "two"), f"""SELECT 'Sentiment' AS model, 'lexicon' AS method, count(*) AS n, {r('avg((y = p)::INT)', 4)} AS accuracy,
  (SELECT {r('f1', 4)} FROM s_cls) AS macro_f1 FROM jud
  UNION ALL SELECT 'Topic', 'keyword', (SELECT count(*) FROM jud), {r('acc', 4)}, {r('f1', 4)} FROM t_cls""")
add("evaluation_report", JUDGED + f""", rated AS (SELECT * FROM clean WHERE rating IS NOT NULL),
held AS (SELECT review_id FROM ({_split('rated', 'round_even(rating, 0)::BIGINT')}) WHERE is_test),
jt AS (SELECT * FROM jud WHERE review_id IN (SELECT review_id FROM held)), tt AS (SELECT * FROM two WHERE review_id IN (SELECT review_id FROM held)),
""" + _models.format("jt", "tt"), f"""SELECT (SELECT {r('f1', 4)} FROM t_cls) AS topic_macro_f1, {r('avg((y = p)::INT)', 4)} AS sentiment_accuracy, 'lexicon' AS method, count(*) AS n_test FROM jt""")


_MODEL = TAGS + ", rated AS (SELECT * FROM clean WHERE rating IS NOT NULL), drawn AS (" + _split("rated", "round_even(rating, 0)::BIGINT") + ")"
add("stored_model", _MODEL, """SELECT topic, coalesce(bool_or(flag) FILTER (WHERE NOT is_test), false) AND NOT coalesce(bool_and(flag) FILTER (WHERE NOT is_test), true) AS trained,
  count(*) FILTER (WHERE is_test) AS scored, 0::BIGINT AS changed FROM lng JOIN drawn USING (review_id) GROUP BY topic""")
add("separable_topic", _MODEL, """SELECT review_id, CASE WHEN flag THEN topic ELSE 'none' END AS predicted_topics, flag::INT::DOUBLE AS p_wifi, flag::INT::DOUBLE AS confidence
  FROM lng JOIN drawn USING (review_id) WHERE is_test AND topic = 'wifi'""")

for _name in ("uploaded_csv", "uploaded_json", "uploaded_parquet"):
    ORACLES[_name] = ORACLES["loaded_reviews"]
ORACLES["written_report"] = ORACLES["topic_stats"]
add("star_labels", CLEAN, """SELECT review_id, CASE WHEN rating IS NULL THEN 'no label' WHEN round_even(rating, 0) = 1 THEN '1 Star' ELSE concat(round_even(rating, 0)::INT, ' stars') END AS label,
  coalesce((round_even(rating, 0) - 3) / 2, 0e0) AS score FROM clean""")
ORACLES["stored_evaluation"] = ORACLES["evaluation_report"]
add("split_overlap", _MODEL, "SELECT count(*) AS shared FROM drawn a JOIN drawn b USING (review_id) WHERE a.is_test AND NOT b.is_test")

_LABELLED = DOCS + ",\n" + sentiment_ctes("docs") + """,
jud AS MATERIALIZED (SELECT review_id, CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS y, CASE WHEN sentiment_score < 0 THEN 'negative' ELSE 'positive' END AS p
  FROM sent JOIN labels ON doc_id = review_id)"""
add("document_label_accuracy", _LABELLED, f"SELECT {r('avg((y = p)::INT)', 4)} AS accuracy, count(*) AS n FROM jud")
ORACLES["document_label_report"] = ORACLES["classification_report"].replace(JUDGED, _LABELLED)

#: The same questions over documents that orders date and score.
TEXTS = f"""texts AS (SELECT doc_id AS review_id, coalesce(n_name, source) AS Hotel_Name, CAST(o_orderdate AS DATE) AS date,
  CAST(40 + (o_orderkey*37) % 61 - 5*((o_orderkey*7 + o_custkey) % 4) AS DOUBLE) / 10 AS Reviewer_Score, text AS review_text
  FROM documents LEFT JOIN (orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) ON doc_id = o_orderkey),
clean AS MATERIALIZED (SELECT *, CASE WHEN Reviewer_Score IS NOT NULL THEN least(5e0, greatest(1e0, Reviewer_Score / 2)) END AS rating FROM (SELECT DISTINCT * FROM texts)
  WHERE regexp_replace(review_text, '^{SP}+|{SP}+$', '', 'g') <> '')"""
for _name in OVER_TEXTS:
    assert CLEAN in ORACLES[_name], _name
    ORACLES[f"text_{_name}"] = ORACLES[_name].replace(CLEAN, TEXTS)
