"""Text columns. All of it is built-in expressions, evaluated per row in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from reviewops.fixed_values import EMPTY_PLACEHOLDERS, NEGATIONS, PART_PLACEHOLDERS, URL_PATTERN

# Every character that counts as white space, not only the ASCII ones.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPACE_CLASS = r"[\s\p{Z}\x1c-\x1f\x85]"

# Accented Latin letters and the plain letters under them.
_LATIN = [chr(c) for c in range(0xC0, 0x250)]
_PLAIN = {c: "".join(p for p in unicodedata.normalize("NFKD", c) if not unicodedata.combining(p)) for c in _LATIN}
ACCENTED = "".join(c for c, p in _PLAIN.items() if p != c and len(p) == 1)
UNACCENTED = "".join(_PLAIN[c] for c in ACCENTED)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it as often as ``body`` likes.

    An expression repeated in the branches of a condition, or used inside a lambda, is
    evaluated again at each use; a variable of a lambda over one element is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def words_in(values: Iterable[str]) -> Column:
    """Constant array of words. One literal, split when the plan is optimised, is cheaper to build than one per word."""
    return F.split(F.lit("|".join(values)), "[|]")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def is_placeholder(text: Column) -> Column:
    """Blank, or one of the phrases guests type instead of a review."""
    return is_blank(text) | F.lower(strip(text)).isin(EMPTY_PLACEHOLDERS)


def review_part(text: Column) -> Column:
    """Trimmed text of one review field; NULL when it says nothing."""
    t = strip(text)
    return F.when((t == "") | F.lower(t).isin(PART_PLACEHOLDERS), None).otherwise(t)


def combined_review(negative: Column, positive: Column) -> Column:
    return F.concat_ws(" ", review_part(negative), review_part(positive))


def split_words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    def split(t: Column) -> Column:
        return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+"))

    return let(strip(text), split)


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def tokenize(text: Column) -> Column:
    return split_words(F.lower(text))


def clean_text(text: Column) -> Column:
    """Lower-case, no URLs, only ASCII letters, digits and apostrophes, single spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), URL_PATTERN, " ")
    return F.btrim(F.regexp_replace(t, r"[^a-z0-9']+", " "))


def preprocess_text(text: Column) -> Column:
    return strip(F.regexp_replace(clean_text(text), r"([!?.,])\1+", "$1"))


def remove_words(tokens: Column, stop_words: Iterable[str]) -> Column:
    stop_words = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(stop_words))


def has_negation(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?i)\b(" + "|".join(NEGATIONS) + r")\b")


def truncate_words(text: Column, max_words: int = 100) -> Column:
    words = split_words(text)
    return let(words, lambda w: F.when(F.size(w) > max_words, F.concat(F.array_join(F.slice(w, 1, max_words), " "), F.lit("...")))
               .otherwise(F.coalesce(text, F.lit(""))))


def minimal_keywords(keywords: Iterable[str]) -> list[str]:
    """Keywords without those that contain another one.

    If "smell" is looked for, "smelly" can never change the answer. The result of
    a does-any-occur test is the same with a third fewer comparisons.
    """
    keywords = list(keywords)
    return [k for k in keywords if not any(o != k and o in k for o in keywords)]


def mentions_any(lower_text: Column, keywords: Iterable[str], word_boundary: bool = False) -> Column:
    """Whether any keyword occurs in already lower-cased text.

    ``exists`` over a constant array stops at the first hit. It is interpreted, about a fifth slower
    than one OR per keyword, but an OR of a long list outgrows the size the JVM still compiles; tables of
    thousands of keywords are joined instead (``operators.keywords``). The text is bound to a variable first:
    a filter on the result may be pushed below the projection that made the text,
    and would then build the text anew for every keyword.
    """
    if word_boundary:
        keywords = list(keywords)
        pattern = "|".join(re.escape(k) for k in keywords)
        # most places are passed by their letter alone, before any boundary or keyword is looked at
        starts = f"(?=[{''.join(sorted({re.escape(k[0]) for k in keywords}))}])" if all(keywords) and keywords else ""
        return F.coalesce(lower_text.rlike(rf"{starts}\b(?:{pattern})\b"), F.lit(False))
    words = words_in(minimal_keywords(keywords))
    return F.coalesce(let(lower_text, lambda t: F.exists(words, lambda k: t.contains(k))), F.lit(False))


def first_keyword(lower_text: Column, keywords: Iterable[str]) -> Column:
    """First keyword, in list order, that occurs in the text; NULL if none does."""
    return let(lower_text, lambda t: F.get(F.filter(words_in(keywords), lambda k: t.contains(k)), 0))


def snippet_around(lower_text: Column, keyword: Column, before: int = 40, after: int = 60) -> Column:
    """Text from ``before`` characters ahead of the keyword to ``after`` behind it."""
    start = F.position(keyword, lower_text)
    first = F.greatest(start - before, F.lit(1))
    return strip(F.substring(lower_text, first, start - first + F.length(keyword) + after))


# --- words, sentences and pairs ---------------------------------------------

def alphabetic_words(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), 0)


def all_tokens(text: Column) -> Column:
    """Words, numbers and single punctuation marks."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]"), 0)


def sentences(text: Column) -> Column:
    """Stretches up to and including their closing marks; blank ones are dropped."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]+[.!?]*"), 0)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def term_tokens(text: Column) -> Column:
    """Tokens for term weighting: unaccented words of two or more ASCII letters.

    A run of word characters that holds a digit or a foreign letter is not a token.
    """
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, UNACCENTED)
    runs = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.filter(runs, lambda t: t.rlike("^[a-z]{2,}$"))


def counted(items: Column) -> Column:
    """Array of (item, n): each distinct element and how often it occurs, ascending. Nothing leaves the row: equal elements are neighbours once sorted."""
    def counts(s: Column) -> Column:
        firsts = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)))
        return let(firsts, lambda f: F.zip_with(
            f, F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(F.size(s))),
            lambda a, b: F.struct(F.get(s, a).alias("item"), (b - a).cast("long").alias("n"))))

    return let(F.sort_array(items), lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<item:string,n:bigint>>")).otherwise(counts(s)))


def most_frequent(counts: Column, n: int) -> Column:
    """The ``n`` most frequent elements of ``counted``, ties by element, as (item, n)."""
    ordered = F.sort_array(F.transform(counts, lambda c: F.struct((-c.n).alias("less"), c.item.alias("item"))))
    return F.transform(F.slice(ordered, 1, n), lambda c: F.struct(c.item.alias("item"), (-c.less).alias("n")))


def adjacent_pairs(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space."""
    def pairs(ts: Column) -> Column:
        shorter = F.greatest(F.size(ts) - 1, F.lit(0))
        return F.zip_with(F.slice(ts, F.lit(1), shorter), F.slice(ts, F.lit(2), shorter), lambda a, b: F.concat(a, F.lit(" "), b))

    return let(tokens, pairs)
