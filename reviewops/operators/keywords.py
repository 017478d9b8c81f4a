"""Dictionaries that are tables: thousands or millions of keywords looked for in all texts.

A short, fixed dictionary is searched row by row (``text.mentions_any``). A table of keywords has no
bound, so it is joined instead: not every text with every keyword, but by a run of characters
that both contain. Of each keyword the run that the fewest texts have is its index entry; a text that
lacks it can't hold the keyword, and the texts that have it are searched for the keyword itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewops.session import kept

#: Characters of a run; a shorter keyword is a run itself.
GRAM = 6
#: Characters of a text that are cut into runs at once: bounds the array, however long the text.
SLICE = 1 << 16
#: Places of a table of bits that tells most runs no keyword has: 2 MB, sent to every task. Must be a power of two.
BITS = 1 << 24


def _runs(column: Column, size: int) -> Column:
    """All runs of ``size`` characters."""
    return F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _placing():
    """The function of (text, size): a place among ``BITS`` for each run of ``size`` characters of the text, in order.

    Made here, it travels to tasks by value, and they need not have this package.
    """
    bits = BITS.bit_length() - 1

    def places(text: str, size: int) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        out = np.zeros(max(0, len(codes) - size + 1), dtype=np.uint64)
        for i in range(size):
            out = (out + codes[i:i + len(out)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return ((out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)

    return places


def _marks(runs: DataFrame) -> np.ndarray:
    """A bit for each place of rows (place): ``BITS`` bits, however many there are."""
    masks = runs.groupBy(F.shiftright("place", 3).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("place") % 8).cast("int"))).alias("mask"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in masks.toLocalIterator():
        out[row["at"]] = row["mask"]
    return out


def _placed(rows: DataFrame) -> DataFrame:
    """Add ``place``, that of ``run``."""
    places = _placing()

    def placed(run: pa.Array) -> pa.Array:
        runs = run.to_pylist()
        lengths, out = np.array([len(r) for r in runs], dtype=np.int64), np.empty(len(runs), dtype=np.int64)
        for size in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == size)
            out[at] = places("".join([runs[i] for i in at.tolist()]), size)[::size]
        return pa.array(out)

    return rows.withColumn("place", F.arrow_udf(placed, "bigint")("run"))


def _marked_runs(entries: DataFrame, sizes: Sequence[int]):
    """The function of a text: (size, slice, places of its runs, those that are marked) for each slice and size."""
    marks, places, longest = entries.sparkSession.sparkContext.broadcast(_marks(entries)), _placing(), max(sizes)
    step = SLICE

    def found(text: str):
        for begin in range(0, len(text), step):
            part = text[begin:begin + step + longest - 1]
            for size in sizes:
                place = places(part, size)
                yield size, part, place, np.flatnonzero(marks.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)

    return found


def _spread(rows: DataFrame, entries: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Rows (place, n): in how many slices of texts a run of that place occurs, for the places of ``entries``. Runs that share a place are counted as one."""
    found = _marked_runs(entries, sizes)

    def counted(batches):
        known, counts, waiting, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            places = np.concatenate([known, *waiting])
            weights = np.concatenate([counts, np.ones(len(places) - len(known), np.int64)])
            new, at = np.unique(places, return_inverse=True)
            total = np.zeros(len(new), np.int64)
            np.add.at(total, at, weights)
            return new, total

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, _, place, at in found(text):
                    waiting.append(np.unique(place[at]))
                    held += len(waiting[-1])
                if held > 2_000_000:
                    known, counts = merged()
                    waiting, held = [], 0
        known, counts = merged()
        for i in range(0, len(known), 65_536):
            yield pa.record_batch([pa.array(known[i:i + 65_536]), pa.array(counts[i:i + 65_536])], names=["place", "n"])

    texts = rows.where(F.char_length("_text") > 0).select("_text")
    return texts.mapInArrow(counted, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))


def _text_runs(rows: DataFrame, index: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Rows (_key, run) of rows (_key, _text): the runs whose place the index has, each once for each slice of the text."""
    found = _marked_runs(index, sizes)

    def runs(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            here = []
            for size, part, _, at in found(t):
                here.extend({part[i:i + size] for i in at.tolist()})
            out.append(here)
        return pa.array(out, pa.list_(pa.string()))

    texts = rows.where(F.char_length("_text") > 0)
    return texts.select("_key", F.explode(F.arrow_udf(runs, "array<string>")("_text")).alias("run"))


def keyword_matches(df: DataFrame, keywords: DataFrame, key: str = "review_id", text: str = "review_text", keyword: str = "keyword",
                    word_boundary: bool = False, gram: int = GRAM) -> DataFrame:
    """Rows (key, keyword and all other columns of ``keywords``) for every text that holds the keyword, ignoring case.

    Keywords match inside other words too, unless ``word_boundary`` is set. Null and
    empty keywords match nothing. ``key`` names a text; rows of equal key are searched each.
    A run that many texts have isn't chosen unless the keyword has no rarer one. Texts are read twice for that: runs are counted by place,
    then only the chosen ones become rows. Places may be shared, which can cost work but no match: runs and keywords are compared whole.
    Tables of runs and keywords are stored, so that Spark sends the small ones to all tasks by their size and splits hot runs otherwise.
    """
    named = keywords.withColumn("_word", F.lower(F.col(f"`{keyword}`"))).where(F.char_length("_word") > 0)
    words = kept(named.select("_word").distinct().withColumn("_size", F.least(F.char_length("_word"), F.lit(gram))), "keywords")
    sizes = sorted(r[0] for r in words.select("_size").distinct().collect())  # at most ``gram`` of them
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.lower(F.col(f"`{text}`")).alias("_text"))
    if not sizes:
        return df.select(key).join(named.drop("_word"), F.lit(False))

    parts = F.coalesce(*(F.when(F.col("_size") == n, _runs(F.col("_word"), n)) for n in sizes))
    entries = kept(_placed(words.select("_word", F.explode(F.array_distinct(parts)).alias("run"))), "keyword-runs")
    spread = kept(_spread(rows, entries, sizes), "run-counts")
    counted = entries.join(spread, "place", "left").select("_word", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run", "place").alias("_entry"))
    rarest = counted.groupBy("_word").agg(F.min("_entry").alias("_rarest")).where("_rarest.n > 0")
    index = kept(rarest.select("_word", "_rarest.run", "_rarest.place"), "keyword-index")

    asked = _text_runs(rows, index, sizes).join(index, "run").groupBy("_key").agg(F.collect_set("_word").alias("_words"))

    def holds(word: Column) -> Column:
        if word_boundary:
            return F.regexp_like("_text", F.concat(F.lit(r"\b\Q"), word, F.lit(r"\E\b")))
        return F.col("_text").contains(word)

    held = rows.join(asked, "_key").select("_key", F.explode(F.filter("_words", holds)).alias("_word"))
    return held.withColumnRenamed("_key", key).join(named, "_word").drop("_word")


def dictionary_topics(df: DataFrame, keywords: DataFrame, key: str = "review_id", text: str = "review_text", topic: str = "topic",
                      word_boundary: bool = False) -> DataFrame:
    """Rows (key, topics): the topics, sorted, that any of their keywords names; texts without any have an empty array."""
    found = keyword_matches(df.select(key, text), keywords, key, text, word_boundary=word_boundary)
    named = found.groupBy(key).agg(F.array_sort(F.collect_set(topic)).alias("topics"))
    return df.select(key).join(named, key, "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def keyword_table(dictionary, spark) -> DataFrame:
    """A dictionary {topic: keywords} as a table (topic, keyword)."""
    return spark.createDataFrame([(t, k) for t, ks in dictionary.items() for k in ks], "topic string, keyword string")
