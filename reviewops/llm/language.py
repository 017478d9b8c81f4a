"""Language identification by prediction by partial matching.

For every language a tree of byte contexts of variable order (none to three bytes) is
counted on a bounded sample of labelled texts and then frozen. A text's code length under a
language is the sum, over its bytes, of the bits that the longest known context needs; a byte
that a context has never seen costs the context's escape (method C) and is then coded by the
next shorter one, at last by 8 bits. The language with the shortest code wins.

As statistics are frozen, the cost of each byte seen after a context and of each context's escape
can be worked out beforehand. They are kept in sorted tables, for each language by itself: no
language takes room from another. Each run of four bytes is looked up once in a piece of text.

What was counted stays a table in the shared folder. Tasks are sent the languages in groups of
bounded size; with more than one group, each scores the texts for itself and the groups' best meet by text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewops.llm import scan, store

ORDER = 3
_LETTER = re.compile(r"[^\W\d_]")
_PAD = 0x20


@dataclass(frozen=True)
class Model:
    """A group of languages, and how often each byte (the lowest of ``grams``) followed three others in each of them.

    ``piece`` is how many bytes of text are scored at once.
    """

    name: str
    languages: tuple[str, ...]
    grams: np.ndarray
    language: np.ndarray
    counts: np.ndarray
    piece: int


def _padded(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ORDER spaces before each text, and where each byte has come to lie."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.arange(len(data)) + ORDER * (text + 1)
    out = np.full(len(data) + ORDER * (len(ends) - 1), _PAD, dtype=np.uint8)
    out[at] = data
    return out, at


def _grams(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it, itself the lowest."""
    wide = padded.astype(np.uint32)
    grams = wide[at]
    for back in range(1, ORDER + 1):
        grams |= wide[at - back] << np.uint32(8 * back)
    return grams


def _count(batches):
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            texts = batch.column(1).filter(pa.array([x == lang for x in langs]))
            total: dict[int, int] = {}
            for piece in scan.pieces(pa.record_batch({"t": texts}), "t"):
                grams = _grams(*_padded(*scan.texts(piece.column(0), lower=True)))
                for gram, n in zip(*(x.tolist() for x in np.unique(grams, return_counts=True))):
                    total[gram] = total.get(gram, 0) + n
            yield pa.record_batch([pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.int64()),
                                   pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])


@dataclass(frozen=True)
class Learned:
    """All languages, and their counts as a table (language, gram, n)."""

    languages: tuple[str, ...]
    grams: DataFrame
    piece: int

    def group(self, first: int, last: int) -> Model:
        """The model of languages ``first`` to ``last - 1``: what the driver holds and tasks are sent at a time."""
        found = self.grams.where(F.col("language").between(first, last - 1)).toArrow()
        language, gram, n = (found.column(i).to_numpy() for i in range(3))
        return Model(store.new_path(self.grams.sparkSession, "language-model"), self.languages[first:last], gram.astype(np.uint32),
                     (language - first).astype(np.int32), n.astype(np.float64), self.piece)


def learned(labelled: DataFrame, key: str, text: str = "text", lang: str = "lang", rows_per_language: int = 400, grams_per_language: int = 200_000,
            piece: int = 1 << 19) -> Learned:
    """Count contexts on about ``rows_per_language`` whole texts of each language, picked by a hash of ``key``.

    Rows without text or language teach nothing; every other language is learned, those whose
    sampled texts are all empty excepted. The bounds hold for each language by itself: its sampled texts,
    and about its ``grams_per_language`` most frequent runs of four bytes (of those as frequent as the last, a part picked by hash).
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    sizes = store.kept(known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "language-sizes")
    sample = known.join(sizes, "lang").where(F.col("u") * F.col("rows") < rows_per_language).select("lang", "text")
    grams = store.kept(sample.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    # the last count that a language has room for, and the share of its runs; a language has no more rows here than it has different counts
    levels = grams.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("grams"))
    before = F.coalesce(F.sum("grams").over(Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limit = (levels.withColumn("before", before).where((F.col("before") <= grams_per_language) & (F.col("before") + F.col("grams") > grams_per_language))
             .select("lang", F.col("n").alias("least"), ((F.lit(grams_per_language) - F.col("before")) / F.col("grams")).alias("share")))
    u = F.pmod(F.xxhash64("gram"), F.lit(1 << 30)) / float(1 << 30)
    bounded = grams.join(limit, "lang", "left").where(
        F.col("least").isNull() | (F.col("n") > F.col("least")) | (F.col("n") == F.col("least")) & (u < F.col("share")))
    languages = sorted(r.lang for r in bounded.select("lang").distinct().collect())  # one name a language
    spark = labelled.sparkSession
    numbered = spark.createDataFrame(list(enumerate(languages)), "language int, lang string")
    return Learned(tuple(languages), store.kept(bounded.join(numbered, "lang").select("language", "gram", "n"), "language-grams"), piece)


def learn(labelled: DataFrame, key: str, **bounds) -> Model:
    """One model of all languages, as ``learned`` counts them: for as few languages as one group may have."""
    found = learned(labelled, key, **bounds)
    return found.group(0, len(found.languages))


class _Table:
    """Bits of what was seen in one order of one language: of each byte after its context, and of the context's escape."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, inverse = np.unique(pairs, return_inverse=True)
        counts = np.bincount(inverse, counts)
        self.contexts, inverse = np.unique(self.pairs >> np.uint32(8), return_inverse=True)
        kinds = np.bincount(inverse)
        total = np.bincount(inverse, counts) + kinds
        self.seen = np.log2(total[inverse] / counts).astype(np.float32)
        self.escape = np.log2(total / kinds).astype(np.float32)

    def longer(self, pairs: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Bits of the last bytes of ``pairs``, where the next shorter contexts need ``bits``."""
        contexts = pairs >> np.uint32(8)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        bits = bits + np.where(self.contexts[at] == contexts, self.escape[at], np.float32(0))
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.seen[at], bits)


class Costs:
    """The tables of all orders, for each language by itself."""

    def __init__(self, model: Model):
        order = np.argsort(model.language, kind="stable")
        ends = np.searchsorted(model.language[order], np.arange(len(model.languages) + 1))
        self.tables = []
        for a, b in zip(ends[:-1], ends[1:]):
            grams, counts = model.grams[order[a:b]].astype(np.uint32), model.counts[order[a:b]]
            self.tables.append([_Table(grams & np.uint32((1 << (8 * k + 8)) - 1), counts) for k in range(ORDER + 1)])

    def lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length in bits of each text (rows) under each language (columns)."""
        out = np.zeros((len(ends) - 1, len(self.tables)))
        if len(data):
            grams, inverse = np.unique(_grams(*_padded(data, ends)), return_inverse=True)
            pairs = [np.unique(grams & np.uint32((1 << (8 * k + 8)) - 1), return_inverse=True) for k in range(ORDER + 1)]
            filled = np.flatnonzero(np.diff(ends))
            for i, tables in enumerate(self.tables):
                cost = np.full(len(grams), 8, dtype=np.float32)
                for (found, place), table in zip(pairs, tables):
                    bits = np.full(len(found), 8, dtype=np.float32)
                    bits[place] = cost
                    cost = table.longer(found, bits)[place]
                out[filled, i] = np.add.reduceat(cost[inverse], ends[:-1][filled], dtype=np.float64)
        return out


_built: dict[str, Costs] = {}


def _costs(model: Model) -> Costs:
    """The table of the last model used in this worker."""
    if model.name not in _built:
        _built.clear()
        _built[model.name] = Costs(model)
    return _built[model.name]


def _score(column: pa.Array, model: Model):
    """For every run of texts: the texts, the best language of each, its code length, and the sum of 2 ** -(bits more) over the languages."""
    costs = _costs(model)
    for piece in scan.pieces(pa.record_batch({"t": column}), "t", model.piece):
        lengths = costs.lengths(*scan.texts(piece.column(0), lower=True))
        least = lengths.min(axis=1)
        yield scan.strings(piece.column(0)), lengths.argmin(axis=1), least, np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)


def _lettered(text: str) -> bool:
    return _LETTER.search(text) is not None


def _predict(column: pa.Array, model: Model) -> pa.Array:
    langs, scores = [], []
    for values, best, _, total in _score(column, model):
        # the share of the best language when all are as likely beforehand
        for value, i, s in zip(values, best.tolist(), (1 / total).tolist()):
            lettered = _lettered(value)
            langs.append(model.languages[i] if lettered else "und")
            scores.append(s if lettered else 0.0)
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])


_NONE = "named_struct('lang', 'und', 'score', 0.0D)"


def predicted(text: Column, model: Model) -> Column:
    """Struct (lang, score) for a text: one of the learned languages and its share among them, 0 to 1.

    Null, empty and letterless texts, and all texts if nothing was learned, get ``und`` and 0.
    Equal lengths go to the first language by name.
    """
    if not model.languages:
        return F.expr(_NONE)

    @F.arrow_udf("lang string, score double")
    def predict(column: pa.Array) -> pa.Array:
        return _predict(column, model)

    return predict(text)


#: Languages that tasks are sent at a time: 50 MB of counts at most, some 100 MB of tables.
GROUP = 16


def identified(docs: DataFrame, found: Learned, text: str = "text", into: str = "language", group: int = GROUP) -> DataFrame:
    """The documents, all their columns, with a struct ``into`` as ``predicted`` gives it; a column of that name is replaced.

    Beyond ``group`` languages the texts are read once for each group. What a group finds of a text is a row of a
    few numbers under its digest, equal texts as one; only these rows and the documents meet.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c != into]
    whole = F.col(f"`{text}`")
    if len(found.languages) <= group:
        return docs.select(*names, predicted(whole, found.group(0, len(found.languages))).alias(into))
    texts = docs.where(whole.isNotNull()).select(F.md5(whole.cast("binary")).alias("mark"), whole.alias("text"))
    parts = [store.kept(texts.select("mark", _group_score(F.col("text"), found.group(i, min(i + group, len(found.languages)))).alias("s"))
                        .where("s.lang IS NOT NULL").groupBy("mark").agg(F.min("s").alias("s")), "language-scores")
             for i in range(0, len(found.languages), group)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    # as many rows for a text as there are groups
    best = every.groupBy("mark").agg(F.min("s").alias("b"), F.collect_list("s").alias("every"))
    total = F.aggregate("every", F.lit(0.0), lambda a, s: a + s["total"] * F.pow(F.lit(2.0), F.greatest(F.col("b.bits") - s["bits"], F.lit(-1000.0))))
    best = best.select("mark", F.struct(F.col("b.lang").alias("lang"), (1 / total).alias("score")).alias("_best"))
    own = docs.select(F.md5(whole.cast("binary")).alias("mark"), F.struct(*names).alias("_doc"))
    return own.join(best, "mark", "left").select("_doc.*", F.coalesce("_best", F.expr(_NONE)).alias(into))


def _group_score(text: Column, model: Model) -> Column:
    """Struct (bits, lang, total) of a text with a letter: the group's best language, and the sum of ``_score``."""
    @F.arrow_udf("bits double, lang string, total double")
    def judged(column: pa.Array) -> pa.Array:
        out = ([], [], [])
        for values, best, least, total in _score(column, model):
            for value, *row in zip(values, least.tolist(), best.tolist(), total.tolist()):
                row[1] = model.languages[row[1]] if _lettered(value) else None
                for list_, x in zip(out, row):
                    list_.append(x)
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.float64(), pa.string(), pa.float64()))], names=["bits", "lang", "total"])

    return judged(text)
