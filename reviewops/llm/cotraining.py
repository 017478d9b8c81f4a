"""Quality classifier by co-training of two views.

One view is the text: its words and their shapes. The other is what is known of the page
without reading it: source, language, length. Each has a classifier of its own, first taught by the
labelled documents. In every round both classifiers judge all other documents, and either hands those it is
surest of, with its verdict, to the other one; both are taught again. At the end both are
calibrated on labelled documents that neither was taught, and their log-odds are added.

Only the labelled documents are a bounded sample. All others are judged in each round, in one pass over
their texts: each task adds up the features of the documents of every grade of sureness and counts
them. The counts are the histogram that says which grades are handed over; the sums, one mean a grade, are
what the other view is taught by. So a round sends a few megabytes a task, whatever the
texts, and sources or words that no labelled document has are learnt from wherever they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reviewops.llm import scan, store

WIDTH = 1 << 15
#: Grades of sureness that each class is parted into, and slots that are added up together.
GRADES = 12
_CHUNK = 1 << 12

_SHAPE = np.full(256, ord("a"), dtype=np.uint8)  # letters, those beyond ASCII included
_SHAPE[:128] = np.arange(128)
_SHAPE[ord("a"):ord("z") + 1] = ord("a")
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")


@dataclass(frozen=True)
class View:
    """A linear classifier: weights, and the slope and shift of its calibration."""

    weights: np.ndarray
    slope: float
    shift: float

    def log_odds(self, sums: np.ndarray) -> np.ndarray:
        return self.slope * sums + self.shift


@dataclass(frozen=True)
class Model:
    text: View
    page: View
    prior: float  # log-odds of a good document

    def combined(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Log-odds of both views, the prior that both hold counted once."""
        return text + page - self.prior


def _text_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each piece: text, slot and value of every feature, and the number of texts. Values of a text have length 1."""
    for part in scan.pieces(pa.record_batch({"t": column}), "t"):
        data, ends = scan.texts(part.column(0), lower=True)
        words = scan.Words(data, ends)
        raw, _ = scan.texts(part.column(0))
        shapes = scan.Words(_SHAPE[raw], ends)
        half = np.uint64(WIDTH // 2)
        slots = np.concatenate([words.hashes() % half, shapes.hashes(1) % half + half]).astype(np.int64)
        keys, counts = np.unique(np.concatenate([words.text, shapes.text]) * WIDTH + slots, return_counts=True)
        rows, values = keys // WIDTH, np.log1p(counts)
        length = np.sqrt(np.bincount(rows, values ** 2, minlength=part.num_rows))
        yield rows, keys % WIDTH, values / length[rows], part.num_rows


def _page_features(source: list, lang: list, length: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and value of the features of a page: source, language, and length to the half power of two."""
    names = []
    for s, l, n in zip(source, lang, length):
        names += [f"s{s!r}", f"l{l!r}", f"n{None if n is None or n < 0 else int(2 * np.log2(n + 1))}"]
    words = scan.Words(*scan.texts(pa.array([x.replace(" ", "_").replace("\n", "_").replace("\t", "_") or "_" for x in names])))
    hashes = np.zeros(len(names), dtype=np.uint64)
    np.add.at(hashes, words.text, words.hashes())
    rows = np.repeat(np.arange(len(source)), 3)
    return rows, (hashes % np.uint64(WIDTH)).astype(np.int64), np.full(len(rows), 3 ** -0.5)


def _sum(weights: np.ndarray, rows: np.ndarray, slots: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights[slots] * values, minlength=n)


class _Sample:
    """One view of the sampled documents, as rows of a sparse matrix."""

    def __init__(self, slots: list[np.ndarray], values: list[np.ndarray]):
        self.lengths = np.array([len(s) for s in slots], dtype=np.int64)
        self.slots, self.values = (np.concatenate(x) if x else np.empty(0) for x in (slots, values))
        self.rows = np.repeat(np.arange(len(slots)), self.lengths)
        self.slots = self.slots.astype(np.int64)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return _sum(weights, self.rows, self.slots, self.values, len(self.lengths))

    def taught(self, labels: np.ndarray, weight: np.ndarray, steps: int = 100, penalty: float = 1e-3) -> np.ndarray:
        """Weights of a logistic regression; rows of weight 0 take no part, classes weigh the same. Adaptive gradient steps."""
        weights, squares = np.zeros(WIDTH), np.full(WIDTH, 1e-8)
        weight = weight.copy()
        for c in (0, 1):
            total = weight[labels == c].sum()
            if total:
                weight[labels == c] /= 2 * total
        used = weight[self.rows] > 0
        rows, slots, values = self.rows[used], self.slots[used], self.values[used]
        for _ in range(steps):
            sums = _sum(weights, rows, slots, values, len(labels))
            error = (1 / (1 + np.exp(-np.clip(sums, -30, 30))) - labels) * weight
            slope = np.bincount(slots, values * error[rows], minlength=WIDTH) + penalty * weights / max(1, len(labels))
            squares += slope ** 2
            weights -= 0.5 * slope / np.sqrt(squares)
        return weights


def _calibrated(sums: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the sums log-odds, by Newton steps; a view that tells nothing gets the prior alone."""
    good = labels.sum()
    prior = float(np.log((good + 1) / (len(labels) - good + 1)))
    if good == 0 or good == len(labels):
        return 0.0, prior
    centre, spread = sums.mean(), sums.std() or 1.0
    x = np.stack([(sums - centre) / spread, np.ones(len(sums))], 1)
    w = np.array([0.0, prior])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = p * (1 - p)
        a, b, c = 0.1 + (v * x[:, 0] ** 2).sum(), (v * x[:, 0]).sum(), 0.1 + v.sum()
        g, h = ((p - labels) * x[:, 0]).sum() + 0.1 * w[0], (p - labels).sum()
        step = np.array([c * g - b * h, a * h - b * g]) / (a * c - b * b)
        w -= np.clip(step, -2, 2)
    slope = max(0.0, w[0])
    return slope / spread, float(w[1] - slope * centre / spread)


def _sampled(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text_slots, text_values = [], []
        for rows, slots, values, n in _text_features(batch.column("text")):
            cuts = np.searchsorted(rows, np.arange(1, n))
            text_slots += [x.astype("<i4").tobytes() for x in np.split(slots, cuts)]
            text_values += [x.astype("<f4").tobytes() for x in np.split(values, cuts)]
        _, slots, _ = _page_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "length")))
        yield pa.record_batch([batch.column("key"), batch.column("good"), pa.array(text_slots, pa.binary()), pa.array(text_values, pa.binary()),
                               pa.array([x.astype("<i4").tobytes() for x in slots.reshape(-1, 3)], pa.binary())],
                              names=["key", "good", "slots", "values", "page"])


def _grades(sums: np.ndarray, calibration: tuple[float, float], sure: float) -> np.ndarray:
    """1 to GRADES for good documents from just sure enough to surest, below 0 for bad ones, 0 for neither."""
    odds = calibration[0] * sums + calibration[1]
    least = np.log(sure / (1 - sure))
    grade = np.minimum(GRADES, 1 + np.floor((np.abs(odds) - least) / 0.5)).astype(np.int64)
    return np.where(np.abs(odds) >= least, np.sign(odds).astype(np.int64) * grade, 0)


def _judged(weights: list[np.ndarray], calibrations: list[tuple[float, float]], taught: frozenset, sure: float):
    """Documents to what either view would hand over: for each grade the documents and the sums of the other view's features, in chunks of slots."""
    def run(batches):
        kinds = 2 * GRADES + 1
        sums, counts = np.zeros((2, kinds * WIDTH)), np.zeros((2, kinds), dtype=np.int64)
        for batch in batches:
            page_rows, page_slots, page_values = _page_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "length")))
            by_page = _grades(_sum(weights[1], page_rows, page_slots, page_values, batch.num_rows), calibrations[1], sure)
            free = np.array([k not in taught for k in batch.column("key").to_pylist()], dtype=bool)
            by_text, at = [], 0
            for rows, slots, values, n in _text_features(batch.column("text")):
                by_text.append(_grades(_sum(weights[0], rows, slots, values, n), calibrations[0], sure))
                used = ((by_page[at:at + n] != 0) & free[at:at + n])[rows]
                sums[0] += np.bincount((by_page[at:at + n][rows[used]] + GRADES) * WIDTH + slots[used], values[used], minlength=kinds * WIDTH)
                at += n
            by_text = np.concatenate(by_text) if by_text else np.empty(0, dtype=np.int64)
            used = ((by_text != 0) & free)[page_rows]
            sums[1] += np.bincount((by_text[page_rows[used]] + GRADES) * WIDTH + page_slots[used], page_values[used], minlength=kinds * WIDTH)
            for view, grades in enumerate((by_page, by_text)):
                counts[view] += np.bincount(grades[free] + GRADES, minlength=kinds)
        task = TaskContext.get().partitionId()
        out = [(view, grade - GRADES, chunk, task, int(counts[view, grade]), part.tobytes())
               for view in (0, 1) for grade in range(kinds) if counts[view, grade]
               for chunk, part in enumerate(sums[view].reshape(kinds, -1, _CHUNK)[grade]) if chunk == 0 or part.any()]
        columns = zip(*out) if out else [[]] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                              names=["view", "grade", "chunk", "task", "n", "sums"])
    return run


def _added(batches) -> Iterator[pa.RecordBatch]:
    """Rows in order of (view, grade, chunk, task) to one row for each chunk."""
    where, n, total = None, 0, np.zeros(_CHUNK)

    def row():
        return pa.record_batch([pa.array([where[i]], pa.int32()) for i in range(3)] + [pa.array([n]), pa.array([total.tobytes()], pa.binary())],
                               names=["view", "grade", "chunk", "n", "sums"])

    for batch in batches:
        for view, grade, chunk, _, count, part in zip(*(c.to_pylist() for c in batch.columns)):
            if (view, grade, chunk) != where:
                if where is not None:
                    yield row()
                where, n, total = (view, grade, chunk), 0, np.zeros(_CHUNK)
            n, total = n + count, total + np.frombuffer(part)
    if where is not None:
        yield row()


def _gifts(docs: DataFrame, weights: list[np.ndarray], calibrations: list[tuple[float, float]], taught: frozenset, sure: float,
           share: float) -> list[list[tuple[float, int, np.ndarray]]]:
    """For each view (class, documents, mean features) of the grades that the other view hands to it: the surest, until ``share`` of all documents are."""
    parts = docs.mapInArrow(_judged(weights, calibrations, taught, sure), "view int, grade int, chunk int, task int, n bigint, sums binary")
    added = parts.repartition("view", "grade", "chunk").sortWithinPartitions("view", "grade", "chunk", "task").mapInArrow(
        _added, "view int, grade int, chunk int, n bigint, sums binary")
    counts, sums = np.zeros((2, 2 * GRADES + 1), dtype=np.int64), np.zeros((2, 2 * GRADES + 1, WIDTH))
    for r in added.collect():  # at most two views, 25 grades and 8 chunks of 32 kB
        counts[r.view, r.grade + GRADES] = max(r.n, counts[r.view, r.grade + GRADES])
        sums[r.view, r.grade + GRADES, r.chunk * _CHUNK:(r.chunk + 1) * _CHUNK] = np.frombuffer(r.sums)
    out = []
    for view in (0, 1):
        given = []
        for good, grades in ((1.0, range(2 * GRADES, GRADES, -1)), (0.0, range(0, GRADES))):
            had = 0
            for g in grades:
                if had < max(1, share * counts[view].sum()) and counts[view, g]:
                    given.append((good, int(counts[view, g]), sums[view, g] / counts[view, g]))
                    had += counts[view, g]
        out.append(given)
    return out


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, rounds: int = 5, share: float = 0.05, sure: float = 0.9) -> Model | None:
    """Co-train on all documents, with the labels of about ``most_labelled`` of them, picked by a hash of their key.

    docs: (key, text, source, lang, length); labels: (key, good), good 0 or 1; keys are whole numbers. Several labels of
    a document are averaged; null labels and keys teach nothing. A quarter of the labelled
    documents is kept for calibration. Each round a view hands over, in each class, its surest grades until they hold
    ``share`` of the documents, only those it is at least ``sure`` of; documents of the labelled sample are never
    handed over. Together they weigh half as much as the labels. None if there isn't a labelled document of either kind.
    """
    def below(name, limit, total):
        return F.pmod(F.xxhash64(name, F.lit(99)), F.lit(1 << 30)) * F.lit(float(total)) < F.lit(float(limit) * (1 << 30))

    given = store.kept(labels.where("key is not null and good is not null").groupBy("key").agg((F.avg("good") >= 0.5).cast("double").alias("good")), "labels")
    n, both = given.agg(F.count(F.lit(1)), F.count_distinct("good")).first()
    if both < 2:
        return None
    taught = store.kept(given.where(below("key", most_labelled, n)), "labels-sample")
    known = docs.join(taught, "key").select("key", "good", "text", "source", "lang", "length")
    rows = known.mapInArrow(_sampled, "key bigint, good double, slots binary, values binary, page binary").toPandas()  # the bounded sample
    rows = rows.sort_values(["key", "slots", "page"], ignore_index=True)
    good = rows["good"].to_numpy(np.float64)
    if len(np.unique(good)) < 2:
        return None
    slots = ([np.frombuffer(x, "<i4") for x in rows["slots"]], [np.frombuffer(x, "<i4") for x in rows["page"]])
    values = ([np.frombuffer(x, "<f4") for x in rows["values"]], [np.full(3, 3 ** -0.5)] * len(rows))
    held = rows["key"].to_numpy() % 4 == 3
    if len(np.unique(good[held])) < 2 or len(np.unique(good[~held])) < 2:
        held = np.zeros(len(rows), dtype=bool)  # too few to keep any back
    views = [_Sample(s, v) for s, v in zip(slots, values)]

    def fitted(gifts: list[list[tuple[float, int, np.ndarray]]]) -> tuple[list[np.ndarray], list[tuple[float, float]]]:
        weights, calibrations = [], []
        for view in (0, 1):
            means = [m for *_, m in gifts[view]]
            used = [np.flatnonzero(m) for m in means]
            sample = _Sample([*slots[view], *used], [*values[view], *(m[u] for m, u in zip(means, used))])
            truth = np.concatenate([good, [c for c, *_ in gifts[view]]])
            weight = np.concatenate([(~held).astype(float), np.zeros(len(means))])
            for c in (0.0, 1.0):
                sizes = np.array([k if g == c else 0 for g, k, _ in gifts[view]], dtype=float)
                if sizes.sum():
                    weight[len(good):] += 0.5 * (good[~held] == c).sum() * sizes / sizes.sum()
            weights.append(sample.taught(truth, weight))
            judges = held if held.any() else np.ones(len(good), dtype=bool)
            calibrations.append(_calibrated(views[view].sums(weights[-1])[judges], good[judges]))
        return weights, calibrations

    weights, calibrations = fitted([[], []])
    everyone, known_keys = docs.select("key", "text", "source", "lang", "length"), frozenset(rows["key"].tolist())
    for _ in range(rounds):
        gifts = _gifts(everyone, weights, calibrations, known_keys, sure, share)
        if not any(gifts):
            break
        weights, calibrations = fitted(gifts)
    made = [View(w.astype(np.float32), *c) for w, c in zip(weights, calibrations)]
    return Model(*made, float(np.log((good.sum() + 1) / (len(good) - good.sum() + 1))))


def scored(docs: DataFrame, model: Model | None, into: str = "quality") -> DataFrame:
    """The documents with a struct ``into``: text, page and score, the chance of a good document by each view and by both.

    docs has columns text, source, lang and length; each may be null. A column already called ``into`` is replaced. Empty texts are judged by the
    text view's prior. Without a model all chances are 0.5.
    """
    @F.arrow_udf("text double, page double, score double")
    def judge(text: pa.Array, source: pa.Array, lang: pa.Array, length: pa.Array) -> pa.Array:
        n = len(text)
        odds = np.zeros((3, n))
        if model is not None:
            parts = [_sum(model.text.weights, r, s, v, m) for r, s, v, m in _text_features(text)]
            odds[0] = model.text.log_odds(np.concatenate(parts)) if parts else 0
            odds[1] = model.page.log_odds(_sum(model.page.weights, *_page_features(source.to_pylist(), lang.to_pylist(), length.to_pylist()), n))
            odds[2] = model.combined(odds[0], odds[1])
        chances = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        return pa.StructArray.from_arrays([pa.array(c) for c in chances], names=["text", "page", "score"])

    return docs.withColumn(into, judge("text", "source", "lang", "length"))
