"""Removal of passages that an earlier document has.

A window is 50 words in a row. A word goes if a window that covers it also begins in a
document of a smaller number. Two passes over the texts find these windows:

1. Count-min prefilter. Every window is counted under its anchor, the smallest hash of the
   25-word runs inside it: equal windows have equal anchors, and neighbours mostly share theirs,
   so there are thirteen times fewer to count. Each partition counts its anchors in a sketch (none,
   one, more); the sketches are merged cell by cell. A merged count is never too small. The sketch
   grows with the texts. Up to ``SENT`` bits every task is sent all of it; a larger one stays
   where it was merged, in ranges of cells, and runs of texts ask the ranges for their own cells.
2. Windows whose anchor is estimated to occur twice or more are grouped exactly, by 128 bits
   of hash. Each unit of about a megabyte of text first reduces its windows to distinct ones
   with their smallest document, so a passage that a third of all documents share is one row a
   unit. Buckets of hashes work out the smallest document of all, and answer the units that
   have a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from reviewops.llm import scan, store

WINDOW = 50
_GRAM = 25
#: Cells of each of the sketch's two rows for each anchor expected, and their least number. A cell has one bit once merged.
CELLS = 8
LEAST_WIDTH = 1 << 20
#: Bits that every task may be sent (128 MB), cells of a range of a larger sketch (a byte each while they are merged),
#: and rows whose texts ask together.
SENT = 1 << 30
RANGE = 1 << 26
_ASKERS = 12
_WORD_BYTES = 6
_CHUNK = 1 << 16
_NO_KEY = np.iinfo(np.int64).max


class _Windows:
    """Windows of the texts of one piece: first words, anchors, and the texts they are in."""

    def __init__(self, column: pa.Array, size: int):
        self.words = scan.Words(*scan.texts(column))
        self.size = size
        gram = min(_GRAM, size)
        self.hashes = self.words.hashes()
        n = len(self.hashes) - size + 1
        self.at = np.empty(0, dtype=np.int64)
        self.anchors = np.empty(0, dtype=np.uint64)
        if n > 0:
            starts = np.arange(len(self.hashes) - gram + 1)
            grams = scan._spans(self.hashes, starts, starts + gram, scan._STEP_BASES[1])
            self.at = np.flatnonzero(self.words.text[:n] == self.words.text[size - 1:])
            self.anchors = _smallest(grams, size - gram + 1)[self.at]
        self.text = self.words.text[self.at]

    def occurrences(self) -> np.ndarray:
        """Anchors, one for a run of windows of a text that share it: an anchor counts again when another came in between."""
        fresh = np.ones(len(self.at), dtype=bool)
        fresh[1:] = (self.anchors[1:] != self.anchors[:-1]) | (self.text[1:] != self.text[:-1])
        return self.anchors[fresh]


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


def _cells(anchors: np.ndarray, width: int) -> list[np.ndarray]:
    """Cells of the anchors in both rows of the sketch; those of the second row lie behind the first's."""
    return [(scan.mix(anchors + np.uint64(row)) % np.uint64(width)).astype(np.int64) + row * width for row in range(2)]


class _Tally:
    """Cells with one and with more occurrences."""

    def __init__(self):
        self.once, self.more, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), []

    def add(self, cells: list[np.ndarray]) -> None:
        self.waiting.extend(cells)
        if sum(map(len, self.waiting)) > 4_000_000:
            self._merge()

    def _merge(self) -> None:
        new, counts = np.unique(np.concatenate([self.once, *self.waiting]), return_counts=True)
        self.waiting.clear()
        self.once, self.more = np.setdiff1d(new, self.more, assume_unique=True), np.union1d(self.more, new[counts > 1])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Both, ascending, with no cell in both."""
        self._merge()
        return np.setdiff1d(self.once, self.more, assume_unique=True), self.more


def _sketched(size: int, width: int):
    """Rows (chunk, cells): the sketch of a partition, cells with one and with more occurrences."""
    def run(batches):
        tally = _Tally()
        for batch in batches:
            for part in scan.pieces(batch, "text"):
                tally.add(_cells(_Windows(part.column("text"), size).occurrences(), width))
        for kind, cells in zip((1, 2), tally.result()):
            chunks, first = np.unique(cells // _CHUNK, return_index=True)
            parts = np.split((cells % _CHUNK).astype("<u2"), first[1:])
            yield pa.record_batch([pa.array(chunks, pa.int64()), pa.array([kind] * len(chunks), pa.int32()),
                                   pa.array([p.tobytes() for p in parts][:len(chunks)], pa.binary())], names=["chunk", "kind", "cells"])
    return run


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """Sketch parts in the order of their chunks to (chunk, bits): cells of two or more occurrences."""
    name, counts = None, np.zeros(_CHUNK, dtype=np.uint8)

    def out():
        return pa.record_batch([pa.array([name], pa.int64()), pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())], names=["chunk", "bits"])

    for batch in batches:
        for chunk, kind, cells in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if chunk != name:
                if name is not None:
                    yield out()
                name = chunk
                counts[:] = 0
            cells = np.frombuffer(cells, dtype="<u2")
            counts[cells] = np.minimum(counts[cells] + kind, 2)
    if name is not None:
        yield out()


class Sketch:
    """Cells of the merged sketch that have two or more occurrences; its size is fixed by ``width``."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.width = bits, width

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        """False only for anchors that occur once."""
        out = np.ones(len(anchors), dtype=bool)
        for cells in _cells(anchors, self.width):
            out &= (self.bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def width_for(text_bytes: int, size: int = WINDOW) -> int:
    """Cells of a row for texts of so many bytes: windows change their anchor about twice in ``size - 24`` words."""
    anchors = text_bytes / _WORD_BYTES * 2 / max(2, size - min(_GRAM, size) + 1)
    return max(LEAST_WIDTH, 1 << int(np.ceil(np.log2(max(2.0, CELLS * anchors)))))


def sketch(texts: DataFrame, size: int, width: int) -> Sketch:
    """Merge the partitions' sketches of a frame (key, text, ...). The driver gets 2 * width bits, whatever the corpus."""
    parts = texts.select("text").mapInArrow(_sketched(size, width), "chunk bigint, kind int, cells binary")
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merged, "chunk bigint, bits binary")
    bits = np.zeros(2 * width // 8 + _CHUNK // 8, dtype=np.uint8)
    for row in merged.toLocalIterator():
        part = np.frombuffer(row.bits, dtype=np.uint8)
        bits[row.chunk * (_CHUNK // 8):][:len(part)] = part
    return Sketch(bits, width)


class Answers:
    """The cells of some texts that have two or more occurrences, ascending: what a sketch too large to be sent says of them."""

    def __init__(self, cells: np.ndarray, width: int):
        self.cells, self.width = cells, width

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        """False only for anchors that occur once."""
        out = np.ones(len(anchors), dtype=bool)
        for cells in _cells(anchors, self.width):
            at = np.searchsorted(self.cells, cells)
            out &= np.append(self.cells, -1)[at] == cells
        return out


def _asks(size: int, width: int, span: int):
    """Texts, those of an asker one after the other, to its cells (range, asker, once, more), by place in their range."""
    def run(batches):
        asker, tally = None, _Tally()

        def out():
            columns = ([], [], [], [])
            once, more = tally.result()
            found = np.unique(np.concatenate([once // span, more // span]))
            cuts = [(np.searchsorted(c, found * span), np.searchsorted(c, (found + 1) * span)) for c in (once, more)]
            for i, r in enumerate(found.tolist()):
                parts = [(c[a[i]:b[i]] - r * span).astype("<u4").tobytes() for c, (a, b) in zip((once, more), cuts)]
                for column, value in zip(columns, (r, asker, *parts)):
                    column.append(value)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                   names=["range", "asker", "once", "more"])

        for batch in batches:
            askers = batch.column("asker").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], askers[1:] != askers[:-1], [True]))) if len(askers) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if asker is not None and asker != askers[a]:
                    yield out()
                    tally = _Tally()
                asker = int(askers[a])
                for part in scan.pieces(batch.slice(a, b - a), "text"):
                    tally.add(_cells(_Windows(part.column("text"), size).occurrences(), width))
        if asker is not None:
            yield out()
    return run


def _ranged(span: int):
    """Cells asked for, sorted by range, to (range, bits): a range's cells of two or more occurrences."""
    def run(batches):
        name, counts = None, np.zeros(span, dtype=np.uint8)

        def out():
            return pa.record_batch([pa.array([name], pa.int64()), pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())], names=["range", "bits"])

        for batch in batches:
            for range_, *cells in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if range_ != name:
                    if name is not None:
                        yield out()
                    name = range_
                    counts[:] = 0
                for kind, found in zip((1, 2), cells):
                    found = np.frombuffer(found, dtype="<u4")
                    counts[found] = np.minimum(counts[found] + kind, 2)
        if name is not None:
            yield out()
    return run


def _told(span: int):
    """Ranges' bits, each before what askers ask of it, to (asker, cells): their cells of two or more occurrences."""
    def run(batches):
        bits = np.empty(0, np.uint8)
        for batch in batches:
            askers, told = [], []
            for range_, asker, once, more, known in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if known is not None:
                    bits = np.frombuffer(known, dtype=np.uint8)
                    continue
                cells = np.concatenate([np.frombuffer(x, dtype="<u4") for x in (once, more)]).astype(np.int64)
                cells = cells[(bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)]
                if len(cells):
                    askers.append(asker)
                    told.append((cells + range_ * span).astype("<i8").tobytes())
            yield pa.record_batch([pa.array(askers, pa.int64()), pa.array(told, pa.binary())], names=["asker", "cells"])
    return run


def _candidates_asked(texts: DataFrame, size: int, width: int, buckets: int, span: int) -> DataFrame:
    """Units of candidate windows by a sketch of any width, which no task holds more than a range of.

    The texts are written, so that an asker is the same run of rows in both passes. They move once, to meet
    the answers; what is asked is about four bytes for each anchor and row of the sketch.
    """
    asker = F.call_function("shiftright", F.monotonically_increasing_id(), F.lit(_ASKERS))
    texts = store.kept(texts.withColumn("asker", asker), "repeat-texts")
    asks = store.kept(texts.select("asker", "text").mapInArrow(_asks(size, width, span), "range bigint, asker bigint, once binary, more binary"), "repeat-asks")
    ranges = store.kept(asks.repartition(F.col("range")).sortWithinPartitions("range").mapInArrow(_ranged(span), "range bigint, bits binary"), "repeat-ranges")
    none = F.lit(None).cast("binary")
    both = asks.withColumn("bits", none).unionByName(
        ranges.select("range", F.lit(None).cast("bigint").alias("asker"), none.alias("once"), none.alias("more"), "bits"))
    told = (both.repartition(F.col("range")).sortWithinPartitions("range", F.asc_nulls_first("asker"))
            .mapInArrow(_told(span), "asker bigint, cells binary"))
    # an asker's answers come before its texts
    met = texts.withColumn("cells", none).unionByName(told.select(
        F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("mark"), "asker", "cells"))
    met = met.withColumn("is_text", F.col("cells").isNull())
    met = met.repartition(F.col("asker")).sortWithinPartitions("asker", "is_text").select("key", "text", "mark", "asker", "cells")
    return store.kept(met.mapInArrow(_united_asked(size, width, buckets), _UNIT_ROWS), "repeat-units")


def _candidates(texts: DataFrame, size: int, width: int, buckets: int, sent: int = SENT, span: int = RANGE) -> DataFrame:
    """Units of windows (key, text, mark) whose anchors are estimated to occur twice or more."""
    if 2 * width > sent:
        return _candidates_asked(texts, size, width, buckets, min(span, 2 * width))
    shared = texts.sparkSession.sparkContext.broadcast(sketch(texts, size, width))  # 2 * width bits
    return store.kept(texts.mapInArrow(_united(size, buckets, shared), _UNIT_ROWS), "repeat-units")


def _united_asked(size: int, width: int, buckets: int):
    """Answers and texts of askers, answers first, to candidate windows as ``_united`` gives them."""
    def run(batches):
        partition, piece, asker, answers, known = TaskContext.get().partitionId(), 0, None, [], None
        for batch in batches:
            askers, told = batch.column("asker").to_numpy(), batch.column("cells")
            cuts = np.flatnonzero(np.concatenate(([True], askers[1:] != askers[:-1], [True]))) if len(askers) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if askers[a] != asker:
                    asker, answers, known = askers[a], [], None
                cells = told.slice(a, b - a)
                first = cells.null_count
                answers.extend(np.frombuffer(x, dtype="<i8") for x in cells.slice(0, b - a - first).to_pylist())
                if not first:
                    continue
                if known is None:
                    known = Answers(np.sort(np.concatenate([np.empty(0, np.int64), *answers])), width)
                for part in scan.pieces(batch.slice(b - first, first), "text"):
                    yield from _unit(part, (partition << 32) + piece, known, size, buckets)
                    piece += 1
    return run


def _united(size: int, buckets: int, shared):
    """Candidate windows of each unit: a row for each bucket of hashes, and one, of bucket -1, that names its texts.

    low, high: the distinct windows' hashes, ascending; least: the smallest document of each;
    text, at, key_of: the windows themselves, by text of the unit, first word, and place among the distinct ones.
    """
    def run(batches):
        partition, piece = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in scan.pieces(batch, "text"):
                yield from _unit(part, (partition << 32) + piece, shared.value, size, buckets)
                piece += 1
    return run


def _unit(part: pa.RecordBatch, unit: int, filter_: Sketch | Answers, size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_united`` for a unit, a batch with columns key, text and mark."""
    windows = _Windows(part.column("text"), size)
    chosen = np.flatnonzero(filter_.repeated(windows.anchors))
    if not len(chosen):
        return
    at, text = windows.at[chosen], windows.text[chosen]
    low = scan._spans(windows.hashes, at, at + size, scan._STEP_BASES[0])
    high = scan._spans(windows.words.hashes(1), at, at + size, scan._STEP_BASES[1])
    keys = part.column("key").fill_null(_NO_KEY).to_numpy(zero_copy_only=False)
    order = np.lexsort((keys[text], high, low))
    low, high, at, text = low[order], high[order], at[order], text[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    place = np.cumsum(new) - 1
    low, high, least = low[new], high[new], keys[text[new]]
    bucket = (low >> np.uint64(32)) % np.uint64(buckets)
    word = at - windows.words.first[text]
    # distinct windows by bucket, and the windows themselves by that of theirs
    by, inside = np.argsort(bucket, kind="stable"), np.argsort(bucket[place], kind="stable")
    found, begin, counts = np.unique(bucket[by], return_index=True, return_counts=True)
    number = np.empty(len(low), dtype=np.int64)
    number[by] = np.arange(len(low)) - np.repeat(begin, counts)
    cuts = np.searchsorted(bucket[place][inside], found)[1:]
    columns = ([x.tobytes() for x in np.split(values, at_)] for values, at_ in (
        (low[by].astype("<u8"), begin[1:]), (high[by].astype("<u8"), begin[1:]), (least[by].astype("<i8"), begin[1:]),
        (text[inside].astype("<i4"), cuts), (word[inside].astype("<i4"), cuts), (number[place[inside]].astype("<i4"), cuts)))
    found = found.tolist()
    n = len(found)
    yield pa.record_batch([
        pa.array([unit] * (n + 1), pa.int64()), pa.array([*found, -1], pa.int32()), *(pa.array([*c, None], pa.binary()) for c in columns),
        pa.array([None] * n + [part.column("key").to_pylist()], pa.list_(pa.int64())),
        pa.array([None] * n + [part.column("mark").to_pylist()], pa.list_(pa.string()))], names=_UNIT_NAMES)


_UNIT_NAMES = ["unit", "bucket", "low", "high", "least", "text", "at", "key_of", "keys", "marks"]
_UNIT_ROWS = "unit bigint, bucket int, low binary, high binary, least binary, text binary, at binary, key_of binary, keys array<bigint>, marks array<string>"


def _answered(batches) -> Iterator[pa.RecordBatch]:
    """Parts (bucket, unit, low, high, least) of whole buckets, in their order, to answers (unit, bucket, places, least)."""
    name, parts = None, []

    def out():
        low, high, least = (np.concatenate([np.frombuffer(p[i], dtype=k) for p in parts]) for i, k in ((1, "<u8"), (2, "<u8"), (3, "<i8")))
        lengths = [len(p[1]) // 8 for p in parts]
        order = np.lexsort((least, high, low))
        new = np.ones(len(order), dtype=bool)
        a, b = low[order], high[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        smallest = np.empty(len(order), dtype=np.int64)
        smallest[order] = least[order][new][np.cumsum(new) - 1]
        group = np.cumsum(new) - 1
        known = np.empty(len(order), dtype=bool)
        known[order] = (np.bincount(group) > 1)[group]
        answers, start = ([], [], []), 0
        for (unit, *_), length in zip(parts, lengths):
            places = np.flatnonzero(known[start:start + length])
            if len(places):
                for column, value in zip(answers, (unit, places.astype("<i4").tobytes(), smallest[start:start + length][places].astype("<i8").tobytes())):
                    column.append(value)
            start += length
        return pa.record_batch([pa.array(answers[0], pa.int64()), pa.array([name] * len(answers[0]), pa.int32()),
                                pa.array(answers[1], pa.binary()), pa.array(answers[2], pa.binary())], names=["unit", "bucket", "places", "smallest"])

    for batch in batches:
        for bucket, *part in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if bucket != name:
                if parts:
                    yield out()
                name, parts = bucket, []
            parts.append(part)
    if parts:
        yield out()


def _resolved(batches) -> Iterator[pa.RecordBatch]:
    """Unit rows with their answers to (unit, text, windows, smallest): the smallest document of each window of a text."""
    for batch in batches:
        out = ([], [], [], [])
        for unit, least, text, at, key_of, places, smallest in zip(*(batch.column(i).to_pylist() for i in range(7))):
            text, at, key_of = (np.frombuffer(x, dtype="<i4") for x in (text, at, key_of))
            first = np.frombuffer(least, dtype="<i8").copy()
            if places is not None:
                first[np.frombuffer(places, dtype="<i4")] = np.frombuffer(smallest, dtype="<i8")
            order = np.argsort(text, kind="stable")
            found, begin = np.unique(text[order], return_index=True)
            at, first = at[order], first[key_of][order]
            out[0].extend([unit] * len(found))
            out[1].extend(found.tolist())
            out[2].extend(x.astype("<i4").tobytes() for x in np.split(at, begin[1:]))
            out[3].extend(x.astype("<i8").tobytes() for x in np.split(first, begin[1:]))
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                              names=["unit", "text", "windows", "smallest"])


def _later(key: pa.Array, windows: pa.Array, smallest: pa.Array) -> pa.Array:
    """The windows whose smallest document is smaller than ``key``."""
    out = []
    for k, w, s in zip(key.to_pylist(), windows.to_pylist(), smallest.to_pylist()):
        goes = np.frombuffer(s, dtype="<i8") < (_NO_KEY if k is None else k)
        out.append(np.frombuffer(w, dtype="<i4")[goes].tolist())
    return pa.array(out, pa.list_(pa.int32()))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, width: int | None = None, sent: int = SENT,
             bucket_windows: int = 1_000_000) -> DataFrame:
    """Rows (key, mark, starts): the windows, by first word, of each text that also begin in a document of a smaller key.

    ``mark`` is the text's MD5. Rows of one key and text count as one. A null key is larger than all others; keys are whole numbers.
    The sketch has ``width`` cells a row, else as many as the size of the texts asks for; one of more than ``sent`` bits isn't sent to tasks.
    """
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.md5(F.col(text).cast("binary")).alias("mark")).where("text is not null")
    text_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, text_bytes // _WORD_BYTES // bucket_windows)
    units = _candidates(texts, size, width or width_for(text_bytes, size), buckets, sent)
    windows = units.where("bucket >= 0")
    asked = windows.select("bucket", "unit", "low", "high", "least").repartition(F.col("bucket")).sortWithinPartitions("bucket", "unit")
    answers = store.kept(asked.mapInArrow(_answered, "unit bigint, bucket int, places binary, smallest binary"), "repeat-answers")
    names = (units.where("bucket < 0").select("unit", F.posexplode(F.arrays_zip("keys", "marks")).alias("text", "z"))
             .select("unit", "text", F.col("z.keys").alias("key"), F.col("z.marks").alias("mark")))
    found = (windows.join(answers, ["unit", "bucket"], "left").select("unit", "least", "text", "at", "key_of", "places", "smallest")
             .mapInArrow(_resolved, "unit bigint, text int, windows binary, smallest binary").join(names, ["unit", "text"])
             .select("key", "mark", F.arrow_udf(_later, "array<int>")("key", "windows", "smallest").alias("starts")).where(F.size("starts") > 0))
    return found.groupBy("key", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))


def _kept(texts: pa.Array, starts: pa.Array, size: pa.Array) -> pa.Array:
    rows = []
    for text, begin, n in zip(texts.to_pylist(), starts.to_pylist(), size.to_pylist()):
        words = (text or "").encode().split()
        goes = np.zeros(len(words) + 1, dtype=np.int64)
        if begin:
            begin = np.array(begin)
            np.add.at(goes, begin, 1)
            np.add.at(goes, begin + n, -1)
        stays = np.cumsum(goes[:-1]) == 0
        left = [w for w, s in zip(words, stays.tolist()) if s]
        rows.append({"n_words": len(words), "n_removed": len(words) - len(left), "kept": b" ".join(left).decode()})
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "dedup", size: int = WINDOW, width: int | None = None,
                 sent: int = SENT) -> DataFrame:
    """The documents, all their columns, with a struct ``into``: n_words, n_removed, and kept, the words that stay, joined by one space.

    A null text has no words. Repeated rows, of one key, don't remove each other's words.
    """
    mark, theirs, starts = (f"_{into}_{x}" for x in ("mark", "key", "starts"))
    while {mark, theirs, starts} & set(docs.columns):
        mark, theirs, starts = f"{mark}_", f"{theirs}_", f"{starts}_"
    found = store.kept(repeated(docs, key, text, size, width, sent), "repeat-starts").select(
        F.col("key").alias(theirs), F.col("mark").alias(mark), F.col("starts").alias(starts))
    own = docs.withColumn(f"{mark}t", F.md5(F.col(text).cast("binary")))
    same: Column = F.col(f"`{key}`").cast("bigint").eqNullSafe(F.col(theirs)) & (F.col(f"{mark}t") == F.col(mark))
    joined = own.join(found, same, "left")
    names = [F.col(f"`{c}`") for c in docs.columns if c != into]
    return joined.select(*names, F.arrow_udf(_kept, "n_words bigint, n_removed bigint, kept string")(F.col(f"`{text}`"), F.col(starts), F.lit(size)).alias(into))
