"""Packing of documents into sequences of fixed length by column generation.

A document is cut into full pieces and a rest. What is left is a cutting-stock problem: how
often to use which pattern of piece lengths, so that few sequences hold all pieces. Lengths
are rounded up to classes of eight tokens, so a linear program has at most 512 rows whatever
the corpus. Its columns, the patterns, are generated: a knapsack by dynamic programming over
the dual prices finds the pattern that saves most, until none saves more than the tolerance.
The program is rounded down, the few pieces left over are packed largest first, and ranks
within each class tell every piece its sequence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reviewops.llm import scan, store, tokens

CAPACITY = 4096
STEP = 8
_BUCKETS = 1024


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Rows (key, start, length, doc_tokens, ids): the documents' ids and an end id each, cut at multiples of ``capacity``.

    ``ids`` is binary, little-endian 32 bits an id. Null text is empty and has the end id alone.
    """
    path = tokenizer or tokens.default_path()

    def cut(batches):
        encode = tokens.encoder(path).ids
        end = np.array([tokens.END], dtype="<u4").tobytes()
        for batch in batches:
            for part in scan.pieces(batch, batch.schema.names[1], tokens.PIECE):
                flat, begins = encode(part.column(1))
                rows, starts, lengths, totals, ids = [], [], [], [], []
                for row, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
                    found = flat[a:b].tobytes() + end
                    total = b - a + 1
                    for start in range(0, total, capacity):
                        chunk = found[4 * start:4 * (start + capacity)]
                        rows.append(row), starts.append(start), lengths.append(len(chunk) // 4), totals.append(total), ids.append(chunk)
                yield pa.record_batch([part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                                       pa.array(totals, pa.int64()), pa.array(ids, pa.binary())],
                                      names=[batch.schema.names[0], "start", "length", "doc_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(cut, f"`{key}` {kind}, start bigint, length bigint, doc_tokens bigint, ids binary")


def _knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest pattern of unlimited items that fits, and its price."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for space in range(1, room + 1):
        best[space] = best[space - 1]
        if n := fits[space]:
            values = best[space - sizes[:n]] + prices[:n]
            i = int(values.argmax())
            if values[i] > best[space] + 1e-12:
                best[space], last[space] = values[i], i
    pattern, space = np.zeros(len(sizes), dtype=np.int64), room
    while space > 0:
        if last[space] < 0:
            space -= 1
        else:
            pattern[last[space]] += 1
            space -= sizes[last[space]]
    return float(best[room]), pattern


def patterns(sizes: np.ndarray, counts: np.ndarray, room: int, tolerance: float = 2e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns (items of each size) and how often each is used; together they hold exactly ``counts`` items."""
    order = len(sizes)
    if not order:
        return []
    base = np.diag(room // sizes).astype(float)  # a column a pattern: at first, each holds one size
    inverse = np.diag(1 / np.diag(base))
    amounts = inverse @ counts
    for turn in range(1, 40 * order + 100):
        prices = inverse.sum(axis=0)
        worth, column = _knapsack(prices, sizes, room)
        if worth <= 1 + tolerance:  # the optimum is at most this factor below
            break
        direction = inverse @ column
        able = np.flatnonzero(direction > 1e-9)
        out = able[np.argmin(amounts[able] / direction[able])]
        step = amounts[out] / direction[out]
        amounts -= step * direction
        amounts[out] = step
        np.maximum(amounts, 0, out=amounts)
        base[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        if turn % 200 == 0:
            inverse = np.linalg.inv(base)
            amounts = np.maximum(inverse @ counts, 0)
    left, plan = counts.astype(np.int64).copy(), []
    for i in np.argsort(-amounts):
        pattern = base[:, i].astype(np.int64)
        times = int(min(np.floor(amounts[i] + 1e-6), (left[pattern > 0] // pattern[pattern > 0]).min(initial=np.iinfo(np.int64).max)))
        if times > 0 and pattern.any():
            plan.append((pattern, times))
            left -= times * pattern
    while left.any():  # what rounding left over, largest first
        pattern, space = np.zeros(order, dtype=np.int64), room
        for i in range(order - 1, -1, -1):
            pattern[i] = min(left[i], space // sizes[i])
            space -= pattern[i] * sizes[i]
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def _places(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: from which rank on, how many a sequence, the first sequence, and the slots before it there."""
    ranks, rows, sequence = np.zeros(len(sizes), dtype=np.int64), {int(s): [] for s in sizes}, 0
    for pattern, times in plan:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            rows[int(sizes[i])].append((ranks[i], pattern[i], sequence, slot))
            ranks[i] += pattern[i] * times
            slot += pattern[i]
        sequence += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for s, r in rows.items() if r}


def _planned(histogram: DataFrame, room: int) -> dict[int, tuple[np.ndarray, ...]]:
    """The places of each class, worked out in one task from a histogram (class, count) of at most ``room`` rows."""
    def solve(frames):
        whole = pd.concat([pd.DataFrame({"_class": [], "n": []}), *frames]).sort_values("_class")
        plan = patterns(whole["_class"].to_numpy(np.int64), whole["n"].to_numpy(np.int64), room)
        yield pd.DataFrame({"sizes": [whole["_class"].tolist() for _ in plan], "pattern": [p.tolist() for p, _ in plan], "times": [n for _, n in plan]})

    plan = histogram.coalesce(1).mapInPandas(solve, "sizes array<bigint>, pattern array<bigint>, times bigint").collect()
    return _places(np.array(plan[0].sizes, dtype=np.int64), [(np.array(r.pattern), r.times) for r in plan]) if plan else {}


def placed(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """The pieces, further columns included, with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Columns already called so are replaced; ``_class``, ``_bucket``, ``_rank`` and ``_slot`` are names of its own and are dropped.

    Only the plan, of bounded size, reaches the driver. A class may hold any
    share of the pieces: ranks are counted in hash buckets and put together by running totals.
    Equal rows are interchangeable. No pieces give no rows.
    """
    room = capacity // step
    cut = cut.withColumn("_class", F.ceil(F.col("length") / step)).withColumn(
        "_bucket", F.pmod(F.xxhash64(F.col(key).cast("string"), "start", "length"), F.lit(_BUCKETS)))
    cut = store.kept(cut, "packing-pieces")
    totals = store.kept(cut.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "packing-totals")
    places = _planned(totals.groupBy("_class").agg(F.sum("_n").alias("n")), room)
    before = totals.select("_class", "_bucket", F.coalesce(F.sum("_n").over(
        Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = (cut.withColumn("_in", F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy(key, "start", "doc_tokens")))
              .join(before, ["_class", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1).drop("_before", "_in", "_bucket"))

    @F.pandas_udf("sequence long, slot long")
    def place(classes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, slot = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
        classes, ranks = classes.to_numpy(), ranks.to_numpy()
        for size in np.unique(classes):
            here = classes == size
            starts, each, first, slots = places[int(size)]
            i = np.searchsorted(starts, ranks[here], side="right") - 1
            within = ranks[here] - starts[i]
            sequence[here] = first[i] + within // each[i]
            slot[here] = slots[i] + within % each[i]
        return pd.DataFrame({"sequence": sequence, "slot": slot})

    window = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return (ranked.withColumn("_place", place("_class", "_rank"))
            .withColumns({"sequence_id": F.col("_place.sequence"), "_slot": F.col("_place.slot")})
            .withColumn("offset", F.coalesce(F.sum("length").over(window), F.lit(0)))
            .drop("_place", "_slot", "_class", "_rank"))


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, length, ids): the pieces of each sequence one after the other, from a packing that kept ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select(
        "sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
