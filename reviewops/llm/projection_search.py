"""Nearest neighbours by inner product: few stable projections, a kd-tree, and a chi-square stopping test.

Inner products become distances first: a row x is taken as x / M with one more coordinate that makes it a
unit vector, M being the largest norm, and a query as q / |q| with 0 there; then d² = 2 - 2 <q, x> / (|q| M). These
vectors are multiplied by a Gaussian matrix into eight dimensions. A projected squared distance over the true one
follows the chi-square distribution of eight degrees, whatever the vectors are.

Rows are dealt to cells by the upper levels of a kd-tree over the projections, and each cell's
rows are indexed by a kd-tree of their own. A search takes projected neighbours in order of
distance, leaf by leaf, and works out their true products, until the next projected distance is so large
that a row as near as the k-th found so far would have been met by then with
probability ``stop``. So a neighbour is missed with probability 1 - ``stop`` at most.

Every query first searches the cell it falls into; what it finds there tells which other cells
the test can't rule out, by the distance to their boxes, and these are searched too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewops.llm import store

PROJECTIONS = 8
STOP = 0.97
NEAREST = 20
LEAF = 128
#: Rows that a cell should have; queries that meet a block of rows in one task.
CELL = 4096
QUERIES = 50_000
#: Bounds of the sample that the cells are cut by, and of the cells of one vector length. Every row is indexed.
SAMPLE = 65_536
MOST_CELLS = 4096
_MOST_LENGTHS = 16
_SEED = 29


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees."""
    term, total = 1.0, 0.0
    for i in range(degrees // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - exp(-x / 2) * total


def stopping_ratio(stop: float, degrees: int) -> float:
    """The ratio of squared distances, projected over true, at which the distribution function is ``stop``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < stop else (low, middle)
    return high


@lru_cache(maxsize=64)
def _matrix(length: int) -> np.ndarray:
    return np.random.default_rng([_SEED, length]).standard_normal((PROJECTIONS, length + 1))


def _prepared(kind: str):
    """(key, vector) to usable rows: length, norm, projection of the vector as it is, bytes."""
    def run(batches):
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths[lengths > 0]).tolist():
                mine = np.flatnonzero(lengths == length)
                flat = lists.take(pa.array(mine)).flatten()
                if flat.null_count:
                    full = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, length).any(axis=1)
                    mine = mine[full]
                    flat = lists.take(pa.array(mine)).flatten()
                own = flat.to_numpy(zero_copy_only=False).reshape(-1, length)
                rows = own.astype(np.float64)
                largest = np.abs(rows).max(axis=1, initial=0)
                good = np.isfinite(largest) & (largest > 0)
                mine, own, rows, largest = mine[good], own[good], rows[good], largest[good, None]
                if not len(rows):
                    continue
                with np.errstate(over="ignore"):
                    norm = np.minimum(largest[:, 0] * np.sqrt(((rows / largest) ** 2).sum(axis=1)), np.finfo(np.float64).max)
                unit = rows / norm[:, None]
                yield pa.record_batch([keys.take(pa.array(mine)), pa.array(np.full(len(mine), length, dtype=np.int32)), pa.array(norm),
                                       pa.array(list(unit @ _matrix(length)[:, :-1].T), pa.list_(pa.float64())),
                                       pa.array([r.tobytes() for r in own.astype(kind)], pa.binary())],
                                      names=["key", "length", "norm", "unit", "vector"])
    return run


def _planes(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of every inner node of a complete kd-tree, in heap order."""
    axes, thresholds = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
    parts = {1: points}
    for node in range(1, 1 << depth):
        mine = parts.pop(node)
        if len(mine):
            axes[node] = axis = int(np.ptp(mine, axis=0).argmax())
            thresholds[node] = np.median(mine[:, axis])
        right = mine[:, axes[node]] > thresholds[node]
        parts[2 * node], parts[2 * node + 1] = mine[~right], mine[right]
    return axes, thresholds


def _cell_of(points: np.ndarray, planes: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    node = np.ones(len(points), dtype=np.int64)
    if planes is None:
        return node
    axes, thresholds = planes
    while len(node) and node[0] < len(axes):
        node = 2 * node + (points[np.arange(len(points)), axes[node]] > thresholds[node])
    return node


def _placed(largest: dict[int, float], planes: dict[int, tuple]):
    """Adds ``at``, the projection of a row as an indexed one, ``cell``, and ``home``, the cell it falls into as a query."""
    def run(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            unit = np.array(batch.column("unit").to_pylist(), dtype=np.float64).reshape(-1, PROJECTIONS)
            share = batch.column("norm").to_numpy() / np.array([largest[n] for n in lengths.tolist()])
            last = np.array([_matrix(n)[:, -1] for n in lengths.tolist()]).reshape(-1, PROJECTIONS)
            at = unit * share[:, None] + last * np.sqrt(np.maximum(0, 1 - share ** 2))[:, None]
            cell, home = np.ones(len(unit), dtype=np.int64), np.ones(len(unit), dtype=np.int64)
            for length in np.unique(lengths).tolist():
                mine = lengths == length
                cell[mine], home[mine] = (_cell_of(p[mine], planes.get(length)) for p in (at, unit))
            yield pa.record_batch([*batch.columns, pa.array(list(at), pa.list_(pa.float64())), pa.array(cell), pa.array(home)],
                                  names=[*batch.schema.names, "at", "cell", "home"])
    return run


class Tree:
    """A kd-tree over projections: rows in leaf order, the leaves' boxes, and searches that stop by the test."""

    def __init__(self, points: np.ndarray, rows: np.ndarray, keys: np.ndarray, numbers: np.ndarray, leaf: int = LEAF):
        order, cuts = np.arange(len(points)), [0]
        waiting = [(0, len(points))]
        while waiting:
            a, b = waiting.pop()
            if b - a <= leaf:
                cuts.append(b)
                continue
            mine = order[a:b]
            axis = int(np.ptp(points[mine], axis=0).argmax())
            middle = (b - a) // 2
            order[a:b] = mine[np.argpartition(points[mine, axis], middle)]
            waiting += [(a + middle, b), (a, a + middle)]  # the left one first, so that cuts ascend
        self.points, self.rows, self.keys, self.numbers = points[order], rows[order], keys[order], numbers[order]
        self.cuts = np.array(cuts)
        self.low = np.minimum.reduceat(self.points, self.cuts[:-1])
        self.high = np.maximum.reduceat(self.points, self.cuts[:-1])

    def search(self, query: np.ndarray, projected: np.ndarray, norm: float, largest: float, number: int, least: float, nearest: int, ratio: float):
        """Keys and products of the ``nearest`` rows other than ``number``, none below ``least``."""
        gaps = np.maximum(0, np.maximum(self.low - projected, projected - self.high))
        away = (gaps ** 2).sum(axis=1)
        leaves = np.argsort(away, kind="stable")
        keys, scores = np.empty(0, dtype=np.int64), np.empty(0)
        kth, at, step = least, 0, 1
        slack = 1e-9 * norm * largest
        while at < len(leaves):
            limit = radius(kth, norm, largest, ratio)
            some = leaves[at:at + step]
            some = some[away[some] <= limit]
            if not len(some):
                break  # the test holds: leaves come in order of distance
            at, step = at + step, min(2 * step, 64)
            near = np.concatenate([np.arange(self.cuts[i], self.cuts[i + 1]) for i in some.tolist()])
            near = near[((self.points[near] - projected) ** 2).sum(axis=1) <= limit]
            with np.errstate(over="ignore", invalid="ignore"):
                rough = self.rows[near] @ query
                near = near[~(rough < kth - slack) & (self.numbers[near] != number)]
                exact = (self.rows[near] * query).sum(axis=1)  # row by row alike, so equal vectors tie
            good = exact >= kth  # false for what isn't a number
            keys, scores = np.append(keys, self.keys[near[good]]), np.append(scores, exact[good])
            best = np.lexsort((keys, -scores))[:nearest]
            keys, scores = keys[best], scores[best]
            if len(keys) == nearest:
                kth = scores[-1]
        return keys, scores


def radius(kth: float, norm: float, largest: float, ratio: float) -> float:
    """The squared projected distance at which the stopping test holds, if ``kth`` is the k-th product so far."""
    with np.errstate(over="ignore", invalid="ignore"):
        true = 2 - 2 * (kth / norm / largest)
    return ratio * max(true, 0) * (1 + 1e-9) + 1e-12 if np.isfinite(true) else np.inf


def _searched(largest: dict[int, float], kind: str, nearest: int, ratio: float):
    """Blocks of rows, then the queries that meet them, to (number, key, keys, scores) for each query."""
    def run(batches):
        block, rows, tree, matrix = None, [], None, None
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("length", "cell", "part", "turn", "asks", "number", "key", "norm", "least", "at", "vector")]
            for length, cell, part, turn, asks, number, key, norm, least, at, vector in zip(*columns):
                if (length, cell, part, turn) != block:
                    block, rows, tree = (length, cell, part, turn), [], None
                    matrix = _matrix(length)[:, :-1]
                if not asks:
                    rows.append((at, vector, key, number))
                elif rows:
                    if tree is None:
                        points, vectors, keys, numbers = zip(*rows)
                        tree = Tree(np.array(points), np.frombuffer(b"".join(vectors), dtype=kind).astype(np.float64).reshape(len(rows), length),
                                    np.array(keys, dtype=np.int64), np.array(numbers, dtype=np.int64))
                    query = np.frombuffer(vector, dtype=kind).astype(np.float64)
                    found, scores = tree.search(query, matrix @ (query / norm), norm, largest[length], number, -np.inf if least is None else least, nearest, ratio)
                    out.append((number, key, found.tolist(), scores.tolist()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())))],
                                      names=["number", "key", "keys", "scores"])
    return run


def _visits(largest: dict[int, float], boxes: dict[int, tuple], ratio: float):
    """Queries to the further blocks that the stopping test doesn't rule out."""
    def run(batches):
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("length", "home", "home_part", "norm", "least", "unit")]
            which, cells, parts = [], [], []
            for i, (length, home, home_part, norm, least, unit) in enumerate(zip(*columns)):
                names, counts, low, high = boxes[length]
                unit = np.array(unit)
                away = (np.maximum(0, np.maximum(low - unit, unit - high)) ** 2).sum(axis=1)
                for at in np.flatnonzero(away <= radius(-np.inf if least is None else least, norm, largest[length], ratio)).tolist():
                    for part in range(counts[at]):
                        if names[at] != home or part != home_part:
                            which.append(i), cells.append(names[at]), parts.append(part)
            rows = batch.select(["length", "number", "key", "norm", "least", "vector"]).take(pa.array(which, pa.int64()))
            yield pa.record_batch([*rows.columns, pa.array(cells, pa.int64()), pa.array(parts, pa.int32())], names=[*rows.schema.names, "cell", "part"])
    return run


def _met(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of rows and the queries sent to them, together, rows first; a block with very many queries is there several times."""
    where = ["length", "cell", "part"]
    turns = asked.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns"))
    none = {"least": F.lit(None).cast("double"), "asks": F.lit(False)}
    there = rows.join(turns, where).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumns(none)
    asking = (asked.join(turns, where).withColumn("turn", F.pmod(F.xxhash64("number"), F.col("turns")).cast("int"))
              .withColumns({"asks": F.lit(True), "at": F.lit(None).cast("array<double>")}))
    names = [*where, "turn", "asks", "number", "key", "norm", "least", "at", "vector"]
    both = there.select(*names).unionAll(asking.select(*names))
    return both.repartition(*where, "turn").sortWithinPartitions(*where, "turn", "asks")


def nearest_rows(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, stop: float = STOP) -> DataFrame:
    """Rows (query, rank, key, score): for each row that ``queries`` holds of, the ``nearest`` other rows found by inner product.

    ``queries`` is a condition on a column ``key``, a whole number. Products are double
    precision, of the vectors as they are; ties go to the smaller key. Vectors that are null, empty or zero or
    hold null or non-finite components take no part, nor do rows without a key, and vectors of different length don't meet. Repeated
    rows are rows of their own: each is asked for, and is found by the others. Pairs whose product isn't a number are left out. If there are fewer
    rows than ``nearest``, all are returned.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    ratio = stopping_ratio(stop, PROJECTIONS)
    given = vectors.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{vector}`").alias("vector")).where("key is not null")
    prepared = given.mapInArrow(_prepared(kind), "key bigint, length int, norm double, unit array<double>, vector binary")
    prepared = store.kept(prepared.withColumn("number", F.monotonically_increasing_id()), "search-vectors")
    lengths = {r.length: r for r in prepared.groupBy("length").agg(F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).collect()}
    largest = {n: r.norm for n, r in lengths.items()}

    planes = {}
    for length, r in sorted(lengths.items(), key=lambda item: -item[1].n)[:_MOST_LENGTHS]:
        depth = min(MOST_CELLS, max(1, r.n // CELL)).bit_length() - 1
        if depth:
            sample = prepared.where((F.col("length") == length) & (F.pmod(F.xxhash64("number"), F.lit(r.n)) < SAMPLE)).limit(2 * SAMPLE).select("norm", "unit").toPandas()
            share = sample["norm"].to_numpy()[:, None] / r.norm
            planes[length] = _planes(np.stack(sample["unit"]) * share + _matrix(length)[:, -1] * np.sqrt(np.maximum(0, 1 - share ** 2)), depth)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prepared.schema)
    placed = store.kept(prepared.mapInArrow(_placed(largest, planes), names + ", at array<double>, cell bigint, home bigint"), "search-placed")

    sides = [side(F.get("at", F.lit(j))).alias(f"{name}{j}") for j in range(PROJECTIONS) for side, name in ((F.min, "low"), (F.max, "high"))]
    boxes = {}
    for r in placed.groupBy("length", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * CELL)).cast("int").alias("parts"), *sides).collect():
        boxes.setdefault(r["length"], []).append((r["cell"], r["parts"], [r[f"low{j}"] for j in range(PROJECTIONS)], [r[f"high{j}"] for j in range(PROJECTIONS)]))
    known = spark.createDataFrame([(n, c, p) for n, cells in boxes.items() for c, p, *_ in cells], "length int, cell bigint, parts int")
    boxes = {n: tuple(np.array(c) if i > 1 else list(c) for i, c in enumerate(zip(*cells))) for n, cells in boxes.items()}

    parted = placed.join(known, ["length", "cell"])
    rows = parted.select("length", "cell", F.pmod(F.xxhash64("number"), F.col("parts")).cast("int").alias("part"), "number", "key", "norm", "at", "vector")
    homes = known.select("length", F.col("cell").alias("home"), F.col("parts").alias("home_parts"))
    # a query may fall into a cell without rows: then it has no home to search first
    asked = (placed.where(queries).join(homes, ["length", "home"], "left")
             .withColumn("home_part", F.coalesce(F.pmod(F.xxhash64("number"), F.col("home_parts")), F.lit(-1)).cast("int")))
    asked = store.kept(asked.select("length", "home", "home_part", "number", "key", "norm", "unit", "vector"), "search-queries")
    first = asked.select("length", F.col("home").alias("cell"), F.col("home_part").alias("part"), "number", "key", "norm", F.lit(None).cast("double").alias("least"), "vector")
    schema = "number bigint, key bigint, keys array<bigint>, scores array<double>"
    at_home = store.kept(_met(rows, first.where("part >= 0")).mapInArrow(_searched(largest, kind, nearest, ratio), schema), "search-home")

    so_far = at_home.select("number", F.get("scores", F.lit(nearest - 1)).alias("least"))
    visits = asked.join(so_far, "number", "left").mapInArrow(
        _visits(largest, boxes, ratio), "length int, number bigint, key bigint, norm double, least double, vector binary, cell bigint, part int")
    visits = store.kept(visits, "search-visits")
    further = store.kept(_met(rows, visits).mapInArrow(_searched(largest, kind, nearest, ratio), schema), "search-further")

    pairs = at_home.unionAll(further).select("number", "key", F.inline(F.arrays_zip(F.col("keys").alias("k"), F.col("scores").alias("s"))))
    pairs = pairs.toDF("number", "query", "key", "score")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "key", "score"))), 1, nearest)
    found = pairs.groupBy("number", "query").agg(best.alias("best"))
    return found.select("query", F.posexplode("best").alias("place", "one")).select(
        "query", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.key").alias("key"), F.col("one.score").alias("score"))
