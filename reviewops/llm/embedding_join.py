"""Exact range join of embeddings by cosine, in metric cells.

On unit vectors a cosine of at least c is a distance of at most e = sqrt(2 - 2c). A few pivots
divide the space: each vector lives in the cell of its nearest pivot. A vector is also sent to
every other cell that may hold a partner: by the triangle inequality one within the cell's
radius plus e of its pivot, and of these one within e of the plane between the two pivots.
Cells then join alone. All partners of a vector come to its own cell, so its links are counted
there and nowhere else.

Equal vectors of one label are joined as one. A cell's residents are dealt to parts of bounded
size; a part holds its residents and lets all vectors of the cell pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewops.llm import store
from reviewops.llm.components import components
from reviewops.llm.jaccard_join import Forest

#: A pivot for so many vectors of one length, within bounds: the most are sent to all tasks.
VECTORS_A_PIVOT = 4096
LEAST_PIVOTS, MOST_PIVOTS = 8, 1024
PART = 1024
_SLACK = 1e-9


def _unit(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors; None for null, empty and zero ones, and those with null or non-finite components."""
    out = []
    for value in column:
        vector = None
        if value.is_valid and len(value.values) and not value.values.null_count:
            raw = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            largest = np.abs(raw).max()
            if np.isfinite(largest) and largest > 0:
                raw = raw / largest  # so that squares neither overflow nor vanish
                vector = raw / np.sqrt(raw @ raw)
        out.append(vector)
    return out


def _prepared(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = _unit(batch.column(2))
        names = [None if u is None or l is None else hashlib.md5(f"{l}\0".encode() + u.tobytes()).hexdigest() for u, l in zip(units, batch.column(1).to_pylist())]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()),
                               pa.array([None if n is None else len(u) for u, n in zip(units, names)], pa.int32()),
                               pa.array([None if n is None else u.tobytes() for u, n in zip(units, names)], pa.binary())],
                              names=["key", "label", "name", "dim", "unit"])


def _distances(pivots: dict[int, np.ndarray]):
    """Distance to every pivot of the vector's length."""
    def run(batches):
        for batch in batches:
            rows = [np.frombuffer(u, dtype=np.float64) for u in batch.column("unit").to_pylist()]
            found = [np.sqrt(np.maximum(0, 2 - 2 * (pivots[len(u)] @ u))) if len(u) in pivots else np.zeros(1) for u in rows]
            yield pa.record_batch([*batch.columns, pa.array([d.tolist() for d in found], pa.list_(pa.float64())),
                                   pa.array([int(d.argmin()) for d in found], pa.int32())], names=[*batch.schema.names, "distances", "home"])
    return run


def _groups(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a matrix of links, the first row of its connected group; their number for those without a link."""
    n = len(near)
    rows, columns = np.where(near.any(axis=1), np.arange(n), n), np.full(near.shape[1], n)
    while True:
        columns = np.where(near, rows[:, None], n).min(axis=0, initial=n)
        smaller = np.minimum(rows, np.where(near, columns[None, :], n).min(axis=1, initial=n))
        if (smaller == rows).all():
            return rows, columns
        rows = smaller


def _counted(least: float):
    """Rows of parts, residents first, to (name, links) for each resident and edges (a, b) that connect all linked."""
    def run(batches):
        part, residents, others = None, [], []
        links, edges, matrix, forest, places = None, [], None, None, {}

        def compare():
            nonlocal matrix, links, forest
            if matrix is None:
                matrix = np.array([u for *_, u in residents])
                links = np.zeros(len(residents), dtype=np.int64)
            if others and len(matrix):
                block = np.array([u for *_, u in others])
                near = matrix @ block.T >= least
                copies = np.array([c for _, _, c, _ in others])
                links[:] += near @ copies
                mine, theirs = _groups(near)
                # a row for each vector linked here, to the first resident of its group, whatever the number of pairs
                for rows, groups in ((residents, mine), (others, theirs)):
                    for at in np.flatnonzero(groups < len(residents)).tolist():
                        a, b = rows[at][1], residents[groups[at]][1]
                        x, y = (places.setdefault(k, len(places)) for k in (a, b))
                        while len(forest.up) < len(places):
                            forest.up.append(len(forest.up))
                        if forest.join(x, y):
                            edges.append((a, b))
            others.clear()

        def out():
            compare()
            n, m = len(residents), len(edges)
            # a resident is its own partner: the vector itself goes, its copies stay
            return pa.record_batch([pa.array([r[0] for r in residents] + [None] * m, pa.string()), pa.array((links - 1).tolist() + [None] * m, pa.int64()),
                                    pa.array([None] * n + [a for a, _ in edges], pa.int64()), pa.array([None] * n + [b for _, b in edges], pa.int64())],
                                   names=["name", "links", "a", "b"])

        for batch in batches:
            for *where, kind, name, key, copies, unit in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if where != part:
                    if part is not None:
                        yield out()
                    part, residents, others, edges, matrix, forest, places = where, [], [], [], None, Forest(0), {}
                row = (name, key, copies, np.frombuffer(unit, dtype=np.float64))
                if kind == 0:
                    residents.append(row)
                others.append(row)
                if kind and len(others) >= 2048:
                    compare()
        if part is not None:
            yield out()
    return run


def linked(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93,
           pivots: int | None = None, part: int = PART) -> DataFrame:
    """Rows (key, n_links, component): other vectors of the same label with a cosine of at least ``least``, and the smallest key reached by links.

    ``key`` is a whole number. Null labels, null, empty and zero vectors and those with null
    or non-finite components link with nothing; neither do vectors of different length, nor rows
    without a key, whose component is null. Repeated rows are copies of each other and count as links.
    ``pivots`` is the number of rows sent to all tasks for each length of vector, by default one for every
    ``VECTORS_A_PIVOT`` vectors, within bounds; at most 16 lengths get any.
    """
    kind = vectors.schema[label].dataType.simpleString()
    prepared = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).mapInArrow(
        _prepared, f"key bigint, label {kind}, name string, dim int, unit binary")
    prepared = store.kept(prepared, "vectors")
    classes = (prepared.where("key is not null and name is not null").groupBy("name").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit")))
    classes = store.kept(classes, "vector-classes")
    chosen: dict[int, list[np.ndarray]] = {}
    dims = [(r.dim, r.n) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(16).collect()]
    for dim, n in dims:
        number = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, n // VECTORS_A_PIVOT))
        chosen[dim] = np.array([np.frombuffer(r.unit, dtype=np.float64) for r in classes.where(F.col("dim") == dim).orderBy("name").limit(number).select("unit").collect()])
    between = {d: np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T))) for d, p in chosen.items()}
    reach = float(np.sqrt(2 - 2 * least))

    homes = store.kept(classes.mapInArrow(_distances(chosen), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields) + ", distances array<double>, home int"), "vector-homes")
    cells = store.kept(homes.groupBy("label", "dim", F.col("home").alias("cell")).agg(
        F.max(F.element_at("distances", F.col("home") + 1)).alias("radius"), F.count(F.lit(1)).alias("n")), "vector-cells")

    @F.arrow_udf("array<int>")
    def visits(dim: pa.Array, home: pa.Array, distances: pa.Array) -> pa.Array:
        out = []
        for d, h, row in zip(dim.to_pylist(), home.to_pylist(), distances.to_pylist()):
            row = np.array(row)
            apart = between[d][h] if d in between else np.zeros(1)
            beside = (row ** 2 - row[h] ** 2) <= 2 * apart * (reach + _SLACK)  # distance to the plane between the pivots
            out.append(np.flatnonzero(beside | (np.arange(len(row)) == h)).tolist())
        return pa.array(out, pa.list_(pa.int32()))

    sent = homes.withColumn("cell", F.explode(visits("dim", "home", "distances")))
    sent = (sent.withColumn("distance", F.element_at("distances", F.col("cell") + 1)).drop("distances").join(cells, ["label", "dim", "cell"])
            .where(F.col("distance") <= F.col("radius") + reach + _SLACK))
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("name"), parts).cast("int")
    sent = sent.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = sent.select("label", "dim", "cell", "part", F.when((F.col("cell") == F.col("home")) & (F.col("own") == F.col("part")), 0).otherwise(1).alias("kind"),
                       "name", "key", "copies", "unit")
    where = ["label", "dim", "cell", "part"]
    counted = store.kept(rows.repartition(*where).sortWithinPartitions(*where, "kind", "name").mapInArrow(
        _counted(least), "name string, links bigint, a bigint, b bigint"), "vector-links")
    members = prepared.where("key is not null and name is not null").join(classes.select("name", F.col("key").alias("a")), "name").select("a", F.col("key").alias("b"))
    found = components(counted.where("a is not null").select("a", "b").unionAll(members)).withColumnRenamed("vertex", "key")
    links = counted.where("name is not null").select("name", "links")
    return (prepared.join(links, "name", "left").join(found, "key", "left")
            .select("key", F.when(F.col("key").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"), F.coalesce("component", "key").alias("component")))
