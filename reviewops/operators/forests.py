"""Random forests scored by the batch.

The library scores a row by walking all trees of a forest, node by node, with a search in the row's sparse vector at
each. Here a batch of rows is laid out once, in the columns that some tree splits on, and all its rows go down a level
of all trees at a time. Votes are the library's own, added up in its order, so they are the same to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, SparkSession, functions as F

from reviewops.session import new_path

#: Rows times trees that go down together, few enough for a core's cache, and values laid out for them: 8 MB at most.
BLOCK_PATHS, BLOCK_VALUES = 25_600, 1 << 20


@dataclass
class Trees:
    """The nodes of a forest. The first are the roots, one a tree; children lie side by side, and a leaf is its own left child."""

    trees: int
    feature: np.ndarray    # -1 in leaves
    threshold: np.ndarray  # up to here a row goes left; infinite in leaves
    left: np.ndarray
    shares: np.ndarray     # of both classes, by node

    def votes(self, values: np.ndarray, column: np.ndarray) -> list[np.ndarray]:
        """Votes against and for on rows of ``values``. A node compares the value of its ``column``; those of leaves name the last one."""
        rows, width = values.shape
        flat = values.ravel()
        at = node = np.repeat(np.arange(self.trees), rows)  # of each tree and row
        start, going = np.tile(np.arange(rows) * width, self.trees), np.arange(node.size)
        while True:
            place = column.take(at)
            inner = place != width - 1
            n = np.count_nonzero(inner)
            if not n:
                break
            if 2 * n < at.size:  # most have arrived, so only the others go on
                node[going] = at
                keep = np.flatnonzero(inner)
                at, start, going, place = at.take(keep), start.take(keep), going.take(keep), place.take(keep)
            place += start
            at = self.left.take(at) + (flat.take(place) > self.threshold.take(at))
        node[going] = at
        out = []
        for share in self.shares:
            total = np.zeros(rows)
            for votes in share.take(node).reshape(self.trees, rows):  # tree by tree, as the library adds them
                total += votes
            out.append(total)
        return out


def trees_of(spark: SparkSession, model: RandomForestClassificationModel) -> Trees:
    """The trees of a fitted forest, as the library stores them. They are as many nodes as the model holds at the driver."""
    path = new_path(spark, "forest")
    model.write().save(path)
    split, counts = "nodeData.split", "nodeData.impurityStats"
    stored = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", f"{split}.featureIndex",
        F.get(F.col(f"{split}.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        *[F.coalesce(F.get(F.col(counts), F.lit(i)), F.lit(0.0)).alias(f"n{i}") for i in (0, 1)]).toArrow()
    rows = {c: stored[c].to_numpy() for c in stored.column_names}
    order = np.lexsort((rows["id"], rows["treeID"]))
    rows = {c: v[order] for c, v in rows.items()}
    first = np.flatnonzero(rows["id"] == 0)  # ids count the nodes of a tree
    trees, inner = len(first), np.flatnonzero(rows["leftChild"] >= 0)
    start, child = first[rows["treeID"][inner]], trees + 2 * np.arange(len(inner))
    new = np.empty(len(order), dtype=np.intp)
    new[first], new[start + rows["leftChild"][inner]], new[start + rows["rightChild"][inner]] = np.arange(trees), child, child + 1

    feature, threshold, left = np.full(len(new), -1, dtype=np.intp), np.full(len(new), np.inf), np.arange(len(new))
    feature[new[inner]], threshold[new[inner]], left[new[inner]] = rows["featureIndex"][inner], rows["threshold"][inner], child
    total, shares = rows["n0"] + rows["n1"], np.zeros((2, len(new)))
    for i in (0, 1):
        shares[i, new] = np.divide(rows[f"n{i}"], total, out=np.zeros(len(new)), where=total != 0)
    return Trees(trees, feature, threshold, left, shares)


def votes(forests: Sequence[Trees], terms: int, features: str = "features") -> Column:
    """Array of the votes of each forest, those against and those for, on a column of sparse vectors of ``terms`` values."""
    used = np.unique(np.concatenate([f.feature[f.feature >= 0] for f in forests]))
    width = len(used) + 1  # the last column takes the values that no tree asks for
    column_of = np.full(terms + 1, width - 1)
    column_of[used] = np.arange(len(used))
    columns = [column_of[f.feature] for f in forests]
    block = max(1, min(BLOCK_PATHS // max(f.trees for f in forests), BLOCK_VALUES // width))

    @F.arrow_udf("array<double>")
    def vote(indices: pa.Array, values: pa.Array) -> pa.Array:
        lengths, column, value = indices.value_lengths().to_numpy(), column_of[indices.flatten().to_numpy()], values.flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(lengths)))
        out = np.empty((len(lengths), 2 * len(forests)))
        for a in range(0, len(lengths), block):
            b = min(a + block, len(lengths))
            laid = np.zeros((b - a, width))
            laid[np.repeat(np.arange(b - a), lengths[a:b]), column[ends[a]:ends[b]]] = value[ends[a]:ends[b]]
            for i, (forest, compared) in enumerate(zip(forests, columns)):
                out[a:b, 2 * i], out[a:b, 2 * i + 1] = forest.votes(laid, compared)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))

    entries = F.unwrap_udt(features)
    return vote(entries.getField("indices"), entries.getField("values"))
