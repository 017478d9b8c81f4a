"""Merkle manifest of a table: a digest for each row, one for each group, one for all, and proofs.

Digests are hexadecimal SHA-256. A row's leaf hashes its fields, each written as byte count, a colon
and the value, or as ``-`` where it is null. The leaves of a group, in the order of
their keys, are the lowest level of a tree; each run of ``fanout`` nodes becomes one node of the next
level until one is left, and the groups' last nodes are the leaves of one more tree.

A level is made by a slot pivot: nodes are grouped by parent, and conditional aggregates spread
the children of each into ``fanout`` columns. The columns joined are hashed into the parent; the
columns without a child's own are that child's siblings. So siblings come from the pivot that made the
parent and nothing is joined with itself.

Levels shrink by ``fanout``. On the way down each parent hands its children the siblings above them:
a join of one row with one row a level, on keys that occur once. The lowest pivot carries keys and
leaves, so the rows of the table move twice, to be ordered and to meet their parents, and never with
their texts. Positions are exact without a group in one task: rows are dealt by ranges of (group, key), and only
the counts of ranges are added up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewops.llm import store

FANOUT = 3
#: Rows of a range of sorted leaves.
RANGE = 1_000_000
_PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined, in lower-case hexadecimal; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    return digest(*(field(v) for v in values))


def folded(start: Column, path: Column) -> Column:
    """The digest at the top that follows from one below and its siblings."""
    return F.aggregate(path, start, lambda below, step: digest(step["before"], below, step["after"]))


def proof(path: Column) -> Column:
    """The siblings of a path, in order, as one digest."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def _placed(nodes: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """Nodes with ``i``, their place in group ``g`` from 0 on, and ``m``, the group's number of nodes.

    Sorted by ranges of (g, order), written, and numbered by the runs of each group in the ranges:
    at most a row for each range and each group, added up by group. Rows equal in all of these are
    interchangeable.
    """
    ranges = max(1, -(-rows // RANGE), min(rows // 1000, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    by = ["g", *order]
    dealt = nodes.repartitionByRange(ranges, *(F.asc_nulls_first(c) for c in by)).sortWithinPartitions(*(F.asc_nulls_first(c) for c in by))
    dealt = store.kept(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), "merkle-sorted")
    runs = dealt.groupBy("g", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy("g")
    before = F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = store.kept(runs.select("g", "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("m")), "merkle-runs")
    return dealt.join(runs, ["g", "_range"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


@dataclass(frozen=True)
class _Tree:
    """``levels[k]``: parents (g, i, m, c0.., digest) of the k-th level's nodes; ``rows``: the nodes placed; ``tops``: (g, top)."""

    rows: DataFrame
    levels: list[DataFrame]
    tops: DataFrame


def _tree(nodes: DataFrame, order: Sequence[str], carried: Sequence[str], fanout: int) -> _Tree:
    """Trees of all groups at once. ``nodes``: rows (g, digest, carried); ``carried`` columns stay with the slots of the lowest level."""
    rows = nodes.count()
    placed = store.kept(_placed(nodes, order, rows), "merkle-placed")
    most = placed.agg(F.max("m")).first()[0] or 0
    tops, levels, below = [placed.where("m = 1").select("g", F.col("digest").alias("top"))], [], placed
    while most > 1:
        child = F.struct("digest", *(carried if below is placed else [])).alias("child")
        slots = [F.max(F.when(F.col("slot") == s, F.col("child"))).alias(f"c{s}") for s in range(fanout)]
        made = (below.where("m > 1").select("g", F.expr(f"i DIV {fanout}").alias("i"), (F.col("i") % fanout).alias("slot"), "m", child)
                .groupBy("g", "i").agg(F.max(F.expr(f"(m + {fanout - 1}) DIV {fanout}")).alias("m"), *slots))
        below = store.kept(made.withColumn("digest", digest(*(F.col(f"c{s}.digest") for s in range(fanout)))), "merkle-level")
        levels.append(below)
        tops.append(below.where("m = 1").select("g", F.col("digest").alias("top")))
        most = -(-most // fanout)
    whole = tops[0]
    for more in tops[1:]:
        whole = whole.unionAll(more)
    return _Tree(placed, levels, whole)


def _paths(tree: _Tree, above: DataFrame, carried: Sequence[str], fanout: int) -> DataFrame:
    """Rows (digest, carried.., path, shared..) of the lowest nodes; ``above``: rows (g, path, shared..) for the top of each group."""
    shared = [c for c in above.columns if c not in ("g", "path")]
    down = None  # (g, i, path, shared) of the nodes of the level below which we stand
    for k in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[k]
        whole = level.where("m = 1").drop("m", "digest").join(above, "g")
        if down is not None:
            whole = whole.unionByName(level.where("m > 1").drop("m", "digest").join(down, ["g", "i"]))
        kept = ["digest", *carried] if k == 0 else ["digest"]

        def child(slot):
            before = F.concat_ws("", *(F.col(f"c{s}.digest") for s in range(slot)))
            after = F.concat_ws("", *(F.col(f"c{s}.digest") for s in range(slot + 1, fanout)))
            step = F.array(F.struct(before.alias("before"), after.alias("after")))
            return F.when(F.col(f"c{slot}").isNotNull(), F.struct(
                (F.col("i") * fanout + slot).alias("i"), F.concat(step, "path").alias("path"), *(F.col(f"c{slot}.{c}").alias(c) for c in kept)))

        slots = F.filter(F.array(*(child(s) for s in range(fanout))), lambda x: x.isNotNull())
        down = whole.select("g", *shared, F.inline(slots))
        if k:
            down = down.drop("digest")
    lone = tree.rows.where("m = 1").select("g", "digest", *carried).join(above, "g").select("digest", *carried, "path", *shared)
    return lone if down is None else down.select("digest", *carried, "path", *shared).unionByName(lone)


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             carried: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Rows (key, leaf, subroot, root, path, carried columns), one for each row of the table.

    ``path`` lists, from the row up to the root, the siblings before and after the node at each level.
    Groups are ordered by their text, null first, byte by byte, and so are a group's rows by key, null
    first, and rows of equal key by leaf. ``carried`` names further columns to
    work out of each row while it is read, such as the leaf of a changed copy. Missing fields
    are an error; columns that aren't named take no part. An empty table has no rows and no root.
    """
    carried = carried or {}
    extra = [f"x_{i}" for i in range(len(carried))]
    name = F.col(f"`{group}`").cast("string")
    leaves = rows.select(F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("g"),  # null becomes a key of its own, before all others
                         F.col(f"`{key}`").alias("key"), leaf([F.col(f"`{f}`") for f in fields]).alias("digest"),
                         *(c.alias(x) for c, x in zip(carried.values(), extra)))
    own = ["key", *extra]
    tree = _tree(store.kept(leaves, "merkle-leaves"), ["key", "digest"], own, fanout)
    subroots = store.kept(tree.tops, "merkle-subroots").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("digest"))
    upper = _tree(subroots, ["name"], ["name"], fanout)
    top = upper.tops.first()
    root = F.lit(top.top if top else None).cast("string")
    start = store.kept(rows.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast(_PATH).alias("path")), "merkle-start")
    above = _paths(upper, start, ["name"], fanout).select(F.col("name").alias("g"), "path", F.col("digest").alias("subroot"))
    found = _paths(tree, store.kept(above, "merkle-above"), own, fanout)
    return found.select("key", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", *(F.col(x).alias(n) for n, x in zip(carried, extra)))
