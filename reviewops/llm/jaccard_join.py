"""Exact similarity join of texts by the Jaccard index of their n-grams.

Sets of n-grams are lists in one global order, that of their 64-bit hashes. Texts that may be
alike meet in cells; a cell stores its sets in a prefix tree, and each of them walks down the
tree once, sharing the overlap with all sets that begin alike. A subtree is left as soon as
what remains of its longest set, or of the walking set, can't reach the overlap needed.

Who may be alike: the n-grams are dealt into classes by hash, more classes than the n-grams
in which two linked sets can differ. Then some class holds the same n-grams in both, and its
hash is a common signature: a link never lacks one. Classes that are empty, hold only n-grams
that many texts have, or hold few, say little, so there are more classes than that, and each set
leaves out as many as were added, its weakest. Which n-grams are taken for frequent is told by a
sample; any choice gives the same links, a good one fewer candidates.

Equal sets are joined as one. The result is the classes of linked texts, so of links in a
cell only a spanning forest is reported. Clusters of signature sharers are dealt to cells of
bounded size: first at random, each cell with the cluster's first member; then, where a
large cluster has fallen into several classes, all members against those outside its largest class,
block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewops.llm import scan, store
from reviewops.llm.components import components

CELL = 128
#: Members of a block when a cluster is joined block by block: a member goes to as many cells as there are blocks.
BLOCK = 512
_NODE = 32
_BATCH_PAIRS = 1 << 15
_BATCH_TOKENS = 1 << 19
_STEP_TOKENS = 1 << 19
_MARK_BITS = 22


@dataclass(frozen=True)
class Rule:
    """Words an n-gram, and the least share of common ones, num / den."""

    n: int = 5
    num: int = 80
    den: int = 100

    def needed(self, size, other):
        """Least overlap of linked sets of these sizes."""
        return -(-self.num * (size + other) // (self.num + self.den))

    def longest(self, size: int) -> int:
        """Size of the largest set that can be linked with one of ``size``."""
        return size * self.den // self.num


class Signer:
    """Signatures of sets. Sizes fall into bands; a link is found in the band of its smaller set."""

    def __init__(self, rule: Rule, frequent: np.ndarray = np.empty(0, dtype=np.uint64)):
        """frequent: ascending."""
        self.rule, self.frequent = rule, frequent
        self.bounds, self.schemes = [1], []
        self.marks = np.zeros(1 << _MARK_BITS, dtype=bool)  # most n-grams are told from frequent ones without a search
        self.marks[frequent >> np.uint64(64 - _MARK_BITS)] = True

    def _bound(self, band: int) -> int:
        """Smallest size of the band."""
        while len(self.bounds) <= band:
            low = self.bounds[-1]
            self.bounds.append(max(low + 1, self.rule.longest(low - 1) + 1, low * 5 // 4))
        return self.bounds[band]

    def _scheme(self, band: int) -> tuple[int, int]:
        """Number of classes, and the number of weak classes that a set leaves out."""
        while len(self.schemes) <= band:
            low, most = self._bound(len(self.schemes)), self._bound(len(self.schemes) + 1) - 1
            other = self.rule.longest(most)
            differing = (most + other) * (self.rule.den - self.rule.num) // (self.rule.den + self.rule.num)
            weak, classes = 0, differing + 1
            if differing:
                for _ in range(3):
                    weak = int(np.ceil(2 * classes * np.exp(-low / classes) + 0.15 * differing)) + 3
                    classes = differing + 1 + weak
            self.schemes.append((classes if differing else 0, weak))
        return self.schemes[band]

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """grams: one set, ascending."""
        return self.of_sets(grams, np.array([len(grams)]))[0]

    def of_sets(self, grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of many sets, given one after the other, none empty, and the place of the set that each is of."""
        while self.bounds[-1] <= sizes.max(initial=0):
            self._bound(len(self.bounds))
        bands = np.searchsorted(self.bounds, sizes, side="right") - 1
        rare = ~self.marks[grams >> np.uint64(64 - _MARK_BITS)]
        likely = np.flatnonzero(~rare)
        if len(likely):
            found = grams[likely]
            rare[likely] = self.frequent[np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)] != found
        longest = np.array([self.rule.longest(x - 1) for x in self.bounds])
        below = (bands > 0) & (sizes <= longest[bands])
        also = np.repeat(below, sizes)
        one, of_one = self._of(grams, sizes, bands, rare)
        two, of_two = self._of(grams[also], sizes[below], bands[below] - 1, rare[also])
        return np.concatenate([one, two]), np.concatenate([of_one, np.flatnonzero(below)[of_two]])

    def _of(self, grams: np.ndarray, sizes: np.ndarray, bands: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In one band for each set, without its weakest classes: as many as may be left out, but none as strong as one that stays.

        Linked sets hold the same in more classes than either leaves out. Equal classes are equally strong, so one that
        the set of the higher limit keeps is kept by the other too.
        """
        schemes = np.array([self._scheme(x) for x in range(bands.max(initial=-1) + 1)], dtype=np.int64).reshape(-1, 2)
        classes, spare = schemes[bands].T
        starts = np.cumsum(classes) - classes
        total = int(classes.sum())
        if not total:  # only equal sets can be linked
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        if not classes.all():
            some = np.repeat(classes > 0, sizes)
            grams, rare, sizes = grams[some], rare[some], np.where(classes > 0, sizes, 0)
        mixed = scan.mix(grams + np.repeat(np.uint64(0x632BE59BD9B4E019) + bands.astype(np.uint64), sizes))
        dealt = (mixed >> np.uint64(32)) * np.repeat(classes.astype(np.uint64), sizes) >> np.uint64(32)
        slot = dealt.astype(np.int64) + np.repeat(starts, sizes)
        low, high = ((x.astype(np.float64)) for x in (mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32)))  # sums of halves are exact
        sums = np.bincount(slot, low, total).astype(np.uint64) + (np.bincount(slot, high, total).astype(np.uint64) << np.uint64(32))
        strength = np.minimum(np.bincount(slot[rare], minlength=total), 255) * 256 + np.minimum(np.bincount(slot, minlength=total), 255)
        owner = np.repeat(np.arange(len(sizes)), classes)
        there = np.flatnonzero(classes > 0)
        ordered = np.sort(owner << 16 | strength)
        limit = np.zeros(len(sizes), dtype=np.int64)
        limit[there] = ordered[starts[there] + spare[there]] & 0xFFFF
        kept = np.flatnonzero(strength >= limit[owner])
        owner = owner[kept]
        name = (kept - starts[owner]).astype(np.uint64) * np.uint64(1 << 20) + bands[owner].astype(np.uint64)
        return scan.mix(sums[kept] + scan.mix(name)), owner


def _sets(batch: pa.RecordBatch, column: str, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of some rows at a time: the first row, the ascending distinct n-gram hashes of each text, one after the other, and
    how many each has. Of texts shorter than an n-gram all words are one."""
    at_row = 0
    for part in scan.pieces(batch, column):
        words = scan.Words(*scan.texts(part.column(column), lower=True))
        hashes = words.hashes()
        at, grams = words.runs(hashes, n)
        short = np.flatnonzero((words.counts > 0) & (words.counts < n))
        here = words.first[short]
        sizes = np.maximum(words.counts - n + 1, 0)
        sizes[short] = 1
        if len(short):
            grams = np.concatenate([grams, scan._spans(hashes, here, here + words.counts[short], scan._STEP_BASES[1])])
            grams = grams[np.argsort(np.concatenate([words.text[at], short]), kind="stable")]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            grams[a:b].sort()
        new = np.ones(len(grams), dtype=bool)
        new[1:] = grams[1:] != grams[:-1]
        new[ends[:-1][sizes > 0]] = True
        yield at_row, grams[new], np.diff(np.concatenate([[0], np.cumsum(new)])[ends])
        at_row += part.num_rows


def _classes(grams: np.ndarray, sizes: np.ndarray, flip: int = 0) -> np.ndarray:
    """64 bits of hash of each set, 0 of an empty one; with two values of ``flip`` equal sets are one class."""
    some = sizes > 0
    out = np.zeros(len(sizes), dtype=np.uint64)
    if some.any():
        out[some] = np.add.reduceat(scan.mix(grams ^ np.uint64(flip)), (np.cumsum(sizes) - sizes)[some])
    return out.view(np.int64)


def _described(rule: Rule):
    def run(batches):
        for batch in batches:
            for row, grams, sizes in _sets(batch, "text", rule.n):
                yield pa.record_batch([batch.column(0).slice(row, len(sizes)), pa.array(sizes, pa.int64()), pa.array(_classes(grams, sizes)),
                                       pa.array(_classes(grams, sizes, 0xA5A5A5A5A5A5A5A5))], names=["key", "size", "h1", "h2"])
    return run


def _views(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value of a binary column, not copied."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset:column.offset + len(column) + 1].tolist()
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return (data[a:b] for a, b in zip(ends[:-1], ends[1:]))


def _stars(signatures: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signatures, the smallest class of each, and edges from it to the others, as rows."""
    order = np.argsort(signatures)
    signatures, classes = signatures[order], classes[order]
    new = np.ones(len(signatures), dtype=bool)
    new[1:] = signatures[1:] != signatures[:-1]
    first = np.flatnonzero(new)
    smallest = np.minimum.reduceat(classes, first) if len(first) else classes
    of = np.repeat(smallest, np.diff(np.append(first, len(classes))))
    other = np.flatnonzero(of != classes)
    edges = np.stack([of[other], classes[other]], 1)
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
    again = np.zeros(len(edges), dtype=bool)
    again[1:] = (edges[1:] == edges[:-1]).all(axis=1)
    return signatures[first], smallest, edges[~again]


_BLOBS = ["bucket", "signatures", "classes", "edges"]
_BLOB_ROWS = "bucket int, signatures binary, classes binary, edges binary"


def _listed(rule: Rule):
    def run(batches):
        for batch in batches:
            for _, grams, _ in _sets(batch, "text", rule.n):
                yield pa.record_batch([pa.array(grams.view(np.int64))], names=["gram"])
    return run


def _frequent(texts: DataFrame, rule: Rule, one_in: int = 16, least: int = 3, most: int = 500_000) -> np.ndarray:
    """N-grams of ``least`` or more texts of a sample of one in ``one_in``, at most ``most``, ascending."""
    sample = texts.where(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0)
    found = (sample.mapInArrow(_listed(rule), "gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
             .orderBy(F.desc("n"), "gram").limit(most).select("gram").toPandas())
    return np.sort(found["gram"].to_numpy(np.int64).view(np.uint64))


def _signed(rule: Rule, buckets: int, shared, unit: int = 500_000):
    """Signatures by bucket of their hash, each with one class: a unit's other classes of a signature are edges already."""
    def run(batches):
        signer = Signer(rule, shared.value)
        waiting, classes, held = [], [], 0

        def out():
            signatures, smallest, edges = _stars(np.concatenate(waiting), np.concatenate(classes))
            bucket = ((signatures >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            n = len(found)
            return pa.record_batch([
                pa.array(found, pa.int32()), pa.array([x.astype("<u8").tobytes() for x in np.split(signatures[order], first[1:])][:n], pa.binary()),
                pa.array([x.astype("<i8").tobytes() for x in np.split(smallest[order], first[1:])][:n], pa.binary()),
                pa.array([edges.astype("<i8").tobytes() if i == 0 else b"" for i in range(n)], pa.binary())], names=_BLOBS)

        for batch in batches:
            for _, grams, sizes in _sets(batch, "text", rule.n):
                signatures, of = signer.of_sets(grams, sizes[sizes > 0])
                waiting.append(signatures)
                classes.append(_classes(grams, sizes[sizes > 0])[of])
                held += len(signatures)
                if held > unit:
                    yield out()
                    waiting, classes, held = [], [], 0
        if held:
            yield out()
    return run


def _shared(batches) -> Iterator[pa.RecordBatch]:
    """Signatures of whole buckets, in their order, to edges between the classes that share one."""
    name, parts = None, []

    def edges(found: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate([np.empty((0, 2), dtype=np.int64), *found])
        return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def out():
        return _stars(np.concatenate([s for s, _ in parts]), np.concatenate([c for _, c in parts]))[2]

    for batch in batches:
        found = []
        columns = [_views(batch.column(i)) for i in (1, 2, 3)]
        for bucket, signatures, classes, local in zip(batch.column(0).to_pylist(), *columns):
            if bucket != name:
                if parts:
                    found.append(out())
                name, parts = bucket, []
            parts.append((signatures.view("<u8"), classes.view("<i8")))
            found.append(local.view("<i8").reshape(-1, 2).copy())
        yield edges(found)
    if parts:
        yield edges([out()])


class Forest:
    """Disjoint sets of small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class Trie:
    """Prefix trees of the sets of some cells, one tree a cell. Paths without a branch are nodes of up to 32 n-grams."""

    def __init__(self, cells: list[list[np.ndarray]], rule: Rule):
        self.rule = rule
        self.sets: list[np.ndarray] = []
        self.origin: list[int] = []  # place of each set in the order given
        node: list[list[int]] = []  # first token, tokens, depth after, first leaf, end of leaves
        children: list[list[int]] = []
        self.roots: list[tuple[int, int, int]] = []
        given = 0
        starts = [0]
        for cell in cells:
            order = sorted(range(len(cell)), key=lambda i: cell[i].astype(">u8").tobytes())
            first = len(self.sets)
            for i in order:
                self.sets.append(cell[i])
                self.origin.append(given + i)
                starts.append(starts[-1] + len(cell[i]))
            given += len(cell)
            common = [0] * len(cell)  # length of the common beginning with the set before
            for i in range(1, len(cell)):
                a, b = self.sets[first + i - 1], self.sets[first + i]
                k = min(len(a), len(b))
                differ = np.flatnonzero(a[:k] != b[:k])
                common[i] = int(differ[0]) if len(differ) else k
            self.roots.append((len(node), first, first + len(cell)))
            todo = [(first, first + len(cell), 0, -1)]
            while todo:
                low, high, depth, parent = todo.pop()
                shared = common[low - first + 1:high - first]
                end = min(shared) if shared else len(self.sets[low])
                while True:
                    step = min(end, depth + _NODE)
                    node.append([starts[low] + depth, step - depth, step, low, high])
                    children.append([])
                    if parent >= 0:
                        children[parent].append(len(node) - 1)
                    parent, depth = len(node) - 1, step
                    if depth == end:
                        break
                if high - low > 1:
                    cuts = [low, *(low + 1 + k for k, x in enumerate(shared) if x == end), high]
                    todo.extend((a, b, end, parent) for a, b in zip(cuts[:-1], cuts[1:]))
        self.starts = np.array(starts)
        self.sizes = np.diff(self.starts)
        tokens = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        kinds, self.tokens = np.unique(tokens, return_inverse=True)
        self.kinds = len(kinds) + 1
        self.keys = np.repeat(np.arange(len(self.sets)), self.sizes) * self.kinds + self.tokens
        self.node = np.array(node, dtype=np.int64).reshape(-1, 5)
        self.child_ends = np.concatenate([[0], np.cumsum([len(c) for c in children])]).astype(np.int64)
        self.child = np.array([x for c in children for x in c], dtype=np.int64)
        self.least = np.array([self.sizes[a:b].min() for _, _, _, a, b in node], dtype=np.int64)
        self.most = np.array([self.sizes[a:b].max() for _, _, _, a, b in node], dtype=np.int64)

    def links(self) -> list[tuple[int, int]]:
        """Pairs of linked sets, by the places given."""
        found: list[tuple[int, int]] = []
        frontier = [(np.full(b - a, root), np.arange(a, b), np.zeros(b - a, dtype=np.int64), self.sizes[a:b].copy()) for root, a, b in self.roots if b - a > 1]
        if not frontier:
            return found
        todo = [tuple(np.concatenate(x) for x in zip(*frontier))]
        while todo:
            step = todo.pop()
            node, walker, overlap, rest = step
            first, length, depth, low, high = self.node[node].T
            total = int(length.sum())
            if total > _STEP_TOKENS and len(node) > 1:  # bounds what a step holds
                half = len(node) // 2
                todo += [tuple(x[half:] for x in step), tuple(x[:half] for x in step)]
                continue
            if total:
                owner = np.repeat(np.arange(len(node)), length)
                within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
                wanted = walker[owner] * self.kinds + self.tokens[first[owner] + within]
                at = np.searchsorted(self.keys, wanted)
                hit = self.keys[np.minimum(at, len(self.keys) - 1)] == wanted
                overlap = overlap + np.bincount(owner, hit, minlength=len(node)).astype(np.int64)
                last = np.cumsum(length) - 1
                rest = np.where(length > 0, self.starts[walker + 1] - at[last] - hit[last], rest)
            reach = overlap + np.minimum(self.most[node] - depth, rest)
            alive = (high - 1 > walker) & (reach >= self.rule.needed(self.sizes[walker], self.least[node]))
            leaf = alive & (high - low == 1) & (depth == self.sizes[low])
            for a, b in zip(walker[leaf].tolist(), low[leaf].tolist()):
                found.append((self.origin[a], self.origin[b]))
            go = alive & ~leaf
            node, walker, overlap, rest = node[go], walker[go], overlap[go], rest[go]
            number = self.child_ends[node + 1] - self.child_ends[node]
            owner = np.repeat(np.arange(len(node)), number)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
            if len(owner):
                todo.append((self.child[self.child_ends[node][owner] + within], walker[owner], overlap[owner], rest[owner]))
        return found


def _forest(cells: list[list[tuple[int, np.ndarray]]], rule: Rule) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of each cell's links."""
    names = [key for cell in cells for key, _ in cell]
    forest = Forest(len(names))
    pairs = [(x, y) for x, y in Trie([[g for _, g in cell] for cell in cells], rule).links() if forest.join(x, y)]
    return [names[x] for x, _ in pairs], [names[y] for _, y in pairs]


def _joined(rule: Rule):
    """Rows (cluster, a, b, key, grams), sorted by cell, to edges."""
    def run(batches):
        cells, pairs, tokens, name = [], 0, 0, None

        def out():
            left, right = _forest(cells, rule)
            return pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        for batch in batches:
            for *cell, key, grams in zip(*(batch.column(i).to_pylist() for i in range(4)), _views(batch.column(4))):
                if cell != name:
                    if cells:
                        pairs += len(cells[-1]) ** 2
                    if pairs > _BATCH_PAIRS or tokens > _BATCH_TOKENS:
                        yield out()
                        cells, pairs, tokens = [], 0, 0
                    cells.append([])
                    name = cell
                tokens += len(grams) // 8
                cells[-1].append((key, grams.view("<u8").copy()))
        if cells:
            yield out()
    return run


def _grams_of(rule: Rule):
    def run(batches):
        for batch in batches:
            for row, grams, sizes in _sets(batch, "text", rule.n):
                ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(grams.astype("<u8"))])
                yield pa.record_batch([batch.column(0).slice(row, len(sizes)), batch.column(2).slice(row, len(sizes)), sets], names=["key", "cells", "grams"])
    return run


_CELLS = "array<struct<cluster: bigint, a: int, b: int>>"


def _cell_edges(texts: DataFrame, placed: DataFrame, rule: Rule) -> DataFrame:
    """placed: rows (key, cells). The texts of the keys meet in their cells."""
    grams = (texts.join(placed, "key").select("key", "text", "cells").mapInArrow(_grams_of(rule), f"key bigint, cells {_CELLS}, grams binary")
             .select(F.explode("cells").alias("c"), "key", "grams").select("c.cluster", "c.a", "c.b", "key", "grams"))
    return store.kept(grams.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "key").mapInArrow(_joined(rule), "a bigint, b bigint"), "jaccard-links")


def _block(key: str, blocks, seed: int):
    return F.pmod(F.xxhash64(key, F.lit(seed)), blocks).cast("int")


def _linked(texts: DataFrame, sets: DataFrame, same: DataFrame, rule: Rule, cell: int) -> DataFrame:
    """Edges that connect all sets linked with one another, unequal ones; same: (size, h1, h2, representative)."""
    grams = sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(64, grams // 1_000_000)
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent(texts, rule))  # 4 MB at most
    signed = texts.where("key is not null").mapInArrow(_signed(rule, buckets, frequent), _BLOB_ROWS)
    shared = signed.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_shared, "a bigint, b bigint")
    # clusters are made of classes, named by half of their hash; each class is then its smallest key
    likely = components(shared).withColumnsRenamed({"vertex": "h1", "component": "cluster"})
    likely = store.kept(same.join(likely, "h1").select(F.col("representative").alias("key"), "h1", "cluster"), "jaccard-clusters")
    sizes = store.kept(likely.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "jaccard-sizes")

    blocks = F.ceil(F.col("n") / cell).cast("int")
    in_cell = lambda a, b: F.struct(F.col("cluster"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    first = likely.join(sizes, "cluster").select("key", F.when(
        F.col("h1") == F.col("cluster"), F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: in_cell(i, F.lit(-1))))
        .otherwise(F.array(in_cell(_block("key", blocks, 1), F.lit(-1)))).alias("cells"))
    edges = _cell_edges(texts, first, rule)

    # clusters of several cells whose members are not all connected yet
    large = sizes.where(F.col("n") > cell)
    if large.isEmpty():
        return edges
    classes = likely.join(large, "cluster").join(components(edges).withColumnRenamed("vertex", "key"), "key", "left").select(
        "key", "cluster", "n", F.coalesce("component", "key").alias("class"))
    classes = store.kept(classes, "jaccard-classes")
    main = (classes.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("cluster").agg(F.max_by("class", F.struct("c", "class")).alias("main"), F.max("c").alias("c")))
    open_ = store.kept(classes.join(main, "cluster").where("c < n"), "jaccard-open")
    if open_.isEmpty():
        return edges
    half = max(1, min(BLOCK, 4 * cell) // 2)
    rows, columns = F.ceil((F.col("n") - F.col("c")) / half).cast("int"), F.ceil(F.col("n") / half).cast("int")
    outside = F.col("class") != F.col("main")
    across = F.transform(F.sequence(F.lit(0), rows - 1), lambda i: in_cell(i, _block("key", columns, 2)))
    along = F.when(outside, F.transform(F.sequence(F.lit(0), columns - 1), lambda j: in_cell(_block("key", rows, 3), j))).otherwise(F.array().cast(_CELLS))
    second = open_.select("key", F.array_distinct(F.concat(across, along)).alias("cells"))
    return edges.unionAll(_cell_edges(texts, second, rule))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule(), cell: int = CELL) -> DataFrame:
    """Rows (key, n_shingles, component): size of the text's set, and the smallest key it reaches by links.

    ``key`` is a whole number. A text without words, null included, has an empty set and is
    linked with nothing; a text of fewer words than an n-gram has its whole words as one. A
    row without a key is linked with nothing and its component is null. Rows of one key are
    one vertex, whatever their texts; each gets a row of the result.
    """
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    sets = store.kept(texts.mapInArrow(_described(rule), "key bigint, size bigint, h1 bigint, h2 bigint"), "jaccard-sets")
    known = sets.where("size > 0 and key is not null")
    same = store.kept(known.groupBy("size", "h1", "h2").agg(F.min("key").alias("representative")), "jaccard-same")
    copies = known.join(same, ["size", "h1", "h2"]).select(F.col("representative").alias("a"), F.col("key").alias("b"))
    edges = _linked(texts, sets, same, rule, cell).unionAll(copies)
    found = components(edges).withColumnRenamed("vertex", "key")
    return (sets.select("key", F.col("size").alias("n_shingles")).join(found, "key", "left")
            .select("key", "n_shingles", F.coalesce("component", "key").alias("component")))


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule(), cell: int = CELL) -> DataFrame:
    """The documents, with their own columns, without those linked to one of a smaller key."""
    names = docs.columns
    mark = "_component"
    while mark in names:
        mark += "_"
    found = linked(docs, key, text, rule, cell).where("component < key").select(F.col("key").alias(mark)).distinct()
    found = store.kept(found, "jaccard-dropped")
    return docs.join(found, F.col(f"`{key}`") == F.col(mark), "left_anti")
