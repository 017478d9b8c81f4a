"""Phrases that stick together, of each language.

Every word begins a suffix of its piece of text, cut after four words. Suffixes are routed globally
by their leading word, and each route is sorted by a multikey three-way quicksort of suffix
pointers: a segment is parted by one word into smaller, equal and greater pointers; the equal part is a
phrase, its size the phrase's count, and goes on with the next word. Parts below the least
count are abandoned at once, at whatever depth. All segments of a round are parted together, in numpy.

Routes of more suffixes than a task should hold are routed again by two, three and at last four
leading words, so a word or phrase that a third of all text holds is spread too; the counts of
phrases shorter than their route are added up over its parts. Each block of text sends equal
suffixes as one with a count, as numbers with the words they stand for.

Scores, cuts and the phrases dropped for longer ones are joins of the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from reviewops.llm import scan, store
from reviewops.operators.groups import first_n

LONGEST = 4
LEAST = 30
TOP = 2000
#: A phrase goes if a longer one has 80 of 100 of its occurrences.
SHARE = 80
SCALE = 2_000_000

#: Characters that end a piece, and those that only end a word.
STOP = np.zeros(256, dtype=bool)
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = STOP.copy()
GAP[[0x20, 0x09]] = True

#: Text that is numbered at once, and suffixes that a route should have and may have.
BLOCK = 1 << 23
ROUTE = 750_000
LARGEST = 1_500_000
#: Text bytes to a route; at first no more than MOST_ROUTES are made, the rest by routing again.
ROUTE_BYTES = 1 << 23
MOST_ROUTES = 4096

_SCHEMA = "lang string, route string, suffixes bigint, total bigint, words binary, ids binary, counts binary"


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and for every word occurrence a row of the numbers of the ``LONGEST`` words from there on; -1 behind the piece's end."""
    data, ends = scan.texts(texts, lower=True)
    words = scan.Words(data, ends, GAP)
    n = len(words.starts)
    if not n:
        return pa.array([], pa.binary()), np.empty((0, LONGEST), dtype=np.int32)
    spans = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(words.stops - words.starts, out=spans[1:])
    coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(data[~GAP[data]]))]).dictionary_encode()
    ids = coded.indices.to_numpy()
    stops = np.searchsorted(np.flatnonzero(STOP[data]), words.starts)
    piece = np.zeros(n, dtype=np.int64)
    np.cumsum((np.diff(stops) != 0) | (np.diff(words.text) != 0), out=piece[1:])
    rows = np.full((n, LONGEST), -1, dtype=np.int32)
    rows[:, 0] = ids
    for d in range(1, min(LONGEST, n)):
        same = piece[d:] == piece[:-d]
        rows[:-d, d] = np.where(same, ids[d:], -1)
    return coded.dictionary, rows


def _united(rows: np.ndarray, counts: np.ndarray | None, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, with how often they occur."""
    key, top, base = rows[:, 0].astype(np.int64), kinds, kinds + 1
    for d in range(1, rows.shape[1]):
        if top * base >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            top = len(values)
        key, top = key * base + rows[:, d] + 1, top * base
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else np.empty(0, dtype=np.int64)
    if counts is None:
        sums = np.diff(np.append(first, len(order)))
    else:
        sums = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, dtype=np.int64)
    return rows[order[first]], sums.astype(np.int64)


def _blobs(lang, words: pa.Array, rows: np.ndarray, counts: np.ndarray, depth: int, routes: int, above: str) -> Iterator[tuple]:
    """Rows of ``_SCHEMA``, one for each route: suffixes go by the hash of their first ``depth`` words."""
    if not len(rows):
        return
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    hashes = np.append(scan.hashes_of(np.frombuffer(data, dtype=np.uint8), ends[:-1], ends[1:]), np.uint64(0))  # the last is of -1
    leading = hashes[rows[:, 0]]
    for d in range(1, depth):
        leading = scan.mix(leading * np.uint64(0x9E3779B97F4A7C15) + hashes[rows[:, d]])
    route = (scan.mix(leading + np.uint64(depth)) % np.uint64(routes)).astype(np.int64)
    order = np.argsort(route, kind="stable")
    rows, counts, route = rows[order], counts[order], route[order]
    cuts = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1], [True])))
    packer = zstandard.ZstdCompressor(level=1)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        here = rows[a:b].T + 1  # 0 is the end
        used = np.zeros(len(words) + 1, dtype=bool)
        used[here], used[0] = True, True
        ids = (np.cumsum(used, dtype=np.int32) - 1)[here]
        used = np.flatnonzero(used)[1:] - 1
        kind = np.uint16 if len(used) < 1 << 16 else np.uint32
        ones = counts[a:b].max() == 1
        # rows are in order, so the leading words' column is runs
        yield (lang, f"{above}{int(route[a])}/", b - a, int(counts[a:b].sum()), packer.compress(b"\n".join(words.take(pa.array(used)).to_pylist())),
               packer.compress(ids.astype(kind).tobytes()), b"" if ones else packer.compress(counts[a:b].astype(np.int64).tobytes()))


def _gathered(blobs: list[tuple]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, rows and counts of several blobs (suffixes, words, ids, counts), numbered alike."""
    unpack = zstandard.ZstdDecompressor().decompress
    lists = [unpack(b[1]).split(b"\n") for b in blobs]
    coded = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
    numbers, at, rows, counts = coded.indices.to_numpy(), 0, [], []
    for (n, _, ids, several), ws in zip(blobs, lists):
        local = np.append(np.int32(-1), numbers[at:at + len(ws)]).astype(np.int32)
        at += len(ws)
        ids = unpack(ids)
        kind = np.uint16 if len(ids) == 2 * LONGEST * n else np.uint32
        rows.append(local[np.frombuffer(ids, dtype=kind).reshape(LONGEST, n).T])
        counts.append(np.frombuffer(unpack(several), dtype=np.int64) if several else np.ones(n, dtype=np.int64))
    return coded.dictionary, np.concatenate(rows), np.concatenate(counts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "route", "suffixes", "total", "words", "ids", "counts"])


def _sent(routes: int):
    """Texts to suffixes by route."""
    def run(batches):
        for batch in batches:
            for piece in scan.pieces(batch, "text", BLOCK):
                langs = piece.column("lang")
                out = []
                for lang in pc.unique(langs).to_pylist():
                    words, rows = _numbered(piece.column("text").filter(pc.equal(langs, lang)))
                    rows, counts = _united(rows, None, len(words))
                    out.extend(_blobs(lang, words, rows, counts, 1, routes, ""))
                yield _batch(out)
    return run


def _runs(batches, most: int) -> Iterator[tuple]:
    """Blobs of rows sorted by (lang, route), in lists of one route and, if ``most`` is given, of about that many suffixes; with further columns of the first."""
    where, held, size = None, [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            lang, route, suffixes, _, words, ids, counts, *more = row
            if held and ((lang, route) != where[:2] or (most and size + suffixes > most)):
                yield where, held
                held, size = [], 0
            where = (lang, route, *more)
            held.append((suffixes, words, ids, counts))
            size += suffixes
    if held:
        yield where, held


def _rerouted(batches):
    for (lang, route, parts), blobs in _runs(batches, ROUTE):
        words, rows, counts = _gathered(blobs)
        rows, counts = _united(rows, counts, len(words))
        yield _batch(list(_blobs(lang, words, rows, counts, route.count("/") + 1, parts, route)))


def quicksorted(rows: np.ndarray, counts: np.ndarray, least: int, routed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of at least ``least`` occurrences: (a row that begins with it, its words, its count).

    Rows agree in a route if their first ``routed`` words do; counts of shorter phrases are
    only part of the whole, so these are listed with any count.
    """
    width = rows.shape[1]
    flat = np.ascontiguousarray(rows).ravel()
    pointers = np.arange(len(rows), dtype=np.int32)
    starts, sizes, depth = np.array([0]), np.array([len(rows)]), np.array([0])
    found: list[tuple] = []
    turn = 0
    while len(pointers):
        turn += 1
        of = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        keys = flat[pointers * np.int64(width) + depth[of]]
        # any pointer of a segment may be the pivot; where it stands is drawn anew each turn
        drawn = scan.mix(starts.astype(np.uint64) + np.uint64(turn << 32)) % sizes.astype(np.uint64)
        pivots = keys[starts + drawn.astype(np.int64)]
        against = pivots[of]
        part = (keys > against).astype(np.int8) + (keys >= against)  # 0 smaller, 1 equal, 2 greater
        place = np.empty(len(pointers), dtype=np.int32)
        children = np.zeros((len(starts), 3), dtype=np.int64)
        for p in range(3):
            mine = part == p
            running = np.cumsum(mine, dtype=np.int32)
            before = np.where(starts > 0, running[starts - 1], 0)
            children[:, p] = running[starts + sizes - 1] - before
            at = np.flatnonzero(mine)
            place[at] = (starts + children[:, :p].sum(axis=1) - 1 - before)[of[at]] + running[at]
        moved = np.empty_like(pointers)
        moved[place] = pointers
        child_sizes = children.ravel()
        child_starts = np.cumsum(child_sizes) - child_sizes  # segments lie one after the other
        some = child_sizes > 0
        weight = np.zeros(len(child_sizes), dtype=np.int64)
        weight[some] = np.add.reduceat(counts[moved], child_starts[some])
        child_depth = np.repeat(depth, 3)
        equal = np.tile(np.array([False, True, False]), len(starts))
        ended = equal & (np.repeat(pivots, 3) < 0)
        child_depth = child_depth + equal
        listed = equal & ~ended & ((weight >= least) | (child_depth < routed))
        found.append((moved[child_starts[listed]], child_depth[listed], weight[listed]))
        further = some & ~ended & (child_depth < width) & ((weight >= least) | (child_depth + 1 < routed))
        pointers = moved[np.repeat(further, child_sizes)]
        sizes, depth = child_sizes[further], child_depth[further]
        starts = np.cumsum(sizes) - sizes
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _counted(least: int):
    """Suffixes, sorted by route, to phrases (lang, phrase, words, count)."""
    def run(batches):
        for (lang, route), blobs in _runs(batches, 0):
            words, rows, counts = _gathered(blobs)
            at, length, count = quicksorted(rows, counts, least, route.count("/"))
            order = np.argsort(length, kind="stable")
            at, length, count = at[order], length[order], count[order]
            for k in range(1, LONGEST + 1):
                a, b = np.searchsorted(length, [k, k + 1])
                if a < b:
                    chosen = rows[at[a:b]]
                    parts = [words.take(pa.array(chosen[:, d])) for d in range(k)]
                    phrase = pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]
                    yield pa.record_batch([pa.array([lang] * (b - a), pa.string()), phrase.cast(pa.string()),
                                           pa.array(np.full(b - a, k, dtype=np.int32)), pa.array(count[a:b])], names=["lang", "phrase", "words", "f"])
    return run


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, phrase, words, f) of all phrases of 1 to 4 words that occur ``least`` times or more, and rows (lang, n), all word occurrences.

    A-Z are lower-cased; full stops, commas, semicolons, colons, exclamation and question marks and line
    ends part pieces; spaces and tabs part words; all else belongs to words. Null is the language ``und``; null and
    empty texts have no words. Repeated rows count each. Whole texts are taken, whatever their length.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = min(MOST_ROUTES, max(1, size // ROUTE_BYTES))
    sent = store.kept(rows.where("text is not null").mapInArrow(_sent(routes), _SCHEMA), "phrase-suffixes")
    totals, routed = sent.groupBy("lang").agg(F.sum("total").alias("n")), []
    for _ in range(1, LONGEST):
        large = store.kept(sent.groupBy("lang", "route").agg(F.sum("suffixes").alias("s")).where(F.col("s") > LARGEST)
                           .select("lang", "route", F.least(F.ceil(F.col("s") / ROUTE), F.lit(MOST_ROUTES)).cast("int").alias("parts")), "phrase-routes")
        if large.isEmpty():
            break
        again = sent.join(large, ["lang", "route"]).withColumn("_turn", F.pmod(F.xxhash64("ids"), F.ceil(F.col("parts") / 16)))
        again = again.repartition("lang", "route", "_turn").sortWithinPartitions("lang", "route").drop("_turn").select(*sent.columns, "parts")
        routed.append(sent.join(large, ["lang", "route"], "left_anti").select(*sent.columns))
        sent = store.kept(again.mapInArrow(_rerouted, _SCHEMA), "phrase-suffixes")
    for rest in routed:
        sent = sent.unionAll(rest)
    counted = sent.repartition("lang", "route").sortWithinPartitions("lang", "route").mapInArrow(
        _counted(least), "lang string, phrase string, words int, f bigint")
    whole = counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return store.kept(whole, "phrases"), totals


def _part(first: Column, length: Column) -> Column:
    """``length`` words of the phrase from word ``first`` on, counted from 0."""
    return F.call_function("substring_index", F.call_function("substring_index", "phrase", F.lit(" "), first + length), F.lit(" "), -length)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 4 words of each language.

    ``a``, ``l`` and ``r`` count the phrase and what is before and behind its weakest cut;
    score = floor(2000000 * a / (l + r)) of that cut, the first of equal ones. A phrase inside a longer candidate that has
    ``share`` of 100 of its occurrences is dropped. Equal scores go by count, then by the bytes of the phrase.
    Arithmetic is exact: sums in bigint, products in decimals of 38 digits.
    """
    counts, totals = phrases(docs, text, lang, least)
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", _part(F.lit(0), F.col("k")).alias("first"), _part(F.col("k"), F.col("words") - F.col("k")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + r)")
    weakest = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
               .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))

    inner = candidates.where("words > 2").select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("length"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("length"))).alias("at"))
    covers = inner.groupBy("lang", _part(F.col("at"), F.col("length")).alias("phrase")).agg(F.max("a").alias("longer"))
    stays = weakest.join(covers, ["lang", "phrase"], "left").where(
        F.expr(f"longer IS NULL OR CAST(100 AS DECIMAL(10,0)) * CAST(longer AS DECIMAL(20,0)) < CAST({share} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))"))

    flat = stays.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = first_n(flat, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
