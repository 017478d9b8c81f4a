"""Mixing of sources to target weights, in DataFrame functions alone.

The words of each source, document after document, are packed into blocks of fixed length.
The mix is a row of output shards with as many slots each; a slot takes one block. For each
shard, source counts are drawn from the multinomial distribution given by the targets. A
source's slots, numbered through all shards, are mapped through a pseudorandom permutation
of its blocks: none is taken again before all have been taken. The last block of a source may be
short; its place in the order is fixed beforehand, so that the words of any number of slots are
known. Slots and blocks of documents are joined by block index.

Draws scatter around the targets. What a source is given beyond its target goes, slot by slot,
to sources below theirs, so that totals meet the targets within a block.

Everything is drawn from hashes: reruns agree. No group has to fit into a task, nor all sources:
running totals are made in hash buckets, runs of shards or ranges of sources first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewops.llm import store

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 32
SHARD = 4096
MOST = 3
_BUCKETS = 1024
#: Sources that are put in order in one task, slots to a task, and the most tasks that slots are dealt to.
_RANGE = 100_000
_SLOTS, _MOST_TASKS = 250_000, 50_000
#: Odd factors of the permutations' rounds.
_FACTORS = (714_025, 1_000_003, 583_277)


@dataclass(frozen=True)
class Mix:
    """``documents``: rows (key, size, source) with their place in the source; ``sources``: size, target, quota of each; ``draws``: the slots."""

    documents: DataFrame
    sources: DataFrame
    draws: DataFrame


def _before(value: str, *, by: list[str], order: list) -> Column:
    """Sum of ``value`` over the rows before."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _running(rows: DataFrame, order: list[Column], name: str, **sums: str) -> DataFrame:
    """The rows, kept, with sums over those before in a total order: ``sums`` names a column for each sum, ``place`` counts from 1.

    Rows are dealt by ranges of the order; only one row a range is added up in one task.
    """
    rows = store.kept(rows, name)
    ranges = rows.count() // _RANGE + 1
    dealt = store.kept(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), name)
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(value).alias(f"_{into}") for into, value in sums.items()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", *(F.coalesce(F.sum(f"_{x}").over(ahead), F.lit(0)).alias(f"_{x}") for x in ("n", *sums)))
    inside = dealt.select("*", F.row_number().over(Window.partitionBy("_range").orderBy(*order)).alias("_at"),
                          *(_before(value, by=["_range"], order=order).alias(f"_in_{into}") for into, value in sums.items()))
    return store.kept(inside.join(bases, "_range").select(
        *rows.columns, (F.col("_n") + F.col("_at")).alias("place"), *((F.col(f"_{x}") + F.col(f"_in_{x}")).alias(x) for x in sums)), name)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Rows (sid, source, source_size, weight, target, blocks, short_at, quota), one for each source.

    Sources in the order of their code points, null last, take the weights in turn and share
    the size of all of them. A target stops at ``most`` times the source's size and the excess
    goes to the others by weight, until none is above: the sources with the least room for
    their weight fill up first, and the level of the others follows from what these leave.
    The quota is the number of slots whose words, the short block counted as it is, come nearest
    to the target: half a block away at most.
    """
    numbered = _running(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.asc_nulls_last("source")], "mix-order")
    numbered = numbered.select("source", "source_size", F.col("place").cast("int").alias("sid"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("room", F.col("cap") / F.col("weight"))
    filled = _running(weighed, [F.asc("room"), F.asc("sid")], "mix-room", cap_before="cap", weight_before="weight")
    words, heaps = (x or 0 for x in filled.agg(F.sum("source_size"), F.sum("weight")).first())
    filled = filled.withColumn("level", (F.lit(words).cast("bigint") - F.col("cap_before")) / (F.lit(heaps).cast("bigint") - F.col("weight_before")))
    final = filled.where("room >= level").agg(F.min(F.struct("place", "level")).alias("final")).first().final
    cap = F.col("cap").cast("double")
    target = cap if final is None else F.when(F.col("place") < final.place, cap).otherwise(F.least(F.col("weight") * F.lit(final.level), cap))
    blocks = F.ceil(F.col("source_size") / block).cast("bigint")
    return (filled.withColumn("target", target).withColumn("blocks", blocks)
            .withColumn("short_at", F.pmod(F.xxhash64("sid", F.lit(block)), F.greatest("blocks", F.lit(1))))
            .select("sid", "source", "source_size", "weight", "target", "blocks", "short_at",
                    F.when(F.col("blocks") > 0, _quota(block)).otherwise(F.lit(0).cast("bigint")).alias("quota")))


def _quota(block: int) -> Column:
    """Full turns, and of the next turn as many slots as come nearest to the rest: without the short block, or with it."""
    turns = F.floor(F.col("target") / F.col("source_size")).cast("bigint")
    rest = F.col("target") - turns * F.col("source_size")
    lacks = F.col("blocks") * block - F.col("source_size")
    without = F.least(F.round(rest / block).cast("bigint"), F.col("short_at"))
    within = F.greatest(F.round((rest + lacks) / block).cast("bigint"), F.col("short_at") + 1)
    nearer = F.abs(without * block - rest) <= F.abs(within * block - lacks - rest)
    return turns * F.col("blocks") + F.when(nearer, without).otherwise(within)


def _placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words, and the word of the source that each begins at."""
    rows = (sizes.where("size > 0").alias("d").join(sources.select("sid", F.col("source").alias("s")).alias("s"), F.col("d.source").eqNullSafe(F.col("s.s")))
            .drop("s").withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(_BUCKETS))))
    totals = rows.groupBy("sid", "_bucket").agg(F.sum("size").alias("_size"))
    totals = totals.select("sid", "_bucket", _before("_size", by=["sid"], order=["_bucket"]).alias("_base"))
    inside = rows.withColumn("_inside", _before("size", by=["sid", "_bucket"], order=["key", "size"]))
    return inside.join(totals, ["sid", "_bucket"]).withColumn("begin", F.col("_base") + F.col("_inside")).drop("_base", "_inside", "_bucket")


def _permutation(sid: Column, n: Column) -> Column:
    """What ``_permuted`` needs of a source, worked out once for it."""
    bits = F.length(F.bin(n)) - 1
    rounds = [F.struct(F.lit(factor).cast("bigint").alias("factor"), F.pmod(F.xxhash64(sid, F.lit(turn)), F.lit(1 << 20)).alias("add"),
                       F.pmod(F.xxhash64(sid, F.lit(turn + 10)), n).alias("turn")) for turn, factor in enumerate(_FACTORS)]
    return F.struct((F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1).alias("mask"),
                    F.greatest(F.lit(1), F.floor((bits + 1) / 2).cast("int")).alias("half"), n.alias("n"), F.array(*rounds).alias("rounds"))


def _permuted(index: Column, plan: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, another for each source; n up to 2**43.

    Each round multiplies and shifts what lies below the largest power of two in n, which
    maps that range to itself, and then rotates the whole range. The aggregate binds the
    index, which a chain of expressions would work out anew at every use.
    """
    def turned(at: Column, r: Column) -> Column:
        mixed = (at * r["factor"] + r["add"]).bitwiseAND(plan["mask"])
        mixed = mixed.bitwiseXOR(F.call_function("shiftright", mixed, plan["half"]))
        return F.pmod(F.when(at <= plan["mask"], mixed).otherwise(at) + r["turn"], plan["n"])

    return F.aggregate(plan["rounds"], index, turned)


def _draws(sources: DataFrame, seed: int, shard: int) -> DataFrame:
    """Rows (shard, sid, turn, block): one for each slot; turn counts how often the block was taken before."""
    spark = sources.sparkSession
    slots, kinds = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    cells = max(1024, 4 * kinds)
    # the cell of a draw names the few sources that it may fall to
    ranges = _running(sources.where("quota > 0").select("sid", "quota"), [F.asc("sid")], "mix-ranges", low="quota").withColumn("high", F.col("low") + F.col("quota"))
    cell = f"CAST(%s * {cells} DIV {max(slots, 1)} AS bigint)"
    guide = (ranges.select("sid", "high", F.explode(F.sequence(F.expr(cell % "low"), F.expr(cell % "(high - 1)"))).alias("cell"))
             .groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("high", "sid"))).alias("maybe")))
    guide = store.kept(guide, "mix-guide")
    tasks = min(_MOST_TASKS, slots // _SLOTS + 1)
    drawn = (spark.range(0, slots, 1, max(tasks, spark.sparkContext.defaultParallelism)).select((F.col("id") / shard).cast("bigint").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(slots, 1))).alias("u"))
             .withColumn("cell", F.expr(cell % "u")).join(guide, "cell")
             .select("shard", F.filter("maybe", lambda x: F.col("u") < x["high"])[0]["sid"].alias("sid")))
    counts = store.kept(drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n")), "mix-counts")

    runs = counts.withColumn("_run", (F.col("shard") / 1024).cast("bigint"))
    totals = store.kept(runs.groupBy("sid", "_run").agg(F.sum("n").alias("_n")), "mix-runs")
    begun = totals.select("sid", "_run", _before("_n", by=["sid"], order=["_run"]).alias("_base"))
    given = totals.groupBy("sid").agg(F.sum("_n").alias("given"))
    state = (sources.select("sid", "quota", "blocks", "short_at").join(given, "sid", "left").fillna(0, ["given"])
             .withColumn("over", F.greatest(F.col("given") - F.col("quota"), F.lit(0))).withColumn("under", F.greatest(F.col("quota") - F.col("given"), F.lit(0))))
    state = _running(state, [F.asc("sid")], "mix-state", over_before="over", under_before="under").drop("place")
    state = store.kept(state.withColumn("plan", F.when(F.col("blocks") > 0, _permutation(F.col("sid"), F.greatest(F.col("blocks") - 1, F.lit(1))))), "mix-state")

    numbered = (runs.withColumn("_in", _before("n", by=["sid", "_run"], order=["shard"])).join(begun, ["sid", "_run"])
                .join(state, "sid").withColumn("begin", F.col("_base") + F.col("_in")).withColumn("end", F.col("begin") + F.col("n"))
                .repartition(tasks, "shard"))  # few rows, but each becomes many
    own = (numbered.where("begin < quota").select("shard", "sid", "blocks", "short_at", "plan", F.explode(F.sequence("begin", F.least("end", "quota") - 1)).alias("j")))
    # slots beyond a quota, numbered through all sources, go to the sources that have slots to come
    spare = (numbered.where("end > quota").select(
        "shard", F.explode(F.sequence(F.greatest("begin", "quota") - F.col("quota") + F.col("over_before"), F.col("end") - F.col("quota") + F.col("over_before") - 1)).alias("e")))
    wanting = state.where("under > 0").select("sid", "blocks", "short_at", "plan", "given", "under_before", F.explode(F.sequence("under_before", F.col("under_before") + F.col("under") - 1)).alias("e"))
    moved = spare.join(wanting, "e").select("shard", "sid", "blocks", "short_at", "plan", (F.col("given") + F.col("e") - F.col("under_before")).alias("j"))
    # the whole blocks are permuted around the place of the short one
    slots = own.unionByName(moved).withColumn("at", F.pmod("j", "blocks"))
    whole = F.col("at") - F.when(F.col("at") > F.col("short_at"), F.lit(1)).otherwise(F.lit(0))
    return slots.select("shard", "sid", (F.col("j") / F.col("blocks")).cast("bigint").alias("turn"),
                        F.when(F.col("at") == F.col("short_at"), F.col("blocks") - 1).otherwise(_permuted(whole, F.col("plan"))).alias("block"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, block: int = BLOCK, shard: int = SHARD) -> Mix:
    """Draw the mix. Null texts and texts without a word have size 0 and are never taken; null is a source of its own.

    Texts are read once, to count their words. Repeated rows are documents of their own.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    sizes = store.kept(docs.select(F.col(key).alias("key"), size.alias("size"), F.col(source).alias("source")), "mix-sizes")
    sources = store.kept(targets(sizes, block=block), "mix-sources")
    return Mix(sizes, sources, _draws(sources, seed, shard))


def _cut(placed: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words of: from which word of it on, and how many."""
    end = F.col("begin") + F.col("size")
    rows = placed.withColumn("block", F.explode(F.sequence((F.col("begin") / block).cast("bigint"), ((end - 1) / block).cast("bigint"))))
    low = F.greatest(F.col("begin"), F.col("block") * block)
    return rows.withColumn("first", low - F.col("begin")).withColumn("words", F.least(end, (F.col("block") + 1) * block) - low)


def spans(mixed: Mix, block: int = BLOCK) -> DataFrame:
    """The mix itself: rows (shard, turn, key, first, words), the words that every slot takes of each document in its block."""
    cut = _cut(_placed(mixed.documents, mixed.sources), block)
    return mixed.draws.join(cut, ["sid", "block"]).select("shard", "turn", "key", "first", "words")


def taken(mixed: Mix, block: int = BLOCK) -> DataFrame:
    """The documents with source_size and target of their source and ``taken``, the words that the mix takes, repeats counted."""
    uses = mixed.draws.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
    cut = _cut(_placed(mixed.documents, mixed.sources), block).select("sid", "begin", "key", "size", "block", "words")
    some = (cut.join(uses, ["sid", "block"], "left").groupBy("sid", "begin", "key", "size")
            .agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
            .join(mixed.sources, "sid").select("key", "size", "source", "source_size", "target", "taken"))
    sourced = mixed.sources.select(F.col("source").alias("s"), "source_size", "target")
    none = (mixed.documents.where("size = 0").join(sourced, F.col("source").eqNullSafe(F.col("s")))
            .select("key", "size", "source", "source_size", "target", F.lit(0).cast("bigint").alias("taken")))
    return some.unionByName(none)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars",
                    seed: int = 17, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The documents as the mix takes them, with their own columns: once for every turn that takes some of their words.

    A document taken whole keeps its text; of others, the words taken are joined by spaces.
    ``length`` names a column that holds the number of characters, if there is one. Documents
    without words are left out.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(key).alias("key"), size.alias("size"), F.col(source).alias("source"), whole.alias("doc"))
    drawn = mix(docs, key, text, source, seed, block, shard)
    uses = drawn.draws.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
    narrow = _cut(_placed(drawn.documents, drawn.sources), block).select("sid", "begin", "block", "first", "words", "key", "size")
    parts = (narrow.join(uses, ["sid", "block"]).groupBy("sid", "begin", "key", "size")
             .agg(F.array_sort(F.collect_list(F.struct("first", "words", "uses"))).alias("parts")))
    # equal rows of (source, key, size) are told apart by their number
    same = Window.partitionBy("sid", "key", "size")
    parts = parts.withColumn("copy", F.row_number().over(same.orderBy("begin")))
    sid = drawn.sources.select("sid", F.col("source").alias("s"))
    rows = (rows.where("size > 0").join(sid, F.col("source").eqNullSafe(F.col("s"))).select("sid", "key", "size", "doc")
            .withColumn("copy", F.row_number().over(same.orderBy(F.xxhash64("doc")))))
    parts = parts.withColumnRenamed("key", "k")
    joined = rows.join(parts, (rows.key.eqNullSafe(parts.k)) & (rows.sid == parts.sid) & (rows["size"] == parts["size"]) & (rows["copy"] == parts["copy"]))
    turns = joined.select(rows["size"], "doc", "parts", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("parts", lambda p: p["uses"])))).alias("turn"))
    here = turns.withColumn("here", F.filter("parts", lambda p: p["uses"] >= F.col("turn")))
    words = F.regexp_extract_all(F.col(f"doc.`{text}`"), F.lit(WORD), F.lit(0))
    some = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        "here", lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " "))[0]
    full = F.aggregate("here", F.lit(0).cast("bigint"), lambda a, p: a + p["words"]) == F.col("size")
    out = here.withColumn("_new", F.when(full, F.col(f"doc.`{text}`")).otherwise(some))
    made = {text: F.col("_new")} | ({length: F.char_length("_new").cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return out.select(*((made[c] if c in made else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
