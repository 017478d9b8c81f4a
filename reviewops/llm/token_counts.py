"""Token counts of documents in flat token files.

A flat token file is ids of 16 bits, high byte first, one after the other, each document
closed by the end id, without an index. Files are read in blocks; each block is searched for end ids as one
vector. A document that ends in the block it began in is done there. Of the others each
block tells how many ids it holds of them, and a prefix scan over the ends per block numbers
the documents, so that the parts of one meet under its number.

A document may begin with its number, in ids beyond the vocabulary: base ``DIGIT_BASE``,
highest digit first, five digits for 64 bits. They are not counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewops.llm import scan, store, tokens

#: Beyond the vocabulary's 49,408 ids. Its two bytes are one character, U+0080, in UTF-8.
END = 0xC280
END_TEXT = "\u0080"
FIRST_DIGIT = END + 1
DIGIT_BASE = 65_536 - FIRST_DIGIT
DIGITS = 5


def _number(value: int | None) -> bytes:
    if value is None:
        return b""
    value += 1 << 63
    return np.array([FIRST_DIGIT + value // DIGIT_BASE ** k % DIGIT_BASE for k in range(DIGITS - 1, -1, -1)], dtype=">u2").tobytes()


#: Bytes that a text may have, and how many texts of up to that size share a file: two bytes an id, an id a byte at most,
#: make 64 MB. Only a single text of more than 32 MB makes a larger file.
FILES = ((1 << 12, 8192), (1 << 16, 512), (1 << 20, 32), (1 << 31, 1))


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, most: int = 20_000,
          files: tuple[tuple[int, int], ...] = FILES) -> None:
    """Write flat token files of up to ``most`` documents each, and of bounded size: long texts share files with fewer others.

    Null text is empty, a null number is left out. Spark's text writer puts the end id after each document: written as bytes, it is the line's end.
    """
    tokenizer = tokenizer or tokens.default_path()

    def encode(batches):
        encoder = tokens.encoder(tokenizer, ">u2")
        for batch in batches:
            for part in scan.pieces(batch, "text", tokens.PIECE):
                flat, begins = encoder.ids(part.column(1))
                found = [flat[a:b].tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
                yield pa.record_batch([pa.array([_number(k) + ids for k, ids in zip(part.column(0).to_pylist(), found)], pa.binary())], names=["value"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    grade = F.coalesce(*(F.when(size <= limit, i) for i, (limit, _) in enumerate(files)))
    grades = sorted(r[0] for r in rows.select(grade.alias("grade")).distinct().collect()) or [0]  # no more than there are sizes of files
    for i in grades:
        encoded = rows.where(grade == i).mapInArrow(encode, "value binary").select(F.col("value").cast("string"))
        encoded.write.mode("append").option("lineSep", END_TEXT).option("maxRecordsPerFile", min(most, files[i][1])).text(path)


def blocks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Rows (file, block, data) of ``size`` bytes, the last of a file shorter. A task holds a file at a time: see ``FILES``."""
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0), ((F.col("length") - 1) / size).cast("int")))
    parts = F.transform(starts, lambda i: F.struct(i.alias("block"), F.expr("content").substr(i * size + 1, F.lit(size)).alias("data")))
    return (spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.explode(parts).alias("b"))
            .select("file", "b.block", "b.data"))


_PART = "file string, block int, local int, tokens bigint, lead array<int>, whole boolean, ends int"


def _search(batches):
    for batch in batches:
        for file, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            ids = np.frombuffer(data.as_buffer(), dtype=">u2").astype(np.uint16)
            ends = np.flatnonzero(ids == END)
            starts = np.concatenate([[0], ends + 1])
            stops = np.concatenate([ends, [len(ids)]])
            n = len(starts)  # the last one goes on in the next block, and may have nothing here
            lead = [ids[a:min(b, a + DIGITS)].tolist() for a, b in zip(starts.tolist(), stops.tolist())]
            whole = np.ones(n, dtype=bool)
            whole[0] = block == 0 and n > 1
            whole[-1] = False
            yield pa.record_batch([pa.array([file] * n), pa.array([block] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)),
                                   pa.array((stops - starts).astype(np.int64)), pa.array(lead, pa.list_(pa.int32())), pa.array(whole),
                                   pa.array([len(ends)] * n, pa.int32())], names=["file", "block", "local", "tokens", "lead", "whole", "ends"])


def counts(spark: SparkSession, path: str, size: int = 4 << 20) -> DataFrame:
    """Rows (doc_id, n_tokens, file, position): ids of every document, without its number and end id; position counts its file's documents.

    ``size``: bytes a block, even. Documents without a number have a null ``doc_id``. Empty files give no rows.
    """
    parts = store.kept(blocks(spark, path, size).mapInArrow(_search, _PART), "token-parts")
    before = parts.where("local = 0").select("file", "block", F.coalesce(F.sum("ends").over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = store.kept(before, "token-blocks")
    numbered = parts.join(before, ["file", "block"]).withColumn("position", F.col("before") + F.col("local"))
    cut = (numbered.where(~F.col("whole")).groupBy("file", "position")
           .agg(F.sum("tokens").alias("tokens"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "lead"))), lambda x: x["lead"])).alias("lead"),
                F.max(F.col("local") < F.col("ends")).alias("ended"))
           .where("ended").select("file", "position", "tokens", F.slice("lead", 1, DIGITS).alias("lead")))
    every = numbered.where("whole").select("file", "position", "tokens", "lead").unionByName(cut)
    # five digits of a number: a value plus 2**63, in decimals as it needs up to 70 bits on the way
    number = F.when((F.size("lead") == DIGITS) & (F.array_min("lead") >= FIRST_DIGIT),
                    F.aggregate("lead", F.lit(0).cast("decimal(30,0)"), lambda a, d: (a * DIGIT_BASE + (d - FIRST_DIGIT)).cast("decimal(30,0)")))
    return every.select((number - F.expr("9223372036854775808")).cast("bigint").alias("doc_id"),
                        (F.col("tokens") - F.when(number.isNotNull(), DIGITS).otherwise(0)).alias("n_tokens"), "file", "position")
