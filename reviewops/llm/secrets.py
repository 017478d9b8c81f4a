"""Secret scans with an incremental ledger of blobs.

Every version of every file is a blob named by the SHA-256 of its content. The ledger
holds, for each blob and rule version, that the pair was scanned and what was found. A scan
reads only blobs with a pair that the ledger lacks, each once however many paths hold it,
and the findings are then joined back to all paths.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewops.llm import store


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Group ``group`` must have ``least`` characters; ``needs``: each match holds one of these."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()
    version: int = 1


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What lies between the lines of a key: white space, escaped line breaks, quotes, marks of quotation or comment.
_BETWEEN = r"""(?:\s|\\+[nrt]|["',>|#*])"""
#: A key runs to its END line, whatever lies between but another block. Without one it takes the header
#: fields and the runs of base64 that follow, and a last line that is shorter. No part is ever read twice.
_KEY = (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:"
        r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
        rf"|(?:{_BETWEEN}*+[A-Za-z][A-Za-z0-9-]*+:\x20(?:[^\n\\-]|-(?!----))*+)*+(?:{_BETWEEN}*+[A-Za-z0-9+/=]{{16,}}+)++"
        rf"(?:\x20*+(?:[\r\n]|\\+[nr])++[\x20\t>|#*]*+[A-Za-z0-9+/=]++(?=\s|\\|[\"']|\Z))?)?")
#: Formats that vendors publish; they add to the base rules.
MORE = (
    Rule("private_key", _KEY, needs=("-----BEGIN",), version=2),
    Rule("code_host", r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20})", needs=("gh", "glpat-")),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needs=("eyJ",)),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", needs=("://",)),
)
RULES = BASE + MORE

_FOUND = "array<struct<start: int, stop: int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def find(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost matches, none overlapping the one before; those whose group is too short are dropped."""
    if rule.needs and not any(x in text for x in rule.needs):
        return []
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _compiled(rules: tuple[Rule, ...]) -> list[tuple[Rule, re.Pattern]]:
    out = []
    for r in rules:
        # a run of one class is as long as it can be, so asking for the length at once finds the same and is faster
        pattern = r.pattern if r.group or not re.fullmatch(r"\[[^\]]+\]\+", r.pattern) else f"{r.pattern[:-1]}{{{r.least},}}"
        out.append((r, re.compile(pattern, re.ASCII)))
    return out


def blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """The versions with ``blob_id``, the SHA-256 of the content; null content is empty."""
    return versions.withColumn("blob_id", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def new_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob_id string, kind string, version int, found {_FOUND}")


def scan(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows of this scan: one for each pair of blob and rule version that ``ledger`` lacks.

    ``path`` names each version; of the paths of a blob, the least one's text is read. A path
    may occur again with other content (another version), and with the same (read twice, counted once).
    Texts are moved once, by (path, blob); blobs without a new pair aren't moved at all.
    """
    spark = versions.sparkSession
    named = blobs(versions.select(F.col(path).alias("path"), F.col(text).alias("content")), "content")
    first = named.groupBy("blob_id").agg(F.min("path").alias("path"))
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    if ledger is None:
        todo = first.withColumn("kinds", F.array(*(F.lit(r.kind) for r in rules)))
    else:
        done = (ledger.join(F.broadcast(wanted), ["kind", "version"], "left_semi")  # one row a rule
                .groupBy("blob_id").agg(F.collect_set("kind").alias("done")))
        todo = (first.join(done, "blob_id", "left")
                .withColumn("kinds", F.array_except(F.array(*(F.lit(r.kind) for r in rules)), F.coalesce("done", F.array().cast("array<string>"))))
                .where(F.size("kinds") > 0).drop("done"))
    todo = store.kept(todo, "secrets-todo")
    unseen = (named.alias("n").join(todo.alias("t"), F.col("n.path").eqNullSafe(F.col("t.path")) & (F.col("n.blob_id") == F.col("t.blob_id")))
              .select("n.blob_id", "n.content", "t.kinds"))

    def search(batches):
        compiled = _compiled(rules)
        for batch in batches:
            out = ([], [], [], [])
            for blob, content, kinds in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for rule, pattern in compiled:
                    if rule.kind in kinds:
                        spans = find(content or "", rule, pattern)
                        for column, value in zip(out, (blob, rule.kind, rule.version, [{"start": a, "stop": b} for a, b in spans])):
                            column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()),
                                   pa.array(out[3], _SPANS)], names=["blob_id", "kind", "version", "found"])

    return unseen.mapInArrow(search, f"blob_id string, kind string, version int, found {_FOUND}")


def findings(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """All rows and columns of the versions, with ``into``: an array of (start, kind, stop), by start, then rule.

    Positions are code points, stop exclusive. A version without secrets has an empty array;
    a column already called ``into`` is replaced. Many paths of one blob are one hot key:
    the side of the findings has one row a blob, so Spark may split the other.
    """
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    current = [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules]
    any_current = current[0]
    for c in current[1:]:
        any_current = any_current | c
    found = (ledger.where(any_current & (F.size("found") > 0)).dropDuplicates(["blob_id", "kind"])
             .select("blob_id", F.explode(F.transform("found", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("rank"),
                                                                                 F.col("kind").alias("kind"), s["stop"].alias("stop")))).alias("s"))
             .groupBy("blob_id").agg(F.sort_array(F.collect_list("s")).alias("found")))
    found = store.kept(found, "secrets-found")
    key = "_blob_id"
    while key in versions.columns:
        key += "_"
    names = [c for c in versions.columns if c != into]
    named = versions.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    empty = F.array().cast("array<struct<start: int, kind: string, stop: int>>")
    return (named.join(found.withColumnRenamed("blob_id", key), key, "left")
            .select(*(F.col(f"`{c}`") for c in names),
                    F.coalesce(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))), empty)
                    .alias(into)))


def masked(text: str | None, starts: list[int], stops: list[int], mark: str) -> str | None:
    """The text with each run of overlapping spans, given by start, replaced by one mark; it is walked over once."""
    if text is None:
        return None
    out, at = [], 0
    for start, stop in zip(starts, stops):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, path: str = "doc_id", text: str = "text", mark: str = "<secret>", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret replaced by ``mark``; overlapping ones by one mark. Null stays null."""
    ledger = store.kept(scan(docs, path, text, rules), "secrets-ledger")
    into = "_secrets"
    while into in docs.columns:
        into += "_"
    found = findings(docs, ledger, text, rules, into)
    whole = F.col(text)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        return pa.array([masked(t, a, b, mark) for t, a, b in zip(texts.to_pylist(), starts.to_pylist(), stops.to_pylist())], pa.string())

    clean = F.when(F.size(into) == 0, whole).otherwise(cut(F.when(F.size(into) > 0, whole), F.col(into)["start"], F.col(into)["stop"]))
    return found.withColumn(text, clean).select(*(F.col(f"`{c}`") for c in docs.columns))
