"""Queries of this subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewops.llm import collocations, cotraining, embedding_join, jaccard_join, language, merkle, mixing, packing, projection_search, quality_rules, secrets, store, substring_dedup, token_counts

BASE_KINDS = ("assign", "access", "hex")


def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(mixing.mix(store.documents(spark, folder))).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(store.documents(spark, folder)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.placed(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = store.new_path(spark, "token-files")
    token_counts.write(store.documents(spark, folder), path)
    return token_counts.counts(spark, path)


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = substring_dedup.deduplicated(store.documents(spark, folder).select("doc_id", "text"))
    return docs.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.col("dedup.kept").cast("binary"), 256).alias("kept_sha256"))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.linked(store.documents(spark, folder), rule=jaccard_join.Rule(n=3, num=90))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = store.documents(spark, folder)
    ledger = store.kept(secrets.scan(docs, "doc_id"), "secrets-ledger")
    found = secrets.findings(docs.select("doc_id", "text"), ledger)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(number(k).alias(f"n_{k}") for k in BASE_KINDS),
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op7_embedding_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = embedding_join.linked(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = store.documents(spark, folder).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    found = language.learned(docs.where(~held_out), "doc_id")
    return language.identified(docs.select("doc_id", "text", held_out.alias("held_out")), found).select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = store.documents(spark, folder).select("doc_id", "text")
    failed, stays = quality_rules.verdict()
    return quality_rules.measured(docs).select(
        "doc_id", *(f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"), stays.alias("kept"), "rules.ratio", "rules.bad_share")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = store.documents(spark, folder).select(F.col("doc_id").alias("key"), "text", "source", "lang", F.col("n_chars").alias("length"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("key"), F.col("quality").alias("good"))
    judged = cotraining.scored(docs, cotraining.learn(docs, labels))
    return judged.select(F.col("key").alias("doc_id"), F.col("quality.text").alias("p_text"), F.col("quality.page").alias("p_page"),
                         F.col("quality.score").alias("score"), (F.col("quality.score") >= 0.5).alias("kept"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(store.documents(spark, folder))


def op12_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = projection_search.nearest_rows(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("key") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = merkle.leaf([F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in fields])
    found = merkle.manifest(store.documents(spark, folder), fields=fields, carried={"tampered": F.when(altered, changed)})
    return (found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
            .select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


_ALL = (op1_source_mix, op2_packing, op3_token_counts, op4_substring_dedup, op5_secret_scans, op6_ngram_jaccard, op7_embedding_neighbours,
        op8_language_id, op9_quality_rules, op10_quality_classifier, op11_phrase_collocations,
        op12_nearest_vectors, op13_merkle_manifest)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        store.ship(spark)
        return query(spark, folder)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: _shipped(q) for q in _ALL}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"



def _leaf(text: str) -> str:
    values = ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


#: Whether the CRC-32 of doc_id's digits is odd, bit by bit; null counts as odd, it isn't altered.
_crc_odd = """coalesce((xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, 8 * strlen(cast(doc_id as varchar))),
    lambda k: ((ascii(cast(doc_id as varchar)[k // 8 + 1]) >> (k % 8)) & 1)::bigint)), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) & 1) = 1, true)"""

#: DuckDB SQL of the operators that SQL can express.
ORACLES: dict[str, str] = {
    "op4_substring_dedup": f"""
with docs as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
windows as (select doc_id, r, i, array_to_string(w[i:i + 49], ' ') as k from (select *, unnest(range(1, len(w) - 48)) as i from docs)),
first_of as (select k, min(doc_id) as d from windows group by k having count(distinct doc_id) > 1),
gone as (select distinct r, i + o as p from (select r, i, unnest(range(0, 50)) as o from windows join first_of using (k) where d < doc_id)),
word as (select doc_id, r, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from docs),
left_over as (select r, array_to_string(list(x order by p), ' ') as t, count(*) as n from word anti join gone using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from docs left join left_over using (r)""",
    "op6_ngram_jaccard": f"""
with recursive docs as (select doc_id, {_LOWER_WORDS} as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) end as s from docs),
gram as (select doc_id, len(s) as n, unnest(s) as g from sets),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c, any_value(a.n) as n, any_value(b.n) as m
           from gram a join gram b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by all),
link as (select x, y from common where 100 * c >= 90 * (n + m - c)),
edge as (select x, y from link union all select y, x from link),
reach as (select doc_id as v, doc_id as c from sets union select edge.y, reach.c from reach join edge on edge.x = reach.v and reach.c < edge.y)
select doc_id, cast(len(s) as bigint) as n_shingles, (select min(c) from reach where v = doc_id) as component_id from sets""",
    "op7_embedding_neighbours": """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
ok as (select *, sqrt(list_dot_product(e, e)) as n from v where label is not null),
link as (select a.vec_id as x, b.vec_id as y from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id
         where a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach as (select vec_id as v, vec_id as c from v union select link.y, reach.c from reach join link on link.x = reach.v and reach.c < link.y),
least_of as (select v, min(c) as c from reach group by v),
n as (select x, count(*) as n from link group by x)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, c as component_id, vec_id = c as kept
from v join least_of on v.vec_id = least_of.v left join n on n.x = v.vec_id""",
    "op11_phrase_collocations": r"""
with docs as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
              from documents),
piece as (select d, lang, row_number() over () as p, w from (
    select d, lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from docs) where len(w) > 0),
total as (select lang, sum(len(w)) as n from piece group by lang),
gram as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
         from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from piece cross join (values (1), (2), (3), (4)) v(k))),
f as materialized (select lang, phrase, k, count(*) as a from gram group by all having count(*) >= 30),
cut as (select lang, phrase, a, k, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') as x, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') as y
        from (select *, unnest(range(1, k)) as c from f where k > 1)),
weak as (select lang, cut.phrase, any_value(cut.a) as a, min(row(2000000::hugeint * cut.a // (l.a + r.a), c, l.a, r.a)) as m
         from cut join f l using (lang) join f r using (lang) where l.phrase = x and r.phrase = y group by lang, cut.phrase),
inside as (select lang, array_to_string(string_split(phrase, ' ')[o:o + s - 1], ' ') as phrase, max(a) as longer from (
    select *, unnest(range(1, k - s + 2)) as o from (select *, unnest(range(2, k)) as s from f where k > 2)) group by all),
kept as (select lang, phrase, a, m[3] as l, m[4] as r, m[1] as score from weak left join inside using (lang, phrase) where longer is null or 100 * longer < 80 * a),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score from placed join total using (lang) where rank <= 2000""",
    "op13_merkle_manifest": f"""
with recursive leaf as (select row_number() over () as id, *, {_crc_odd} as odd, {_leaf('text')} as h, {_leaf("replace(text, chr(10), '')")} as changed from documents),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, h) - 1 as i, count(*) over (partition by source) as m from leaf),
node as (select 0 as level, coalesce('=' || source, '') as g, i, m, h from placed
         union all select level + 1, g, i // 3, (m + 2) // 3, sha256(string_agg(h, '' order by i)) from node where m > 1 group by level, g, i // 3, m),
sub as (select g, h, row_number() over (order by g) - 1 as i, count(*) over () as m from node where m = 1),
upper as (select 0 as level, i, m, h from sub union all select level + 1, i // 3, (m + 2) // 3, sha256(string_agg(h, '' order by i)) from upper where m > 1 group by level, i // 3, m),
every as materialized (select level, g, i, m, h from node union all select level, null, i, m, h from upper),
run as materialized (select level, g, i // 3 as up, list(h order by i) as hs from every where m > 1 group by level, g, i // 3),
height as (select coalesce(g, '-') as g, max(level) as top from every group by g),
climb as (select id, coalesce('=' || source, '') as g, false as high, 0 as level, i, m, case when odd then h else changed end as x, '' as p from placed
          union all
          select c.id, c.g, c.high or c.m = 1, case when c.m = 1 then 0 else c.level + 1 end, case when c.m = 1 then s.i else c.i // 3 end,
                 case when c.m = 1 then s.m else (c.m + 2) // 3 end,
                 case when c.m = 1 then c.x else sha256(array_to_string(list_concat(r.hs[1:c.i % 3], [c.x], r.hs[c.i % 3 + 2:]), '')) end,
                 case when c.m = 1 then c.p else c.p || array_to_string(list_concat(r.hs[1:c.i % 3], r.hs[c.i % 3 + 2:]), '') end
          from climb c join sub s on s.g = c.g
          left join run r on r.level = c.level and r.up = c.i // 3 and r.g is not distinct from (case when c.high then null else c.g end) and c.m > 1
          where c.m > 1 or not c.high),
root as (select h from upper where m = 1)
select doc_id, placed.h as leaf, sub.h as subroot, root.h as root, sha256(p) as proof_sha256, x as folded_root, x = root.h as verified
from placed join climb using (id) join sub on sub.g = coalesce('=' || source, '') cross join root where climb.high and climb.m = 1""",
}
