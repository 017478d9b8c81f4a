import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewops.llm import collocations, merkle, projection_search, queries
from tests.llm.conftest import folder_of, sorted_rows

# --- phrases ----------------------------------------------------------------


def phrase_rows(rows, least=30, share=80, top=2000):
    """The contract, word for word; rows are (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        found = []
        for p, a in candidates.items():
            if 100 * longer[p] < share * a:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrases_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("route", F.lit("x"))
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


def test_phrases_of_documents(spark, small):
    got = queries.QUERIES["op11_phrase_collocations"](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("lang", "text").collect()
    assert sorted(tuple(r) for r in got.collect()) == phrase_rows(docs)


TEXTS = [
    (None, None), ("en", ""), ("en", " \t. ,\n"), ("en", "New York. new  york\tNEW YORK, new\x0byork; a b c d e " * 40), (None, "ab cd ab cd " * 31), ("und", "ab cd. cd ab " * 10),
    ("", "é é É é; x y x y z " * 33), ("de", "eins zwei drei vier fünf " * 35 + "eins zwei " * 5), ("de", "zwei drei: " * 50), ("ja", "漢字 かな 漢字 。" * 30),
    ("en", "word " * 5000), ("en", "a b\rc d\fe! " * 29), ("en", "the end"), ("x", "y" * 100_000 + " z")] + [("en", "same line here")] * 40


@pytest.mark.parametrize("largest", [None, 40])
def test_phrases_of_odd_texts(spark, monkeypatch, largest):
    """Once as it is, once with routes so small that hot words and phrases are routed by all four words."""
    if largest:
        for name, value in (("LARGEST", largest), ("ROUTE", 16), ("ROUTE_BYTES", 4096), ("BLOCK", 512)):
            monkeypatch.setattr(collocations, name, value)
    want = phrase_rows(TEXTS)
    assert len(want) > 15 and phrases_of(spark, TEXTS) == want


def test_phrases_least_share_and_top(spark):
    rows = [("en", "a b c. a b d. a b c d. b c")] * 3
    assert phrases_of(spark, rows, least=3, share=60, top=4) == phrase_rows(rows, 3, 60, 4)
    assert phrases_of(spark, [], least=1) == []


@pytest.mark.parametrize("routed", [1, 2, 3, 4])
def test_quicksort_counts(routed):
    rng = np.random.default_rng(routed)
    rows = rng.zipf(1.6, (3000, 4)).clip(1, 50).astype(np.int32) - 1
    ended = rng.integers(1, 5, 3000)
    rows[np.arange(4) >= ended[:, None]] = -1
    counts = rng.integers(1, 4, 3000)
    want = Counter()
    for row, c in zip(rows.tolist(), counts.tolist()):
        for k in range(1, 5):
            if row[k - 1] >= 0:
                want[tuple(row[:k])] += c
    got = {tuple(rows[i, :k].tolist()): c for i, k, c in zip(*(x.tolist() for x in collocations.quicksorted(rows, counts, 30, routed)))}
    assert got == {p: c for p, c in want.items() if c >= 30 or len(p) < routed}


# --- nearest neighbours -----------------------------------------------------


def test_distribution():
    assert projection_search.chi_square(projection_search.stopping_ratio(0.97, 8), 8) == pytest.approx(0.97)
    draws = (np.random.default_rng(1).standard_normal((200_000, 8)) ** 2).sum(axis=1)
    assert (draws <= projection_search.stopping_ratio(0.9, 8)).mean() == pytest.approx(0.9, abs=0.005)


def recall(got, vectors, every, nearest=20):
    """Share of true neighbours found; order, ties and scores are checked on the way."""
    ids, matrix = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], dtype=np.float64)
    found = {}
    for r in got:
        found.setdefault(r[0], []).append(tuple(r)[1:])
    hits = total = 0
    for at in np.flatnonzero(ids % every == 0):
        scores = (matrix * matrix[at]).sum(axis=1)
        order = np.lexsort((ids, -scores))
        order = order[order != at][:nearest]
        mine = sorted(found.pop(int(ids[at])))
        assert [m[0] for m in mine] == list(range(1, len(order) + 1))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        known = dict(zip(ids.tolist(), scores.tolist()))
        assert all(known[i] == s and i != ids[at] for _, i, s in mine)
        hits, total = hits + len({m[1] for m in mine} & set(ids[order].tolist())), total + len(order)
    assert not found
    return hits / total


@pytest.mark.parametrize("cell", [projection_search.CELL, 60])
def test_neighbours_of_embeddings(spark, small, monkeypatch, cell):
    monkeypatch.setattr(projection_search, "CELL", cell)
    got = queries.QUERIES["op12_nearest_vectors"](spark, small)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.dtypes[1][1] == "int"
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert recall(got.collect(), [tuple(r) for r in rows], 20) >= 0.9


@pytest.mark.parametrize("cell", [projection_search.CELL, 200])
def test_neighbours_of_uneven_lengths_and_copies(spark, monkeypatch, cell):
    """Norms over six magnitudes, and a third of the rows equal."""
    monkeypatch.setattr(projection_search, "CELL", cell)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((1500, 24)) * 10 ** rng.uniform(-3, 3, (1500, 1))
    vectors[::3] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = projection_search.nearest_rows(df, F.col("key") % 10 == 0, nearest=5).collect()
    assert recall(got, rows, 10, 5) >= 0.9


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (20, [0.0, -1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (40, [1.0, 2.0, 3.0]), (60, [0.0, 0.0]), (None, [1.0, 1.0]), (80, [1e-300, 0.0]), (80, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"key": F.lit(1), "cell": F.lit("x"), "number": F.lit(2)})
    got = sorted_rows(projection_search.nearest_rows(df, F.col("key") % 20 == 0, nearest=3).collect())
    tiny = [(80, 1, 1, 2e-300), (80, 2, 2, 2e-300), (80, 3, 2, 2e-300)]
    assert got == sorted([(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 2, 2.0), (20, 1, 0, 0.0), (20, 2, 80, 0.0), (20, 3, 80, 0.0), *tiny, *tiny])  # 40 has nobody of its length
    assert projection_search.nearest_rows(df.limit(0), F.col("key") % 20 == 0).collect() == []
    ask_all = projection_search.nearest_rows(df.where("vec_id = 2"), F.lit(True)).collect()
    assert sorted(tuple(r) for r in ask_all) == [(2, 1, 2, 5.0)] * 2


# --- manifest ---------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves, fanout=3):
    """The last node, and for each leaf the siblings (before, after) on the way there."""
    nodes, below, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [range(a, min(a + fanout, len(nodes))) for a in range(0, len(nodes), fanout)]
        for run in runs:
            for at in run:
                for i in below[at]:
                    paths[i].append(([nodes[j] for j in run if j < at], [nodes[j] for j in run if j > at]))
        nodes, below = [sha(*(nodes[j] for j in run)) for run in runs], [sum((below[j] for j in run), []) for run in runs]
    return nodes[0], paths


def manifest_rows(rows, fanout=3):
    """Rows (doc_id, leaf, subroot, root, proof, folded root, verified) by the contract."""
    names = ("doc_id", "source", "lang", "n_chars", "text")

    def leaf(r, **other):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in ({**r, **other}[n] for n in names)))

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in order:
        members = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made.append((members, *tree_of([leaf(r) for r in members], fanout)))
    if not made:
        return []
    root, upper = tree_of([m[1] for m in made], fanout)
    out = []
    for (members, subroot, paths), above in zip(made, upper):
        for r, path in zip(members, paths):
            x = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                x = leaf(r, text=r["text"].replace("\n", ""))
            for before, after in path + above:
                x = sha(*before, x, *after)
            out.append((r["doc_id"], leaf(r), subroot, root, sha(*(d for b, a in path + above for d in b + a)), x, x == root))
    return sorted_rows(out)


@pytest.mark.parametrize("which", ["nasty", "empty", "small"])
def test_manifest(spark, which, request):
    folder = request.getfixturevalue(which)
    got = queries.QUERIES["op13_merkle_manifest"](spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted_rows(got.collect()) == manifest_rows(rows)


def test_manifest_of_many_ranges_and_groups(spark, monkeypatch, tmp_path_factory):
    """One group over many ranges, hundreds of groups of one row, long texts, clashing names."""
    monkeypatch.setattr(merkle, "RANGE", 97)
    rows = [(i, f"line\nline {i}" if i % 3 else None, "en", "hot" if i % 2 else f"s{i}", i) for i in range(1200)] + [(5000, "x" * 3_000_000, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns(
        {"i": F.lit(1), "m": F.lit(2), "g": F.lit("y"), "path": F.lit(0), "digest": F.lit("z"), "slot": F.lit(3)})
    folder = folder_of(df, tmp_path_factory)
    got = sorted_rows(queries.QUERIES["op13_merkle_manifest"](spark, folder).collect())
    assert got == manifest_rows([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])


def test_manifest_with_another_fanout(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = merkle.manifest(docs, fanout=5)
    got = found.select("key", "leaf", "subroot", "root", merkle.proof(F.col("path")), merkle.folded(F.col("leaf"), F.col("path"))).collect()
    want = [r[:5] for r in manifest_rows([r.asDict() for r in docs.collect()], 5)]
    assert sorted_rows(r[:5] for r in map(tuple, got)) == sorted_rows(want) and all(r[5] == r[3] for r in got)
