"""Substring, n-gram and embedding duplicates against brute force, and components against a plain search."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewops.llm import embedding_join, jaccard_join, substring_dedup
from reviewops.llm.components import components
from reviewops.llm.queries import QUERIES
from tests.llm.conftest import docs_of, folder_of, sorted_rows, words

FOLDERS = ["nasty", "empty", "small", "copies"]


def smallest_reached(vertices, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    out = {}
    for v in sorted(vertices):
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = v
                todo += near[x]
    return out


@pytest.fixture(scope="session")
def copies(spark, shared_folder, tmp_path_factory):
    """Groups of exact and near copies, chains of them, shared passages, short texts and repeated rows."""
    random.seed(7)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(2, 6))) for _ in range(400)]
    prose = lambda n: random.choices(vocabulary, k=n)
    rows, passage = [], prose(80)
    for _ in range(12):
        base = prose(random.randint(3, 220))
        rows += [base, list(base)]
        for _ in range(random.randint(1, 6)):
            base = list(base)  # each is a copy of the one before
            for _ in range(random.randint(0, 3)):
                base[random.randrange(len(base))] = random.choice(vocabulary)
            rows.append(base)
    near = prose(150)
    for _ in range(60):
        copy = list(near)
        for i in random.sample(range(150), random.randint(0, 6)):
            copy[i] = random.choice(vocabulary)
        rows.append(copy)
    for _ in range(25):
        a, n = random.randint(0, 40), random.randint(30, 80)
        rows.append(prose(random.randint(0, 60)) + passage[a:a + n] + prose(random.randint(0, 60)))
    rows += [["a"], ["A"], ["a", "b"], ["B", "A"], passage + passage, passage * 3]
    random.shuffle(rows)
    spaces = [" ", "\n", "\t ", "  "]
    texts = [(i, "".join(w + random.choice(spaces) for w in r), "en", "s") for i, r in enumerate(rows)]
    texts += texts[:5] + [(500, None, None, None), (None, texts[3][1], "en", "s"), (7, texts[9][1], "en", "s")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string").repartition(5)
    return folder_of(df, tmp_path_factory)


def removed_by_hand(docs, size=50):
    first = {}
    split = [(i, words(t)) for i, t in docs]
    order = lambda i: (i is None, i)
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            if key not in first or order(i) < order(first[key]):
                first[key] = i
    out = []
    for i, w in split:
        gone = {k + o for k in range(len(w) - size + 1) if order(first[tuple(w[k:k + size])]) < order(i) for o in range(size)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("folder", FOLDERS)
def test_substring_dedup(spark, request, folder):
    folder = request.getfixturevalue(folder)
    rows = QUERIES["op4_substring_dedup"](spark, folder).collect()
    assert sorted_rows(rows) == sorted_rows(removed_by_hand(docs_of(spark, folder)))


def test_a_crowded_sketch_loses_nothing(spark, copies):
    docs = spark.read.parquet(f"{copies}/documents.parquet")
    rows = substring_dedup.deduplicated(docs, width=1 << 10).select("doc_id", "dedup.n_words", "dedup.n_removed").collect()
    assert sorted_rows(rows) == sorted_rows(r[:3] for r in removed_by_hand(docs_of(spark, copies)))


@pytest.mark.parametrize("folder", FOLDERS)
def test_a_sketch_that_is_asked(spark, request, folder):
    """Nothing may be sent: ranges of cells are asked instead, and the rows are the same."""
    folder = request.getfixturevalue(folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = substring_dedup.deduplicated(docs, sent=0).select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.col("dedup.kept").cast("binary"), 256))
    assert sorted_rows(rows.collect()) == sorted_rows(removed_by_hand(docs_of(spark, folder)))


@pytest.mark.parametrize("sent", [0, substring_dedup.SENT])
def test_single_windows_are_filtered_at_the_load_of_large_texts(spark, monkeypatch, sent):
    """Cells for each anchor are what they are at a terabyte: the least width, which small texts are given, is out of the way."""
    random.seed(5)
    shared = " ".join(f"s{random.random()}" for _ in range(60))
    docs = [(i, " ".join(f"w{random.random()}" for _ in range(300)), str(i)) for i in range(400)]
    docs += [(1000, shared, "m"), (1001, shared, "n")]
    texts = spark.createDataFrame(docs, "key bigint, text string, mark string").repartition(7)
    monkeypatch.setattr(substring_dedup, "LEAST_WIDTH", 1)
    width = substring_dedup.width_for(sum(len(t) for _, t, _ in docs) // 3)  # these words are thrice as long as common ones
    let_through = substring_dedup._candidates(texts, 50, width, 64, sent, 1 << 12).where("bucket >= 0")
    found = let_through.agg(F.sum(F.octet_length("text")) / 4, F.sum(F.octet_length("low")) / 8).first()
    windows, single = 400 * 251 + 22, 400 * 251
    assert 22 <= found[0] <= 22 + 0.1 * single
    crowded = substring_dedup._candidates(texts, 50, 1 << 8, 64, sent, 1 << 7).where("bucket >= 0").agg(F.sum(F.octet_length("text")) / 4).first()
    assert crowded[0] == windows


def shingles(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def links_by_hand(docs, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in docs]
    edges = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k]
             if i is not None and j is not None and a and b and den * min(len(a), len(b)) >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b)]
    found = smallest_reached({i for i, _ in sets if i is not None}, edges)
    return [(i, len(s), found.get(i)) for i, s in sets]


@pytest.mark.parametrize("folder", FOLDERS)
def test_jaccard(spark, request, folder):
    folder = request.getfixturevalue(folder)
    rows = QUERIES["op6_ngram_jaccard"](spark, folder).collect()
    assert sorted_rows(rows) == sorted_rows(links_by_hand(docs_of(spark, folder), 3, 90, 100))


@pytest.mark.parametrize("cell", [4, 128])
def test_jaccard_of_five_words_in_small_cells(spark, copies, cell):
    docs = spark.read.parquet(f"{copies}/documents.parquet")
    expected = links_by_hand(docs_of(spark, copies), 5, 80, 100)
    assert sorted_rows(jaccard_join.linked(docs, cell=cell).collect()) == sorted_rows(expected)
    left = jaccard_join.distinct(docs, cell=cell)
    assert left.columns == docs.columns
    assert sorted_rows({(r.doc_id,) for r in left.collect()}) == sorted_rows({(i,) for i, _, c in expected if i == c})


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 6), st.sampled_from([(90, 100), (80, 100), (50, 100), (2, 3)]))
def test_trie_finds_all_links(seed, share):
    rule = jaccard_join.Rule(3, *share)
    rng = np.random.default_rng(seed)
    cells = []
    for _ in range(rng.integers(1, 4)):
        base = rng.integers(0, 1 << 63, rng.integers(1, 90), dtype=np.uint64)
        cell = []
        for _ in range(rng.integers(1, 9)):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.3])]
            cell.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(1, 5), dtype=np.uint64)])))
        cells.append(cell)
    expected, at = set(), 0
    for cell in cells:
        for i in range(len(cell)):
            for j in range(i):
                o = len(np.intersect1d(cell[i], cell[j]))
                if rule.den * o >= rule.num * (len(cell[i]) + len(cell[j]) - o):
                    expected.add((at + j, at + i))
        at += len(cell)
    assert {tuple(sorted(p)) for p in jaccard_join.Trie(cells, rule).links()} == expected


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 6), st.sampled_from([(90, 100), (80, 100), (60, 100)]), st.integers(1, 400))
def test_linked_sets_share_a_signature(seed, share, size):
    rule = jaccard_join.Rule(3, *share)
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    lose = rng.integers(0, len(a) - rule.needed(len(a), len(a)) + 1) if len(a) > 1 else 0
    kept = rng.permutation(a)[lose:]
    b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(0, 2 + size // 20), dtype=np.uint64)]))
    o = len(np.intersect1d(a, b))
    if rule.den * o >= rule.num * (len(a) + len(b) - o) and not np.array_equal(a, b):
        for share_frequent in (0, 0.3, 1):
            signer = jaccard_join.Signer(rule, np.sort(a[rng.random(len(a)) < share_frequent]))
            assert np.intersect1d(signer.signatures(a), signer.signatures(b)).size


def test_unlinked_sets_of_frequent_grams_share_no_signature():
    """Large groups of near copies, whose n-grams are all frequent, don't become one cluster through the classes that are empty in each."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 1064, dtype=np.uint64)) for _ in range(30)]
    copies = [np.unique(np.concatenate([s[:-20], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])) for s in sets]
    signer = jaccard_join.Signer(jaccard_join.Rule(), np.unique(np.concatenate(sets + copies)))
    found = [np.unique(signer.signatures(s)) for s in sets]
    assert len(np.unique(np.concatenate(found))) == sum(map(len, found))
    assert all(np.intersect1d(a, signer.signatures(b)).size for a, b in zip(found, copies))


def test_signatures_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 5, 9, 40, 333, 1064, 7)]
    signer = jaccard_join.Signer(jaccard_join.Rule(), np.sort(np.concatenate(sets)[::3]))
    found, of = signer.of_sets(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert all(np.array_equal(np.sort(found[of == i]), np.sort(signer.signatures(s))) for i, s in enumerate(sets))


def test_components(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 2000 + i) for i in range(50)] + [(random.randint(100, 300), random.randint(100, 300)) for _ in range(120)] + [(5, 5), (900, 900)]
    df = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
    expected = smallest_reached({v for e in edges if e[0] != e[1] for v in e}, edges)
    assert {r.vertex: r.component for r in components(df).collect()} == expected
    assert components(df.limit(0)).count() == 0


def vectors_by_hand(rows):
    unit = []
    for _, e, label in rows:
        ok = label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
        x = np.array(e, dtype=np.float64) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    edges, n = [], [0] * len(rows)
    for i, (a, _, la) in enumerate(rows):
        for j, (b, _, lb) in enumerate(rows):
            if i != j and a is not None and b is not None and la == lb and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                n[i] += 1
                edges.append((a, b))
    found = smallest_reached({r[0] for r in rows if r[0] is not None}, edges)
    return [(r[0], n[i], found.get(r[0]), r[0] is not None and found[r[0]] == r[0]) for i, r in enumerate(rows)]


def test_embeddings(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted_rows(QUERIES["op7_embedding_neighbours"](spark, small).collect()) == sorted_rows(vectors_by_hand(rows))


@pytest.mark.parametrize("part", [3, 1024])
def test_odd_embeddings(spark, part):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(20):
        centre = rng.normal(size=4)
        rows += [(10 * i + k, [float(x) for x in np.float32(centre + rng.normal(size=4) * 0.15)], i % 3) for k in range(8)]
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], 2), (902, None, 1), (903, [], 1), (904, [0.0] * 4, 1), (905, [None, 1.0, 0.0, 0.0], 1),
             (906, [float("nan"), 1.0, 0.0, 0.0], 1), (907, [float("inf"), 1.0, 0.0, 0.0], 1), (908, rows[0][1], None), (909, [1.0, 0.0], 1), (910, [2.0, 0.0], 1),
             (911, [1e30, 0.0, 0.0, 0.0], 0), (912, [1e-30, 0.0, 0.0, 0.0], 0), rows[1], (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, home string")
    got = [(*r, r[0] is not None and r[0] == r[2]) for r in embedding_join.linked(df, part=part, pivots=4).collect()]
    assert sorted_rows(got) == sorted_rows(vectors_by_hand([tuple(r)[:3] for r in df.collect()]))
    assert embedding_join.linked(df.limit(0)).count() == 0


def test_groups_of_a_matrix_of_links():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.02, 0.1, 1.0):
        near = rng.random((30, 40)) < share
        rows, columns = embedding_join._groups(near)
        group = {("r", i): {("r", i)} for i in range(30)} | {("c", j): {("c", j)} for j in range(40)}
        for i, j in zip(*np.nonzero(near)):
            both = group["r", i] | group["c", j]
            for x in both:
                group[x] = both
        first = lambda x: min((i for kind, i in group[x] if kind == "r"), default=30) if len(group[x]) > 1 else 30
        assert rows.tolist() == [first(("r", i)) for i in range(30)] and columns.tolist() == [first(("c", j)) for j in range(40)]
