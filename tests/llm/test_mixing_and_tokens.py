"""Mixing, packing and token files against plain versions."""

import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewops.llm import mixing, packing, store, token_counts, tokens
from reviewops.llm.queries import QUERIES
from tests.llm.conftest import docs_of, sorted_rows, words

FOLDERS = ["nasty", "empty", "small"]


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, full = {s: Fraction(0) for s in order}, set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        for s in order:
            target[s] = Fraction(3 * sizes[s]) if s in full else Fraction(rest * weight[s], sum(weight[x] for x in open_))
        above = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("folder", FOLDERS)
def test_mix(spark, request, folder):
    folder = request.getfixturevalue(folder)
    query = QUERIES["op1_source_mix"]
    rows = query(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert sorted_rows((r.doc_id, r.size, r.source) for r in rows) == sorted_rows((d.doc_id, len(words(d.text)), d.source) for d in docs)
    sizes, taken, docs_in = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        docs_in[r.source] += 1
        assert 0 <= r.taken <= 3 * r.size
    target = targets_by_hand(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= mixing.BLOCK / 2
    assert sorted_rows(query(spark, folder).collect()) == sorted_rows(rows)


def test_sources_in_ranges_give_the_same_mix(spark, monkeypatch):
    """Many sources, some alike in room, put in order a few at a time."""
    rows = [(i, "w " * (1 + i % 5 * 40), f"s{i % 37:02}" if i % 37 else None) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")

    def mixed():
        drawn = mixing.mix(docs)
        sources = {r.source: (r.sid, r.target, r.quota) for r in drawn.sources.collect()}
        return sources, sorted((r.key, r.taken) for r in mixing.taken(drawn).collect())

    whole = mixed()
    assert [whole[0][s][0] for s in (*(f"s{i:02}" for i in range(1, 37)), None)] == list(range(1, 38))
    monkeypatch.setattr(mixing, "_RANGE", 4)
    assert mixed() == whole


def test_targets_with_small_and_empty_sources(spark):
    sizes = {"a": 1000, "b": 1, "c": 0, "d": 50, "é": 7, "z": 3, None: 100}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    expected = targets_by_hand(sizes)
    for r in mixing.targets(df).collect():
        assert abs(r.target - expected[r.source]) < 1e-6, r


def test_small_sources_beside_a_large_one_get_their_words(spark):
    sizes = {"hot": 40_000, **{f"s{n}": n for n in (1, 5, 10, 16, 31, 32, 33, 40, 64, 100, 333)}}
    docs = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    target = targets_by_hand(sizes)
    rows = mixing.taken(mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))).collect()
    assert {r.source for r in rows} == set(sizes)
    for r in rows:
        assert abs(r.taken - target[r.source]) <= mixing.BLOCK / 2, r
        if target[r.source] == 3 * r.size:
            assert r.taken == 3 * r.size, r
    # targets between full turns: as near as the blocks allow
    some = [(s, n) for s, n in zip("abcdefghij", (900, 10, 70, 45, 333, 20, 61, 100, 7, 250))]
    rows = mixing.taken(mixing.mix(spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(some)], "doc_id bigint, text string, source string"))).collect()
    target = targets_by_hand(dict(some))
    assert all(abs(r.taken - target[r.source]) <= mixing.BLOCK / 2 and r.taken <= 3 * r.size for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(spark, n):
    df = spark.range(n).select(mixing._permuted(F.col("id"), mixing._permutation(F.lit(5), F.lit(n).cast("bigint"))).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(n))


def test_spans_are_the_mix(spark, small):
    mixed = mixing.mix(store.documents(spark, small))
    by_span = {r.key: r.n for r in mixing.spans(mixed).groupBy("key").agg(F.sum("words").alias("n")).collect()}
    assert by_span == {r.key: r.taken for r in mixing.taken(mixed).collect() if r.taken}


def test_mixed_documents(spark, nasty):
    docs = store.documents(spark, nasty)
    texts = dict(docs_of(spark, nasty))
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    rows = rows.collect()
    taken = defaultdict(int)
    for r in rows:
        assert set(words(r.text)) <= set(words(texts[r.doc_id])) and r.n_chars == len(r.text)
        taken[r.doc_id] += len(words(r.text))
    expected = defaultdict(int)
    for r in QUERIES["op1_source_mix"](spark, nasty).collect():
        expected[r.doc_id] += r.taken
    assert taken == {k: v for k, v in expected.items() if v}


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_by_hand(t, text):
    return t.encode(text or "", add_special_tokens=False).ids + [tokens.END]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aé ß́ 　\x0b\x1c\n'sΣ<|endoftext>1ﬁK", max_size=60))
def test_words_have_the_ids_of_the_text(text):
    text = text.encode("utf-8", "replace").decode()
    got = tokens.encoder(tokens.default_path()).encode([text.encode()])[0]
    assert np.frombuffer(got, "<u4").tolist() == ids_by_hand(tokenizer_once(), text)[:-1]


_TOKENIZER = []


def tokenizer_once():
    if not _TOKENIZER:
        _TOKENIZER.append(tokenizer())
    return _TOKENIZER[0]


@pytest.mark.parametrize("folder", FOLDERS)
def test_packing(spark, request, folder):
    folder = request.getfixturevalue(folder)
    rows = QUERIES["op2_packing"](spark, folder).collect()
    t = tokenizer_once()
    expected = []
    for i, text in docs_of(spark, folder):
        ids = ids_by_hand(t, text)
        for a in range(0, len(ids), 4096):
            part = np.array(ids[a:a + 4096], dtype="<u4")
            expected.append((i, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert sorted_rows(r[:5] for r in rows) == sorted_rows(expected)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    if rows:
        total = sum(r.length for r in rows)
        assert len(sequences) <= total / 4096 * 1.03 + 2


def test_sequences_hold_the_ids(spark, nasty):
    packed = packing.placed(packing.pieces(store.documents(spark, nasty)))
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=30))
def test_patterns_hold_every_piece(counts):
    sizes = np.array(sorted(counts))
    wanted = np.array([counts[s] for s in sizes])
    plan = packing.patterns(sizes, wanted, 64)
    assert (sum(p * n for p, n in plan) == wanted).all()
    assert all((p * sizes).sum() <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= (sizes * wanted).sum() / 64 * 2 + 2  # never worse than half full


@pytest.mark.parametrize("folder", FOLDERS)
def test_token_counts(spark, request, folder):
    folder = request.getfixturevalue(folder)
    rows = QUERIES["op3_token_counts"](spark, folder).collect()
    t = tokenizer_once()
    assert sorted_rows(r[:2] for r in rows) == sorted_rows((i, len(ids_by_hand(t, x)) - 1) for i, x in docs_of(spark, folder))


@pytest.mark.parametrize("size", [2, 4, 10, 64, 1 << 20])
def test_documents_across_blocks(spark, nasty, size):
    path = store.new_path(spark, "token-files")
    token_counts.write(store.documents(spark, nasty).where("doc_id is null or doc_id not in (5, 12)").coalesce(1), path)
    t = tokenizer_once()
    rows = token_counts.counts(spark, path, size).collect()
    assert sorted_rows(r[:2] for r in rows) == sorted_rows((i, len(ids_by_hand(t, x)) - 1) for i, x in docs_of(spark, nasty) if i not in (5, 12))
    assert sorted(r.position for r in rows) == list(range(len(rows)))


def test_long_texts_get_files_of_their_own(spark, tmp_path):
    """No file holds more than its size allows, and nothing is lost when most texts are long."""
    texts = ["a b c " * n for n in (0, 1, 5, 40, 400, 4000, 40_000)] * 4 + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    path = str(tmp_path / "tokens")
    token_counts.write(docs, path, files=((64, 8), (4096, 4), (1 << 31, 1)))
    got = {r.doc_id: r.n_tokens for r in token_counts.counts(spark, path, size=1024).collect()}
    assert got == {i: 3 * (len(t or "") // 6) for i, t in enumerate(texts)}
    sizes = [p.stat().st_size for p in (tmp_path / "tokens").glob("part-*")]
    assert max(sizes) <= 2 * (3 * 40_000 + 6) and len(sizes) >= 8 + 8 // 4 + 2
    token_counts.write(docs.limit(0), str(tmp_path / "none"))
    assert token_counts.counts(spark, str(tmp_path / "none")).count() == 0
