"""The pipeline's stages against plain versions, each on its own input."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from reviewops.llm import quality_rules, secrets, store
from tests.llm.conftest import sorted_rows, words
from tests.llm.test_joins import links_by_hand
from tests.llm.test_mixing_and_tokens import ids_by_hand, targets_by_hand, tokenizer_once
from tests.llm.test_row_operators import rules_by_hand


@pytest.mark.parametrize("folder", ["nasty", "empty", "small"])
def test_stages(spark, request, folder):
    folder = request.getfixturevalue(folder)
    docs = store.documents(spark, folder)
    packer = __import__("zstandard").ZstdCompressor(level=3)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        after = store.kept(stage(spark, docs, folder), name)
        rows = after.collect()
        if number < 4:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        if name == "quality_rules":
            def stays(text):
                return not rules_by_hand(text)[5] and (lambda r: r[2] and r[1] <= 0.25)(
                    quality_rules._compression((text or "").encode(), packer, quality_rules.BANDS, 4096))
            assert sorted_rows(rows) == sorted_rows(r for r in before if stays(r.text))
        if name == "ngram_jaccard":
            found = links_by_hand([(r.doc_id, r.text) for r in before], 5, 80, 100)
            assert sorted_rows(rows) == sorted_rows(r for r, (i, _, c) in zip(before, found) if i == c)
        if name == "secret_scan":
            assert len(rows) == len(before)
            masked = {r.doc_id: r.text for r in rows}
            for r in before:
                spans = sorted(s for rule, pattern in secrets._compiled(secrets.RULES) for s in secrets.find(r.text or "", rule, pattern))
                text, at = "", 0
                for a, b in spans:
                    if a >= at:
                        text += (r.text or "")[at:a] + "<secret>"
                    at = max(at, b)
                assert masked[r.doc_id] == (text + r.text[at:] if spans else r.text)
        if name == "source_mix":
            sizes, taken, of = defaultdict(int), defaultdict(int), {}
            for r in before:
                sizes[r.source] += len(words(r.text))
                of[r.doc_id] = r
            for r in rows:
                taken[r.source] += len(words(r.text))
                whole = of[r.doc_id]
                assert r.text == whole.text or set(words(r.text)) <= set(words(whole.text))
            target = targets_by_hand(sizes) if sizes else {}
            assert all(abs(taken[s] - target[s]) <= 16 for s in sizes)
        if name == "packing":
            t, pieces = tokenizer_once(), defaultdict(int)
            for r in before:
                ids = ids_by_hand(t, r.text)
                for a in range(0, len(ids), 4096):
                    pieces[r.doc_id, a, zlib.crc32(np.array(ids[a:a + 4096], dtype="<u4").tobytes())] += 1
            got = defaultdict(int)
            for r in rows:
                got[r.doc_id, r.start, zlib.crc32(bytes(r.ids))] += 1
            assert got == pieces
        docs = after


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small)
    used = {r.sequence_id: r.n for r in rows.groupBy("sequence_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert used and max(used.values()) <= 4096
    assert {r.doc_id for r in rows.collect()} <= {r.doc_id for r in store.documents(spark, small).collect()}
