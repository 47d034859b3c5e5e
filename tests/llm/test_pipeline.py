"""The stages one after the other, each against what it is given."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from mimicry.llm import packing, secrets
from mimicry.llm.common import stored, table
from tests.llm.test_jaccard import plain
from tests.llm.test_secrets import plain as plain_spans

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard", "secret_scan", "source_mix", "best_fit_packing"]
    docs = table(spark, SF, "documents")
    columns, steps = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert name == names[-1] or docs.columns == columns
        steps.append(docs.collect())
    given, spoken, single, clean, mixed, packed = steps

    assert {r.doc_id for r in given} - {r.doc_id for r in spoken} == {
        r.doc_id for r in given if not any(c.isalpha() for c in r.text or "")
    }
    groups = plain([(r.doc_id, r.text) for r in spoken])
    assert sorted(r.doc_id for r in single) == sorted(i for i, c in groups.items() if i == c)
    before = {r.doc_id: r for r in single}
    assert len(clean) == len(single)
    for r in clean:
        base, added = plain_spans(before[r.doc_id].text)
        assert (r.text == before[r.doc_id].text) == (not base and not added)
        assert r.n_chars == len(r.text) and (secrets.MARK in r.text) >= bool(base)
    size = sum(len(WORD.findall(r.text)) for r in clean)
    taken = sum(len(WORD.findall(r.text)) for r in mixed)
    assert 1.2 * size < taken < 1.8 * size and set(mixed) <= set(clean)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    pieces = Counter(r.doc_id for r in packed if r.piece == 0)
    assert pieces == Counter(r.doc_id for r in mixed)
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.CAPACITY


def test_no_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() == 0
