"""The pipeline, stage by stage, on whole tables and on odd rows."""

from __future__ import annotations

import os
import sys

import pytest
from compare import sf_dir

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from pkgwarden.llm import crf_secrets  # noqa: E402
from pkgwarden.sources.tables import settle  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and returned, as rows."""
    docs = spark.read.parquet(f"{sf_dir()}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = settle(stage(spark, docs, sf_dir()))
        found[name] = (docs.collect(), kept.collect())
        docs = kept
    return found


def test_columns_and_order(stages):
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixing", "encoding"]
    for name, (given, kept) in stages.items():
        if name != "encoding":
            assert kept[0].asDict().keys() == given[0].asDict().keys()


def test_toxic_documents_go(spark, stages):
    given, kept = stages["toxicity"]
    labels = {
        r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir()}/labels.parquet").collect()
    }
    left = {r.doc_id for r in kept}
    gone = {r.doc_id for r in given} - left
    assert not any(labels.get(i) == 0 for i in gone)
    assert sum(labels.get(i) == 1 for i in gone) >= 0.8 * sum(labels.values())


def test_one_of_each_near_duplicate_stays(stages):
    given, kept = stages["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in given)
    ids = [i for i, _ in rows]
    labels = brute.components(ids, [brute.simhash(t, 3) for _, t in rows], 3)
    assert sorted(r.doc_id for r in kept) == sorted(set(labels))
    texts = dict(rows)
    assert all(r.text == texts[r.doc_id] for r in kept)


def test_secrets_are_gone(stages):
    given, kept = stages["secrets"]
    assert {r.doc_id for r in given} == {r.doc_id for r in kept}
    before = {r.doc_id: r.text for r in given}
    for r in kept:
        assert not crf_secrets.pattern_spans(r.text)
        assert r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or "[SECRET]" in r.text


def test_mix_and_round_trip(stages):
    given, kept = stages["mixing"]
    total = sum(len(brute.words(r.text)) for r in given)
    assert sum(len(brute.words(r.text)) for r in kept) == pytest.approx(total, rel=0.01)
    mixed, encoded = stages["encoding"]
    assert len(mixed) == len(encoded)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in encoded)


def test_odd_rows_pass_through(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [
        (1, None, None, None, None),
        (None, "some words", "en", None, 3),
        (2, "", "en", "a", 0),
        (3, "token = abcdefghijklmnop", "en", "a", 24),
        (3, "token = abcdefghijklmnop", "en", "a", 24),
    ]
    found = {}
    for given in (rows, []):
        docs = spark.createDataFrame(given, columns)
        for name, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, sf_dir()))
            found.setdefault(name, []).append(docs.collect())
    assert all(empty == [] for _, empty in found.values())
    # No row of these is toxic; texts without words are one group, and so are repeated rows.
    assert len(found["toxicity"][0]) == len(rows)
    assert {r.doc_id for r in found["near_duplicates"][0]} == {1, 3, None}
    assert {r.text for r in found["secrets"][0]} == {None, "some words", "[SECRET]"}
    assert all(r.round_trip for r in found["encoding"][0])
