"""Each registered query of the pipeline operators against a plain version, on whole tables."""

from __future__ import annotations

import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import oracle, oracle_result, sf_dir, spark_result

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from pkgwarden.llm import crf_secrets, mixing, queries  # noqa: E402
from pkgwarden.llm.bpe_tree import read_ranks  # noqa: E402


def run(spark, name):
    return queries.queries()[name](spark, sf_dir()).collect()


@pytest.fixture(scope="module")
def documents(spark):
    """(id, text) in ascending order of the id."""
    rows = queries.table(spark, sf_dir(), "documents").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text or "") for r in rows)


def test_op1_edits_and_likeness(spark, documents):
    found = {r.doc_id: r for r in run(spark, "op1_lz_fingerprint")}
    texts = [t for _, t in documents]
    assert len(found) == len(documents)
    near, following = [], []
    for (key, text), edit, after in zip(
        documents, brute.edited(texts), texts[1:] + texts[:1], strict=True
    ):
        row, own = found[key], brute.phrases(text)
        assert row.n_chars == len(text)
        assert row.edited_sha256 == brute.sha(edit)
        near.append(row.near_edited - brute.jaccard(own, brute.phrases(edit)))
        following.append(row.near_next - brute.jaccard(own, brute.phrases(after)))
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
    for errors in (near, following):
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    marks = {}
    for key, text in documents:
        assert marks.setdefault(text, found[key].fingerprint) == found[key].fingerprint


def test_op2_equals_the_articles(spark):
    pages = {r.page_id: r for r in queries.table(spark, sf_dir(), "pages").collect()}
    found = run(spark, "op2_html_blocks")
    assert len(found) == len(pages)
    for r in found:
        text = brute.article_text(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, text, len(text))


def test_op3_base_spans(spark, documents):
    found = {r.doc_id: r for r in run(spark, "op3_crf_secrets")}
    for key, text in documents:
        spans = crf_secrets.pattern_spans(text)
        row, kinds = found[key], [k for _, k, _ in spans]
        written = [f"{crf_secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(kinds.count(k) for k in range(3))
        assert row.base_sha256 == brute.sha(",".join(written))
        assert set(written) <= set(row.spans.split(","))| {""}


def test_op4_recall_and_scores(spark):
    rows = queries.table(spark, sf_dir(), "embeddings").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    found = {}
    for r in sorted(run(spark, "op4_kmeans_tree"), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    assert sorted(found) == sorted(i for i in ids if i % 20 == 0)
    hits = 0
    for query, own in found.items():
        every = brute.nearest(ids, vectors, query, len(ids))
        exact = dict(every)
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(r.score == exact[r.vec_id] for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {i for i, _ in every[:20]})
    assert hits >= 0.9 * 20 * len(found)


def test_op5_components(spark, documents):
    found = {r.doc_id: r for r in run(spark, "op5_simhash")}
    ids = [i for i, _ in documents]
    marks = [brute.simhash(t, 3) for _, t in documents]
    expected = brute.components(ids, marks, 3)
    assert {i: (f"{m:016x}", c) for i, m, c in zip(ids, marks, expected, strict=True)} == {
        i: (r.fingerprint, r.component_id) for i, r in found.items()
    }


def test_op6_equals_the_library(spark, documents):
    encoding = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        special_tokens={},
    )
    found = {r.doc_id: r for r in run(spark, "op6_bpe_tree")}
    for key, text in documents:
        ids = encoding.encode_ordinary(text)
        assert found[key].n_tokens == len(ids)
        assert found[key].ids_sha256 == brute.sha(" ".join(map(str, ids)))
        assert found[key].decoded_sha256 == brute.sha(text)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, sf_dir())
    with oracle(sf_dir()) as connection:
        sql = queries.oracle_sql()[name]
        assert spark_result(df) == oracle_result(connection, sql)


def test_op8_held_out_fold(spark):
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf_dir(), "labels").collect()}
    rows = run(spark, "op8_toxicity")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    learned = [(labels[r.doc_id], r.predicted) for r in rows if r.doc_id in labels and not r.held_out]
    assert sum(a == b for a, b in learned) >= 0.95 * len(learned)
    clean = [r.predicted for r in rows if labels.get(r.doc_id) == 0 and r.held_out]
    assert sum(clean) <= 0.1 * len(clean)


def test_op8_finds_held_out_toxic_documents(spark):
    """On a table of more labels: the fold that was not learnt from."""
    directory = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in queries.table(spark, directory, "labels").collect()}
    rows = queries.op8_toxicity(spark, directory).filter("held_out").collect()
    toxic = [r.predicted for r in rows if labels.get(r.doc_id) == 1]
    clean = [r.predicted for r in rows if labels.get(r.doc_id) == 0]
    assert len(toxic) > 50 and np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.02


def test_op9_equals_plain_removal(spark, documents):
    expected = brute.without_repeats(documents, 20)
    for r in run(spark, "op9_window_dedup"):
        words, removed, kept = expected[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (words, removed, brute.sha(kept))


def test_op10_meets_its_targets(spark, documents):
    rows = run(spark, "op10_mixing")
    assert sorted(map(str, rows)) == sorted(map(str, run(spark, "op10_mixing")))
    texts = dict(documents)
    sources = {
        r.doc_id: r.source for r in queries.table(spark, sf_dir(), "documents").collect()
    }
    by_source = {}
    for r in rows:
        assert r.size == len(brute.words(texts[r.doc_id]))
        assert r.taken <= 3 * r.size
        by_source.setdefault(sources[r.doc_id], []).append(r)
    total = sum(r.size for r in rows)
    assert sum(own[0].target for own in by_source.values()) == pytest.approx(total)
    for own in by_source.values():
        assert own[0].source_size == sum(r.size for r in own)
        # A source of ten documents cannot meet every number of words.
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 + 0.01 * own[0].source_size


def test_mix_meets_every_target_by_a_word(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    taken, target = {}, {}
    for r in mixing.mix_sources(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= mixing.MOST_COPIES
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
