"""Hard negatives, the n-gram join and whitening on small inputs, against plain versions."""

from __future__ import annotations

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgwarden.llm import count_rtree, hard_negatives, whitening
from pkgwarden.sources.tables import shared_dir

# ---- whitening -----------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "count"), [(1, 4), (3, 2), (8, 60), (20, 400)])
def test_spectrum_follows_every_row(dims, count):
    draw = np.random.default_rng(dims)
    rows = np.floor(draw.standard_normal((count, dims)) * 100)
    rows[: count // 2, -1] = rows[: count // 2, 0]
    rows[count // 3 : count // 2] = rows[0]
    whole, parts = whitening.Spectrum.empty(dims), []
    for row in rows:
        whole.add(row)
    for part in np.array_split(rows, 3):
        parts.append(whitening.Spectrum.empty(dims))
        for row in part:
            parts[-1].add(row)
    for other in parts[1:]:
        parts[0].join(other)
    off = rows - rows.mean(0)
    for found in (whole, parts[0]):
        scatter = (found.vectors * found.values) @ found.vectors.T
        assert np.allclose(scatter, off.T @ off, atol=1e-9 * max(1, abs(scatter).max()))
        assert np.allclose(found.vectors.T @ found.vectors, np.eye(dims), atol=1e-12)
        assert found.n == count and np.allclose(found.mean, rows.mean(0))


def test_deflation_of_equal_and_untouched_values():
    values, vectors = np.array([1.0, 1.0, 1.0, 2.0, 5.0]), np.eye(5)
    v = np.array([1.0, 2.0, 0.0, 1e-200, 3.0])
    new, turned = whitening.rank_one(values, vectors, v, 0.5)
    expected = np.diag(values) + 0.5 * np.outer(v, v)
    assert np.allclose((turned * new) @ turned.T, expected, atol=1e-13)
    assert (np.diff(new) >= 0).all() and 2.0 in new
    assert whitening.rank_one(values, vectors, np.zeros(5), 1.0)[0] is values


def test_secular_roots_interlace():
    draw = np.random.default_rng(4)
    for size in (1, 2, 5, 40):
        d = np.sort(draw.random(size) * 10.0 ** draw.integers(-6, 6, size))
        z = draw.standard_normal(size) * 10.0 ** draw.integers(-4, 1, size)
        roots, vectors = whitening.secular(d, z, 0.7)
        assert (roots > d).all() and (roots[:-1] < d[1:]).all()
        exact = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z))
        assert np.allclose(roots, exact, rtol=1e-10, atol=1e-13 * exact[-1])
        assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-12)


def expected_whitening(rows: np.ndarray, count: int):
    off = rows - rows.mean(0)
    values, vectors = np.linalg.eigh(off.T @ off / len(rows))
    values, vectors = values[::-1], vectors[:, ::-1]
    return off @ vectors[:, :count] / np.sqrt(values[:count]), values[:count] / values.sum()


def test_whitening_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    draw = np.random.default_rng(2)
    given = (draw.standard_normal((90, 5)) * [1, 2, 0.5, 3, 1]).tolist()
    rows = [(i, v) for i, v in enumerate(given)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    found = whitening.whiten(df, 3).collect()
    scaled = np.floor(1024 * np.array(given)) + 100_000
    expected, explained = expected_whitening(scaled, 3)
    table = np.zeros((90, 3))
    for r in found:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 90 and r.explained == pytest.approx(explained[r.component - 1])
        assert r.identity_error < 1e-10
    signs = np.sign((table * expected).sum(0))
    assert np.allclose(table * signs, expected, atol=1e-9)
    exact = [[int(c) for c in row] for row in scaled]
    sums = [sum(column) for column in zip(*exact, strict=True)]
    deviations = {i: sum((90 * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for i, r in enumerate(exact)}
    assert all(r.deviation == deviations[r.vec_id] for r in found)


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, n long, component string"
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [4.0, -1.0]), (3, [0.5, 0.25])]
    odd = [(4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [])]
    rows = [(*r, 1, "x") for r in good + odd]
    found = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.vec_id), r.component) for r in found) == sorted(
        (str(i), c) for i, _ in good for c in (1, 2)
    )
    assert {r.n for r in found} == {4}
    assert [r.whitened for r in found if r.vec_id == 1 and r.component == 1][0] != 0
    # Without variance there is nothing to whiten; neither are there rows without vectors.
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "x") for i in range(3)], schema)
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0], 1, "x") for i in range(3)], schema)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    for empty in (rows[len(good) : len(good) + 1], []):
        assert whitening.whiten(spark.createDataFrame(empty, schema)).count() == 0


def test_large_entries_keep_exact_deviations(spark):
    rows = [(1, [2.0**20, 0.0]), (2, [-(2.0**20), 1.0]), (3, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.deviation for r in whitening.whiten(df, 1).collect()}
    x = [[(1 << 30) + 100_000, 100_000], [-(1 << 30) + 100_000, 101_024], [(1 << 40) + 100_000, 100_000]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((3 * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    assert [found[i + 1] for i in range(3)] == [e if e < 1 << 63 else None for e in exact]


# ---- hard negatives ------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        place = hard_negatives.hilbert_index(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_interval_bounds_hold():
    draw = np.random.default_rng(0)
    rows, anchors = draw.integers(-99, 99, (200, 6)), draw.integers(-99, 99, (9, 6))
    least, most = hard_negatives.bounds(anchors, rows.min(0)[None], rows.max(0)[None])
    scores = anchors @ rows.T
    assert (least[:, 0] <= scores.min(1)).all() and (scores.max(1) <= most[:, 0]).all()
    point = hard_negatives.bounds(anchors, rows[:1], rows[:1])
    assert np.allclose(point[0][:, 0], scores[:, 0]) and np.allclose(point[1][:, 0], scores[:, 0])


def plain_negatives(rows, step):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, label, vector)."""
    x = {i: [math.floor(256 * c) for c in v] for i, _, v in rows}
    label = {i: name for i, name, _ in rows}
    score = lambda a, b: sum(p * q for p, q in zip(x[a], x[b], strict=True))
    found = []
    for a in (i for i in x if i % step == 0):
        order = sorted((-score(a, i), i) for i in x if i != a)
        for minus, p in [o for o in order if label[o[1]] == label[a]][:5]:
            inside = [
                (-s, i) for s, i in order
                if label[i] != label[a] and 30 * -minus <= 100 * -s <= 90 * -minus
            ]
            found += [(a, p, n, i, -minus, s) for n, (s, i) in enumerate(inside[:10], 1)]
    return sorted(found)


def mined(spark, rows, step=10):
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>, score long")
    found = hard_negatives.mine(df, F.col("id") % step == 0)
    assert found.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    ]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_negatives_equal_the_plain_version(spark, monkeypatch, spread):
    """Small blocks, groups and spans, clusters and copies, ties among equal vectors."""
    for name, value in (("BLOCK", 16), ("SPAN", 2), ("GROUP", 4), ("ZONES", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((6, 5))
    rows = []
    for i in range(400):
        vector = centres[i % 6] + spread * draw.standard_normal(5)
        rows.append((i, "ab"[int(draw.random() < 0.2)], vector.round(2).tolist()))
    rows += [(400 + i, "abc"[i % 3], rows[7][2]) for i in range(150)]
    found = mined(spark, [(*r, 0) for r in rows])
    assert found and found == plain_negatives(rows, 10)


def test_zone_maps_leave_blocks_out(spark):
    rows = []
    for i in range(60):
        centre = [10.0, 0.0, 0.0] if i < 30 else [-10.0, 0.0, 0.0]
        rows.append((i, i % 2, [int(256 * c) + i for c in centre], i // 15, 0))
    stored = spark.createDataFrame(rows, "id long, label long, x array<long>, block long, curve long")
    zones = hard_negatives.zone_maps(stored)
    window = F.array(F.struct(F.lit(0).alias("of"), F.lit(1).alias("low"), F.lit(1 << 40).alias("high")))
    anchors = stored.filter("id = 0").select(
        F.lit(0).cast("long").alias("group"), F.lit(1).cast("long").alias("place"), "label", "x",
        window.alias("windows"),
    )
    found = hard_negatives.needed_blocks(anchors, zones, True).collect()
    assert sorted(r.block for r in found) == [0, 1]


def test_negatives_of_odd_rows(spark):
    nan = float("nan")
    rows = [
        (0, "a", [1.0, 0.0], 1), (0, "a", [1.0, 0.0], 1), (1, "a", [0.9, 0.1], 1),
        (2, "b", [0.5, 0.5], 1), (3, "b", [0.5, 0.5], 1), (4, None, [0.5, 0.5], 1),
        (None, "b", [0.5, 0.5], 1), (5, "b", None, 1), (6, "b", [nan, 1.0], 1),
        (7, "b", [None, 1.0], 1), (8, "b", [0.5], 1), (9, "b", [], 1), (10, "c", [0.0, 0.0], 1),
    ]
    found = mined(spark, rows)
    assert found == [(0, 1, 1, 2, 58880, 32768), (0, 1, 2, 3, 58880, 32768)]
    assert mined(spark, []) == []
    assert mined(spark, [(0, "a", None, 1)]) == []
    assert mined(spark, [(0, "a", [1e300, 1.0], 1), (1, "a", [1e300, 1.0], 1)]) == []


# ---- n-gram join ---------------------------------------------------------------------------


def plain_sets(texts, size=4):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = []
    for text in texts:
        words = [w for w in (text or "").translate(lower).replace("\t", " ").split(" ") if w]
        count = max(1, len(words) - size + 1) if words else 0
        found.append({tuple(words[i : i + size]) for i in range(count)})
    return found


def plain_components(ids, sets):
    labels = list(ids)
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and labels[i] != labels[j]:
                labels[i] = labels[j] = min(labels[i], labels[j])
                changed = True
    return labels


def near_texts(seed: int) -> list[str]:
    """Texts of many lengths with copies of which some words are changed, on both sides of 0.85."""
    draw = random.Random(seed)
    texts = []
    for length in (1, 3, 4, 6, 9, 10, 15, 28, 60, 150, 400):
        own = [f"w{draw.randrange(10**6)}" for _ in range(length)]
        texts += [" ".join(own), " ".join(own).upper()]
        for share in (0.0, 0.01, 0.02, 0.04):
            near = [w if draw.random() > share else f"x{draw.randrange(9)}" for w in own]
            texts.append(" ".join(near))
            texts.append(" ".join(near + [f"y{draw.randrange(99)}"] * draw.randrange(3)))
        for extra in range(1, 4 + length // 8):
            texts.append(" ".join(own + [f"z{extra}_{i}" for i in range(extra)]))
    return texts


@pytest.mark.parametrize(("block", "chunk"), [(1 << 14, 1 << 20), (3, 40)])
def test_join_equals_the_plain_version(spark, block, chunk):
    texts = near_texts(block)
    rows = [(i, t, "m") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    found = {
        r.doc_id: (r.n_shingles, r.component)
        for r in count_rtree.similarity_join(df, block=block, chunk=chunk).collect()
    }
    sets = plain_sets(texts)
    labels = plain_components(range(len(texts)), sets)
    assert found == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, labels, strict=True))}
    assert len(set(labels)) < len(labels)


def test_linked_sets_share_a_part():
    """Whatever two linked sets differ in, they have a key in common in the class of the larger."""
    share, draw = count_rtree.Share(), np.random.default_rng(8)
    for size in [*range(6, 60), 100, 333, 1000, 5000]:
        for _ in range(20):
            common = draw.integers(0, 1 << 63, size).astype(np.uint64)
            most = size * 15 // 85
            extra = draw.integers(0, 1 << 63, max(most, 0)).astype(np.uint64)
            cut = draw.integers(0, most + 1)
            a, b = (np.unique(np.append(common, e)) for e in (extra[:cut], extra[cut:]))
            if len(a) == len(b) == size:
                continue
            keys = [
                set(np.concatenate([count_rtree.part_keys(s, c, share) for c in found]).tolist())
                for s in (a, b)
                if (found := share.classes(len(s)))
            ]
            assert len(keys) == 2 and keys[0] & keys[1]


def test_tree_finds_every_pair_within_the_bound():
    draw = np.random.default_rng(1)
    share = count_rtree.Share()
    base = draw.poisson(4, (40, 16))
    points = np.repeat(base, 20, axis=0) + (draw.random((800, 16)) < 0.05)
    sizes = points.sum(1)
    tree = count_rtree.CountTree(points.astype(np.int32), sizes, share)
    asked, rows = tree.search(np.arange(800), np.arange(800))
    overlap = np.minimum(points[:, None], points[None]).sum(2)
    near = share.reached(overlap, sizes[:, None] + sizes[None])
    assert set(zip(asked.tolist(), rows.tolist(), strict=True)) == {
        (i, j) for i, j in np.argwhere(near).tolist() if i < j
    }
    labels = count_rtree.connected(tree)
    assert labels.tolist() == [min(np.flatnonzero(labels == label)) for label in labels]
    assert all(labels[i] == labels[j] for i, j in np.argwhere(near))


def test_join_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    near = long + " one more"
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"),
        (7, long), (8, near), (8, near), (None, None), (9, "é ß x y z"), (-3, "é ß x y z"),
        (10, "É ß x y z"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component long")
    found = sorted((str(r.doc_id), r.n_shingles, r.component) for r in count_rtree.similarity_join(df).collect())
    assert found == sorted([
        ("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("4", 1, 4), ("5", 1, 4), ("6", 1, 6),
        ("None", 1, 4), ("7", 977, 7), ("8", 979, 7), ("8", 979, 7), ("None", 0, None),
        ("9", 2, -3), ("-3", 2, -3), ("10", 2, 10),
    ])
    assert count_rtree.similarity_join(df.limit(0)).count() == 0


def test_one_large_group_of_near_copies(spark):
    """A third of all rows in one block; half of them linked, half below the share."""
    draw = random.Random(2)
    own = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        near = own.copy()
        for at in draw.sample(range(200), 1 if i % 2 else 14):
            near[at] = f"x{i}_{at}"
        texts.append(" ".join(near))
    texts += [" ".join(f"v{draw.randrange(10**6)}" for _ in range(200)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = plain_sets(texts)
    found = {r.doc_id: r.component for r in count_rtree.similarity_join(df, block=64, chunk=9000).collect()}
    assert [found[i] for i in range(len(texts))] == plain_components(range(len(texts)), sets)


def test_packed_keys_come_back():
    draw = np.random.default_rng(5)
    for count in (1, 2, 300, 70_000):
        keys = draw.integers(0, 1 << 64, count, dtype=np.uint64)
        keys[: count // 3] = draw.choice(np.array([0, 1, (1 << 64) - 1, 1 << 63], np.uint64), count // 3)
        ids = draw.integers(0, 1 << 40, count, dtype=np.uint64)
        found = []
        for bucket, size, data in zip(*count_rtree.by_bucket(keys, ids, 9), strict=True):
            own, numbers = count_rtree.unpacked(data, size)
            found += [(bucket, k, i) for k, i in zip(own.tolist(), numbers.tolist(), strict=True)]
        wanted = [(k >> 55, k >> 23 & 0xFFFFFFFF, i) for k, i in zip(keys.tolist(), ids.tolist(), strict=True)]
        assert sorted(found) == sorted(wanted)


def test_stars_hold_the_members_of_all_blocks():
    draw = random.Random(6)
    rows = [(draw.randrange(400), draw.randrange(60)) for _ in range(900)]
    rows += [(1 << 31, 7), (1 << 31, 7), (0xFFFFFFFF, 3), (0xFFFFFFFF, 1 << 39)]
    blocks = {}
    for key, number in rows:
        blocks.setdefault(key, set()).add(number)
    wanted = {}
    for members in blocks.values():
        if len(members) > 1:
            wanted.setdefault(min(members), set()).update(members - {min(members)})
    keys, ids = (np.array(c) for c in zip(*rows, strict=True))
    found = list(count_rtree.stars(keys.astype(np.uint32), ids.astype(np.uint64)))
    assert {least: set(others.tolist()) for least, others in found} == wanted
    assert len(found) == len(wanted) and all(np.all(np.diff(o.astype(int)) > 0) for _, o in found)
    assert not list(count_rtree.stars(np.empty(0, np.uint32), np.empty(0, np.uint64)))


def test_sets_of_one_number_are_compared(spark):
    """With 3 bits nearly all sets share their number with others."""
    texts = near_texts(11)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component for r in count_rtree.similarity_join(df, id_bits=3).collect()}
    labels = plain_components(range(len(texts)), plain_sets(texts))
    assert [found[i] for i in range(len(texts))] == labels


def test_join_writes_little(spark):
    """Scratch tables hold neither the keys of all sets nor a row for each shared key and set."""
    draw = random.Random(9)
    texts = []
    for _ in range(700):
        texts.append(" ".join(f"w{draw.randrange(10**6)}" for _ in range(500)))
    for _ in range(30):
        own = [f"v{draw.randrange(10**6)}" for _ in range(500)]
        texts += [" ".join(w if draw.random() > 0.003 else "x" for w in own) for _ in range(12)]

    def written() -> int:
        found = (os.path.join(d, f) for d, _, names in os.walk(shared_dir(spark)) for f in names)
        return sum(os.path.getsize(f) for f in found)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(4)
    before = written()
    found = {r.doc_id: r.component for r in count_rtree.similarity_join(df).collect()}
    assert len(found) == len(texts) and len(set(found.values())) == 730
    assert written() - before < 0.25 * sum(map(len, texts))
