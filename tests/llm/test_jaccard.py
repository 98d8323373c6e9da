import random
from collections import Counter

from helpers import classes, edge_docs, edge_rows, no_docs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa
from xmcforge.llm.components import components
from xmcforge.llm.jaccard import Bands, near_duplicates
from xmcforge.llm.linking import cell_pairs, exact_common, forest, least_common, may_link, ngram_sets, settled, signatures, tile_cells


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    out, common = [], " ".join(word() for _ in range(40))
    for base in range(40):
        words = [word() for _ in range(rnd.choice([1, 3, 4, 5, 9, 20, 60, 200]))] + (common.split() if base % 3 == 0 else [])
        for _ in range(rnd.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rnd.randrange(0, max(1, len(copy) // 25) + 1)):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy).upper() if rnd.random() < 0.2 else "  ".join(copy) + "\n")
    ids = list(range(len(out)))
    rnd.shuffle(ids)
    return list(zip(ids, out))


def found(df, n, percent):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, n, percent).collect()}


def test_equal_to_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, 4, 85) == classes(docs, 4, 85)
    assert found(df, 5, 80) == classes(docs, 5, 80)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] is not None]
    out = near_duplicates(edge_docs(spark), 4, 85).collect()
    assert len(out) == len(edge_rows())
    want = classes(rows, 4, 85)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in out if r.doc_id is not None)
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert near_duplicates(no_docs(spark), 4, 85).count() == 0


def test_ids_with_two_texts_join_both(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (3, b)], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(df, 4, 85).collect()} == {3}


def test_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(300):
        copy = list(base)
        copy[i % 110] = f"x{i}"
        docs.append((i, " ".join(copy)))
    out = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert {r.component_id for r in out} == {0}


def test_similar_sets_share_a_tile(spark):
    docs = corpus(2)
    rows = signatures(spark.createDataFrame(docs, "id long, text string"), 4, Bands(85)).collect()
    tiles = {r.id: set(r.tiles) for r in rows}
    h, o = ngram_sets(pa.array([t for _, t in docs]), 4)
    sets = {i: set(h[o[k]:o[k + 1]].tolist()) for k, (i, _) in enumerate(docs)}
    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                assert tiles[i] & tiles[j]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=60), st.sets(st.integers(0, 400), min_size=1, max_size=60))
def test_bitmaps_never_rule_out_a_link(x, y):
    x = x | set(range(1000, 1040))
    y = y | set(range(1000, 1040))

    def bits(s, width):
        b = np.zeros(width, bool)
        b[[v % width for v in s]] = True
        return np.packbits(b, bitorder="little").view("<u8")[None, :]

    ok = may_link(bits(x, 128), len(x), bits(y, 64), len(y), 85)[0]
    similar = 100 * len(x & y) >= 85 * len(x | y)
    assert ok or not similar
    assert (len(x & y) >= least_common(len(x), len(y), 85)) == similar


def test_bands_cover_neighbours():
    b = Bands(85)
    for s in range(1, 3000):
        for other in (s, -(-s * 85 // 100)):
            if 100 * other >= 85 * s:
                assert set(b.joined(s)) & set(b.joined(max(1, other)))


def one_tile(spark, texts):
    """(docs, members, marks): all texts in one tile."""
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = signatures(docs, 4, Bands(85)).withColumnRenamed("id", "node")
    members = sets.selectExpr("1L as tile", "node", "0L as pivot", f"{len(texts)}L as n")
    return docs, members, sets.select("node", "size", "bits")


NO_LABELS = "node long, label long"


@pytest.mark.parametrize("grams", [1 << 22, 9])
def test_cells_hold_every_pair_of_different_classes_once(spark, grams):
    docs, members, marks = one_tile(spark, [f"w{i} a{i} b{i} c{i}" for i in range(30)])
    labels = spark.createDataFrame([(i, 3) for i in range(3, 14)], NO_LABELS)  # eleven of one class
    of = {i: 3 if 3 <= i < 14 else i for i in range(30)}
    cells, seen = {}, Counter()
    for r in tile_cells(members, labels, marks, 8, grams).collect():
        cells.setdefault((r.mi, r.aj, r.sub), []).append(r)
        assert r.minor == (of[r.node] != 3)
    assert (max(sub for _, _, sub in cells) > 0) == (grams == 9)
    for rows in cells.values():
        for x in rows:
            for y in rows:
                if x.flag & 1 and y.flag & 2 and of[x.node] != of[y.node] and (not y.minor or x.node < y.node):
                    seen[min(x.node, y.node), max(x.node, y.node)] += 1
    assert seen == {(i, j): 1 for i in range(30) for j in range(i + 1, 30) if of[i] != of[j]}


def test_cells_emit_forests_not_pairs(spark):
    """Fewer rows than the cells have members, however many pairs are possible."""
    docs, members, marks = one_tile(spark, [" ".join(f"w{k}" for k in range(40)) + f" x{i}" for i in range(60)])
    labels, data = spark.createDataFrame([], NO_LABELS), marks.withColumnRenamed("bits", "data")
    cells = tile_cells(members, labels, marks, block=16).cache()
    pairs = cell_pairs(cells, labels, data, 85, False).collect()
    assert {(r.a, r.b) for r in pairs} and len(pairs) < cells.count() < 60 * 60 / 2
    whole = cell_pairs(tile_cells(members, labels, marks), labels, data, 85, False).collect()
    assert len(whole) == 59  # a tree over one cell
    assert {r.label for r in settled(members, marks, labels, docs, 4, 85, block=16).collect()} == {0}


def test_bitmaps_that_rule_nothing_out_lose_no_link(spark):
    docs = [(i, t) for i, (_, t) in enumerate(corpus(5))]
    _, members, marks = one_tile(spark, [t for _, t in docs])
    blind = marks.selectExpr("node", "size", f"X'{'ff' * 8}' as bits")
    want = {i: c for i, (_, c) in classes(docs, 4, 85).items()}
    for block, grams in ((1024, 1 << 22), (40, 900)):
        labels = settled(members, blind, spark.createDataFrame([], NO_LABELS), spark.createDataFrame(docs, "id long, text string"), 4, 85, block, grams)
        got = {r.node: r.label for r in labels.collect()}
        assert {i: got.get(i, i) for i, _ in docs} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 9000), min_size=1, max_size=40), min_size=2, max_size=12))
def test_overlaps_in_bulk(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    p, q = (np.array(v) for v in zip(*[(i, j) for i in range(len(sets)) for j in range(len(sets)) if i < j]))
    assert exact_common(arrays, p, q).tolist() == [len(sets[i] & sets[j]) for i, j in zip(p, q)]


def test_a_forest_takes_the_most_similar_pairs():
    sets = [set(range(100)), set(range(3, 100)), set(range(8, 100)), set(range(500, 600))]
    rows = [[i, i, len(s), np.array(sorted(s), "<u8").tobytes(), 3, True] for i, s in enumerate(sets)]
    assert sorted(forest(rows, 85, True)) == [(0, 1), (1, 2)]


def test_no_band_names_empty_parts_often():
    """Sets with so many empty parts that they name them stay rare, at the low end of each band, too."""
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        bands = Bands(percent)
        for band in range(60):
            size = bands.smallest(band)
            if bands.edges[band] > 40000:
                break
            if bands.of(size) not in (band, band - 1) or band not in bands.joined(size):
                continue
            named = 0
            for _ in range(200):
                empty = bands.parts(band) - len(np.unique(rng.integers(0, bands.parts(band), size)))
                named += empty > bands.spare(band)
            assert named <= 10, (percent, band, size, named)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
