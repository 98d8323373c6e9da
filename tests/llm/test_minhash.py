import random

import numpy as np
from helpers import classes, edge_docs, edge_rows, no_docs
from test_jaccard import corpus
from xmcforge.llm.linking import mixed
from xmcforge.llm.minhash import TensoredTables, minhash_classes


def found(df, n, percent, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_classes(df, n, percent, **kw).collect()}


def test_equal_to_all_pairs(spark):
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, 5, 85) == classes(docs, 5, 85)
    assert found(df, 5, 80) == classes(docs, 5, 80)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] is not None]
    want = classes(rows, 5, 85)
    df = edge_docs(spark).selectExpr("*", "text as node", "doc_id as label", "lang as tile", "1 as bits")
    out = minhash_classes(df, 5, 85).collect()
    assert len(out) == len(edge_rows())
    assert all((r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id) for r in out if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, None)]
    assert minhash_classes(no_docs(spark), 5, 85).count() == 0


def test_keys_combine_pairs_of_a_few_minhashes():
    t = TensoredTables(3, 12)
    assert len(t.salts) == 72
    h = np.sort(mixed(np.arange(500, dtype=np.uint64)))
    keys, ends = t.tiles(h, np.array([0, 0, 100, 500]))
    assert ends.tolist() == [0, 0, 144, 288] and len(set(keys.tolist())) == 288
    low = t.minhashes(h, np.array([0, 100, 500]))
    salt, odd = t.salts[5]
    want = [(int(v) ^ salt) * odd % 2 ** 64 for v in h[:100]]
    want = min((v ^ v >> 32) * 0x9E3779B97F4A7C15 % 2 ** 64 for v in want)
    assert int(low[0, 5]) == want


def test_two_sets_share_a_table_if_and_only_if_both_collections_agree_somewhere():
    rnd, t = random.Random(4), TensoredTables(2, 4)
    for similarity in (0.3, 0.6, 0.9):
        for _ in range(60):
            common = rnd.randrange(20, 60)
            alone = int(common * (1 - similarity) / (2 * similarity)) + 1
            v = mixed(np.array([rnd.getrandbits(60) for _ in range(common + 2 * alone)], np.uint64))
            x, y = np.sort(v[:common + alone]), np.sort(np.concatenate([v[:common], v[common + alone:]]))
            keys, ends = t.tiles(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            low = t.minhashes(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])).reshape(2, 2, 4, 2)
            agree = (low[0] == low[1]).all(axis=2)
            assert bool(set(keys[:16].tolist()) & set(keys[16:].tolist())) == bool(agree[0].any() and agree[1].any())


def test_pairs_at_the_threshold_meet():
    """Sets of similarity 0.85 share a table about as often as stated (2.2e-5 misses)."""
    t, rng = TensoredTables(), np.random.default_rng(5)
    assert t.miss(0.85) < 3e-5 and t.miss(0.92) < 1e-6 and 1 - t.miss(0.1) < 2e-4
    sets, ends = [], [0]
    for _ in range(2000):
        v = mixed(rng.integers(0, 2 ** 62, 100, dtype=np.uint64))  # 85 common, 15 more in the first
        sets += [v, v[:85]]
        ends += [ends[-1] + 100, ends[-1] + 185]
    keys, _ = t.tiles(np.concatenate(sets), np.array(ends))
    keys = keys.reshape(-1, 2, 144)
    assert (keys[:, 0] == keys[:, 1]).any(axis=1).mean() >= 0.999
    apart = mixed(rng.integers(0, 2 ** 62, 200000, dtype=np.uint64))
    keys, _ = t.tiles(apart, np.arange(0, 200001, 100))
    assert len(np.unique(keys)) == len(keys)


def test_a_large_group_of_near_copies(spark):
    base, docs = [f"w{i}" for i in range(150)], []
    for i in range(400):
        copy = list(base)
        copy[i % 140] = f"x{i}"
        docs.append((i, " ".join(copy)))
    out = minhash_classes(spark.createDataFrame(docs, "doc_id long, text string"), 5, 85).collect()
    assert {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1
