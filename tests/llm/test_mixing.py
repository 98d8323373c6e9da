from collections import Counter

import pytest
from helpers import edge_docs, no_docs, words

from xmcforge.llm import mixing


def filled(sizes, weights, limit=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = dict.fromkeys(order, 0.0), float(sum(sizes.values()))
    full = set()
    while True:
        left = total - sum(limit * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: float(limit * sizes[s]) if s in full else left * w[s] / sum(w[x] for x in free) for s in order}
        over = {s for s in free if target[s] > limit * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_equal_repeated_sharing(spark):
    for sizes in ({"b": 10, "a": 1000, "é": 5, "Z": 700, None: 3}, {"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 5}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1)).collect()}
        assert got == pytest.approx(filled(sizes, (5, 2, 1)))


def test_copies_and_reruns(spark):
    rows = [(i, "w " * (1 + i % 40), "abcd"[i % 4] if i % 9 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, second = (Counter(r.doc_id for r in mixing.mix(df, (5, 2, 1)).collect()) for _ in range(2))
    assert first == second and max(first.values()) <= 3
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target, taken = filled(sizes, (5, 2, 1)), Counter()
    for i, t, s in rows:
        taken[s] += first[i] * len(words(t))
    assert all(abs(taken[s] - target[s]) < 0.15 * target[s] for s in sizes)
    # every copy count is the floor of its rate or one more
    for i, t, s in rows:
        rate = target[s] / sizes[s]
        assert first[i] in (int(rate), int(rate) + 1)


def test_salted_join_gives_the_same_rows(spark, monkeypatch):
    df = edge_docs(spark)
    plain = Counter(mixing.mix(df, (5, 2, 1)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(mixing.mix(df, (5, 2, 1)).collect()) == plain


def test_edges(spark):
    assert mixing.mix(no_docs(spark), (5, 2, 1)).count() == 0
    df = spark.createDataFrame([(1, None, None, 7, 1), (2, "a b", "s", 8, 2)], "doc_id long, text string, source string, copies int, target int")
    out = mixing.mix(df, (5, 2, 1))
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} <= {1, 2}


def test_words_miss_their_share_by_at_most_half_a_document(spark):
    import random
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.choice([1, 3, 20, 300]), "abc"[i % 3]) for i in range(150)]  # 50 documents a source
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2, 3):
        taken, sizes, largest = Counter(), Counter(), Counter()
        for _, t, s in rows:
            sizes[s] += len(words(t))
            largest[s] = max(largest[s], len(words(t)))
        for r in mixing.mix(df, (5, 2, 1), seed=seed).collect():
            taken[r.source] += len(words(r.text))
        target = filled(sizes, (5, 2, 1))
        assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_draws_are_fair(spark):
    """Each document is copied with about the probability of the fraction."""
    df = spark.createDataFrame([(i, "w w", "a" if i < 60 else "b") for i in range(120)], "doc_id long, text string, source string")
    more = Counter()
    for seed in range(12):
        more.update(Counter(r.doc_id for r in mixing.mix(df, (5, 3), seed=seed).collect()))
    # targets 150 and 90 of 120 words: rates 1.25 and 0.75
    a, b = [more[i] / 12 for i in range(60)], [more[i] / 12 for i in range(60, 120)]
    assert sum(a) / 60 == pytest.approx(1.25, abs=0.01) and sum(b) / 60 == pytest.approx(0.75, abs=0.01)
    assert max(a) <= 1.8 and min(b) >= 0.2
