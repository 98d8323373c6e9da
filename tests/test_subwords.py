"""Longest pieces against a plain reading of each word."""

import random
from collections import Counter

from xmcforge.functions import subwords as SW
from xmcforge.functions.text import BOS_ID, EOS_ID, FIRST_TOKEN_ID, UNK_ID


def vocab_of(texts, min_count, max_piece):
    words = Counter(w for t in texts for w in (t or "").lower().split())
    pieces = Counter()
    for w, n in words.items():
        if n >= min_count and 2 <= len(w) <= max_piece:
            pieces[w] += n
        for c in w:
            pieces[c] += n
    order = sorted(pieces, key=lambda p: (-pieces[p], p.encode()))
    return {p: FIRST_TOKEN_ID + i for i, p in enumerate(order)}, pieces


def read(word, vocab, max_piece):
    out = []
    while word:
        size = next((n for n in range(min(max_piece, len(word)), 0, -1) if word[:n] in vocab), 0)
        out.append(vocab.get(word[:size], UNK_ID))
        word = word[max(size, 1):]
    return out


def rows_of(texts, vocab, max_piece):
    out = []
    for i, t in texts:
        words = (t or "").lower().split()
        out.append((i, 0, 0, BOS_ID))
        out += [(i, p, k, x) for p, w in enumerate(words, 1) for k, x in enumerate(read(w, vocab, max_piece))]
        out.append((i, len(words) + 1, 0, EOS_ID))
    return sorted(out)


def test_vocabulary_and_ids_equal_a_plain_reading(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcé中𠀁0") for _ in range(rnd.choice((1, 2, 2, 3, 4, 9))))
    texts = [(i, " ".join(word() for _ in range(rnd.randrange(30)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "  "), (103, "Abc ABC abc"), (104, "ab" * 400), (105, "ab ab ab")]
    corpus = spark.createDataFrame(texts, "row_id long, text string")
    for min_count, max_piece in ((2, 32), (3, 3)):
        want, counts = vocab_of([t for _, t in texts], min_count, max_piece)
        vocab = SW.piece_vocab(corpus, min_count=min_count, max_piece=max_piece)
        have = {r.token: (r.token_id, r["count"]) for r in vocab.collect()}
        assert have == {p: (i, counts[p]) for p, i in want.items()}
        got = sorted(map(tuple, SW.subword_sequence(corpus, vocab, max_piece=max_piece).collect()))
        assert got == rows_of(texts, want, max_piece)


def test_characters_without_a_piece_are_unknown_one_by_one(spark):
    known = [("ab", 3, 4), ("a", 9, 5), ("b", 8, 6)]
    vocab = spark.createDataFrame(known, "token string, count long, token_id long")
    corpus = spark.createDataFrame([(1, "abxyab bab"), (1, "ab")], "row_id long, text string")
    got = sorted(map(tuple, SW.subword_sequence(corpus, vocab).collect()))
    assert got == rows_of([(1, "abxyab bab"), (1, "ab")], {"ab": 4, "a": 5, "b": 6}, 32)


def test_empty_corpus(spark):
    corpus = spark.createDataFrame([], "row_id long, text string")
    vocab = SW.piece_vocab(corpus)
    assert vocab.count() == 0 and SW.subword_sequence(corpus, vocab).count() == 0


def test_few_decomposed_words_leave_the_rows_of_the_texts_where_they_are(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, f"ab ab{i % 7} x{i}") for i in range(50)], "row_id long, text string")
    vocab = SW.piece_vocab(corpus, min_count=3)
    few = SW.subword_sequence(corpus, vocab)
    joins = [x for x in few._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) >= 2 and all("broadcast" in x for x in joins)
    monkeypatch.setattr(SW, "PIECES_BROADCAST_ROWS", 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, SW.subword_sequence(corpus, vocab).collect()))


def shuffled(plan):
    """Rows that the exchanges of a plan that has run have written."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_only_rare_words_of_the_texts_are_shuffled(spark, monkeypatch):
    texts = [(i, "ab cd " * 30 + f"xy{i}") for i in range(50)]
    corpus = spark.createDataFrame(texts, "row_id long, text string")
    vocab = SW.piece_vocab(corpus, min_count=3)
    monkeypatch.setattr(SW, "PIECES_BROADCAST_ROWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the readings were many
    try:
        got = SW.subword_sequence(corpus, vocab)
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert rows == rows_of(texts, vocab_of([t for _, t in texts], 3, 32)[0], 32)
    # the texts once for each reading, the 50 rare words and their 50 readings; 3,050 words in all
    assert shuffled(got._jdf.queryExecution().executedPlan()) <= 4 * len(texts)


def test_rows_of_a_words_places_stay_in_its_task(spark):
    words = [(f"abcab{i}", f"abcab{i}", 1) for i in range(40)]
    vocab = spark.createDataFrame([("a", 1, 4), ("abc", 1, 5), ("b", 1, 6), ("ab", 1, 7)], "token string, count long, token_id long")
    got = SW.decompose(spark.createDataFrame(words, "key string, word string, n long"), vocab, tasks=3)
    rows = {r.key: r.ids for r in got.collect()}
    assert rows == {w: read(w, {"a": 4, "abc": 5, "b": 6, "ab": 7}, 32) for w, _, _ in words}
    assert shuffled(got._jdf.queryExecution().executedPlan()) == len(words)


def test_slices_of_the_vocabulary_and_windows_of_words_read_alike(spark, monkeypatch):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abé中𠀁") for _ in range(rnd.choice((1, 2, 3, 3, 4, 5, 9, 40))))
    texts = [(i, " ".join(word() for _ in range(rnd.randrange(40)))) for i in range(50)] + [(90, None), (None, "ab ab"), (91, "zz" * 70), (91, "zz ab")]
    corpus = spark.createDataFrame(texts, "row_id long, text string")
    pieces, _ = vocab_of([t for _, t in texts], 2, 5)
    pieces = {p: i for p, i in pieces.items() if p not in ("z", "中")}  # characters without a piece
    vocab = spark.createDataFrame([(p, 1, i) for p, i in pieces.items()], "token string, count long, token_id long")
    want = sorted(rows_of([(-1 if i is None else i, t) for i, t in texts], pieces, 5))
    for lookup, window, common, few in ((7, 4, 48 << 20, 0), (25, 256, 3_000, 0), (500_000, 3, 0, 100_000)):
        for k, v in (("LOOKUP_ROWS", lookup), ("WINDOW", window), ("COMMON_BYTES", common), ("PIECES_BROADCAST_ROWS", few), ("TASK_CHARACTERS", 300)):
            monkeypatch.setattr(SW, k, v)
        slices = SW._slices(vocab, 5)
        assert (len(slices) > 3 and max(x[3] for x in slices) > 1) if lookup == 7 else slices
        got = [tuple(r) for r in SW.subword_sequence(corpus, vocab, max_piece=5).collect()]
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
