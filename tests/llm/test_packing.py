import os
import zlib

import numpy as np
import public_tokenizers as P
from helpers import edge_docs, edge_rows, no_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from xmcforge.llm.packing import fill_sequences, pack, pack_texts, token_pieces

MODEL = P.path("byte_bpe_50k.json")


def check_sequences(rows, limits):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for group in by.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == list(np.cumsum([0] + [r.length for r in group])[:-1])
        assert sum(r.length for r in group) <= limits["length"] and len(group) <= limits["segments"]


def test_pieces_are_the_tokenizers_ids(spark):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(MODEL)
    got = {}
    for r in token_pieces(edge_docs(spark), MODEL, 2048, slice_bytes=5000).collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, t, *_ in edge_rows():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want = {(a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)}
        assert got[i] == want, i


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(list("ab1'!. \t\n\r\x0b\x1c\x85  ​　é") + ["'s", "<|endoftext|>"]), max_size=40).map("".join))
def test_runs_are_safe_boundaries(text):
    import re
    from xmcforge.llm.packing import SPACE
    tok = _tokenizer()
    runs = re.findall(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", text)
    assert "".join(runs) == text
    split = [i for r in runs for i in tok.encode(r, add_special_tokens=False).ids]
    assert split == tok.encode(text, add_special_tokens=False).ids


def _tokenizer(cache=[]):  # noqa: B006
    if not cache:
        cache.append(Tokenizer.from_file(MODEL))
    return cache[0]


def test_packed_texts(spark):
    out = pack_texts(edge_docs(spark), MODEL, length=256, max_segments=4).collect()
    check_sequences(out, {"length": 256, "segments": 4})
    n = len(token_pieces(edge_docs(spark), MODEL, 256).collect())
    assert len(out) == n
    assert pack_texts(no_docs(spark), MODEL).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 2), st.integers(0, 12)), max_size=60))
def test_limits_hold_and_nothing_is_lost(items):
    demand = np.array(items, np.int64).reshape(-1, 3)
    limits = np.array([10, 5, 8])
    sequence, place = fill_sequences(demand, limits) if len(demand) else (np.zeros(0, int), np.zeros(0, int))
    assert len(sequence) == len(items)
    for s in set(sequence.tolist()):
        mine = sequence == s
        assert sorted(place[mine]) == list(range(mine.sum()))
        assert mine.sum() == 1 or (demand[mine].sum(axis=0) <= limits).all()


def test_the_largest_dot_product_goes_in_next():
    # left (10, 10): (6, 1) scores 0.7, (5, 5) scores 1.0 and goes first; then (5, 5) fills up
    sequence, place = fill_sequences([[6, 1], [5, 5], [5, 5]], [10, 10])
    assert sequence.tolist() == [1, 0, 0] and sorted(place.tolist()) == [0, 0, 1]


def test_general_examples_with_nulls_and_clashing_names(spark):
    rows = [(i, 5 + i % 3, None if i % 4 == 0 else i % 5, "old") for i in range(50)]
    df = spark.createDataFrame(rows, "item int, tokens long, loss long, sequence_id string")
    out = pack(df, {"tokens": 16, "loss": 6}, "tokens", group_rows=10).collect()
    assert sorted(r.item for r in out) == list(range(50))
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.tokens for r in g) <= 16 and sum(r.loss or 0 for r in g) <= 6 for g in by.values())


def test_each_limit_decides_some_placement():
    """Instruction data: prompts bear no loss, so loss, segments and length bind in different places."""
    demand = [(100, 1, 10)] * 6 + [(10, 1, 1)] * 9 + [(30, 1, 30)] * 6
    limits = {0: 200, 1: 5, 2: 60}
    full = fill_sequences(demand, list(limits.values()))[0]
    for d in limits:  # without this limit some sequence exceeds it
        free = fill_sequences(demand, [10 ** 9 if k == d else v for k, v in limits.items()])[0]
        assert max(sum(demand[i][d] for i in range(len(demand)) if free[i] == s) for s in range(free.max() + 1)) > limits[d]
    for s in range(full.max() + 1):
        rows = [demand[i] for i in range(len(demand)) if full[i] == s]
        assert all(sum(r[d] for r in rows) <= limits[d] for d in limits)


def test_the_segment_limit_binds_on_short_texts(spark):
    import public_tokenizers
    from collections import Counter
    df = spark.createDataFrame([(i, "some words") for i in range(100)], "doc_id long, text string")
    for n in (16, 5):
        out = pack_texts(df, public_tokenizers.path("byte_bpe_50k.json"), max_segments=n).collect()
        assert max(Counter(r.sequence_id for r in out).values()) == n


def test_units_encoded_together_equal_units_alone():
    import random
    import public_tokenizers
    from array import array
    from tokenizers import Tokenizer
    from xmcforge.llm.packing import token_bytes, unit_ids
    tok, rnd = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    bits = ["a", "The", "é", "日", "😀", "'s", "12", "!", "\n", "\x85", "　", "<|endoftext|>", "\x00", "़"]
    units = [rnd.choice([" ", "", "  "]) + "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 6))) for _ in range(5000)]
    units = [u for u in dict.fromkeys(units) if u]
    want = [array("I", tok.encode(u, add_special_tokens=False).ids).tobytes() for u in units]
    assert unit_ids(tok, token_bytes(tok), units) == want


def test_a_column_called_like_the_group_passes(spark):
    from xmcforge.llm.common import written
    df = written(spark.createDataFrame([(i, 5, i * 2) for i in range(20)], "doc_id long, n long, _group long"), "named")
    out = pack(df, {"n": 10}, "n").collect()
    assert all(r._group == 2 * r.doc_id for r in out) and len(out) == 20
