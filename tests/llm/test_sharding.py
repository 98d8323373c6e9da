import hashlib
import random
import zlib

from helpers import edge_docs, edge_rows, no_docs

from xmcforge.llm.sharding import minimax_cuts, shard_texts


def smallest_capacity(sizes, n):
    def shards(c):
        used, left = 1, c
        for s in sizes:
            if s > left:
                used, left = used + 1, c
            left -= s
        return used
    c = max(max(sizes, default=1), -(-sum(sizes) // n), 1)
    while shards(c) > n:
        c += 1
    return c


def test_cuts_equal_brute_force(spark):
    rnd = random.Random(5)
    for trial, n in ((40, 3), (7, 8), (200, 5), (1, 4)):
        rows = [(hashlib.md5(str((trial, i)).encode()).hexdigest(), rnd.choice([1, 3, 50, 400, 1000])) for i in range(trial)]
        capacity, keys = minimax_cuts(spark.createDataFrame(rows, "key string, size long"), n)
        ordered = sorted(rows)
        assert capacity == smallest_capacity([s for _, s in ordered], n)
        loads = [0] * n
        for k, s in ordered:
            loads[sum(c is None or k > c for c in keys)] += s
        assert max(loads) <= capacity


def test_rows_slots_and_groups(spark):
    out = shard_texts(edge_docs(spark), 3).collect()
    rows = edge_rows()
    assert len(out) == len(rows)
    want = sorted((r[0] or -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in out) == want
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    shard = {}
    for r in out:
        assert shard.setdefault((r["size"], r.text_crc32, r["size"] > 1 or r.doc_id), r.shard) == r.shard
    assert shard_texts(no_docs(spark), 8).count() == 0


def test_one_group_of_a_third(spark):
    rows = [(i, "same text in many rows" if i % 3 == 0 else f"text {i} " * (i % 7 + 1)) for i in range(600)]
    out = shard_texts(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len({r.shard for r in out if r.doc_id % 3 == 0}) == 1
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
