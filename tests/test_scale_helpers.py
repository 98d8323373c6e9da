import numpy as np
from pyspark.sql import functions as F

from xmcforge.functions import text as TX
from xmcforge.operators import assets as AS
from xmcforge.operators.retrieval import block_topk, plan_blocks


def test_plan_blocks_bounds_memory_and_copies_cheaper_side():
    # big labels, few queries: grow label blocks (copy the small query side)
    n_qb, n_lb = plan_blocks(par=64, n_q=1_000, n_l=2_000_000, dim=768, block_bytes=128 << 20, k=10)
    assert n_lb == 64 and n_qb == 1
    # many queries, few labels, large k: grow query blocks (copy the small label side)
    n_qb, n_lb = plan_blocks(par=64, n_q=2_000_000, n_l=1_000, dim=64, block_bytes=128 << 20, k=500)
    assert n_lb == 1 and n_qb >= 64
    # tiny inputs never split below the minimum block size
    n_qb, n_lb = plan_blocks(par=1000, n_q=300, n_l=300, dim=8, k=10)
    assert n_qb * n_lb <= 2
    # labels are streamed: the grid grows with the queries' bytes only, not with both sides
    n_qb, n_lb = plan_blocks(par=1000, n_q=10**9, n_l=10**9, dim=64, k=10)
    assert n_lb == 1 and n_qb == -(-10**9 // ((128 << 20) // (8 * 64)))
    # excluded pairs count in a block's bytes
    assert plan_blocks(par=1, n_q=10**6, n_l=10, dim=64, excluded_per_query=1000)[0] > 30 * plan_blocks(1, 10**6, 10, 64)[0]


def test_block_topk_excluded_never_selected_and_flagged_after():
    rng = np.random.default_rng(0)
    q = rng.normal(size=(4, 5)); lab = rng.normal(size=(9, 5))
    qi, li = np.arange(4), np.arange(100, 109)
    full = block_topk(qi, q, li, lab, 3)
    ex_q, ex_l = full[0][::3], full[1][::3]          # each query's best label
    before = block_topk(qi, q, li, lab, 3, ex_q, ex_l, drop_excluded=True)
    assert not set(zip(before[0], before[1])) & set(zip(ex_q, ex_l))
    assert len(before[0]) == 12
    after = block_topk(qi, q, li, lab, 3, ex_q, ex_l, drop_excluded=False)
    assert set(zip(after[0][after[3]], after[1][after[3]])) == set(zip(ex_q, ex_l))


def test_long_form_pad_equals_array_pad(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(i, " ".join(rng.choice(words, size=int(rng.integers(0, 40))))) for i in range(60)]
    corpus = spark.createDataFrame(rows, "row_id long, text string")
    vocab = TX.build_vocab(corpus)
    for max_len in (2, 5, 32, 64):
        a = TX.pad_and_mask(TX.tokenize(corpus, vocab), max_len).select("row_id", "input_ids", "attention_mask")
        b = TX.pad_and_mask_long(TX.id_sequence(corpus, vocab), max_len).select("row_id", "input_ids", "attention_mask")
        pa = {r.row_id: (list(r.input_ids), list(r.attention_mask)) for r in a.collect()}
        pb = {r.row_id: (list(r.input_ids), list(r.attention_mask)) for r in b.collect()}
        assert pa == pb and len(pa) == 60
        assert all(len(v[0]) == max_len for v in pb.values())


def test_urls_long_form_order_and_lists(spark):
    urls = spark.createDataFrame([(1, 5, "http://b"), (1, 2, "http://a"), (2, 9, "https://c")],
                                 "owner_id long, ord long, url string")
    lf = AS.urls_per_owner(urls).toPandas().sort_values(["owner_id", "pos"])
    assert lf.url.tolist() == ["http://a", "http://b", "https://c"] and lf.pos.tolist() == [0, 1, 0]
    lists = {r.owner_id: list(r.urls) for r in AS.as_lists(AS.urls_per_owner(urls)).collect()}
    assert lists == {1: ["http://a", "http://b"], 2: ["https://c"]}


def test_encoder_tokenizes_a_batch_in_slices():
    import tracemalloc
    import pandas as pd
    from xmcforge.operators import represent as RP
    texts = pd.Series([" ".join(f"w{(i * j) % 997}" for j in range(400)) for i in range(4000)] + [None, ""])
    enc = RP.hashed_bag_encoder(16)
    tracemalloc.start()
    out = enc(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60 and out.shape == (4002, 16)
    for i in (0, 1, 1999, 3999, 4000, 4001):
        assert np.array_equal(out[i:i + 1], enc(texts[i:i + 1]))
