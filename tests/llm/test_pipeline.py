from collections import Counter

from helpers import DOCS, SF, classes, edge_rows

import corpus_pipeline as P
from xmcforge.llm.common import table


def test_stages_act_on_their_own_input(spark):
    docs = table(spark, SF, "documents")
    n, before = docs.count(), docs
    for name, stage in P.STAGES[:-1]:
        after = P.written(stage(spark, before, SF), name)
        assert after.columns == docs.columns
        if name == "toxicity":
            labels = table(spark, SF, "labels").collect()
            gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()}
            tox, clean = ({r.doc_id for r in labels if r.toxic == v} for v in (1, 0))
            assert len(gone & tox) >= 0.9 * len(tox) and len(gone & clean) <= 0.1 * len(clean)
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            want = {i for i, (_, c) in classes(rows, 5, 80).items() if c == i}
            assert {r.doc_id for r in after.select("doc_id").collect()} == want
        if name == "mix_sources":
            assert max(Counter(r.doc_id for r in after.select("doc_id").collect()).values()) <= 3
        before = after
    packed = P.STAGES[-1][1](spark, before, SF).collect()
    assert n > before.select("doc_id").distinct().count() > 0
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}
    load = Counter()
    for r in packed:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 2048


def test_edge_rows_pass_every_stage(spark):
    extra = [(*r, "x") for r in edge_rows()]
    docs = spark.createDataFrame(extra, DOCS + ", removed string")
    for name, stage in P.STAGES[:3]:
        docs = P.written(stage(spark, docs, SF), name)
        assert docs.columns[-1] == "removed"
    ids = {r.doc_id for r in docs.collect()}
    assert {1, 2, 3, 4, 6, None} <= ids and 5 not in ids


def test_empty_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_columns_called_like_the_inner_ones_pass_every_stage(spark):
    names = ["_toxicity", "_cut", "_id", "_group", "_text_key", "_gone", "score", "copies"]
    docs = spark.createDataFrame([(*r, *names) for r in edge_rows()], DOCS + "".join(f", {n} string" for n in names))
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, SF), name)
        assert docs.columns[-len(names):] == names
    assert {tuple(r[n] for n in names) for r in docs.collect()} == {tuple(names)}
    assert P.STAGES[-1][1](spark, docs, SF).count() > 0
