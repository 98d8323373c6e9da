"""Asset batches: stops between and inside batches, conflicts, reruns."""

import pytest
from pyspark.sql import functions as F

from xmcforge.sources import asset_log as AL
from xmcforge.sources import files as IO


def batches(spark, n=3):
    def blobs(b):
        return lambda: spark.range(b * 20, b * 20 + 20).select(
            F.expr("id div 3").alias("owner_id"), F.col("id").alias("ord"), F.encode(F.concat(F.lit("x"), F.col("id")), "UTF-8").alias("bytes"))
    return [(f"b{b}", blobs(b)) for b in range(n)]


def rows(spark, path):
    return sorted((r.asset_id, r.owner_id, r.ord, r.payload) for r in AL.read_assets(spark, path).collect())


def test_stopped_and_resumed_equals_one_run(spark):
    whole, broken = IO.scratch_path(spark, "a"), IO.scratch_path(spark, "b")
    assert AL.append_all(spark, whole, batches(spark)) == ["b0", "b1", "b2"]
    AL.append_all(spark, broken, batches(spark)[:1])
    assert AL.prepare_batch(spark, broken, *[x() if callable(x) else x for x in batches(spark)[1]])["n_rows"]  # stopped before its commit
    assert rows(spark, broken) == rows(spark, whole)[:20]
    assert AL.append_all(spark, broken, batches(spark)) == ["b1", "b2"]
    assert rows(spark, broken) == rows(spark, whole) and AL.append_all(spark, broken, batches(spark)) == []
    ids = [r[0] for r in rows(spark, whole)]
    assert ids == list(range(len(ids)))


def test_owners_of_earlier_batches_are_left_out(spark):
    path = IO.scratch_path(spark, "c")
    AL.append_all(spark, path, batches(spark, 2))
    # owner 6 holds ords 18 to 20: its last asset is in the second batch, where the owner counts as done
    assert 20 not in [r[2] for r in rows(spark, path)] and len(rows(spark, path)) == 39


def test_a_number_is_committed_once(spark):
    path = IO.scratch_path(spark, "d")
    (n0, f0), (n1, f1) = batches(spark, 2)
    first, second = AL.prepare_batch(spark, path, n0, f0()), AL.prepare_batch(spark, path, n1, f1())
    AL.commit(spark, path, first)
    with pytest.raises(AL.CommitConflict):
        AL.commit(spark, path, second)
    assert [c["name"] for c in AL.commits(spark, path)] == ["b0"]
    assert AL.append_batch(spark, path, n1, f1()) and len(rows(spark, path)) == 39


def test_empty_tables_and_batches(spark):
    path = IO.scratch_path(spark, "e")
    assert AL.read_assets(spark, path).count() == 0 and AL.commits(spark, path) == []
    name, blobs = batches(spark, 1)[0]
    assert AL.append_batch(spark, path, "none", blobs().limit(0)) and AL.append_batch(spark, path, name, blobs())
    assert len(rows(spark, path)) == 20
