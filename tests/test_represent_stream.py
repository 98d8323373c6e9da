import datetime
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from xmcforge.operators import represent as RP
from xmcforge.streaming import state as ST


def test_pooling_edge_cases(spark):
    rows = [(0, 0, [1.0, 2.0], 1), (0, 1, [3.0, 4.0], 1), (0, 2, [9.0, 9.0], 0),
            (1, 0, [5.0, 6.0], 0), (1, 1, [7.0, 8.0], 0)]
    df = spark.createDataFrame(rows, "seq_id long, pos long, embedding array<double>, mask long")
    mean = dict((k, list(v)) for k, v in RP.masked_mean_pool(df).toPandas().values.tolist())
    assert mean[0] == [2.0, 3.0] and mean[1] == [0.0, 0.0]
    last = dict((k, list(v)) for k, v in RP.last_token_pool(df).toPandas().values.tolist())
    assert last[0] == [3.0, 4.0] and last[1] == [7.0, 8.0]     # all-zero mask -> final position


def test_label_centroid_zero_fill(spark):
    xy = spark.createDataFrame([(0, 7), (1, 7)], "doc_id long, label_id long")
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "doc_id long, embedding array<double>")
    labels = spark.createDataFrame([(7,), (8,)], "label_id long")
    c = dict((k, list(v)) for k, v in RP.label_centroids(xy, vec, labels, dim=2).toPandas().values.tolist())
    assert c == {7: [0.5, 0.5], 8: [0.0, 0.0]}


def test_ema_closed_form_equals_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(s), int(i), float(rng.normal())) for i, (k, s) in
            enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 1000, 60)))]
    df = spark.createDataFrame(rows, "key long, step long, id long, value double")
    got = dict((r.key, r.ema) for r in RP.ema(df, 0.9).collect())
    for k in range(3):
        c = 0.0
        for _, s, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            c = 0.9 * c + 0.1 * v
        assert math.isclose(got[k], c, rel_tol=1e-9, abs_tol=1e-12)


def test_stream_ema_counts_late_rows(spark, tmp_path):
    sch = ST.OBS_SCHEMA
    base = pd.Timestamp("2024-01-01").to_pydatetime()
    src = str(tmp_path / "src")
    first = [(1, base + datetime.timedelta(seconds=10), 1, 1.0, "a"), (1, base + datetime.timedelta(seconds=20), 2, 2.0, "a")]
    late = [(1, base + datetime.timedelta(seconds=5), 3, 100.0, "a"), (1, base + datetime.timedelta(seconds=30), 4, 3.0, "a")]
    spark.createDataFrame(first, sch).repartition(1).write.mode("append").parquet(src)
    spark.createDataFrame(late, sch).repartition(1).write.mode("append").parquet(src)
    res = ST.stream_ema(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), w=0.5).toPandas()
    row = res.iloc[0]
    assert row.n_obs == 3 and row.late == 1
    assert math.isclose(row.ema, ((0.5 * 0 + 0.5 * 1.0) * 0.5 + 0.5 * 2.0) * 0.5 + 0.5 * 3.0)


def test_stream_latest_equals_batch(spark, tmp_path):
    sch = ST.OBS_SCHEMA
    base = pd.Timestamp("2024-01-01").to_pydatetime()
    rows = [(k, base + datetime.timedelta(seconds=s), i, float(i), "x") for i, (k, s) in
            enumerate([(1, 5), (2, 3), (1, 9), (2, 1), (3, 4), (1, 2)])]
    src = str(tmp_path / "src")
    for chunk in (rows[:3], rows[3:]):
        spark.createDataFrame(chunk, sch).repartition(1).write.mode("append").parquet(src)
    s = ST.stream_latest(spark, src, str(tmp_path / "out"), str(tmp_path / "ck")).toPandas()
    b = RP.latest_by_key(spark.createDataFrame(rows, sch)).toPandas()
    assert dict(zip(s.key, s.id)) == dict(zip(b.key, b.id)) == {1: 2, 2: 1, 3: 4}


def test_compaction_keeps_latest_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, 10.0, 0), (2, 20.0, 0)], "key long, v double, batch_id long").write.parquet(log)
    spark.createDataFrame([(1, 11.0, 1)], "key long, v double, batch_id long").write.mode("append").parquet(log)
    snap = ST.compact_log(spark, log, str(tmp_path / "snap"), ["key"]).toPandas().sort_values("key")
    assert snap.v.tolist() == [11.0, 20.0] and snap.batch_id.tolist() == [1, 0]


def test_log_sink_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "log")
    sink = ST._log_sink(out)
    batch = spark.createDataFrame([(1, 1.0), (2, 2.0)], "key long, v double")
    sink(batch, 0)
    sink(batch, 0)                       # a retried micro-batch
    sink(spark.createDataFrame([(1, 5.0)], "key long, v double"), 1)
    log = spark.read.parquet(out)
    assert log.count() == 3
    assert dict(ST.latest_state(spark, out, ["key"]).select("key", "v").toPandas().values.tolist()) == {1: 5.0, 2: 2.0}


def test_pca_components_match_numpy_up_to_sign(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 6)) @ np.diag([5.0, 3.0, 2.0, 1.0, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(base)],
                               "label_id long, embedding array<double>")
    comps = RP.pca_fit(df, 3)                              # (3 x dim)
    cov = np.cov(base, rowvar=False)
    w, v = np.linalg.eigh(cov)
    ref = v[:, np.argsort(w)[::-1][:3]].T
    for c, r in zip(comps, ref):
        assert np.allclose(np.abs(c @ r), 1.0, atol=1e-6)


def test_l2_normalize_is_linear_in_the_width(spark):
    """The norm is folded once per row, not once per element."""
    from pyspark.sql import functions as F
    from xmcforge.functions.vectors import l2_normalize
    wide = spark.range(20).select(F.transform(F.sequence(F.lit(1), F.lit(1152)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
    out = wide.select("v", l2_normalize("v").alias("n")).collect()
    for r in out:
        v = np.array(r.v)
        assert np.allclose(r.n, v / np.sqrt((v * v).sum()), rtol=1e-12)
    zero = spark.createDataFrame([([0.0, 0.0],), (None,), ([],)], "v array<double>").select(l2_normalize("v").alias("n")).collect()
    assert [r.n for r in zero] == [[0.0, 0.0], None, []]


def test_ema_keeps_null_keys(spark):
    obs = spark.createDataFrame([(None, 1, 1, 2.0), (None, 2, 2, 4.0), (7, 1, 3, 1.0)], "key long, step long, id long, value double")
    got = {r.key: (round(r.ema, 9), r.n_obs) for r in RP.ema(obs, 0.5).collect()}
    assert got == {None: (0.5 * 0.5 * 2.0 + 0.5 * 4.0, 2), 7: (0.5, 1)}


def test_vector_sums_equal_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(None if k == 9 else int(k), f"g{k % 3}", None if k == 4 and i % 2 else [float(x) for x in rng.normal(size=5)], None if i % 17 == 0 else float(w))
            for i, (k, w) in enumerate(zip(np.where(rng.random(600) < 0.4, 0, rng.integers(0, 12, 600)), rng.random(600)))]
    rows.append((77, "g0", [None, 1.0, 2.0, 3.0, 4.0], 2.0))
    df = spark.createDataFrame(rows, "k long, g string, embedding array<double>, w double").repartition(5)
    want = {}
    for k, g, v, w in rows:
        if v is not None:
            s, n = want.setdefault((k, g), [np.zeros(5), 0.0])
            want[k, g] = [s + np.array([x or 0.0 for x in v]) * (w or 0.0), n + (w or 0.0)]
    for limit in (RP.SUM_BYTES, 200):  # a task that hands its sums on early
        monkeypatch.setattr(RP, "SUM_BYTES", limit)
        got = {(r.k, r.g): r for r in RP.vector_sums(df, ["k", "g"], weight="w").collect()}
        assert set(got) == set(want) and len(got) == RP.vector_sums(df, ["k", "g"], weight="w").count()
        for key, (s, n) in want.items():
            assert np.allclose(got[key].s, s) and math.isclose(got[key].w, n, abs_tol=1e-12)
    assert RP.vector_mean(df.where("false"), ["k"]).count() == 0


def test_vector_sums_shuffle_one_row_per_key_and_task(spark):
    df = spark.range(0, 4000, 1, 4).select((F.col("id") % 3).alias("k"), F.array(*[F.lit(float(i)) for i in range(32)]).alias("embedding"))
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("w", T.DoubleType())])
    parts = df.select("k", F.col("embedding").alias("s"), F.lit(1.0).alias("w")).mapInArrow(RP._adder(["k"], schema, False), schema)
    assert parts.count() == 3 * 4


def test_gram_matrix_and_plain_second_moments(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 7)) + 3.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id long, embedding array<double>").repartition(4)
    gram, total, n = RP.gram_matrix(df)
    assert n == 300 and np.allclose(gram, x.T @ x) and np.allclose(total, x.sum(axis=0))
    plain = RP.pca_fit(df, 2, center=False)
    vectors = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :2].T
    assert np.allclose(np.abs((plain * vectors).sum(axis=1)), 1.0)
    centred = RP.pca_fit(df, 3)
    cov = np.linalg.eigh(np.cov(x, rowvar=False))[1][:, ::-1][:, :3].T
    assert np.allclose(centred.T @ centred, cov.T @ cov)  # the projector, free of signs
    assert (centred[np.arange(3), np.abs(centred).argmax(axis=1)] > 0).all()
    assert RP.pca_fit(df.where("false"), 3).size == 0


def _observations(n=120):
    rng = np.random.default_rng(12)
    base = pd.Timestamp("2024-01-01").to_pydatetime()
    return [(int(k), base + datetime.timedelta(seconds=int(s)), i, float(v), "x")
            for i, (k, s, v) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, 600, n), rng.normal(size=n)))]


def test_stream_ema_of_shuffled_files_is_the_batch_mean(spark, tmp_path):
    rows, src = _observations(), str(tmp_path / "src")
    order = np.random.default_rng(1).permutation(len(rows))
    for part in np.array_split(order, 5):  # files without any order in time
        spark.createDataFrame([rows[i] for i in part], ST.OBS_SCHEMA).repartition(1).write.mode("append").parquet(src)
    got = {r.key: r for r in ST.stream_ema(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), 0.8, delay_s=600).collect()}
    batch = {r.key: r for r in RP.ema(spark.createDataFrame(rows, ST.OBS_SCHEMA), 0.8).collect()}
    assert set(got) == set(batch)
    for k, r in batch.items():
        assert math.isclose(got[k].ema, r.ema, rel_tol=1e-9) and got[k].n_obs == r.n_obs and got[k].late == 0


def test_stream_ema_state_is_bounded_by_the_delay(spark, tmp_path):
    rows, src = sorted(_observations(), key=lambda r: (r[1], r[2])), str(tmp_path / "src")
    for part in np.array_split(np.arange(len(rows)), 4):
        spark.createDataFrame([rows[i] for i in part], ST.OBS_SCHEMA).repartition(1).write.mode("append").parquet(src)
    got = ST.stream_ema(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), 0.8, delay_s=60).collect()
    batch = {r.key: r.ema for r in RP.ema(spark.createDataFrame(rows, ST.OBS_SCHEMA), 0.8).collect()}
    for r in got:
        newest = max(x[1] for x in rows if x[0] == r.key)
        assert r.pending == sum(x[0] == r.key and x[1] >= newest - datetime.timedelta(seconds=60) for x in rows)
        assert math.isclose(r.ema, batch[r.key], rel_tol=1e-9) and r.late == 0


def test_replay_keeps_rows_without_a_time_and_cuts_by_rows(spark, tmp_path):
    base = pd.Timestamp("2024-01-01").to_pydatetime()
    rows = [(1, None, 900, 5.0, "a"), *((1, base, i, float(i), "a") for i in range(400))]  # one time for nearly all
    src = str(tmp_path / "src")
    ST.stage_replay(spark.createDataFrame(rows, ST.OBS_SCHEMA), src, rows_per_file=100)
    files = sorted((os.stat(os.path.join(src, f)).st_mtime, f) for f in os.listdir(src) if f.startswith("part-"))
    counts = [spark.read.parquet(os.path.join(src, f)).count() for _, f in files]
    assert sum(counts) == 401 and max(counts) <= 250 and [f for _, f in files] == sorted(f for _, f in files)
    assert spark.read.parquet(os.path.join(src, files[0][1])).where("step is null").count() == 1
    got = ST.stream_ema(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), 0.5).first()
    batch = RP.ema(spark.createDataFrame(rows, ST.OBS_SCHEMA), 0.5).first()
    assert got.n_obs == batch.n_obs == 401 and math.isclose(got.ema, batch.ema) and got.late == 0
    freq = ST.stream_label_frequency(spark, src, str(tmp_path / "fo"), str(tmp_path / "fc")).first()
    assert freq.freq == 401


def test_latest_vectors_on_a_snapshot(spark, tmp_path):
    base = pd.Timestamp("2024-01-01").to_pydatetime()
    schema = "key long, step timestamp_ntz, id long, embedding array<float>"
    first = [(1, base, 1, [1.0, 2.0]), (2, base, 2, [3.0, 4.0]), (None, base, 3, [9.0])]
    second = [(1, base + datetime.timedelta(1), 4, [5.0, 6.0]), (3, base, 5, None), (2, base - datetime.timedelta(1), 6, [0.0, 0.0])]
    one = spark.createDataFrame(first, schema)
    state = None
    for i, rows in enumerate((first, second)):
        src, snap = str(tmp_path / f"src{i}"), str(tmp_path / "snap")
        ST.stage_replay(spark.createDataFrame(rows, schema), src, min_files=1)
        state = ST.stream_latest(spark, src, str(tmp_path / f"o{i}"), str(tmp_path / f"c{i}"), ["embedding"], one.schema, snap if i else None)
        if not i:
            state.write.parquet(snap)
    assert {r.key: r.embedding for r in state.collect()} == {1: [5.0, 6.0], 2: [3.0, 4.0], 3: None, None: [9.0]}
