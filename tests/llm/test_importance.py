import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from helpers import SF, edge_docs, edge_rows, no_docs
from xmcforge.llm.common import table, written
from xmcforge.llm.importance import alnum_words, kth_key, op12_importance, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, bench, percent=10, min_words=20, longest=1, buckets=10000):
    def counted(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t, longest)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counted([d[1] for d in docs]), counted(bench)
    S, T = sum(s), sum(t)
    rows, able = [], []
    for i, text in docs:
        n, fs = features(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
                 for b in (zlib.crc32(f.encode()) % buckets for f in fs)]
        weight = sum(gains) // len(gains) if gains else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(fs), weight, score, None])
        if n >= min_words and i is not None:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    bench = [r.text for r in table(spark, SF, "benchmark").collect()]
    out = op12_importance(spark, SF)
    assert dict(out.dtypes) == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}
    assert got(out) == brute(docs, bench)


@pytest.mark.parametrize("longest", [1, 3])
def test_edges(spark, longest):
    rows = [(r[0], r[1]) for r in edge_rows()]
    bench = spark.createDataFrame([(1, "short text of alpha gamma"), (2, None), (3, "")], "item_id long, text string")
    df = edge_docs(spark).selectExpr("*", "doc_id as id", "1 as score", "2 as rank", "'w' as weight")
    want = brute(rows, ["short text of alpha gamma"], 50, 2, longest, 500)
    assert got(resample(df, bench, 50, 2, 2024, longest, 500)) == want
    assert any(r[4] for r in want)
    none = spark.createDataFrame([], "text string")
    assert got(resample(df, none, 50, 2, buckets=500)) == brute(rows, [], 50, 2, 1, 500)
    assert resample(no_docs(spark), bench).count() == 0
    assert all(r.rank is None for r in resample(df, bench, 10, 10 ** 6).collect())


def test_words_of_bytes():
    texts = ["A-b Cé|日本\x1cx\x7fy z̈", None, "", "  ", "don't 3.14 ÀB", "\x85q"]
    flat, offsets = alnum_words(pa.array(["cut", *texts, "off"]).slice(1, len(texts)))
    rows = [flat.to_pylist()[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    assert rows == [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]


def test_selects_the_kth_key(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(12), rnd.randrange(90)) for _ in range(700)]  # many ties and repeated keys
    keys = written(spark.createDataFrame(rows, "score long, id long"), "keys")
    rows.sort(key=lambda r: (-r[0], r[1]))
    for k in (1, 2, 350, 699, 700):
        assert kth_key(keys, k, pivots=3) == rows[k - 1]


def test_equal_keys_at_the_end_of_the_draw(spark):
    text = " ".join(["word"] * 30)
    df = spark.createDataFrame([(7, text)] * 10, "doc_id long, text string")
    bench = spark.createDataFrame([("word",)], "text string")
    assert sorted(r["rank"] for r in resample(df, bench, 30).collect() if r["rank"]) == [1, 2, 3]
