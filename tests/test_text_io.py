import os

from pyspark.sql import functions as F

from xmcforge.functions import text as TX
from xmcforge.sources import files as IO


def test_compose_and_strip(spark):
    df = spark.createDataFrame([(0, " a ", "b "), (1, "t", None)], "row_id long, title string, content string")
    out = dict(TX.compose_text(df, ["title", "content"]).select("row_id", "text").toPandas().values.tolist())
    assert out == {0: "a  b", 1: "t None"}
    assert TX.fields_for("ShortTitles-1K") == ["title"]
    assert TX.fields_for("full-docs-1K") == ["title", "content"]


def test_vocab_tokenize_pad(spark):
    df = spark.createDataFrame([(0, "b a b"), (1, "C c a"), (2, "")], "row_id long, text string")
    vocab = TX.build_vocab(df).toPandas().sort_values("token_id")
    assert vocab.token.tolist() == ["a", "b", "c"]          # counts 2,2,2 -> token order
    assert vocab.token_id.tolist() == [4, 5, 6]
    ids = dict((r, list(v)) for r, v in TX.tokenize(df, TX.build_vocab(df)).toPandas().values.tolist())
    assert ids[0] == [2, 5, 4, 5, 3] and ids[2] == [2, 3]
    pad = TX.pad_and_mask(TX.tokenize(df, TX.build_vocab(df)), 4).toPandas().set_index("row_id")
    assert list(pad.loc[0, "input_ids"]) == [2, 5, 4, 3]    # truncated, EOS kept
    assert list(pad.loc[2, "input_ids"]) == [2, 3, 0, 0] and list(pad.loc[2, "attention_mask"]) == [1, 1, 0, 0]


def test_assemble_rejects_unknown_order(spark):
    import pytest
    df = spark.createDataFrame([(0,)], "x long")
    with pytest.raises(ValueError):
        TX.assemble_sequence(df, "sideways", text_ids="a", text_mask="b")


def test_latin1_lines_with_blanks(spark, tmp_path):
    p = tmp_path / "raw.txt"
    p.write_bytes("café  \n\n  naïve\n".encode("latin-1"))
    got = IO.read_lines(spark, str(p), encoding="ISO-8859-1").toPandas().sort_values("row_id")
    assert got.text.tolist() == ["café", "", "naïve"] and got.row_id.tolist() == [0, 1, 2]


def test_sparse_matrix_roundtrip_keeps_empty_rows(spark, tmp_path):
    xy = spark.createDataFrame([(0, 3, 1.0), (0, 1, 1.0), (2, 0, 0.5)], "doc_id long, label_id long, value double")
    rows = spark.createDataFrame([(0,), (1,), (2,), (3,)], "doc_id long")
    path = str(tmp_path / "xy")
    IO.write_sparse_matrix(xy, rows, 4, path)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert text == "4 4\n1:1.0 3:1.0\n\n0:0.5\n\n"
    body, header = IO.read_sparse_matrix(spark, path)
    assert sorted(map(tuple, body.toPandas().values.tolist())) == [(0, 1, 1.0), (0, 3, 1.0), (2, 0, 0.5)]
    assert header.toPandas().values.tolist() == [[4, 4]]


def test_filter_pairs_missing_file_is_empty(spark, tmp_path):
    assert IO.read_filter_pairs(spark, str(tmp_path / "nope")).count() == 0
    assert IO.read_filter_pairs(spark, None).count() == 0


def test_asset_table_resume(spark):
    blobs = spark.createDataFrame([(1, 0, b"x"), (1, 1, b"y"), (2, 0, b"z"), (3, 0, b"w")],
                                  "owner_id long, ord long, bytes binary")
    done = spark.createDataFrame([(1,)], "owner_id long")
    t = IO.build_asset_table(blobs, done_owners=done, start_id=10).toPandas().sort_values("asset_id")
    assert t.owner_id.tolist() == [2, 3] and t.asset_id.tolist() == [10, 11]
    assert IO.decode_payload(IO.build_asset_table(blobs)).select("bytes").toPandas().bytes.map(bytes).tolist() == \
        [b"x", b"y", b"z", b"w"]


def test_line_numbers_across_many_splits(spark, tmp_path):
    lines = [("" if i % 17 == 0 else f"line {i} " + "x" * (i % 50)) for i in range(20000)]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = IO.read_lines(spark, str(tmp_path), encoding="UTF-8")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        pdf = got.toPandas().sort_values("row_id")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert pdf.row_id.tolist() == list(range(40000))
    assert pdf.text.tolist() == [t.strip() for t in lines] * 2


def test_part_files_are_read_by_number(spark, tmp_path):
    from xmcforge.sources.files import read_lines
    (tmp_path / "part-99999-a.txt").write_text("first\nsecond\n")
    (tmp_path / "part-100000-a.txt").write_text("third\n")
    got = sorted((r.row_id, r.text) for r in read_lines(spark, str(tmp_path)).collect())
    assert got == [(0, "first"), (1, "second"), (2, "third")]


def test_header_of_a_file_read_in_several_splits(spark, tmp_path):
    from xmcforge.sources import files as IO
    path = tmp_path / "m.txt"
    path.write_text("3000 7\n" + "\n" * 3 + "1:1.0 2:1.0\n" * 3000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        line = IO.first_line(spark, str(path))
        # one row of the split at the file's start, whichever task ends first
        assert "input_file_block_start" in line._jdf.queryExecution().executedPlan().toString()
        assert [r.text for r in line.collect()] == ["3000 7"]
        assert [tuple(r) for r in IO.read_sparse_matrix(spark, str(path))[1].repartition(3).collect()] == [(3000, 7)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
