import hashlib
import random
import struct
import tempfile

import pytest

from xmcforge.llm import warc

PAGES = "page_id long, url string, html string, payload string, size int"


def pages():
    rnd = random.Random(4)
    body = lambda n: " ".join(rnd.choice(["<p>", "</p>", "wort", "été", "日本", "x"]) for _ in range(n))
    big, small = body(900), "<p>small</p>"
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else small if i % 3 == 1 else body(rnd.randrange(1, 600)), "c", 1) for i in range(90)]
    return rows + [(200, None, None, None, None), (201, "u\r\nX: y%0A", "", "", 0), (None, "null id", big, "", 0), (202, "long", "é" * 400000, "", 0)]


def expected(rows):
    last = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(i, last.get(h, i))
    out = []
    for i, u, h, *_ in rows:
        raw = (h or "").encode()
        refers = last[h] if i is not None and h in last and last[h] != i else None
        out.append((i, u or "", len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers,
                    raw if refers is None else None))
    return out


def test_round_trip(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="warc-") + "/a"
    df = spark.createDataFrame(pages(), PAGES)
    records, archives = warc.write_archives(warc.plan_records(df), folder, 50_000)
    out = warc.read_archives(spark, folder).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.page_id, r.target_uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                   None if r.payload is None else bytes(r.payload)) for r in out), key=key)
    assert got == sorted(expected(pages()), key=key) and records == len(out) and archives >= 2


def test_dictionary_frame_leads_and_records_are_frames():
    texts = [("<html><body>" + f"page {i} " * 40 + "</body></html>").encode() for i in range(200)]
    records = [warc.record_bytes(i, "u", t, len(t), hashlib.sha1(t).hexdigest(), None) for i, t in enumerate(texts)]
    d = warc.train_dictionary(texts)
    data = warc.archive_bytes(records, d)
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE_MAGIC
    frames = list(warc.iter_frames(data))
    assert [r for _, r in frames] == records
    assert all(struct.unpack_from("<I", data, at)[0] == warc.FRAME_MAGIC for at, _ in frames)
    import zstandard as zs
    assert all(zs.get_frame_parameters(data[at:]).dict_id == d.dict_id() != 0 for at, _ in frames)
    assert [r for _, r in warc.iter_frames(warc.archive_bytes(records[:3], None))] == records[:3]
    for broken in (data[:-3], data[:40], data + b"\x00"):
        with pytest.raises(ValueError):
            list(warc.iter_frames(broken))
    assert list(warc.iter_frames(b"")) == []


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 6"),
    lambda r: r.replace(b"hello", b"hallo"), lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: odd"),
    lambda r: r.replace(b"WARC-Date", b"WARC-Type"), lambda r: r[:-2], lambda r: r.replace(b"sha1:", b"md5:")])
def test_faults_are_found(change):
    good = warc.record_bytes(1, "u", b"hello", 5, hashlib.sha1(b"hello").hexdigest(), None)
    assert warc.parse_record(good)["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.parse_record(change(good))


def test_empty_table(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="warc-") + "/a"
    df = spark.createDataFrame([], PAGES)
    assert tuple(warc.write_archives(warc.plan_records(df), folder)) == (0, 0)
