import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from helpers import SF, edge_docs, edge_rows, no_docs
from tokenizers import Tokenizer
from xmcforge.llm.alignment import align, group_links, lockstep, op13_align, spaced_units
from xmcforge.llm.common import table

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Rows of the contract by the two libraries on whole texts and plain loops."""
    tok, sp = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            byte[chr(256 + extra)] = b
            extra += 1
    docs, held = [], Counter()
    for i, text in rows:
        ids_a, ids_b = [], []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            bytes_a = [bytes(byte[c] for c in tok.id_to_token(x)) for x in a]
            bytes_b = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ids_a, ids_b = a, b
        groups, links = [], Counter()
        if ids_a:
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            x = y = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                x1, y1 = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
                groups.append((ids_a[x:x1], ids_b[y:y1]))
                links.update((p, q) for p in ids_a[x:x1] for q in ids_b[y:y1])
                x, y = x1, y1
        held.update(links.keys())
        docs.append((i, ids_a, ids_b, groups, links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for i, ids_a, ids_b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(ids_a), len(ids_b), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_the_libraries(spark):
    out = op13_align(spark, SF)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(out) == brute([tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()])


def test_edges(spark):
    rnd = random.Random(13)
    bits = [" ", "  ", "\n", "\t", "a", "Z", "ing", "é", "é", "日", "本", "😀", "🏳️‍🌈", "▁", "<s>", "<|endoftext|>", "<0x41>", "\xa0", "　",
            "'s", "1234", "!!", "\x00", "\x1c", "\x85", "़", "ﬁ", "①", "x" * 50, "abab" * 9]
    odd = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 30))) for _ in range(400)]
    rows = [(r[0], r[1]) for r in edge_rows() if not r[1] or len(r[1]) < 100000] + list(enumerate(odd, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "'p' as pairs", "2 as id", "3 as n_a")
    assert got(align(df, *PATHS)) == brute(rows)
    assert got(align(df, *PATHS, slice_bytes=300, chunk_bytes=900)) == brute(rows)
    assert align(no_docs(spark), *PATHS).count() == 0
    none = spark.createDataFrame([("k", None), ("l", "")], "doc_id string, text string")
    assert got(align(none, *PATHS)) == [("k", 0, 0, 0, 0, 0, 0, ""), ("l", 0, 0, 0, 0, 0, 0, "")]


def test_very_long_texts(spark):
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] in (4, 8)]
    out = {r.doc_id: r for r in align(edge_docs(spark), *PATHS).collect() if r.doc_id in (4, 8)}
    tok, sp = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    tok.encode_special_tokens = True
    for i, text in rows:
        assert (out[i].n_a, out[i].n_b) == (len(tok.encode(" " + text).ids), len(sp.encode(text)))
        assert out[i].n_links >= max(out[i].n_a, out[i].n_b) >= out[i].n_groups > 0


def test_lockstep_merges_lanes_of_any_length():
    rng = np.random.default_rng(2)
    lens, ends_a, ends_b, bounds_a, bounds_b, want, base = rng.integers(0, 60, 50), [], [], [0], [0], [], 0
    for n in lens.tolist():
        inner = np.arange(1, n)
        for ends, bounds in ((ends_a, bounds_a), (ends_b, bounds_b)):
            if n:
                ends += (base + np.append(inner[rng.random(len(inner)) < 0.4], n)).tolist()
            bounds.append(len(ends))
        base += n
    a0, a1, b0, b1 = lockstep(*(np.array(v) for v in (ends_a, ends_b, bounds_a, bounds_b)))
    both = sorted(set(ends_a) & set(ends_b))
    assert [ends_a[k - 1] for k in a1] == [ends_b[k - 1] for k in b1] == both
    assert a0.tolist() == [0, *a1[:-1]] and b0.tolist() == [0, *b1[:-1]]


def test_large_groups_are_counted_by_distinct_ids():
    a, b = np.array([1, 2] * 60 + [5]), np.array([3] * 100 + [4] * 20)
    group, pair, times = group_links(a, b, np.array([0, 120]), np.array([120, 121]), np.array([0, 119]), np.array([119, 120]))
    found = Counter()
    for g, p, t in zip(group.tolist(), pair.tolist(), times.tolist()):
        found[g, p >> 15, p & 32767] += t
    assert found == Counter([(0, x, y) for x in a[:120].tolist() for y in b[:119].tolist()] + [(1, 5, 4)])


def test_units_join_to_the_text():
    import pyarrow as pa
    texts = ["a b", "", " lead", "tail ", "a  b", "x\n y \nz", "one", "　 w", "a\t b"]
    units, code, ends = spaced_units(pa.array(texts))
    for t, x, y in zip(texts, ends, ends[1:]):
        assert "".join(units[k] for k in code[x:y]) == " " + t and all(units[k].startswith(" ") for k in code[x:y])
