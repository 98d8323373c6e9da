from helpers import edge_docs, edge_rows, no_docs

from xmcforge.llm.substrings import drop_repeats, spans


def brute(rows, min_words=8):
    """{(id, text): (rest, merged ranges)} by one pass over the documents in rank order."""
    last = float("inf")
    first = {}
    for i, t in rows:
        for w, _, _ in spans(t or "", min_words):
            first[w] = min(first.get(w, last), last if i is None else i)
    out = {}
    for i, t in rows:
        if t is None:
            out[i, t] = (None, [])
            continue
        gone, own = [False] * len(t), set()
        for w, a, b in spans(t, min_words):
            if w in own or first[w] < (last if i is None else i):
                gone[a:b] = [True] * (b - a)
            own.add(w)
        ranges = []
        for k, g in enumerate(gone):
            if g and (not k or not gone[k - 1]):
                ranges.append([k, k + 1])
            elif g:
                ranges[-1][1] = k + 1
        out[i, t] = ("".join(c for c, g in zip(t, gone) if not g), ranges)
    return out


def test_equal_to_one_ranked_pass(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    want = brute(rows)
    got = drop_repeats(edge_docs(spark)).collect()
    assert len(got) == len(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    have = sorted(((r.doc_id, r.text, tuple((s.start, s.end) for s in r.removed)) for r in got), key=key)
    need = sorted(((i, want[i, t][0], tuple(map(tuple, want[i, t][1]))) for i, t in rows), key=key)
    assert have == need


def test_offsets_point_into_the_original(spark):
    passage = " ".join(f"Word{i} goes on with some more words here." for i in range(8))
    rows = [(1, "Start of one. " + passage + " end of one"), (2, "another host text " + passage + " which goes on"), (3, "clean text with its own words only and nothing else")]
    out = {r.doc_id: r for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].removed == [] and out[1].text == rows[0][1] and out[3].text == rows[2][1]
    cut = "".join(rows[1][1][s.start:s.end] for s in out[2].removed)
    assert cut.strip() == passage and out[2].text == "another host text which goes on"


def test_hot_line_and_edges(spark):
    line = "This very common line stands in a third of all the texts."
    rows = [(i, (line + "\n" if i % 3 == 0 else "") + f"Own words {i} of text number {i} which nobody else has {i}.") for i in range(900)]
    out = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(line in r.text for r in out) == 1 and sum(bool(r.removed) for r in out) == 299
    assert drop_repeats(no_docs(spark)).count() == 0
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, removed string")
    assert drop_repeats(df).first().removed == []


def spliced(seed, tidy):
    """Share cut of each of 200 passages of 55 words, without line breaks, inside other texts."""
    import random
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) + (rnd.choice([".", ""]) if tidy and rnd.random() < 0.12 else "")
    shares = []
    for _ in range(200):
        source, host = [word() for _ in range(150)], [word() for _ in range(80)]
        a, at = rnd.randrange(95), rnd.randrange(80)
        passage = " ".join(source[a:a + 55])
        head = " ".join(host[:at]) + " "
        text = head + passage + " " + " ".join(host[at:])
        known = {w for w, _, _ in spans(" ".join(source), 8)}
        gone = [False] * len(text)
        for w, b, e in spans(text, 8):
            if w in known:
                gone[b:e] = [True] * (e - b)
        shares.append(sum(gone[len(head):len(head) + len(passage)]) / len(passage))
    return shares


def test_passages_spliced_mid_sentence_are_cut():
    for tidy in (True, False):
        shares = spliced(5, tidy)
        assert min(shares) > 0.3 and sum(shares) > 0.7 * len(shares)


def test_every_window_holds_a_pick():
    from xmcforge.llm.substrings import WINDOW, picked
    words = [f"w{i * i % 71}" for i in range(500)]
    at = [0, *picked(words), len(words)]
    assert max(b - a for a, b in zip(at, at[1:])) <= WINDOW + 1


def test_columns_called_like_the_inner_ones_pass(spark):
    text = "One passage of some words that is repeated here and there in full."
    rows = [(1, text, 77, 78, "g"), (2, "Intro. " + text, 79, 80, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _text_key long, _gone string")
    out = {r.doc_id: r for r in drop_repeats(df).collect()}
    assert [(out[i]._id, out[i]._text_key, out[i]._gone) for i in (1, 2)] == [(77, 78, "g"), (79, 80, "h")]
    assert out[2].removed and not out[1].removed


def cut_alone(text, min_words=8, window=12):
    """The spans of one text by plain loops: words, edges of both cuts, first edge far enough."""
    import re
    dense = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff9f\U00020000-\U000323af"
    words = list(re.finditer(rf"[{dense}]|[^\s{dense}]+", text))
    if not words:
        return []
    whole, top = (1 << 64) - 1, [2 if not re.match(f"[{dense}]", w[0]) else 1 for w in words]

    def mix(h, factor):
        h = (h ^ h >> 30) * factor & whole
        return h ^ h >> 29

    low = [text.replace("\u0130", "i").lower()[w.start():w.end()] for w in words]
    h = [mix(sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(w)) & whole, 0xBF58476D1CE4E5B9) for w in low]
    pair = [mix((a * 0xD1342543DE82EF95 + b) & whole, 0x94D049BB133111EB) for a, b in zip(h, h[1:])]
    picks = {min(range(i, i + window), key=lambda k: (pair[k], k)) for i in range(len(pair) - window + 1)}
    capital = lambda c: any(a <= c <= b for a, b in ("AZ", "\u00c0\u00d6", "\u00d8\u00de", "\u0391\u03a9", "\u0410\u042f"))
    units = {i for i in range(1, len(words)) if words[i - 1][0][-1] in ".!?\u3002\uff01\uff1f" or capital(words[i][0][0])
             or "\n" in text[words[i - 1].end():words[i].start()]}
    found = set()
    for inner in (units, picks):
        edges = sorted({0, len(words)} | inner)
        for i in edges:
            j = next((j for j in edges if j > i and sum(top[i:j]) >= 2 * min_words), None)
            if j is not None:
                found.add((i, j))
    place = [0, *(w.start() for w in words[1:]), len(text)]
    return [(" ".join(low[i:j]), place[i], place[j]) for i, j in sorted(found)]


def mixed_texts(seed, n):
    import random
    rnd = random.Random(seed)
    alphabet = ["a", "bc", "Dd", "\u00e9", "\u03a3", "\u0130", "\u4e2d", "\u6587", "\u3002", "\uff21", "\U00020001", "\U0001f600", "\u0085", "\x1c", ".", "!", " ", " ", "\n", "  ", "\t", "\u00a0", "\u3000"]
    return ["", " ", "\n\n", "one", *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(160))) for _ in range(n))]


def test_spans_equal_those_of_plain_loops():
    texts = mixed_texts(3, 400)
    assert all(spans(t, m) == cut_alone(t, m) for t in texts for m in (2, 8))
    assert sum(len(spans(t, 8)) for t in texts) > 1000


def test_many_texts_at_once_give_each_texts_own_spans():
    from xmcforge.llm.substrings import text_spans
    texts = mixed_texts(4, 200) + ["the same eight words twice in one text\n"] * 2 + ["Own line of eight words that is repeated.\n" * 3]
    row, h1, h2, at = (x.tolist() for x in text_spans(texts, 8))
    seen, want = {}, []
    for r, t in enumerate(texts):
        own = set()
        for w, a, b in cut_alone(t):
            want.append((r, w, ~(a << 32 | b) if w in own else a << 32 | b))
            own.add(w)
    assert [(r, p) for r, p in zip(row, at)] == [(r, p) for r, _, p in want]
    for (_, w, _), d in zip(want, zip(h1, h2)):
        assert seen.setdefault(w, d) == d
    assert len(set(seen.values())) == len(seen)


def test_lines_in_scripts_without_spaces_are_found(spark):
    line = "\u8fd9\u662f\u4e00\u4e2a\u5728\u8bb8\u591a\u6587\u6863\u4e2d\u91cd\u590d\u51fa\u73b0\u7684\u53e5\u5b50\u3002"
    other = "\u53e6\u5916\u4e00\u4e9b\u53ea\u6709\u8fd9\u91cc\u624d\u6709\u7684\u5185\u5bb9"
    rows = [(1, line + "\n" + other), (2, other[::-1] + "\n" + line), (3, other[3:9] + line[:5])]
    out = {r.doc_id: r for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].removed == [] and out[3].removed == []
    assert out[2].text.strip() == other[::-1]
