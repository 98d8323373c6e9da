"""Small tables and brute-force versions for the tests of this folder."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rnd = random.Random(3)
    words = ["alpha", "Beta", "gamma.", "délta", "ε", "zeta!", "Eta", "#theta", "iota|", "<|endoftext|>", "日本語テキスト", "x" * 60]
    long = " ".join(rnd.choice(words) for _ in range(30000))
    para = "One passage of some words that is repeated, here and there. It ends after this sentence of eight words."
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n ", None, "a", 3), (4, long, "en", "b", len(long)),
        (5, long, "en", "b", len(long)), (6, "short text", "de", "c", 10), (6, "short text", "de", "c", 10),
        (None, "no id here but words enough to count for a unit of text", None, None, None), (8, "x" * 200000, "en", "a", 200000),
        (9, "line one\nline one\nline one", "en", "a", 26), (10, "Intro words. " + para + " tail", "en", "é", None),
        (11, "Other start " + para + "\nand more", "en", "b", None), (12, "a\x1cb\x85c d e　f᠎g​h", "en", "b", 17),
        (13, "  leading and trailing  \r\n\r\n", "en", "a", 26), (14, "é" * 5 + " " + "é" * 5, "fr", "a", 16),
    ]
    return rows


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1))


def classes(docs, n, percent):
    """{id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())
