import re
from collections import Counter

from helpers import WORD, edge_docs, edge_rows, no_docs, words

from xmcforge.llm.quality import BASE, RULES, Rule, cascade, estimate, order_rules

REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(text):
    text = text or ""
    w = words(text)
    windows = list(zip(w, w[1:], w[2:]))
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measurements_equal_brute_force(spark):
    out = cascade(edge_docs(spark), report=REPORT, base=BASE).collect()
    want = Counter((i, *measured(t)) for i, t, *_ in edge_rows())
    assert Counter((r.doc_id, *(r[c] for c in REPORT)) for r in out) == want
    for r in out:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept) and r.kept == (r.rejected_by is None)


def test_the_order_never_changes_the_verdict(spark):
    texts = [("word " * 10,), ("#a b c " * 40,), (" ".join(f"w{i}" for i in range(60)),), ("ABC DEF! " * 3 + " ".join(f"W{i}X" for i in range(80)),)]
    df = spark.createDataFrame(texts, "text string")
    verdicts = [{r.text: r.kept for r in cascade(df, rules=rules).collect()} for rules in (RULES, RULES[::-1])]
    assert verdicts[0] == verdicts[1] and list(verdicts[0].values()).count(True) == 1


def test_rules_run_by_rejections_per_cost():
    rules = (Rule("dear", None), Rule("cheap", None), Rule("idle", None))
    stats = [{"rule": "dear", "n": 9, "rejected": 4, "seconds": 4.0}, {"rule": "cheap", "n": 9, "rejected": 2, "seconds": 0.5},
             {"rule": "idle", "n": 9, "rejected": 0, "seconds": 0.1}]
    assert [r.name for r in order_rules(rules, stats)] == ["cheap", "dear", "idle"]


def test_sample_and_edges(spark):
    stats = estimate(edge_docs(spark), sample_rows=100)
    assert {s["rule"] for s in stats} == {r.name for r in RULES} and all(0 <= s["rejected"] <= s["n"] for s in stats)
    assert cascade(no_docs(spark)).count() == 0
    df = spark.createDataFrame([("a", "old", 1)], "text string, kept string, n_words int")
    row = cascade(df, report=("n_words",)).first()
    assert row.kept is False and row.n_words == 1
