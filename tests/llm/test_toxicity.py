from helpers import SF, edge_docs, no_docs

from xmcforge.llm import toxicity as X
from xmcforge.llm.common import table


def path(machine, symbols):
    return "".join(s for s, _ in machine.run(symbols)), [w for _, w in machine.run(symbols)]


def test_transducers_compose_as_they_run_in_turn():
    import itertools
    neg, rep, tgt = X.scoped("n", {"i": "j", "h": "k"}, 3), X.scoped("r", {"i": "p", "h": "q"}, None), X.scoped("t", {"i": "I", "h": "H"}, 3)
    both = X.compose(X.compose(neg, rep, "oihtnr"), tgt, "oihtnr")
    for symbols in itertools.product("oihtnr", repeat=5):
        step = [s for s, _ in neg.run(symbols)]
        step = [s for s, _ in rep.run(step)]
        assert [s for s, _ in both.run(symbols)] == [s for s, _ in tgt.run(step)]


def test_negated_reported_and_aimed_insults_weigh_differently():
    m = X.grammar()
    weight = lambda s: sum(w for _, w in m.run(s))
    assert weight("ti") > weight("i") > weight("ri") > weight("ni") > 0 == weight("ontr")
    assert weight("nooooi") == weight("i")  # out of the negation's scope


def test_matched_clauses_not_words():
    model = X.Model({"idiot": 4.0, "lowe*": 5.0}, 1.0, -3.0)
    m = X.grammar()
    score = lambda t: model.matched(t, m, {})
    assert score("You idiot. A fine day.") == 4.0 * 1.25 and score("not an idiot") == 4.0 * 0.4
    assert score("He said: idiot") == 2.0 and score("no. Idiot!") == 4.0 and score("lowering") == 5.0 and score("") == 0.0


def by_rules(symbols):
    """The weight of a clause from the rules in words, looking back over the whole clause each time."""
    s = list(symbols)
    seen = lambda x, what, reach: any(s0[y] == what for y in range(max(0, x - reach), x))
    s0 = list(s)
    for x, c in enumerate(s0):  # negation, report
        if c in "ihu":
            if seen(x, "n", 3):
                s[x] = {"i": "j", "h": "k", "u": "o"}[c]
            elif "r" in s0[:x]:
                s[x] = {"i": "p", "h": "q", "u": "o"}[c]
    total = 0.0
    used = set()  # threat words that are aimed already or have met their target
    for x, c in enumerate(s):
        total += {"j": 0.4, "k": 0.3, "p": 0.5, "q": 0.4}.get(c, 0.0)
        if c == "i":
            total += 1.25 if seen(x, "t", 3) else 1.0
        meant = [y for y in range(x) if s0[y] == "m" or (s0[y] == "w" and "f" in s0[max(0, y - 2):y])]
        framed = bool(meant) and "t" in s0[meant[0]:x]
        if c == "h":
            aimed = framed or seen(x, "t", 3)
            total += 1.4 if aimed else 1.0
            if aimed:
                used |= set(range(x + 1))
        if c == "u" and framed:
            total += 1.4
            used |= set(range(x + 1))
        if c == "t":
            since = max([y for y in range(x) if s0[y] == "t"], default=-1)
            insult = any(s[y] == "i" and not seen(y, "t", 3) for y in range(max(since + 1, x - 3), x))
            waiting = [y for y in range(max(since + 1, x - 3), x) if y not in used and
                       (s[y] == "h" or (s[y] == "u" and any(z == "m" or (z == "w" and "f" in s0[max(0, k - 2):k])
                                                            for k, z in enumerate(s0[:y]))))]
            if waiting and s[waiting[-1]] == "u":
                total += 1.4
            elif insult:
                total += 0.25
            elif waiting:
                total += 0.4
    return total


def test_grammar_weighs_as_the_rules_say():
    import itertools
    import random
    m = X.grammar()
    weight = lambda s: sum(w for _, w in m.run(s))
    rnd = random.Random(7)
    longer = ["".join(rnd.choice("oihutnrfwm") for _ in range(rnd.randint(5, 12))) for _ in range(30000)]
    for symbols in [*itertools.product("oihutnrfwm", repeat=4), *longer]:
        assert abs(weight(symbols) - by_rules(symbols)) < 1e-9, "".join(symbols)


def test_patterns_of_several_words():
    model = X.Model({"idiot": 4.0}, 1.0, -3.0)
    score = lambda t: model.matched(t, X.grammar(), {})
    threat = 1.4 * X.MIN_LOG_ODDS
    for text in ("I will kill you", "we are going to hurt you", "I'll destroy you", "Ich werde dich verletzen", "je vais te tuer"):
        assert abs(score(text) - threat) < 1e-9, text
    for text in ("they kill time", "frost will kill the plants", "I will never hurt you", "He said: I will kill you", "you will. I kill"):
        assert score(text) == 0.0, text
    assert score("an idiot, are you") == 4.0 + 0.25 * X.MIN_LOG_ODDS


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    model = X.fitted(spark, SF)
    rows = X.score(docs, model).join(labels, "doc_id").where(X.held_out()).select("score", "toxic").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    assert right >= 0.8 * len(rows)


def test_edges(spark):
    model = X.Model({"idiot": 4.0}, 1.0, -3.0)
    out = X.score(edge_docs(spark), model).collect()
    assert len(out) == 15 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[1] == by[2] == by[3]
    assert X.score(no_docs(spark), model).count() == 0
    none = X.fit(X.fit_sample(no_docs(spark), spark.createDataFrame([], "doc_id long, toxic int")))
    assert none.lexicon == {} and X.score(edge_docs(spark), none).where("score >= 0.5").count() == 0
    df = spark.createDataFrame([("you idiot idiot", "old")], "text string, score string")
    assert X.score(df, model).first().score > 0.5


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"plain words {i}" + (" idiot" if i % 4 == 0 else "")) for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic")
    lies = labels.withColumn("toxic", X.F.when(X.held_out(), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    a, b = (X.fit(X.fit_sample(docs, x.where(~X.held_out()))) for x in (labels, lies))
    assert a == b and "idiot" in a.lexicon or "idio*" in a.lexicon


def test_words_behind_glued_marks_and_other_spaces_are_scored(spark):
    model = X.Model({"idiot": 4.0, "lowe*": 5.0}, 1.0, -3.0)
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = ["Shut up...idiot", "So?idiot go", "a;lower", "fine!no.Idiot", "plain words", "", "an idiotic.text", "x.y", None]
    texts += [f"you{c}idiot" for c in spaces] + [f"so{c}lowering,{c}words" for c in spaces]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in X.score(df, model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - model.probability(model.matched(t or "", X.grammar(), {}))) < 1e-12, t
    assert got[0] > 0.5 and got[9] > 0.5
