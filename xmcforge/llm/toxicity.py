"""Toxicity by a weighted finite-state pattern grammar.

A clause is a run of words between sentence marks or line breaks.  A lexicon turns its words into
symbols (insult, threat, target, negation, report, first person, intention, other); a cascade of small
transducers rewrites them and a final one weighs what is left:

    negation   insults and threats in its scope count little
    report     those after a word of reported speech count less
    insult     a target shortly before or after it makes it aimed
    threat     intention, target and threat word in any of the orders that the languages have ("I will
               hurt you", "ich werde dich verletzen"); a threat word that the lexicon has not learned
               counts only within this pattern of several words

The transducers are composed once into one machine, which then reads each clause that holds an insult
or a threat word.
A text's score is a logistic function of the weights of its matched clauses.

Lexicon weights and the logistic function are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmcforge.llm.common import slices, table, with_fields, words_of
from xmcforge.llm.registry import query

FIT_ROWS = 8000         # labelled rows the fit reads at most, taken by the hash of their id
LEXICON_SIZE = 4000     # patterns kept at most
MIN_CLAUSES = 5         # distinct toxic clauses a pattern must occur in
MIN_LOG_ODDS = 3.0
STEMS = (4, 5, 6)       # lengths of word beginnings tried as patterns
SCOPE = 3               # words that a negation or a target reaches

# Fixed word lists (function words of English, German, French, Spanish).
NEGATIONS = "not no never nicht kein keine nie ne pas jamais nunca sin".split()
REPORTS = "said says wrote quoted reported claimed sagte schrieb zitierte disait écrivait dijo escribió".split()
TARGETS = "you your they he she people du ihr sie dich euch vous toi te ils elles usted ustedes ellos ellas".split()
THREATS = "kill hurt destroy attack töten umbringen verletzen tuer frapper matar golpear".split()
PERSONS = "i we ich wir je nous yo nosotros".split()
WILLS = "will shall gonna going werde werden vais allons".split()
INTENTIONS = "i'll we'll i’ll we’ll voy vamos".split()

# Fixed symbols: o other, i insult, h threat, u threat word without a learned weight, t target, n negation,
# r report, f first person, w will, m intention; derived ones: j k negated, p q reported, I H aimed (insult
# and threat each), A target that an insult stands before, B the same of a threat, K T the threat word and
# the target that complete the pattern of an unlearned threat.
SYMBOLS = "oihutnrfwm"
WEIGHTS = {"i": 1.0, "h": 1.0, "I": 1.25, "H": 1.4, "j": 0.4, "k": 0.3, "p": 0.5, "q": 0.4, "A": 0.25, "B": 0.4, "K": 1.4, "T": 1.4}
HOLDS = "ihu"           # a clause without one of these matches nothing
PERSON_SCOPE = 2        # words from a first person to its will
CLAUSE_END = re.compile(r"[.!?;\n]+")
# What ends a word in a clause: the clause's end and white space as str.split() has it.
WORD_END = "[.!?;" + "".join(rf"\x{{{c:x}}}" for c in range(0x110000) if chr(c).isspace()) + "]+"


@dataclass
class Transducer:
    """Deterministic letter transducer: (state, symbol) -> (state, symbol out, weight).

    Symbols without an arc pass unchanged along ``default[state]``."""
    arcs: dict = field(default_factory=dict)
    default: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol):
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        return self.default.get(state, state), symbol, 1.0

    def run(self, symbols):
        """Output symbols and weights from the start state."""
        state, out = self.start, []
        for s in symbols:
            state, o, w = self.step(state, s)
            out.append((o, w))
        return out


def compose(a: Transducer | Pattern, b: Transducer | Pattern, alphabet: str) -> Transducer:
    """The machine that feeds ``a``'s output to ``b``, over the states reachable with ``alphabet``."""
    start = (a.start, b.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for s in alphabet:
            na, mid, wa = a.step(state[0], s)
            nb, out, wb = b.step(state[1], mid)
            arcs[state, s] = ((na, nb), out, wa * wb)
            if (na, nb) not in seen:
                seen.add((na, nb))
                todo.append((na, nb))
    return Transducer(arcs, {}, start)


def scoped(trigger: str, rewrite: dict[str, str], scope: int | None) -> Transducer:
    """After ``trigger`` rewrite symbols for ``scope`` words (None: to the clause's end)."""
    t = Transducer()
    states = range(2) if scope is None else range(scope + 1)
    full = max(states)
    for s in states:
        after = s if scope is None else max(0, s - 1)
        t.default[s] = after
        t.arcs[s, trigger] = (full, "o", 1.0)
        if s:
            for x, y in rewrite.items():
                t.arcs[s, x] = (after, y, 1.0)
    return t


class Pattern:
    """A transducer given by its step function and start state."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def insult_pattern() -> Pattern:
    """Insults aimed by a target up to ``SCOPE`` words before (I) or after them (the target becomes A).

    State: words left in a target's reach, and in the reach of an insult not aimed yet."""
    def step(state, s):
        target, insult = (max(0, x - 1) for x in state)
        if s == "t":
            return (SCOPE, 0), "A" if state[1] else "t", 1.0
        if s == "i":
            return ((target, 0), "I", 1.0) if state[0] else ((target, SCOPE), "i", 1.0)
        return (target, insult), s, 1.0
    return Pattern((0, 0), step)


def threat_pattern() -> Pattern:
    """Threats: aimed like insults (H, B), or intention, target and threat word together (K, T).

    State: words left for a target, words left for a will after a first person, intention (0 none, 1 seen,
    2 seen with a target behind it), the pending threat word and the words left for its target."""
    def step(state, s):
        target, person, intent, pending, left = state
        after_t, after_p, after_l = max(0, target - 1), max(0, person - 1), max(0, left - 1)
        after_pending = pending if after_l else ""
        if s == "f":
            return (after_t, PERSON_SCOPE, intent, after_pending, after_l), s, 1.0
        if s == "m" or (s == "w" and person):
            return (after_t, 0, max(intent, 1), after_pending, after_l), s, 1.0
        if s in "tA":
            out = {"u": "T", "h": "B"}.get(pending, s) if s == "t" or pending == "u" else s
            return (SCOPE, after_p, 2 if intent else 0, "", 0), out, 1.0
        if s in "hu":
            if intent == 2 or (s == "h" and target):
                return (after_t, after_p, intent, "", 0), "H" if s == "h" else "K", 1.0
            if s == "h" or intent:
                return (after_t, after_p, intent, s, SCOPE), s, 1.0
        return (after_t, after_p, intent, after_pending, after_l), s, 1.0
    return Pattern((0, 0, 0, "", 0), step)


@functools.lru_cache(maxsize=1)
def grammar() -> Transducer:
    """Negation, then reported speech, insults, threats and the weights."""
    weigh = Pattern(0, lambda state, s: (0, s, WEIGHTS.get(s, 0.0)))
    machine = scoped("n", {"i": "j", "h": "k", "u": "o"}, SCOPE)
    for part in (scoped("r", {"i": "p", "h": "q", "u": "o"}, None), insult_pattern(), threat_pattern(), weigh):
        machine = compose(machine, part, SYMBOLS)
    return machine


def bare(word: str) -> str:
    """A word in lower case without what is not a letter or digit at its ends."""
    word = word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end]


def patterns(word: str) -> list[str]:
    """The patterns that match a bare word: itself and its beginnings (marked by a star)."""
    return [word] + [word[:k] + "*" for k in STEMS if len(word) >= k] if word else []


@dataclass(frozen=True)
class Model:
    lexicon: dict          # pattern -> weight
    slope: float
    bias: float

    def symbol(self, word: str) -> tuple[str, float]:
        w = bare(word)
        weight = max((self.lexicon[p] for p in patterns(w) if p in self.lexicon), default=0.0)
        if weight > 0:
            return ("h" if w in THREATS else "i"), weight
        for s, words in (("u", THREATS), ("n", NEGATIONS), ("r", REPORTS), ("t", TARGETS), ("f", PERSONS), ("w", WILLS),
                         ("m", INTENTIONS)):
            if w in words:
                return s, 0.0
        return "o", 0.0

    def matched(self, text: str, machine: Transducer, symbols: dict) -> float:
        """Sum over the matched clauses of the weights along the machine's path; what no learned word
        carries (a target or an unlearned threat word that completes a pattern) weighs ``MIN_LOG_ODDS``."""
        total = 0.0
        for clause in CLAUSE_END.split(text):
            read = [symbols.get(w) or symbols.setdefault(w, self.symbol(w)) for w in clause.split()]
            if any(s in HOLDS for s, _ in read):
                total += sum((w or MIN_LOG_ODDS) * f for (_, w), (_, f) in zip(read, machine.run(s for s, _ in read)))
        return total

    def probability(self, total: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * total + self.bias))))


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``fit_rows`` labelled rows, chosen by the hash of their id."""
    chosen = (labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    return docs.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def fit(sample: DataFrame, lexicon_size: int = LEXICON_SIZE) -> Model:
    """Learn the lexicon and the logistic function from ``sample`` (text, toxic).

    Patterns are counted over distinct clauses, so copies of a text count once.  The driver receives
    at most ``lexicon_size`` patterns and two numbers per sampled row."""
    def clauses(batches):
        import pyarrow as pa
        for batch in batches:
            for part in slices(batch, "text"):
                rows = {(" ".join(c.lower().split()), y) for t, y in zip(part["text"].to_pylist(), part["toxic"].to_pylist())
                        for c in CLAUSE_END.split(t) if c.strip()}
                if rows:
                    c, y = zip(*rows)
                    yield pa.RecordBatch.from_pydict({"clause": list(c), "toxic": pa.array(y, pa.int32())})

    def counted(batches):
        from collections import Counter
        import pyarrow as pa
        for batch in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for c, y in zip(batch["clause"].to_pylist(), batch["toxic"].to_pylist()):
                n[y].update({p for w in c.split() for p in patterns(bare(w))})
                n[y][""] += 1  # all clauses
            names = list(set(n[0]) | set(n[1]))
            yield pa.RecordBatch.from_pydict({"pattern": names, "bad": pa.array([n[1][p] for p in names], pa.int64()),
                                              "good": pa.array([n[0][p] for p in names], pa.int64())})

    distinct = sample.mapInArrow(clauses, "clause string, toxic int").groupBy("clause").agg(F.min("toxic").alias("toxic"))
    counts = distinct.mapInArrow(counted, "pattern string, bad long, good long").groupBy("pattern").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).persist()
    total = counts.where("pattern = ''").first()
    if total is None or not total["bad"] or not total["good"]:
        counts.unpersist()
        return Model({}, 0.0, -math.log(19.0))  # nothing to learn from: a low constant score
    base = math.log(total["bad"] / total["good"])
    odds = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - base
    best = (counts.where(f"pattern <> '' and bad >= {MIN_CLAUSES}").withColumn("odds", odds)
            .where(F.col("odds") >= MIN_LOG_ODDS).orderBy(F.desc("bad"), F.length("pattern"), "pattern").limit(lexicon_size))
    lexicon: dict[str, float] = {}
    for r in best.collect():
        p = r["pattern"]
        shorter = [q for q in patterns(p.rstrip("*")) if q in lexicon]
        if not shorter:  # a shorter beginning already matches what this one does
            lexicon[p] = r["odds"] * r["bad"] / (r["bad"] + 10.0)
    counts.unpersist()
    model = Model(lexicon, 1.0, 0.0)
    rows = totals(sample, model).select("toxic", "_total").collect()  # at most fit_rows pairs of numbers
    slope, bias = logistic([r["_total"] for r in rows], [r["toxic"] for r in rows])
    return Model(lexicon, slope, bias)


def logistic(x: list[float], y: list[int], rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not negative) and bias of a one-dimensional logistic fit by Newton's method."""
    import numpy as np
    x, y = np.minimum(np.array(x, float), 30.0), np.array(y, float)
    a, b = 0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum() + ridge * b])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (0.0, float(b))


def totals(df: DataFrame, model: Model, text_col: str = "text", out: str = "_total") -> DataFrame:
    """Append the weight of the matched clauses of every whole text (0 where nothing matches)."""
    kept, schema = with_fields(df, [(out, T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        machine = grammar()
        symbols: dict = {}
        for batch in batches:
            for part in slices(batch, text_col):
                flat, offsets = words_of(pc.replace_substring_regex(part.column(text_col), WORD_END, " "))
                coded = flat.dictionary_encode()
                if len(symbols) > 1_000_000:
                    symbols.clear()
                hit = np.fromiter((((symbols.get(w) or symbols.setdefault(w, model.symbol(w)))[0] in HOLDS)
                                   for w in coded.dictionary.to_pylist()), bool, len(coded.dictionary))
                value = np.zeros(part.num_rows)
                if hit.any():  # texts without such a word match no clause
                    at = np.flatnonzero(hit[np.asarray(coded.indices)])
                    for i in np.unique(np.searchsorted(offsets, at, side="right") - 1):
                        value[i] = model.matched(part.column(text_col)[int(i)].as_py(), machine, symbols)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], names=[*part.schema.names, out])

    return kept.mapInArrow(run, schema)


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Append the toxicity in [0, 1] of every whole text; other columns pass through.

    Null texts score like empty ones, equal texts equally.  No shuffle."""
    rows = totals(df, model, text_col, out)
    z = F.lit(model.slope) * F.col(f"`{out}`") + F.lit(model.bias)
    return rows.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether the crc32 of the id as text is divisible by 5 (such rows are never learned from)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitted(spark: SparkSession, sf_dir: str, fit_rows: int = FIT_ROWS) -> Model:
    """The model of the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    return fit(fit_sample(docs, labels, fit_rows))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fitted(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
