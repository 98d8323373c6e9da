"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds per text) and selectivity (share it rejects) are estimated on a bounded
sample inside Spark tasks; rules then run by rejections per second, highest first, and the first
rejection ends a text's cascade.  Rules are a conjunction, so the order changes the cost and
``rejected_by``, never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmcforge.llm.common import slices, table, with_fields
from xmcforge.llm.registry import query

# Rows of the cost sample: it sets the order of the rules only.
SAMPLE_ROWS = 2000


class Text:
    """Lazy measurements of one whole UTF-8 text; each is made at most once."""

    __slots__ = ("raw", "points", "got")

    def __init__(self, raw: bytes, points: int):
        self.raw, self.points, self.got = raw, points, {}

    def __getitem__(self, name: str):
        if name not in self.got:
            self.got[name] = MEASURES[name](self)
        return self.got[name]


def _lines(t: Text) -> list[bytes]:
    return [x for x in t.raw.split(b"\n") if x.strip()]


def _repeat_words(t: Text) -> int:
    words = t["words"]
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    covered, last = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, last)
            last = i + 3
    return covered


MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.raw.split(),
    "lines": _lines,
    "n_words": lambda t: len(t["words"]),
    "word_chars": lambda t: t.points - sum(map(t.raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))),
    "n_symbols": lambda t: sum(map(t.raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))),
    "n_lines": lambda t: len(t["lines"]),
    "n_dup_lines": lambda t: len(t["lines"]) - len(set(t["lines"])),
    "n_repeat_words": _repeat_words,
    "n_upper_words": lambda t: sum(map(bytes.isupper, t["words"])),
}


@dataclass(frozen=True)
class Rule:
    """``rejects(measurements)`` is true for a text that the rule turns away."""
    name: str
    rejects: Callable[[Text], bool]


BASE = (
    Rule("few_words", lambda t: t["n_words"] < 50),
    Rule("repeated_words", lambda t: 100 * t["n_repeat_words"] > 50 * t["n_words"]),
)
RULES = BASE + (
    Rule("symbols", lambda t: 10 * t["n_symbols"] > t["n_words"]),
    Rule("repeated_lines", lambda t: 100 * t["n_dup_lines"] > 40 * t["n_lines"]),
    Rule("upper_case", lambda t: 2 * t["n_upper_words"] > t["n_words"]),
    Rule("word_length", lambda t: not 2 * t["n_words"] <= t["word_chars"] <= 15 * t["n_words"]),
)


def _texts(part, text_col: str):
    import pyarrow as pa
    import pyarrow.compute as pc
    text = pc.fill_null(part.column(text_col), "")
    return zip(text.cast(pa.binary()).to_pylist(), pc.utf8_length(text).to_pylist())


def estimate(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
             sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[dict]:
    """Per rule: sampled rows, rejections and seconds, each rule timed on fresh measurements.

    The sample is at most ``sample_rows`` random rows; the driver receives one row per rule."""
    n = df.count()
    if n == 0:
        return [{"rule": r.name, "n": 0, "rejected": 0, "seconds": 0.0} for r in rules]
    sample = df.select(F.col(text_col).alias("text")).sample(min(1.0, 1.5 * sample_rows / n), seed).limit(sample_rows)

    def run(batches):
        import time
        import pyarrow as pa
        for batch in batches:
            for part in slices(batch, "text"):
                for r in rules:
                    t0, n, bad = time.perf_counter(), 0, 0
                    for raw, points in _texts(part, "text"):
                        n += 1
                        bad += bool(r.rejects(Text(raw, points)))
                    yield pa.RecordBatch.from_pydict({"rule": [r.name], "n": pa.array([n], pa.int64()),
                                                      "rejected": pa.array([bad], pa.int64()),
                                                      "seconds": [time.perf_counter() - t0]})

    got = {r["rule"]: r.asDict() for r in sample.mapInArrow(run, "rule string, n long, rejected long, seconds double")
           .groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"),
                                F.sum("seconds").alias("seconds")).collect()}
    return [got.get(r.name, {"rule": r.name, "n": 0, "rejected": 0, "seconds": 0.0}) for r in rules]


def order_rules(rules: tuple[Rule, ...], stats: list[dict]) -> list[Rule]:
    """Rules by rejections per second, highest first; ties keep their given order."""
    gain = {s["rule"]: s["rejected"] / max(s["seconds"], 1e-9) for s in stats}
    return sorted(rules, key=lambda r: -gain.get(r.name, 0.0))


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
            report: tuple[str, ...] = (), base: tuple[Rule, ...] = (),
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Append ``kept`` and ``rejected_by`` (null if kept); other columns pass through.

    ``report`` names integer measurements to append as well: those that the cascade did not need
    are made after its verdict.  ``base`` adds ``base_failed``: whether any of these rules rejects.
    Null texts count as empty.  No shuffle; equal texts get equal verdicts."""
    ordered = order_rules(rules, estimate(df, rules, text_col, sample_rows))
    fields = [(m, T.LongType()) for m in report]
    fields += [("base_failed", T.BooleanType())] if base else []
    fields += [("kept", T.BooleanType()), ("rejected_by", T.StringType())]
    kept, schema = with_fields(df, fields)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for part in slices(batch, text_col):
                cols: list[list] = [[] for _ in fields]
                for raw, points in _texts(part, text_col):
                    t = Text(raw, points)
                    by = next((r.name for r in ordered if r.rejects(t)), None)
                    row = [t[m] for m in report]
                    row += [any(r.rejects(t) for r in base)] if base else []
                    for col, v in zip(cols, [*row, by is None, by]):
                        col.append(v)
                types = [pa.int64()] * len(report) + [pa.bool_()] * bool(base) + [pa.bool_(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays],
                                                 names=[*part.schema.names, *(n for n, _ in fields)])

    return kept.mapInArrow(run, schema)


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest(range(0, 3)) AS k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper
  FROM w LEFT JOIN c ON c.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines OR 2 * n_upper > n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""


@query("op5_quality_cascade", OP5_SQL)
def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measurements and the cascade's verdict of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    # which rule comes first depends on measured costs, so only the verdict is reported
    return cascade(docs, report=report, base=BASE).drop("text", "rejected_by")
