"""Substring duplicates by hashing lines and sentences.

A text is cut twice.  Units begin at line breaks, after sentence marks and at capital letters, so
that whole lines and sentences are found to their ends.  Picked words, the smallest hash of each
window of ``WINDOW`` words, lie at most ``WINDOW`` words apart and depend on the words around them
only, so that a passage spliced in anywhere is found from its first pick to its last one.  In both
cuts a piece shorter than ``min_words`` is hashed together with the pieces after it until the span
is long enough.  A word is a run of characters other than white space; in scripts written without
spaces each character is a word that counts as half of one.  Span digests are grouped over all
texts; the occurrence in the lowest-ranked document stays and the other ones are cut out, with
their offsets in the original text kept.

Cutting and hashing work on the code points of many texts at once: a word's hash is a polynomial of its lower-case characters,
mixed; a span's digest is two polynomials of 64 bits over its words' hashes, read off running sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmcforge.llm.common import discard, free_name, slices, table, written
from xmcforge.llm.registry import query

MIN_WORDS = 8
CUT_BYTES = 1 << 20  # text cut and hashed at once
WINDOW = 12  # every so many words in a row hold a picked one
ENDS = ".!?\u3002\uff01\uff1f"
CAPITALS = ((0x41, 0x5A), (0xC0, 0xD6), (0xD8, 0xDE), (0x391, 0x3A9), (0x410, 0x42F))
# scripts without spaces between words: Thai to Myanmar, Khmer, Japanese and Chinese signs, full-width forms
DENSE = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3001, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
         (0xF900, 0xFAFF), (0xFF01, 0xFF9F), (0x20000, 0x323AF))
CHAR_BASE, FIRST_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
MIX, SECOND_MIX = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@cache
def marks():
    """Flags of each code point below 0x32400: white space 1, end of a sentence 2, capital 4, dense script 8."""
    import numpy as np
    flags = np.zeros(0x32400, np.uint8)
    flags[[c for c in range(0x3001) if chr(c).isspace()]] = 1
    flags[[ord(c) for c in ENDS]] |= 2
    for bit, ranges in ((4, CAPITALS), (8, DENSE)):
        for a, b in ranges:
            flags[a:b + 1] |= bit
    return flags


@cache
def _powers(base: int, size: int):
    import numpy as np
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int):
    """base^0 to base^(n-1) modulo 2^64; short tables are kept."""
    if n > 1 << 18:
        return _powers.__wrapped__(base, n)
    return _powers(base, 1 << 18)[:n]


def mixed(h, factor: int):
    """Every bit of ``h`` over all bits of the result."""
    import numpy as np
    h = (h ^ (h >> np.uint64(30))) * np.uint64(factor)
    return h ^ (h >> np.uint64(29))


def lowered(text: str) -> str:
    """``text`` in lower case, as long as before (the one letter that grows is written as i)."""
    return text.replace("\u0130", "i").lower()


def code_points(text: str):
    import numpy as np
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Words:
    """Arrays over the words of many texts that stand one after the other (``edges``: where each text
    begins, and where the last one ends): first place, place after the last character, text, whether a
    line, a sentence or a capital begins there, and half words before (one entry more)."""
    edges: Any
    starts: Any
    ends: Any
    text: Any
    begins: Any
    weight: Any

    def text_ends(self):
        """The word after the last one of each word's text."""
        import numpy as np
        return np.searchsorted(self.text, self.text, side="right")


def words_in(texts: list[str]) -> Words:
    import numpy as np
    points = code_points("".join(texts))
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    flags = marks()[np.minimum(points, 0x323FF)]
    inside = (flags & 1) == 0
    alone = (flags & 8) != 0
    cut = np.ones(len(points) + 1, bool)  # no word goes on over this place
    cut[1:-1] = ~inside[1:] | ~inside[:-1] | alone[1:] | alone[:-1]
    cut[edges] = True
    starts, ends = np.flatnonzero(inside & cut[:-1]), np.flatnonzero(inside & cut[1:]) + 1
    begins = (flags[starts] & 4) != 0
    lines = np.cumsum(points == 10, dtype=np.int64)[starts]
    begins[1:] |= ((flags[ends[:-1] - 1] & 2) != 0) | (lines[1:] > lines[:-1])
    weight = np.concatenate([[0], np.cumsum(2 - alone[starts])])
    return Words(edges, starts, ends, np.searchsorted(edges, starts, side="right") - 1, begins, weight)


def word_hashes(texts: list[str], words: Words):
    import numpy as np
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    points = code_points("".join(map(lowered, texts)))
    sizes = words.ends - words.starts
    at = np.cumsum(sizes) - sizes
    inner = np.arange(int(sizes.sum())) - np.repeat(at, sizes)  # place inside the word
    chars = points[inner + np.repeat(words.starts, sizes)].astype(np.uint64) + np.uint64(1)
    return mixed(np.add.reduceat(chars * powers(CHAR_BASE, int(sizes.max()))[inner], at), MIX)


def pick_places(hashes, text):
    """Places of the words with the smallest hash, taken with the next word's, of any ``WINDOW``
    words in a row of a text (the first one of equal hashes)."""
    import numpy as np
    if len(hashes) <= WINDOW:
        return np.zeros(0, np.int64)
    pair = mixed(hashes[:-1] * np.uint64(FIRST_BASE) + hashes[1:], SECOND_MIX)
    least = np.lib.stride_tricks.sliding_window_view(pair, WINDOW).argmin(axis=1) + np.arange(len(pair) - WINDOW + 1)
    return least[text[:-WINDOW] == text[WINDOW:]]  # windows within one text


def picked(words: list[str]) -> list[int]:
    """The picked places of one text's ``words``."""
    import numpy as np
    text = " ".join(words)
    found = words_in([text])
    return np.unique(pick_places(word_hashes([text], found), found.text)).tolist()


def word_spans(words: Words, hashes, min_words: int):
    """(first word, word after the last) of each span of both cuts, in order, each once."""
    import numpy as np
    n = len(words.starts)
    if not n:
        return np.zeros((2, 0), np.int64)
    end = words.text_ends()
    found = []
    for inner in (np.flatnonzero(words.begins), pick_places(hashes, words.text)):
        edge = np.zeros(n + 1, bool)
        edge[0] = edge[end] = edge[inner] = True
        edges = np.flatnonzero(edge)
        # the first edge that is min_words away, if the text goes on to there
        to = np.searchsorted(words.weight[edges], words.weight[edges] + 2 * min_words)
        first, after = edges[to < len(edges)], edges[to[to < len(edges)]]
        whole = after <= end[first]
        found.append(first[whole] << 32 | after[whole])
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def digests(hashes, first, after):
    """Two 64-bit polynomials over the word hashes of each span."""
    import numpy as np
    out = []
    for base, h in ((FIRST_BASE, hashes), (SECOND_BASE, mixed(hashes, SECOND_MIX))):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(base, len(h)), out=sums[1:])
        back = powers(pow(base, -1, 1 << 64), len(h))[first]
        # the length tells spans apart whose surplus words hash to 0
        out.append(mixed((sums[after] - sums[first]) * back + (after - first).astype(np.uint64), MIX).view(np.int64))
    return out


def span_places(words: Words, first, after):
    """(start, end) of spans in their texts: from the text's beginning or a word's first place to the
    next word's first place or the text's end."""
    import numpy as np
    text = words.text[first]
    begin = (first == 0) | (words.text[first - 1] != text)
    last = words.text[after - 1]
    end = np.where(after == words.text_ends()[first], words.edges[last + 1], np.append(words.starts, 0)[after])
    return np.where(begin, 0, words.starts[first] - words.edges[text]), end - words.edges[text]


def text_spans(texts: list[str], min_words: int):
    """(row, digests, second digests, start * 2^32 + end) of the spans of ``texts``; the last one has all
    bits turned where an earlier span of the same text is equal."""
    import numpy as np
    words = words_in(texts)
    hashes = word_hashes(texts, words)
    first, after = word_spans(words, hashes, min_words)
    if not len(first):
        return (np.zeros(0, np.int64),) * 4
    row = words.text[first]
    h1, h2 = digests(hashes, first, after)
    start, end = span_places(words, first, after)
    at = start << 32 | end
    order = np.lexsort((h2, h1, row))  # stable: equal spans stay in the text's order
    a, b = order[:-1], order[1:]
    again = b[(h1[a] == h1[b]) & (h2[a] == h2[b]) & (row[a] == row[b])]
    at[again] = ~at[again]
    return row, h1, h2, at


def spans(text: str, min_words: int) -> list[tuple[str, int, int]]:
    """(normalised words, start, end) of each span; ``end`` is where the next word starts.

    Pieces at the end of a text that do not reach ``min_words`` words begin no span."""
    words = words_in([text])
    first, after = word_spans(words, word_hashes([text], words), min_words)
    low = lowered(text)
    low = [low[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
    start, end = span_places(words, first, after) if len(first) else (first, after)
    return [(" ".join(low[i:j]), a, b) for i, j, a, b in zip(*(x.tolist() for x in (first, after, start, end)))]


def span_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(_id, _text_key, h1, h2, at) of ``docs`` (_id, _text_key, _text); ``at`` is start * 2^32 + end,
    with all bits turned (negative) for a span that an earlier span of the same text equals."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for part in slices(batch, "_text", CUT_BYTES):
                row, *found = text_spans([t or "" for t in part.column("_text").to_pylist()], min_words)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(row), part.column("_text_key").take(row), *map(pa.array, found)],
                    names=["_id", "_text_key", "h1", "h2", "at"])

    return docs.mapInArrow(run, "_id long, _text_key long, h1 long, h2 long, at long")


def drop_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS,
                 ranges_col: str = "removed") -> DataFrame:
    """``df`` with repeated spans cut out of ``text_col`` and their original offsets in ``ranges_col``.

    Documents rank by id, nulls last.  Rows that share an id rank equal: a span first seen under
    that id stays in each of them.  A text's own repeats go, too.  ``ranges_col`` lists merged
    [start, end) ranges in code points; it is empty for untouched texts.  Null and empty texts stay
    as they are; a text with nothing left becomes empty.  Other columns pass through, whatever their
    names; one called like ``ranges_col`` is replaced."""
    last = F.lit((1 << 63) - 1)
    rank = F.coalesce(df[f"`{id_col}`"].cast("long"), last)
    kept = df.drop(ranges_col)
    docs = df.select(rank.alias("_id"), F.xxhash64(df[f"`{text_col}`"]).alias("_text_key"), df[f"`{text_col}`"].alias("_text"))
    rows = span_rows(docs, min_words)
    # a text's own repeats go in any case: they are dealt by place, not to their digest's task
    again = F.col("at") < 0
    rows = rows.withColumn("h1", F.when(again, F.xxhash64("_id", "at")).otherwise(F.col("h1")))
    # narrow and summed map-side: a line that a third of all texts holds is one row per task
    first = (rows.where(~again).groupBy("h1", "h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
             .where("_first < _last").drop("_last"))
    first = written(first, "first")  # its shuffle files go before the spans are shuffled
    gone = (rows.join(first, ["h1", "h2"], "left").where(again | (F.col("_first") < F.col("_id")))
            .groupBy("_id", "_text_key").agg(F.collect_list(F.when(again, F.bitwise_not("at")).otherwise(F.col("at"))).alias("_gone")))
    gone = written(gone, "repeats")  # the spans' shuffle files go before the texts are shuffled
    discard(first)
    names = kept.columns
    i, key, gone_col = (free_name(names, c) for c in ("_id", "_text_key", "_gone"))
    gone = gone.select(F.col("_id").alias(i), F.col("_text_key").alias(key), F.col("_gone").alias(gone_col))
    joined = (kept.withColumn(i, F.coalesce(F.col(f"`{id_col}`").cast("long"), last))
              .withColumn(key, F.xxhash64(F.col(f"`{text_col}`")))
              .join(gone, [i, key], "left").select(*[F.col(f"`{c}`") for c in names], gone_col))
    at = names.index(next(c for c in names if c.lower() == text_col.lower()))
    schema = T.StructType(list(kept.schema.fields) + [T.StructField(ranges_col, T.ArrayType(SPAN))])

    def cut(batches):
        import pyarrow as pa
        for batch in batches:
            for part in slices(batch, names[at]):
                texts = part.column(at).to_pylist()
                removed = []
                for i, gone in enumerate(part.column(gone_col).to_pylist()):
                    ranges: list[list[int]] = []
                    for a, b in sorted((g >> 32, g & 0xFFFFFFFF) for g in gone or ()):
                        if ranges and a <= ranges[-1][1]:
                            ranges[-1][1] = max(b, ranges[-1][1])
                        else:
                            ranges.append([a, b])
                    if ranges:
                        edges = [0, *(x for r in ranges for x in r), len(texts[i])]
                        texts[i] = "".join(texts[i][a:b] for a, b in zip(edges[::2], edges[1::2]))
                    removed.append([{"start": a, "end": b} for a, b in ranges])
                cols = list(part.columns[:-1])
                cols[at] = pa.array(texts, cols[at].type)
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=[*names, ranges_col])

    return joined.mapInArrow(cut, schema)


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages: what is left, and what was cut where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeats(docs)
    cut = F.aggregate("removed", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "text", "removed", cut.cast("long").alias("removed_chars"))
