"""Subword ids (P02, P03): words that the vocabulary lacks decompose into its longest pieces.

The vocabulary is counted, not fitted: frequent words plus every character.  A word is read from
left to right, each time taking the longest piece that stands at the place reached; a character
without a piece is one unknown id.  Only distinct unknown words are decomposed, in native
expressions: each place's next ``max_piece`` characters are looked up as rows that stay in the task
that holds the word, and a fold over the pieces found picks those the reading meets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xmcforge.functions.text import BOS_ID, EOS_ID, FIRST_TOKEN_ID, UNK_ID, tokens
from xmcforge.plans.partitioning import spread_if_small
from xmcforge.plans.ranking import dist_rank
from xmcforge.session import reliable_checkpoint

# Longest piece of a vocabulary in characters; it bounds the lookups at a place of a word.
MAX_PIECE = 32
# Up to this many words besides the common ones (a key and a few ids each) go to every task.
PIECES_BROADCAST_ROWS = 100_000
# The common words and their ids that go to every task, in estimated bytes.
COMMON_BYTES = 48 << 20
# Pieces of the vocabulary that go to every task at once while words are decomposed.
LOOKUP_ROWS = 500_000
# Characters of the distinct words that a task decomposes, and the most tasks.
TASK_CHARACTERS, MAX_TASKS = 250_000, 20_000
# A long word is cut into windows of this many places before its places become rows.
WINDOW = 256


def characters(word: str) -> Column:
    return F.split(word, "")


def word_key(word: str) -> Column:
    """A word of up to 32 bytes itself, else its md5 behind a character that no word holds."""
    return F.when(F.octet_length(word) <= 32, F.col(word)).otherwise(F.concat(F.lit("\u0000"), F.md5(word)))


def word_counts(corpus: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """(word, n): the distinct words of the texts with their occurrences."""
    rows = spread_if_small(corpus.select(*{text_col, key or text_col}), key=key or text_col)
    return rows.select(F.explode(tokens(text_col)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def piece_vocab(corpus: DataFrame, text_col: str = "text", min_count: int = 2, max_piece: int = MAX_PIECE,
                words: DataFrame | None = None) -> DataFrame:
    """(token, count, token_id): words of 2 to ``max_piece`` characters found ``min_count`` times or more, and
    every character of every word with its occurrences; ranked by (count desc, token), ids after the
    special ones.  Null and empty texts add nothing; without words the table is empty.  ``words``: the
    corpus' ``word_counts`` if they are there already."""
    words = word_counts(corpus, text_col) if words is None else words
    whole = (F.col("n") >= min_count) & F.length("word").between(2, max_piece)
    pieces = F.concat(F.when(whole, F.array("word")).otherwise(F.array().cast("array<string>")), characters("word"))
    counts = (words.select("n", F.explode(pieces).alias("token"))
              .groupBy("token").agg(F.sum("n").cast("long").alias("count")))
    ranked = dist_rank(counts, [F.col("count").desc(), F.col("token").asc()], rank_col="r")
    return ranked.select("token", "count", (F.col("r") - 1 + FIRST_TOKEN_ID).cast("long").alias("token_id"))


def _slices(vocab: DataFrame, max_piece: int) -> list[tuple[int, int, int, int]]:
    """(shortest, longest, part, parts): the vocabulary by its pieces' sizes, at most ``LOOKUP_ROWS`` in a
    slice; a size with more is dealt over parts.  The first slice begins at size 1."""
    size = F.length("token").alias("size")
    counts = {r["size"]: r["count"] for r in vocab.select(size).where(F.col("size").between(1, max_piece)).groupBy("size").count().collect()}
    out, total = [], LOOKUP_ROWS + 1
    for s, n in sorted(counts.items()):
        if total + n <= LOOKUP_ROWS:
            out[-1][1], total = s, total + n
        else:
            parts = -(-n // LOOKUP_ROWS)
            out += [[s, s, p, parts] for p in range(parts)]
            total = n if parts == 1 else LOOKUP_ROWS + 1
    out = out or [[1, 1, 0, 1]]
    out[0][0] = 1
    return [tuple(x) for x in out]


def _longest(words: DataFrame, vocab: DataFrame, low: int, high: int, part: int, parts: int, max_piece: int) -> DataFrame:
    """(key, n, of, hits): the longest piece of a slice of the vocabulary at each place of a word that has one,
    as (place * max_piece + max_piece - size, id); n and the word's length come with the first slice.

    Places and tries of a word are rows of the task that holds the word; long words go in windows."""
    pieces = vocab.where(F.length("token").between(low, high) & (F.pmod(F.xxhash64("token"), F.lit(parts)) == part))
    of = F.length("word")
    cut = words.select("key", "n", of.alias("of"), "word", F.explode(F.sequence(F.lit(0), of - 1, F.lit(WINDOW))).alias("start"))
    cut = cut.select("key", "n", "of", "start", F.substring("word", F.col("start") + 1, F.lit(WINDOW + high - 1)).alias("window"))
    places = cut.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.length("window")))).alias("i"))
    room = F.length("window") - F.col("i") + 1
    tries = (places.where(room >= low).select("*", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), room))).alias("size"))
             .select("key", "n", "of", (F.col("start") + F.col("i") - 1).cast("long").alias("at"), "size",
                     F.substring("window", F.col("i"), F.col("size")).alias("token")))
    head = (F.col("at") == 0) & (F.col("size") == 1) & F.lit(low == 1 and part == 0)  # keeps a word without any piece
    met = F.col("token_id").isNotNull()
    place = F.col("at") * max_piece + (max_piece - F.col("size"))
    hit = F.struct(place.alias("place"), F.bitwise_not(F.col("token_id").cast("long")).alias("not_id"))
    found = (tries.join(F.broadcast(pieces.select("token", "token_id")), "token", "left").where(met | head)
             .groupBy("key").agg(F.max(F.when(head, F.col("n"))).alias("n"), F.max(F.when(head, F.col("of"))).alias("of"),
                                 F.array_sort(F.collect_list(F.when(met, hit))).alias("h")))
    at = lambda x: x["place"] - x["place"] % max_piece
    first = F.filter("h", lambda x, i: (i == 0) | (at(F.get("h", i - 1)) != at(x)))
    return found.select("key", "n", "of", first.alias("h")).select(
        "key", "n", "of", F.transform("h", lambda x: x["place"]).alias("places"),
        F.transform("h", lambda x: F.bitwise_not(x["not_id"])).alias("ids"))


def decompose(words: DataFrame, vocab: DataFrame, max_piece: int = MAX_PIECE, tasks: int | None = None) -> DataFrame:
    """(key, n, ids) of the distinct words (key, word, n): ``ids`` = the word's pieces' ids.

    A word of c characters makes up to c * ``max_piece`` rows, none of which leaves the task that holds the word: the
    vocabulary goes there, at most ``LOOKUP_ROWS`` at once.  Of each word the pieces found in a slice of the
    vocabulary are kept, and meet when there are several slices."""
    if tasks is None:
        tasks = _tasks(words)
    slices = _slices(vocab, max_piece)
    if len(slices) == 1:
        found = _longest(words.repartition(tasks, "key"), vocab, *slices[0], max_piece)
    else:
        words = reliable_checkpoint(words)
        kept = [reliable_checkpoint(_longest(words.repartition(tasks, "key"), vocab, *x, max_piece)) for x in slices]
        found = (reduce(DataFrame.unionByName, kept).groupBy("key")
                 .agg(F.max("n").alias("n"), F.max("of").alias("of"), F.flatten(F.collect_list("places")).alias("places"),
                      F.flatten(F.collect_list("ids")).alias("ids")))
    hits = F.arrays_zip("places", "ids")
    hits = F.array_sort(hits) if len(slices) > 1 else hits
    unknown = lambda n: F.array_repeat(F.lit(UNK_ID).cast("long"), n.cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<bigint>").alias("ids"))

    def step(s: Column, p: Column) -> Column:
        back = p["places"] % max_piece
        at = ((p["places"] - back) / max_piece).cast("long")
        return F.when(at >= s["to"], F.struct((at + max_piece - back).alias("to"), F.concat(
            s["ids"], unknown(at - s["to"]), F.array(p["ids"])).alias("ids"))).otherwise(s)

    read = F.aggregate(hits, start, step, lambda s: F.struct(s["to"], s["ids"]))
    return found.select("key", "n", "of", read.alias("r")).select(
        "key", "n", F.concat("r.ids", unknown(F.col("of") - F.col("r.to"))).alias("ids"))


def _tasks(words: DataFrame) -> int:
    size = words.agg(F.sum(F.length("word"))).first()[0] or 0
    return max(1, min(MAX_TASKS, -(-size // TASK_CHARACTERS)))


def _common(readings: DataFrame) -> tuple[int, bool]:
    """The least occurrences of a word among the most frequent words that fit ``COMMON_BYTES``, and whether the
    others are few.  Words that occur once do not count as frequent."""
    cost = F.lit(128) + 2 * F.octet_length("key") + 8 * F.size("ids")
    level = F.floor(F.log2("n") * 16)  # under 1,000 rows come here
    levels = readings.groupBy(level.alias("level")).agg(F.min("n").alias("n"), F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("words"))
    least, free, words, cost = (1 << 63) - 1, COMMON_BYTES, 0, 0
    for r in sorted(levels.collect(), key=lambda r: -r["n"]):
        if r["n"] > 1 and not words and r["cost"] <= free:
            least, free = r["n"], free - r["cost"]
        else:
            words, cost = words + r["words"], cost + r["cost"]
    return least, words <= PIECES_BROADCAST_ROWS and cost <= COMMON_BYTES


def subword_sequence(corpus: DataFrame, vocab: DataFrame, id_col: str = "row_id", text_col: str = "text",
                     max_piece: int = MAX_PIECE, words: DataFrame | None = None) -> DataFrame:
    """(``id_col``, word_pos, piece_pos, token_id): BOS at word 0, the text's words from 1 on with their
    pieces in order, EOS after the last word.  Null and empty texts keep BOS and EOS.

    (word_pos, piece_pos) orders a text without regrouping its rows.  Each distinct word is read once: a word of
    the vocabulary is one piece, the others decompose.  The frequent words' readings go to every task, so
    that only the rare words of the texts are shuffled to meet theirs.  ``words``: the corpus' ``word_counts``
    if they are there already."""
    if words is None:
        words = reliable_checkpoint(word_counts(corpus, text_col, id_col))
    keyed = words.select(word_key("word").alias("key"), "word", "n")
    tokens_of = vocab.select(F.col("token").alias("word"), "token_id")
    known = keyed.join(tokens_of, "word").select("key", "n", F.array(F.col("token_id").cast("long")).alias("ids"))
    decomposed = decompose(keyed.join(tokens_of, "word", "left_anti").select("key", "word", "n"), vocab, max_piece, _tasks(words))
    readings = reliable_checkpoint(known.unionByName(decomposed))
    least, few = _common(readings)
    common = F.broadcast(readings.where(F.col("n") >= least).select("key", F.col("ids").alias("_common")))
    others = readings.where(F.col("n") < least).select("key", F.col("ids").alias("_other"))

    def out(rows: DataFrame, ids: Column) -> DataFrame:
        return (rows.select(id_col, F.col("word_pos").cast("long").alias("word_pos"), F.posexplode(ids).alias("piece_pos", "token_id"))
                .withColumn("piece_pos", F.col("piece_pos").cast("long")))

    texts = spread_if_small(corpus.select(id_col, text_col), key=id_col)
    none = F.array(F.lit(None).cast("string"))
    framed = F.concat(none, F.coalesce(tokens(text_col), F.array().cast("array<string>")), none)
    rows = texts.select(id_col, framed.alias("_t")).select(id_col, F.posexplode_outer("_t").alias("word_pos", "word"))
    rows = rows.select(id_col, "word_pos", word_key("word").alias("key")).join(common, "key", "left")
    frame = F.array(F.when(F.col("word_pos") == 0, F.lit(BOS_ID)).otherwise(F.lit(EOS_ID)).cast("long"))
    if few:  # the text's rows need no shuffle
        return out(rows.join(F.broadcast(others), "key", "left"), F.coalesce("_common", "_other", frame))
    frequent = out(rows.where(F.col("_common").isNotNull() | F.col("key").isNull()), F.coalesce("_common", frame))
    rare = texts.select(id_col, F.posexplode_outer(tokens(text_col)).alias("word_pos", "word")).where(F.col("word").isNotNull())
    rare = rare.select(id_col, (F.col("word_pos") + 1).alias("word_pos"), word_key("word").alias("key")).join(common, "key", "left_anti")
    return frequent.unionByName(out(rare.join(others, "key"), F.col("_other")))
