"""Packing token sequences by vector bin packing.

Every example has a demand vector (tokens, segments, loss-bearing tokens) and every sequence the
same limits.  A sequence is filled greedily: among the examples that fit on every dimension, the one
whose demand has the largest dot product with what is left of the sequence goes in next.  Examples
are dealt evenly into groups of bounded size, each packed in one task, so packing never sees the
whole corpus; only narrow rows (no ids, no text) are shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmcforge.llm.common import free_name, slices, table, worker_memory, written
from xmcforge.llm.registry import query

GROUP_ROWS = 4000
# White space of the tokenizer's pre-tokens.  A text is cut before white space that follows another
# character: its pre-tokens end there, and no special string holds white space.
SPACE = "\t-\r \x85\xa0  -     　"
BLANKS = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
JOINED_UNITS = 512     # units encoded as one text
CACHE_UNITS = 800_000  # encoded units remembered per Python worker
CALL_CHARS = 1 << 20
PIECE_SLICE = 12 << 20  # text bytes encoded at once: more texts share a distinct unit


def text_units(text):
    """(distinct units, unit numbers of all texts in order, offsets per row) of an Arrow string array.

    Where every space of a text stands between two other characters, units are cut before spaces
    (vectorised); other texts are cut before each run of white space."""
    import re
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    text = pc.fill_null(text, "")
    odd = np.asarray(pc.match_substring_regex(text, f"^ | $|[{SPACE}] | [{SPACE}]"))
    lists = pc.split_pattern(pc.if_else(pa.array(odd), "", text), " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    code = 2 * np.asarray(coded.indices, dtype=np.int64) + 1  # odd: the unit starts with the space
    code[offsets[:-1]] -= 1
    names = coded.dictionary.to_pylist()
    used = np.zeros(2 * len(names), bool)
    used[code] = True
    used = np.flatnonzero(used)
    place = np.empty(2 * len(names), np.int64)
    place[used] = np.arange(len(used))
    units = [" " + names[c >> 1] if c & 1 else names[c >> 1] for c in used.tolist()]
    code = place[code]
    if odd.any():
        runs = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        number = {u: i for i, u in enumerate(units)}
        parts, sizes = [], np.diff(offsets)
        for i in range(len(odd)):
            if odd[i]:
                cut = [number.setdefault(u, len(number)) for u in runs.findall(text[i].as_py())]
                parts.append(np.array(cut, np.int64))
                sizes[i] = len(cut)
            else:
                parts.append(code[offsets[i]:offsets[i + 1]])
        code, units = np.concatenate(parts), list(number)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    return units, code, offsets


def token_bytes(tok):
    """How many bytes of text each id of a byte-level vocabulary stands for: a character of an entry
    is one byte."""
    import numpy as np
    return np.array([len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size(with_added_tokens=True))], np.int64)


def unit_ids(tok, lens, units: list[str]) -> list[bytes]:
    """The ids (uint32 bytes) of each unit, without added special tokens.

    Units of a space and a visible run are encoded many at a time in one text, whose pre-tokens end
    where a unit does, and cut where their bytes end; the others are encoded alone."""
    import numpy as np
    out: list = [None] * len(units)
    alone, joined = [], []
    for i, u in enumerate(units):
        (joined if len(u) > 1 and u[0] == " " and u[1] not in BLANKS and u[-1] not in BLANKS else alone).append(i)
    groups = [joined[i:i + JOINED_UNITS] for i in range(0, len(joined), JOINED_UNITS)]
    for group, e in zip(groups, tok.encode_batch_fast(["".join([units[i] for i in g]) for g in groups], add_special_tokens=False)):
        ids = np.array(e.ids, np.uint32)
        ends = np.cumsum(lens[ids])
        want = np.cumsum([len(units[i]) if units[i].isascii() else len(units[i].encode()) for i in group])
        at = np.searchsorted(ends, want)
        if ends[-1] != want[-1] or (ends[at] != want).any():
            alone += group
            continue
        blob, cuts = ids.tobytes(), [0, *(4 * at + 4).tolist()]
        for i, a, b in zip(group, cuts, cuts[1:]):
            out[i] = blob[a:b]
    for i, e in zip(alone, tok.encode_batch_fast([units[i] for i in alone], add_special_tokens=False)):
        out[i] = array("I", e.ids).tobytes()
    return out


def token_pieces(df: DataFrame, model_path: str, length: int, text_col: str = "text", id_col: str = "doc_id",
                 end_id: int = 1, slice_bytes: int = PIECE_SLICE) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each text's ids, then ``end_id``, cut every
    ``length`` ids.

    Null and empty texts are the one id ``end_id``.  Repeated rows are cut like any other.  Only
    ``id_col`` and ``text_col`` are read.  No shuffle; ids do not leave the task."""
    docs = df.select(df[f"`{id_col}`"].alias(id_col), df[f"`{text_col}`"].alias("_text"))
    schema = T.StructType([docs.schema[0]] + [T.StructField(n, T.LongType()) for n in
                                              ("start", "length", "ids_crc32", "doc_tokens")])

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import zlib
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(model_path)
        known = worker_memory(f"ids {model_path}")

        lens = token_bytes(tok)

        def learn(missing: list[str]) -> None:
            while missing:
                chars = np.cumsum([len(u) for u in missing[:1 << 16]])
                n = max(1, int(np.searchsorted(chars, CALL_CHARS)))
                known.update(zip(missing[:n], unit_ids(tok, lens, missing[:n])))
                missing = missing[n:]

        end = array("I", [end_id]).tobytes()
        step = 4 * length
        for batch in batches:
            for part in slices(batch, "_text", slice_bytes):
                units, code, ends = text_units(part.column("_text"))
                if len(known) + len(units) > CACHE_UNITS:
                    known.clear()
                learn([u for u in units if u not in known])
                each = [known[u] for u in units]
                size = np.fromiter(map(len, each), np.int64, len(each)) // 4
                blob = np.frombuffer(b"".join(each), "<u4")
                first = np.cumsum(size) - size
                taken = size[code]  # ids of each unit of the texts, in order
                at = np.cumsum(taken) - taken
                ids = blob[np.repeat(first[code] - at, taken) + np.arange(int(taken.sum()))]
                bounds = np.concatenate([[0], np.cumsum(taken)])[ends].tolist()
                rows, cols = [], ([], [], [], [])
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    text_ids = ids[a:b].tobytes() + end
                    for s in range(0, len(text_ids), step):
                        cut = text_ids[s:s + step]
                        rows.append(i)
                        for c, v in zip(cols, (s // 4, len(cut) // 4, zlib.crc32(cut), len(text_ids) // 4)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())),
                                                  *(pa.array(c, pa.int64()) for c in cols)], names=schema.names)

    return docs.mapInArrow(run, schema)


def fill_sequences(demand, limits):
    """Sequence number and place in it of each row of ``demand`` (rows x dimensions).

    Rows of equal demand are interchangeable and held as one class with a count.  A row that alone
    exceeds a limit gets a sequence of its own."""
    import numpy as np
    demand, limits = np.asarray(demand, np.int64), np.asarray(limits, np.int64)
    classes, member = np.unique(demand, axis=0, return_inverse=True)
    member = member.reshape(-1)
    by_class = np.argsort(member, kind="stable")
    count = np.bincount(member, minlength=len(classes))
    first = np.cumsum(count) - count
    sequence = np.empty(len(demand), np.int64)
    place = np.empty(len(demand), np.int64)
    n = 0
    for c in np.flatnonzero((classes > limits).any(axis=1)):
        rows = by_class[first[c]:first[c] + count[c]]
        sequence[rows], place[rows] = n + np.arange(len(rows)), 0
        n += len(rows)
        count[c] = 0
    # in an empty sequence the dot product ranks the classes once and for all
    ranked = np.argsort(-(classes @ (1.0 / limits)), kind="stable")
    live = np.flatnonzero(count)  # ascending in the first dimension, as the classes are
    heads = classes[live, 0]
    for opener in ranked:
        while count[opener]:
            left, at, c = limits.copy(), 0, opener
            fits = live
            while True:
                row = by_class[first[c]]
                first[c] += 1
                count[c] -= 1
                sequence[row], place[row] = n, at
                at += 1
                left -= classes[c]
                fits = fits[:np.searchsorted(heads if at == 1 else classes[fits, 0], left[0], side="right")]
                ok = count[fits] > 0
                for d in range(1, len(limits)):
                    ok &= classes[fits, d] <= left[d]
                fits = fits[ok]  # what does not fit now will not fit later
                if not len(fits):
                    break
                # demands and what is left count as shares of the limits
                c = fits[np.argmax(classes[fits] @ (left / limits / limits))]
            n += 1
            if (count[live] == 0).sum() * 8 >= len(live):
                live = live[count[live] > 0]
                heads = classes[live, 0]
    return sequence, place


def pack(examples: DataFrame, limits: Mapping[str, int], length_col: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to ``examples``.

    ``limits`` maps integer demand columns to what a sequence may hold of each; ``offset`` sums
    ``length_col`` over the examples before it in the sequence.  Null demands count as 0.  An example
    that exceeds a limit alone gets a sequence of its own.  ``examples`` must come from a written
    table.  Groups are dealt by row number, so repeated rows and hot keys spread evenly; an empty
    table gives no rows.  Columns named like the two new ones are replaced."""
    kept = examples.drop("sequence_id", "offset")
    groups = -(-kept.count() // group_rows)
    dims, names = list(limits), kept.columns
    tops = [int(limits[d]) for d in dims]
    schema = T.StructType(list(kept.schema.fields) + [T.StructField("sequence_id", T.LongType()),
                                                      T.StructField("offset", T.LongType())])
    group = free_name(names, "_group")
    dealt = kept.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, groups))))

    def run(key, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        col = lambda c: np.asarray(pc.fill_null(rows.column(c), 0).combine_chunks(), dtype=np.int64)
        sequence, place = fill_sequences(np.stack([col(d) for d in dims], axis=1), tops)
        lengths = col(length_col)
        order = np.lexsort((place, sequence))
        ends = np.cumsum(lengths[order])
        start = np.r_[True, sequence[order][1:] != sequence[order][:-1]]
        before = ends - lengths[order]
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(start, before, 0))
        sequence = sequence + (int(key[0].as_py()) << 32)
        return pa.Table.from_arrays([*(rows.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                                    names=[*names, "sequence_id", "offset"])

    return dealt.groupBy(group).applyInArrow(run, schema)


def pack_texts(df: DataFrame, model_path: str, length: int = 2048, max_segments: int = 16, max_loss: int | None = None,
               text_col: str = "text", id_col: str = "doc_id", end_id: int = 1) -> DataFrame:
    """Texts as pieces of at most ``length`` ids, packed into sequences under three limits: ids,
    pieces, and ids that bear loss (every id but a text's first, which nothing predicts; at most
    ``max_loss``, by default ``length``).  A piece above a limit has a sequence of its own."""
    pieces = token_pieces(df, model_path, length, text_col, id_col, end_id)
    pieces = written(pieces.withColumn("segments", F.lit(1).cast("long"))
                     .withColumn("loss_tokens", F.col("length") - (F.col("start") == 0).cast("long")), "pieces")
    return pack(pieces, {"length": length, "segments": max_segments, "loss_tokens": max_loss or length}, "length")


@query("op2_pack")
def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (byte_bpe_50k ids, then id 1) in sequences of at most 2048 ids."""
    import public_tokenizers
    out = pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
