"""Alignment of two tokenizers' tokens by byte offsets.

Both tokenizers split the same bytes (a space, then the text).  Where a token of A and a token of B
end together, the bytes are cut; the tokens between two cuts are a group, and every A token of a
group is linked with every B token of it.

Texts are cut into units before spaces that follow a visible character; neither tokenizer has a token
over such a place, so a distinct unit is encoded once and remembered.  The merge itself runs in
lockstep: one state vector of A and B pointers holds a lane for each stretch of a batch's documents
(a document is one or more stretches, cut at unit ends), each step advances the pointer whose token
ends first (both on a cut) in all lanes at once, emits the cuts and links, and drops finished lanes.

Corpus counts of linked id pairs come from one row per *chunk* of documents and distinct pair, not
per document: the counts a chunk needs are joined back to the chunk, and its documents look them up.
"""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmcforge.llm.common import slices, table, worker_memory, written
from xmcforge.llm.packing import SPACE, unit_ids
from xmcforge.llm.registry import query

SLICE = 2 << 20           # text bytes aligned at once
CHUNK_BYTES = 32 << 20    # text bytes of documents that look up their pair counts together
STRETCH_UNITS = 96        # units of a lane of the lockstep merge
CACHE_UNITS = 400_000     # encoded units remembered per Python worker
CALL_CHARS = 1 << 20
EACH_PAIR = 4096          # links of a group listed one by one; larger groups are counted by distinct ids
B_IDS = 1 << 15           # an id pair is a * B_IDS + b


def byte_decoder() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Encoders:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_decoder()
        entries = (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True)))
        self.bytes_a = [bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(pieces) > B_IDS or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the piece vocabulary has too many pieces, or pieces over the end of a word")
        self.len_a, self.len_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))

    def encode(self, units: list[str]):
        """(ids A, ids B, bytes equal) of each unit, ids as int32 bytes; a unit starts with a space."""
        import numpy as np
        ids = [unit_ids(self.a, self.len_a, units),
               [array("I", x).tobytes() for x in self.b.encode([u[1:] for u in units], num_threads=1)]]
        space = array("I", [self.space]).tobytes()
        ids[1] = [x or space for x in ids[1]]  # B sees an empty text in a lone space, but a space within a longer one
        raw = [u.encode() for u in units]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        same = True
        for part, spelled, lens in zip(ids, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b)):
            flat = np.frombuffer(b"".join(part), "<u4")
            upto = np.concatenate([[0], np.cumsum(lens[flat])])
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) // 4)
            same = same and bool((upto[ends] == np.cumsum(sizes)).all()) and b"".join([spelled[i] for i in flat.tolist()]) == b"".join(raw)
        if same:
            return zip(*ids, [True] * len(units))
        text = lambda x, spelled: b"".join([spelled[i] for i in array("I", x)])
        return zip(*ids, [text(x, self.bytes_a) == r == text(y, self.bytes_b) for x, y, r in zip(*ids, raw)])

    @property
    def space(self) -> int:
        return self.b.piece_to_id("▁")


def spaced_units(text):
    """(distinct units, unit numbers of all texts in order, offsets per row) of a space and each text:
    units start with a space that follows a visible character (or is the first)."""
    import re
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    odd = np.asarray(pc.match_substring_regex(text, f"^ | $|[{SPACE}] | [{SPACE}]"))
    lists = pc.split_pattern(pc.if_else(pa.array(odd), "", text), " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    code = np.asarray(coded.indices, dtype=np.int64)
    units = [" " + w for w in coded.dictionary.to_pylist()]
    if odd.any():
        before = re.compile(f"(?<=[^{SPACE}])(?= )")
        number = {u: i for i, u in enumerate(units)}
        parts, sizes = [], np.diff(offsets)
        for i in range(len(odd)):
            if odd[i]:
                cut = [number.setdefault(u, len(number)) for u in before.split(" " + text[i].as_py())]
                parts.append(np.array(cut, np.int64))
                sizes[i] = len(cut)
            else:
                parts.append(code[offsets[i]:offsets[i + 1]])
        code, units = np.concatenate(parts), list(number)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    return units, code, offsets


def lockstep(ends_a, ends_b, bounds_a, bounds_b):
    """Merge the byte ends of A and B tokens in all lanes at once.

    Lane k holds the tokens from ``bounds_a[k]`` to ``bounds_a[k + 1]`` of A and likewise of B; both
    end at the same byte.  Returns the groups in order of A: first and one-past-last tokens
    (a0, a1, b0, b1)."""
    import numpy as np
    a, b = bounds_a[:-1].copy(), bounds_b[:-1].copy()
    stop = bounds_a[1:]
    live = a < stop
    a, b, stop = a[live], b[live], stop[live]
    a0, b0 = a.copy(), b.copy()
    cuts = []
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        cut = end_a == end_b
        if cut.any():
            cuts.append((a0[cut], a[cut], b0[cut], b[cut]))
            a0, b0 = np.where(cut, a, a0), np.where(cut, b, b0)
            live = a < stop
            if not live.all():
                a, b, stop, a0, b0 = a[live], b[live], stop[live], a0[live], b0[live]
    if not cuts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    groups = [np.concatenate(c) for c in zip(*cuts)]
    order = np.argsort(groups[0], kind="stable")
    return tuple(g[order] for g in groups)


def group_links(ids_a, ids_b, a0, a1, b0, b1):
    """(group, id pair, number) of all links of the groups: every A token with every B token."""
    import numpy as np
    na, nb = a1 - a0, b1 - b0
    one = np.flatnonzero(na * nb <= EACH_PAIR)
    count = (na * nb)[one]
    group = np.repeat(one, count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    pair = ids_a[a0[group] + k // nb[group]] * B_IDS + ids_b[b0[group] + k % nb[group]]
    out = [(group, pair, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(na * nb > EACH_PAIR).tolist():
        x, nx = np.unique(ids_a[a0[g]:a1[g]], return_counts=True)
        y, ny = np.unique(ids_b[b0[g]:b1[g]], return_counts=True)
        pair = (x[:, None] * B_IDS + y).reshape(-1)
        out.append((np.full(len(pair), g), pair, (nx[:, None] * ny).reshape(-1)))
    return tuple(np.concatenate(c) for c in zip(*out))


def decimal_words(n: int):
    """The decimal digits of the numbers below ``n`` (7 digits at most), first digit in the lowest byte."""
    import numpy as np
    known = worker_memory("decimal words", small=True)
    if len(known.get("words", ())) < n:
        known["words"] = np.array([int.from_bytes(str(i).encode(), "little") for i in range(n)], np.uint64)
    return known["words"]


def spelled(ids_a, ids_b, a0, a1, b0, b1):
    """The groups as ``a1,a2|b1;a3|b2,b3;`` in one byte string, and the place after each group."""
    import numpy as np
    group = np.arange(len(a0))
    na, nb = a1 - a0, b1 - b0
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ga, gb = np.repeat(group, na), np.repeat(group, nb)
    ids[np.arange(len(ids_a)) + b0[ga]] = ids_a  # after the B tokens of earlier groups
    ids[np.arange(len(ids_b)) + a1[gb]] = ids_b  # after the A tokens up to this group
    mark[a1 + b0 - 1], mark[a1 + b1 - 1] = ord("|"), ord(";")
    # the decimal digits of an id are bytes of one 64-bit word, its mark comes after them, and bytes
    # that are still 0 are left out
    digits = 1 + (ids > 9).astype(np.uint64) + (ids > 99) + (ids > 999) + (ids > 9999) + (ids > 99999)
    words = decimal_words(int(ids.max()) + 1 if len(ids) else 1)[ids] | mark.astype(np.uint64) << digits * np.uint64(8)
    text = words.astype("<u8").view(np.uint8)
    text = text[text != 0]
    ends = np.cumsum(digits.astype(np.int64) + 1)
    after = a1 + b1 - 1
    return text.tobytes(), ends[after] if len(after) else after


def aligned(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", id_col: str = "doc_id",
            slice_bytes: int = SLICE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a row per document with
    its distinct linked id pairs (sorted, int32 bytes) and how often each is linked (int64 bytes),
    and, with a null n_a, a row per chunk with its pairs and how many of its documents link them."""
    docs = df.select(df[f"`{id_col}`"].alias("id"), df[f"`{text_col}`"].alias("text"))
    longs = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    schema = T.StructType([T.StructField("chunk", T.LongType()), docs.schema[0], *longs, T.StructField("groups_sha256", T.StringType()),
                           T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def run(batches):
        import hashlib
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        memory = worker_memory(f"aligned {path_a} {path_b}")
        if "encoders" not in memory:
            memory.update(encoders=Encoders(path_a, path_b), known={}, wrong=set())
        enc, known, wrong = memory["encoders"], memory["known"], memory["wrong"]

        def learn(missing):
            while missing:
                chars = np.cumsum([len(u) for u in missing[:1 << 14]])
                n = max(1, int(np.searchsorted(chars, CALL_CHARS)))
                for u, (a, b, equal) in zip(missing[:n], enc.encode(missing[:n])):
                    known[u] = (a, b)
                    if not equal:
                        wrong.add(u)
                missing = missing[n:]

        def tokens(units, code, side):
            """Ids of the units of ``code`` in order and the number of ids before each unit."""
            each = [known[u][side] for u in units]
            size = np.fromiter(map(len, each), np.int64, len(each)) // 4
            blob = np.frombuffer(b"".join(each), "<i4")
            first = np.cumsum(size) - size
            taken = size[code]
            ends = np.concatenate([[0], np.cumsum(taken)])
            return blob[np.repeat(first[code] - ends[:-1], taken) + np.arange(int(ends[-1]))].astype(np.int64), ends

        def one(part, chunk):
            text = pc.fill_null(part.column("text"), "")
            units, code, rows = spaced_units(text)
            if len(known) + len(units) > CACHE_UNITS:
                known.clear()
                wrong.clear()
            learn([u for u in units if u not in known])
            n = part.num_rows
            count = np.diff(rows)
            use = np.asarray(pc.binary_length(text)) > 0
            if wrong:
                bad = np.fromiter((u in wrong for u in units), bool, len(units))
                for i in np.flatnonzero(use & (np.bincount(np.repeat(np.arange(n), count), bad[code], n) > 0)).tolist():
                    ids = [[v for u in code[rows[i]:rows[i + 1]].tolist() for v in np.frombuffer(known[units[u]][s], "<i4").tolist()] for s in (0, 1)]
                    raw = (" " + text[i].as_py()).encode()
                    use[i] = raw == b"".join([enc.bytes_a[v] for v in ids[0]]) == b"".join([enc.bytes_b[v] for v in ids[1]])
            code = code[np.repeat(use, count)]
            rows = np.concatenate([[0], np.cumsum(np.where(use, count, 0))])
            (ids_a, upto_a), (ids_b, upto_b) = tokens(units, code, 0), tokens(units, code, 1)
            ends_a, ends_b = np.cumsum(enc.len_a[ids_a]), np.cumsum(enc.len_b[ids_b])
            lanes = np.unique(np.concatenate([np.arange(0, len(code), STRETCH_UNITS), rows]))  # cut at documents, too
            a0, a1, b0, b1 = lockstep(ends_a, ends_b, upto_a[lanes], upto_b[lanes])
            doc_of = np.searchsorted(upto_a[rows], a0, side="right") - 1  # an empty row has no tokens
            n_groups = np.bincount(doc_of, minlength=n)
            said, after = spelled(ids_a, ids_b, a0, a1, b0, b1)
            last = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
            sha = [hashlib.sha256(said[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(last, last[1:])]
            group, pair, times = group_links(ids_a, ids_b, a0, a1, b0, b1)
            key = doc_of[group] << 31 | pair
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            times = np.add.reduceat(times, new) if len(new) else times
            key = key[new]
            ends = np.concatenate([[0], np.cumsum(np.bincount(key >> 31, minlength=n))]).tolist()
            pairs = (key & (1 << 31) - 1).astype("<i4")
            blob_p, blob_t = pairs.tobytes(), times.astype("<i8").tobytes()
            n_links = np.zeros(n, np.int64)
            np.add.at(n_links, doc_of, (a1 - a0) * (b1 - b0))
            out = pa.RecordBatch.from_arrays(
                [pa.array([chunk] * n, pa.int64()), part.column("id"), pa.array(np.diff(upto_a[rows])), pa.array(np.diff(upto_b[rows])),
                 pa.array(n_groups), pa.array(n_links), pa.array(sha, pa.string()),
                 pa.array([blob_p[4 * x:4 * y] for x, y in zip(ends, ends[1:])], pa.binary()),
                 pa.array([blob_t[8 * x:8 * y] for x, y in zip(ends, ends[1:])], pa.binary())], names=schema.names)
            return out, np.unique(pairs, return_counts=True)

        def of_chunk(chunk, found, id_type):
            pairs = np.concatenate([p for p, _ in found])
            order = np.argsort(pairs, kind="stable")
            pairs, number = pairs[order], np.concatenate([c for _, c in found])[order]
            new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
            number = np.add.reduceat(number, new) if len(new) else number
            none = [pa.nulls(1, pa.int64()) for _ in longs]
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.nulls(1, id_type), *none, pa.nulls(1, pa.string()),
                 pa.array([pairs[new].tobytes()], pa.binary()), pa.array([number.astype("<i8").tobytes()], pa.binary())], names=schema.names)

        chunk, held, found, id_type = TaskContext.get().partitionId() << 24, 0, [], None
        for batch in batches:
            id_type = batch.column("id").type
            for part in slices(batch, "text", slice_bytes):
                out, pairs = one(part, chunk)
                yield out
                found.append(pairs)
                held += part.column("text").nbytes
                if held >= chunk_bytes:
                    yield of_chunk(chunk, found, id_type)
                    chunk, held, found = chunk + 1, 0, []
        if found:
            yield of_chunk(chunk, found, id_type)

    return docs.mapInArrow(run, schema)


def align(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", id_col: str = "doc_id", **sizes) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    The count of an id pair is the number of rows of ``df`` that hold it linked; ``n_best`` counts the
    row's links whose count is the highest of their A id in the table (ties included), ``count_sum``
    sums the counts over the row's links.  Texts that are null, empty or not restored by either
    tokenizer's token bytes have no tokens: zeros and ''.  Repeated rows and rows with a null id count
    like any other.  Whole texts are aligned; only ``id_col`` and ``text_col`` are read; an empty table
    gives none.  A task holds a slice of texts (a longer text alone) and the distinct pairs of a chunk."""
    rows = written(aligned(df, path_a, path_b, text_col, id_col, **sizes), "aligned")

    def listed(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for chunk, pairs, times in zip(*(batch.column(c) for c in ("chunk", "pairs", "times"))):
                pairs, times = np.frombuffer(pairs.as_buffer(), "<i4"), np.frombuffer(times.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk.as_py())), pa.array(pairs), pa.array(times)],
                                                 names=["chunk", "pair", "docs"])

    of_chunks = written(rows.where("n_a is null").select("chunk", "pairs", "times").mapInArrow(listed, "chunk long, pair int, docs long"), "pairs")
    counts = of_chunks.groupBy("pair").agg(F.sum("docs").alias("docs"))
    # an A id has at most B_IDS pairs
    tops = counts.groupBy(F.expr(f"pair div {B_IDS}").alias("a")).agg(F.max("docs").alias("top"))
    counts = written(counts.withColumn("a", F.expr(f"pair div {B_IDS}")).join(tops, "a")
                     .select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")), "counts")
    wanted = of_chunks.select("chunk", "pair").join(counts, "pair")
    kept = rows.where("n_a is not null")
    out = T.StructType([kept.schema["id"]] + [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
                       + [T.StructField("groups_sha256", T.StringType())])

    def look_up(docs, known):
        import numpy as np
        import pyarrow as pa
        order = np.argsort(np.asarray(known.column("pair")), kind="stable")
        names, number, best = (np.asarray(known.column(c))[order] for c in ("pair", "docs", "best"))
        n_best, total = [], []
        for pairs, times in zip(docs.column("pairs"), docs.column("times")):
            pairs, times = np.frombuffer(pairs.as_buffer(), "<i4"), np.frombuffer(times.as_buffer(), "<i8")
            at = np.searchsorted(names, pairs)
            n_best.append(int(times[best[at].astype(bool)].sum()))
            total.append(int((times * number[at]).sum()))
        kept = ["id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.Table.from_arrays([*(docs.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()),
                                     docs.column("groups_sha256")], names=out.names)

    return (kept.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(look_up, out)
            .select(F.col("id").alias(id_col), *out.names[1:]))


@query("op13_align")
def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the byte-level and the piece vocabulary."""
    import public_tokenizers
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
