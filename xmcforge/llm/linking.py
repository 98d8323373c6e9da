"""Classes of rows linked by the Jaccard similarity of their word n-gram sets.

A caller gives a *tiling*: which keys (tiles) a set has, so that sets in reach of each other share
a tile.  What happens inside the tiles is the same for every tiling:

1. Equal sets are one node from the start.
2. Each node meets the smallest member of its tiles; hashed bitmaps bound the overlap from above and
   the most promising pair is decided exactly on sorted hash arrays.
3. Tiles that still hold several classes are compared in cells of bounded size, twice.  First by
   bitmap: a cell looks at every pair of its members of different classes, but emits only a spanning
   forest of what the bitmaps leave possible, most similar pairs first, and these are decided.
   Classes that refuted pairs connect form clusters; a node is in one cluster, however many tiles it
   has.  Then the cells of a cluster get the hash arrays themselves and decide every pair that the
   bitmaps leave possible; they emit a spanning forest of the links.
   So no link between classes is lost, and a group of any size emits about as many rows as members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmcforge.llm.common import SLICE_BYTES, discard, slices, words_of, worker_memory, written
from xmcforge.llm.components import components

# Members of a tile on each side of a cell; larger tiles are cut into blocks of about this many.
BLOCK = 1024
# n-grams of all members of a cell; cells of longer sets are cut further.
CELL_GRAMS = 1 << 22
# Bytes of bitmaps that one vectorised comparison holds at once.
COMPARE_BYTES = 8 << 20
CELL = ["tile", "mi", "aj", "sub"]


def mixed(h):
    """A bijective scramble of 64-bit numbers (array of uint64)."""
    import numpy as np
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngram_sets(text, n: int):
    """Sorted distinct n-gram hashes of an Arrow string array: (hashes, offsets per row).

    Words are split at ASCII white space after lower-casing A-Z; a text of fewer than ``n`` words
    is one n-gram; a null or wordless text has none."""
    import numpy as np
    import pyarrow.compute as pc
    import xxhash
    flat, offsets = words_of(pc.ascii_lower(pc.fill_null(text, "")))
    coded = flat.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = each[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.uint64)
    rows = len(offsets) - 1
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(rows), counts)
    place = np.arange(len(words)) - offsets[owner] if len(words) else np.zeros(0, np.int64)
    h = np.zeros(len(words), np.uint64)
    for k in range(n):  # word k of the n-gram, absent beyond the end of a short text
        inside = place + k < counts[owner]
        shifted = np.zeros(len(words), np.uint64)
        shifted[:max(0, len(words) - k)] = words[k:]
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, shifted + np.uint64(1), np.uint64(0)))
    begins = (place + n <= counts[owner]) | ((place == 0) & (counts[owner] < n))
    h, owner = h[begins], owner[begins]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int64)


def _sums(values, offsets):
    import numpy as np
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def signatures(docs: DataFrame, n: int, tiling) -> DataFrame:
    """(id, size, s1, s2, bits, tiles) of ``docs`` (id, text): set size, set digest, bitmap and the
    keys of the set's tiles.

    ``tiling.width(size)`` is the bitmap's width in bits (a power of two from 64), and
    ``tiling.tiles(hashes, offsets)`` gives the flat keys (int64) and their offsets per row."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        worker_memory("linking")  # earlier stages' dictionaries go
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, offsets = ngram_sets(part.column("text"), n)
                sizes = np.diff(offsets)
                s1, s2 = (_sums(mixed(h ^ np.uint64(0x632BE59BD9B4E019 * salt % (1 << 64))), offsets) for salt in (1, 2))
                bitmaps = []
                for i, size in enumerate(sizes.tolist()):
                    width = tiling.width(size) if size else 0
                    bit = np.zeros(width, bool)
                    bit[(h[offsets[i]:offsets[i + 1]] & np.uint64(max(width, 1) - 1)).astype(np.int64)] = True
                    bitmaps.append(np.packbits(bit, bitorder="little").tobytes())
                keys, ends = tiling.tiles(h, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                     pa.array(bitmaps, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))],
                    names=["id", "size", "s1", "s2", "bits", "tiles"])

    return docs.mapInArrow(run, "id long, size long, s1 long, s2 long, bits binary, tiles array<long>")


def least_common(a, b, percent: int):
    """The smallest overlap with which sets of ``a`` and ``b`` n-grams are similar."""
    return -(-percent * (a + b) // (100 + percent))


def fold(bits, width: int):
    """A bitmap (rows of uint64 words) folded to ``width`` words."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def most_common(bits_a, size_a, bits_b, size_b):
    """An upper bound of the overlap of rows (broadcast): n-grams whose bit the other set lacks are
    not shared."""
    import numpy as np
    width = min(bits_a.shape[-1], bits_b.shape[-1])
    a, b = fold(bits_a, width), fold(bits_b, width)
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(size_a - only_a, size_b - only_b)


def may_link(bits_a, size_a, bits_b, size_b, percent: int):
    """Which rows (broadcast) the upper bound leaves possible."""
    return most_common(bits_a, size_a, bits_b, size_b) >= least_common(size_a, size_b, percent)


def bounded_pairs(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that the bitmaps of ``marks`` (node, size, bits) leave possible, with the
    similarity that they bound (likely)."""
    def side(x):
        return marks.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            keep, likely = [], []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "bitsa", "bitsb"))):
                if 100 * min(na, nb) < percent * max(na, nb):
                    keep.append(False)
                    continue
                common = int(most_common(np.frombuffer(x, "<u8")[None, :], na, np.frombuffer(y, "<u8")[None, :], nb)[0])
                keep.append(common >= least_common(na, nb, percent))
                if keep[-1]:
                    likely.append(common / (na + nb - common))
            some = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(likely, pa.float64())], names=["a", "b", "likely"])

    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
            .mapInArrow(run, "a long, b long, likely double"))


def gram_arrays(texts: DataFrame, n: int) -> DataFrame:
    """(node, grams) of ``texts`` (id, text): the sorted hash array of each whole text as bytes."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, offsets = ngram_sets(part.column("text"), n)
                data = h.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([data[8 * a:8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())],
                    names=["node", "grams"])

    return texts.select("id", "text").mapInArrow(run, "node long, grams binary")


def decided(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, ok) of the ``pairs`` (a, b), a written table: whether the sets are similar, by
    intersection of the sorted hash arrays of their whole texts in ``docs`` (id, text).  An id with
    several texts is similar when one of them is."""
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    grams = written(gram_arrays(docs.join(nodes, "id", "left_semi"), n), "grams")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ga"), batch.column("gb")):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two ascending runs
                common = int((both[1:] == both[:-1]).sum())
                ok.append(0 < common and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    both = (pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
            .join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b"))
    out = written(both.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long, ok boolean")
                  .groupBy("a", "b").agg(F.max("ok").alias("ok")), "decided")
    discard(grams)
    return out


def tile_cells(members: DataFrame, labels: DataFrame, marks: DataFrame, block: int = BLOCK, grams: int = CELL_GRAMS) -> DataFrame:
    """(tile, mi, aj, sub, node, flag, minor): the cells in which the tiles of ``members`` (tile, node,
    n) that hold several ``labels`` (node, label) are compared.

    In a tile the members of its largest class are the major ones; two of them never need a
    comparison.  Every pair of a minor member x and a member y is in the cell of x's block among the
    minor members (flag 1) and y's block among all (flag 2).  Cells of more than ``grams`` n-grams
    (by the sizes of ``marks``) are cut into s * s parts ``sub`` in the same way.  Tiles with the same
    members are compared once."""
    named = members.join(labels, "node", "left").select("tile", "node", "n", F.coalesce("label", "node").alias("label"))
    by_label = named.groupBy("tile", "label").agg(
        F.count(F.lit(1)).alias("_c"), F.min("node").alias("_a"), F.max("node").alias("_b"), F.max("n").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y"))
    tiles = (by_label.groupBy("tile").agg(
        F.sum("_c").alias("_n"), F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.max("n").alias("n"), F.bit_xor("_x").alias("_x"),
        F.bit_xor("_y").alias("_y"), F.max(F.struct("_c", "label")).alias("_top"), F.count(F.lit(1)).alias("_labels"))
        .where("_labels > 1")
        .groupBy("_a", "_b", "_n", "_x", "_y").agg(F.min(F.struct("tile", "n", "_top")).alias("t"))
        .select("t.tile", F.ceil(F.col("t.n") / F.lit(block)).cast("int").alias("_all"), F.col("t._top.label").alias("_top"),
                F.ceil((F.col("_n") - F.col("t._top._c")) / F.lit(block)).cast("int").alias("_minor")))
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / F.lit(block))).cast("int")
    # joined by tile and block, so that a tile of any size is dealt over many tasks
    dealt = named.withColumn("_own", own).join(
        tiles.withColumn("_own", F.explode(F.sequence(F.lit(0), F.col("_all") - 1))), ["tile", "_own"])
    dealt = (dealt.withColumn("minor", F.col("label") != F.col("_top"))
             .withColumn("_mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_minor").cast("long")).cast("int")))
    as_minor = F.transform(F.sequence(F.lit(0), F.col("_all") - 1), lambda j: F.struct(
        F.col("_mine").alias("mi"), j.alias("aj"), F.when(j == F.col("_own"), 3).otherwise(1).alias("flag")))
    as_any = F.transform(F.sequence(F.lit(0), F.col("_minor") - 1), lambda i: F.struct(
        i.alias("mi"), F.col("_own").alias("aj"), F.lit(2).alias("flag")))
    cells = F.when(F.col("minor"), F.concat(as_minor, F.filter(as_any, lambda c: c["mi"] != F.col("_mine")))).otherwise(as_any)
    cells = written(dealt.select("tile", "node", "minor", F.explode(cells).alias("c")).select("tile", "c.mi", "c.aj", "node", "c.flag", "minor"), "cells")
    sizes = marks.groupBy("node").agg(F.sum("size").alias("_size"))
    heavy = (cells.join(sizes, "node").groupBy("tile", "mi", "aj").agg(F.sum("_size").alias("_sum")).where(F.col("_sum") > grams)
             .select("tile", "mi", "aj", F.ceil(F.col("_sum") / F.lit(grams)).cast("int").alias("_cut")))
    cells = cells.join(heavy, ["tile", "mi", "aj"], "left").withColumn("_cut", F.coalesce("_cut", F.lit(1)))
    part = F.pmod(F.xxhash64("node", F.lit(9)), F.col("_cut").cast("long")).cast("int")
    subs = F.transform(F.sequence(F.lit(0), F.col("_cut") - 1), lambda k: F.struct(  # x's part times _cut plus y's part
        (part * F.col("_cut") + k).alias("as_x"), (k * F.col("_cut") + part).alias("as_y")))
    subs = F.flatten(F.transform(subs, lambda s: F.when(s["as_x"] == s["as_y"], F.array(
        F.struct(s["as_x"].alias("sub"), F.col("flag").alias("flag")))).otherwise(F.array(
            F.struct(s["as_x"].alias("sub"), F.col("flag").bitwiseAND(F.lit(1)).alias("flag")),
            F.struct(s["as_y"].alias("sub"), F.col("flag").bitwiseAND(F.lit(2)).alias("flag"))))))
    return cells.select("tile", "mi", "aj", "node", "minor", F.explode(subs).alias("c")).select(
        "tile", "mi", "aj", "c.sub", "node", "c.flag", "minor").where("flag > 0")


def exact_common(arrays, p, q):
    """The overlaps of the sorted hash ``arrays`` p[k] and q[k]: the hashes that several arrays hold
    are numbered, and each array's numbers are bits, a stretch of them at a time."""
    import numpy as np
    owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    _, place, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    several = counts[place] > 1
    owner, place = owner[several], number[place[several]]
    common, stretch = np.zeros(len(p), np.int64), 1 << 12
    order = np.argsort(place // stretch, kind="stable")
    owner, place = owner[order], place[order]
    edges = np.searchsorted(place // stretch, np.arange(0, (int(number[-1]) if len(number) else -1) // stretch + 2))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if a == b:
            continue
        here = place[a:b] % stretch
        width = -(-(int(here.max()) + 1) // 64) * 64
        bits = np.zeros((len(arrays), width), bool)
        bits[owner[a:b], here] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, COMPARE_BYTES // (width // 8))
        for at in range(0, len(p), step):
            common[at:at + step] += np.bitwise_count(bits[p[at:at + step]] & bits[q[at:at + step]]).sum(axis=1, dtype=np.int64)
    return common


def forest(members, percent: int, exact: bool):
    """Pairs (a < b) of one cell's ``members`` (node, label, size, data, flag, minor): a spanning
    forest over the labels, the most similar pairs first.  ``data`` are bitmaps, and pairs count that
    these leave possible; or, with ``exact``, sorted hash arrays, and pairs count that are similar."""
    import numpy as np
    node, label, size, flag = (np.array([m[k] for m in members], np.int64) for k in (0, 1, 2, 4))
    minor = np.array([m[5] for m in members], bool)
    if len(node) < 2 or label.min() == label.max():
        return []
    if exact:
        arrays = [np.frombuffer(m[3], "<u8") for m in members]
        width = max(64, 1 << (4 * int(size.min()) - 1).bit_length())
        bits = np.zeros((len(arrays), width // 8), np.uint8)
        for row, array in zip(bits, arrays):
            bit = np.zeros(width, bool)
            bit[(array & np.uint64(width - 1)).astype(np.int64)] = True
            row[:] = np.packbits(bit, bitorder="little")
        bits = bits.view("<u8")
    else:
        words = min(len(m[3]) for m in members) // 8
        bits = np.concatenate([fold(np.frombuffer(m[3], "<u8")[None, :], words) for m in members])
    xs, ys = np.flatnonzero(flag & 1), np.flatnonzero(flag & 2)
    found = []
    rows = max(1, COMPARE_BYTES // (8 * max(1, len(ys))))
    step = max(1, COMPARE_BYTES // (8 * bits.shape[1]))
    for start in range(0, len(xs), rows):
        x = xs[start:start + rows, None]
        ok = ((label[x] != label[ys]) & (~minor[ys] | (node[x] < node[ys]))
              & (100 * np.minimum(size[x], size[ys]) >= percent * np.maximum(size[x], size[ys])))
        i, j = np.nonzero(ok)
        i, j = x[i, 0], ys[j]
        for at in range(0, len(i), step):
            p, q = i[at:at + step], j[at:at + step]
            common = most_common(bits[p], size[p], bits[q], size[q])
            keep = common >= least_common(size[p], size[q], percent)
            found.append((p[keep], q[keep], common[keep]))
    if not found:
        return []
    i, j, common = (np.concatenate([f[k] for f in found]) for k in range(3))
    if exact and len(i):
        common = exact_common(arrays, i, j)
        keep = common >= least_common(size[i], size[j], percent)
        i, j, common = i[keep], j[keep], common[keep]
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    order = np.lexsort((b, a, -common / (size[i] + size[j] - common)))
    a, b, i, j = a[order], b[order], i[order], j[order]
    _, named = np.unique(label, return_inverse=True)
    classes = int(named.max()) + 1
    low, high = np.minimum(named[i], named[j]), np.maximum(named[i], named[j])
    root, out = list(range(classes)), []

    def top(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    first = np.sort(np.unique(low * classes + high, return_index=True)[1])  # the best pair of each two classes
    for k, x, y in zip(first.tolist(), low[first].tolist(), high[first].tolist()):
        x, y = top(x), top(y)
        if x != y:
            root[y] = x
            out.append((int(a[k]), int(b[k])))
    return out


def cell_pairs(cells: DataFrame, labels: DataFrame, data: DataFrame, percent: int, exact: bool) -> DataFrame:
    """(tile, mi, aj, sub, a, b): the forests of the ``cells`` (see ``forest``), with the ``data``
    (node, size, data) of their members."""
    rows = (cells.join(labels, "node", "left").join(data, "node")
            .select(*CELL, "node", F.coalesce("label", "node").alias("label"), "size", "data", "flag", "minor"))

    def run(batches):
        import pyarrow as pa
        worker_memory("linking")
        key, held = None, []

        def flush():
            pairs = forest(held, percent, exact)
            cols = [[k] * len(pairs) for k in key] + [[p[s] for p in pairs] for s in (0, 1)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*CELL, "a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*CELL, "node", "label", "size", "data", "flag", "minor")]
            for t, mi, aj, sub, *member in zip(*cols):
                if (t, mi, aj, sub) != key:
                    if held:
                        yield flush()
                    key, held = (t, mi, aj, sub), []
                held.append(member)
        if held:
            yield flush()

    return (rows.repartition(*CELL).sortWithinPartitions(*CELL)
            .mapInArrow(run, "tile long, mi int, aj int, sub int, a long, b long"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the classes that ``links`` (a, b) join are one."""
    def of(x):
        return links.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left")

    edges = of("a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    edges = written(edges.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct(), "edges")
    roots = components(edges)
    old = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select(
        "node", F.coalesce("root", "label").alias("label"))
    new = roots.join(labels.select("node"), "node", "left_anti")  # classes of one node so far
    out = written(old.unionByName(new), "labels")
    discard(edges)
    return out


def settled(members: DataFrame, marks: DataFrame, labels: DataFrame, docs: DataFrame, n: int, percent: int,
            block: int = BLOCK, grams: int = CELL_GRAMS) -> DataFrame:
    """``labels`` (node, label) once no tile of ``members`` holds a link between two classes."""
    cells = written(tile_cells(members, labels, marks, block, grams), "cells")
    pairs = written(cell_pairs(cells, labels, marks.withColumnRenamed("bits", "data"), percent, False), "pairs")
    asked = written(pairs.select("a", "b").distinct(), "asked")
    verdicts = decided(asked, docs, n, percent)
    labels = merged(labels, verdicts.where("ok").select("a", "b"))
    # classes that a refuted pair connects are a cluster: two classes with a link are in the same one,
    # as the forest of the cell that saw the link connects them
    edges = written(verdicts.where("not ok").join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
                    .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
                    .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct(), "edges")
    clusters = components(edges).select(F.col("node").alias("label"), F.col("label").alias("tile"))
    inside = labels.join(clusters, "label").select("tile", "node")
    inside = written(inside.unionByName(clusters.join(labels.select("label").distinct(), "label", "left_anti").select("tile", F.col("label").alias("node"))), "inside")
    sized = inside.join(inside.groupBy("tile").agg(F.count(F.lit(1)).alias("n")), "tile")
    rest = written(tile_cells(sized, labels, marks, block, grams), "cells")
    arrays = written(gram_arrays(docs.join(rest.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), n), "grams")
    arrays_data = arrays.select("node", F.expr("length(grams) div 8").alias("size"), F.col("grams").alias("data"))
    links = written(cell_pairs(rest, labels, arrays_data, percent, True).select("a", "b").distinct(), "links")
    labels = merged(labels, links)
    discard(cells, pairs, asked, verdicts, edges, inside, rest, arrays, links)
    return labels


def linked_classes(docs: DataFrame, n: int, percent: int, tiling, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its n-gram set and the smallest id
    that links of at least ``percent`` % Jaccard similarity reach, among sets that share a tile.

    Null and wordless texts have the empty set and stand alone.  Rows with a null id are not linked
    (component null).  Rows that repeat an id are one node with several sets.  Only ``id_col`` and
    ``text_col`` are read; an empty table gives none.  Every link decides exactly; none is capped."""
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    sets = written(signatures(docs, n, tiling).withColumn("row", F.monotonically_increasing_id()), "sets")
    digest = ["s1", "s2", "size"]
    keys = sets.where("size > 0 and id is not null").groupBy(*digest).agg(F.min(F.struct("id", "row")).alias("x"))
    keys = written(keys.select(*digest, F.col("x.id").alias("node"), "x.row"), "keys")
    rows = written(sets.select("id", *digest).join(keys.drop("row"), digest, "left").select("id", "size", "node"), "rows")
    nodes = written(sets.join(keys.select("row", "node"), "row").select("node", "size", "bits", "tiles"), "nodes")
    discard(sets, keys)
    # dealt by tile once: the count and the join below both read this exchange
    tiles = nodes.select("node", F.explode("tiles").alias("tile")).repartition("tile")
    shared = (tiles.groupBy("tile").agg(F.min("node").alias("pivot"), F.max("node").alias("_last"), F.count(F.lit(1)).alias("n"))
              .where("pivot < _last").drop("_last"))
    members = written(tiles.join(shared, "tile").dropDuplicates(["tile", "node"]).select("tile", "node", "pivot", "n"), "members")
    marks = written(nodes.select("node", "size", "bits").join(members.select("node").distinct(), "node", "left_semi"), "marks")
    discard(nodes)
    # first each node against the most similar one of its tiles' smallest members
    star = bounded_pairs(members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), marks, percent)
    star = written(star.groupBy("a").agg(F.max(F.struct("likely", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b")), "star")
    verdicts = decided(star, docs, n, percent)
    labels = components(verdicts.where("ok"))
    # then what the tiles still hold of different classes
    labels = settled(members, marks, labels, docs, n, percent)
    # an id with several sets links their nodes
    several = rows.where("id is not null and node is not null").groupBy("id").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi")
    several = written(rows.join(several.select("id"), "id", "left_semi").where("node is not null").select(F.col("id").alias("a"), F.col("node").alias("b")), "several")
    if several.limit(1).count():
        labels = merged(labels, several)
    discard(members, marks, star, verdicts, several)
    return (rows.join(labels, "node", "left")
            .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("label", "node", "id")).alias("component_id")))
