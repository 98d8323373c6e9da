"""Near-duplicate join on word n-gram sets by exact Jaccard similarity.

Sets are compared only inside tiles.  A tile holds sets of one size band that also agree on one
part of their n-grams: the n-grams are dealt by hash into more parts than two similar sets of that
band can differ in, so similar sets agree on at least one part and share a tile.  In a tile, hashed
bitmap signatures bound the overlap from above by bit counts; pairs that pass are decided exactly on
sorted hash arrays (``linking``).
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession

from xmcforge.llm.common import table
from xmcforge.llm.linking import linked_classes, mixed
from xmcforge.llm.registry import query

MAX_SIZE = 1 << 40


class Bands:
    """Size bands for a similarity of at least ``percent`` / 100, and the parts used in each.

    Sets of similar size are in one band or in neighbouring ones; a set in reach of the next band's
    smallest size belongs to that band's tiles, too."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]
        while self.edges[-1] < MAX_SIZE:
            self.edges.append(math.floor(self.edges[-1] * 10000 / percent ** 2) + 1)
        self.spares: dict[int, int] = {}

    def of(self, size: int) -> int:
        return bisect_right(self.edges, size) - 1

    def joined(self, size: int) -> list[int]:
        band = self.of(size)
        return [band] + [band + 1] * (100 * size >= self.percent * self.edges[band + 1])

    def smallest(self, band: int) -> int:
        """The smallest set that belongs to the band's tiles."""
        return max(1, -(-self.percent * self.edges[band] // 100))

    def differ(self, band: int) -> int:
        """The most n-grams in which two similar sets of the band's tiles can differ."""
        return (100 - self.percent) * 2 * (self.edges[band + 1] - 1) // (100 + self.percent)

    def spare(self, band: int) -> int:
        """Parts beyond the necessary ones: empty parts that a set may have.

        Sets that agree on empty parts only have more than this many of them and must name them;
        such a name is shared by unrelated sets.  So this is what the band's smallest set (which
        leaves most parts empty) rarely exceeds: the mean of its empty parts and two standard
        deviations, with these spare parts counted in.  Below about 70 % no number suffices; then
        as many as the band's sets can differ in."""
        if band not in self.spares:
            need, size = self.differ(band) + 1, self.smallest(band)
            spare, step = 3, max(1, need // 64)
            while spare < need:
                parts = need + spare
                empty = math.exp(-size / parts)
                mean = parts * empty
                if spare >= mean + 2 * math.sqrt(max(0.0, mean * (1 - (1 + size / parts) * empty))):
                    break
                spare += step
            self.spares[band] = spare
        return self.spares[band]

    def parts(self, band: int) -> int:
        return self.differ(band) + 1 + self.spare(band)

    def width(self, size: int) -> int:
        """Bitmap width, a power of two of at least four times the smallest size of the set's band:
        few n-grams share a bit, so the bound is close to the true overlap."""
        return max(64, 1 << (4 * self.edges[self.of(size)] - 1).bit_length())

    def tiles(self, h, offsets):
        """(flat keys, offsets per row): one key for each part of each set's n-grams ``h``."""
        import numpy as np
        tagged, dealt = (mixed(h ^ np.uint64(0x632BE59BD9B4E019 * salt % (1 << 64))) for salt in (3, 4))
        keys, ends = [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            ends.append(ends[-1])
            for band in self.joined(b - a) if b > a else ():
                m = self.parts(band)
                where = (dealt[a:b] % np.uint64(m)).astype(np.int64)
                total = np.zeros(m, np.uint64)
                np.add.at(total, where, tagged[a:b])
                full = np.bincount(where, minlength=m) > 0
                if m - full.sum() > self.spare(band):
                    full[:] = True  # so many empty parts that they may be all two sets agree on
                names = np.flatnonzero(full).astype(np.uint64)
                keys.append(mixed(total[full] + mixed(names + np.uint64((band + 1) << 40))).view(np.int64))
                ends[-1] += len(keys[-1])
        return np.concatenate(keys) if keys else np.zeros(0, np.int64), np.array(ends, np.int64)


def near_duplicates(docs: DataFrame, n: int, percent: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its n-gram set and the smallest id
    that links of at least ``percent`` % Jaccard similarity reach.

    Null and wordless texts have the empty set and stand alone.  Rows with a null id are not linked
    (component null).  Rows that repeat an id are one node with several sets.  Only ``id_col`` and
    ``text_col`` are read; an empty table gives none.  Every link decides exactly; none is capped."""
    return linked_classes(docs, n, percent, Bands(percent), text_col, id_col)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
                        GROUP BY x.doc_id, y.doc_id) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, t.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) t ON t.a = d.doc_id
"""


@query("op7_ngram_join", OP7_SQL)
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 4-word shingles at a Jaccard similarity of at least 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85)
