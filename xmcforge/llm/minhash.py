"""Near-duplicate classes by MinHash with tensored banding; candidates are verified exactly.

A table of locality-sensitive hashing asks that a whole tuple of minhashes agrees.  Instead of
drawing a tuple for each of ``m * m`` tables, two small collections of ``m`` tuples of ``k``
minhashes are drawn, and the key of table (i, j) combines tuple i of the first and tuple j of the
second collection: 2 k m minhashes of a set serve m * m tables of 2 k minhashes each.

Two sets of similarity s meet in a table unless one collection has no tuple in which they agree, so
they miss each other with a probability of at most 2 (1 - s^k)^m: with the defaults (k = 3, m = 12)
2.2e-5 at s = 0.85 and below 1e-8 from 0.92 on, while sets of similarity 0.1 meet in 1.4e-4 of the
cases.  Whatever meets is verified on full n-gram sets (``linking``), so no wrong link remains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmcforge.llm.common import table
from xmcforge.llm.linking import linked_classes, mixed
from xmcforge.llm.registry import query

TUPLE = 3
TUPLES = 12
# n-grams whose minhashes are taken in one vectorised step
STEP = 1 << 16


class TensoredTables:
    """The table keys of n-gram sets: all pairs of the two collections' tuples."""

    def __init__(self, k: int = TUPLE, m: int = TUPLES, seed: int = 11):
        import random
        rnd = random.Random(seed)
        self.k, self.m = k, m
        self.salts = [(rnd.getrandbits(64), rnd.getrandbits(64) | 1) for _ in range(2 * k * m)]

    def miss(self, similarity: float) -> float:
        """The probability that two sets of this similarity share no table."""
        one = (1 - similarity ** self.k) ** self.m
        return 1 - (1 - one) ** 2

    def width(self, size: int) -> int:
        """Bitmap width, a power of two of four to eight times the set's size."""
        return max(64, 1 << (4 * size - 1).bit_length())

    def minhashes(self, h, offsets):
        """(rows, 2 k m) smallest salted hashes of the sets ``h`` (offsets per row, none empty)."""
        import numpy as np
        out = np.empty((len(offsets) - 1, len(self.salts)), np.uint64)
        start = 0
        while start < len(offsets) - 1:  # as many whole sets as fit a step, one at least
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + STEP, side="right")) - 1)
            part, begins = h[offsets[start]:offsets[stop]], offsets[start:stop] - offsets[start]
            for i, (salt, odd) in enumerate(self.salts):
                v = (part ^ np.uint64(salt)) * np.uint64(odd)
                v ^= v >> np.uint64(32)
                v *= np.uint64(0x9E3779B97F4A7C15)
                out[start:stop, i] = np.minimum.reduceat(v, begins)
            start = stop
        return out

    def tiles(self, h, offsets):
        """(flat keys, offsets per row): m * m keys of each set that is not empty."""
        import numpy as np
        sizes = np.diff(offsets)
        some = sizes > 0
        ends = np.concatenate([[0], np.cumsum(np.where(some, self.m * self.m, 0))])
        if not some.any():
            return np.zeros(0, np.int64), ends
        low = self.minhashes(h, np.concatenate([offsets[:-1][some], offsets[-1:]])).reshape(-1, 2, self.m, self.k)
        tuples = np.zeros(low.shape[:3], np.uint64)
        for i in range(self.k):
            tuples = mixed(tuples * np.uint64(0x9E3779B97F4A7C15) + low[..., i])
        place = np.arange(self.m * self.m, dtype=np.uint64).reshape(self.m, self.m)
        keys = mixed(tuples[:, 0, :, None] + mixed(tuples[:, 1, None, :] + place))
        return keys.reshape(-1).view(np.int64), ends


def minhash_classes(docs: DataFrame, n: int = 5, percent: int = 80, tables: TensoredTables | None = None,
                    text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: its set size, the smallest id that links of
    at least ``percent`` % Jaccard similarity between candidates reach, and whether it is that id.

    Null and wordless texts have the empty set and stand alone.  Rows with a null id are not linked
    (component and kept null).  Rows that repeat an id are one node with several sets.  Texts are
    read whole; only ``id_col`` and ``text_col`` are read, so further columns of any name do no
    harm; an empty table gives none.  Similarities far below 0.8 need more or shorter tuples."""
    out = linked_classes(docs, n, percent, tables or TensoredTables(), text_col, id_col)
    return out.withColumn("kept", F.col("component_id") == F.col(f"`{id_col}`"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
                        GROUP BY x.doc_id, y.doc_id) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, t.component_id, t.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) t ON t.a = d.doc_id
"""


@query("op11_minhash", OP11_SQL)
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 5-word shingles at a Jaccard similarity of at least 0.85."""
    return minhash_classes(table(spark, sf_dir, "documents"), 5, 85)
