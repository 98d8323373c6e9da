"""Approximate retrieval jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from xmcforge.operators import ann as AN
from xmcforge.operators import retrieval as R
from xmcforge.plans import fixtures as fx
from xmcforge.plans import oracle_text as O
from xmcforge.plans.registry import job

K = 10
PROBES = 8


@job("ann_topk", oracle=O.topk_sql(K))
def ann_topk(t):
    """Inverted-file top-10, widened until each query's bound holds (so it equals J02)."""
    return AN.ann_topk(fx.queries(t), AN.build_cells(fx.labels(t)), K, PROBES)


@job("ann_topk_filtered", oracle=O.topk_sql(K, exclude_view="fx_filter", mode="before"))
def ann_topk_filtered(t):
    """J11 with filter pairs removed before ranking, in every probed cell."""
    return AN.ann_topk(fx.queries(t), AN.build_cells(fx.labels(t)), K, PROBES, exclude=fx.filter_pairs(t))


@job("ann_recall")
def ann_recall(t):
    """J11 without widening: recall of the exact top 10 after 8, 16 and all cells (rows only)."""
    index = AN.build_cells(fx.labels(t))
    exact = R.ova_topk(fx.queries(t), fx.labels(t), K)
    cells = index[1].count()
    out = None
    for p in (PROBES, 2 * PROBES, cells):
        row = AN.recall(AN.ann_topk(fx.queries(t), index, K, p, widen=False), exact).select(
            F.lit(min(p, cells)).cast("long").alias("probes"), F.lit(cells).cast("long").alias("cells"), "recall")
        out = row if out is None else out.unionByName(row)
    return out
