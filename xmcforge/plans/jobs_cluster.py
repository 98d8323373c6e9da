"""Clustering jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from xmcforge.operators import cluster as CL
from xmcforge.plans import fixtures as fx
from xmcforge.plans.fixtures import NORM_SQL
from xmcforge.plans.registry import job

SEED = 0


def _u52(*parts: str) -> str:
    inner = " || ':' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"('0x' || substr(md5({inner}), 1, 13))::bigint"


def _split_sql(src: str, level: int) -> str:
    """One seeded split (1 round) of every node of ``src`` (item_id, node, v)."""
    return f"""
select item_id, node, v, cast(case when rk <= n // 2 then 0 else 1 end as bigint) as side from (
  select s.item_id, s.node, s.v, count(*) over (partition by s.node) as n,
         row_number() over (partition by s.node order by
           round(list_dot_product(s.v, c.c0) - list_dot_product(s.v, c.c1), 9) desc, s.item_id) as rk
  from ({src}) s join (
    select node, arg_min(v, struct_pack(h := h, i := item_id)) as c0, arg_max(v, struct_pack(h := h, i := item_id)) as c1
    from (select item_id, node, v, {_u52('item_id', SEED, level, 'node')} as h from ({src})) group by node) c
  on c.node = s.node)"""


BASE_SQL = "select item_id, 0::bigint as node, " + NORM_SQL + " as v from fx_cluster"
LEVEL1_SQL = f"select item_id, node * 2 + side as node, v from ({_split_sql(BASE_SQL, 0)})"


@job("balanced_split", oracle=f"select item_id, side from ({_split_sql(BASE_SQL, 0)})")
def balanced_split(t):
    """One balanced halving of all items by seeded centroid score difference."""
    items = fx.cluster_items(t).select("item_id", CL.root_node(),
                                       F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    from xmcforge.functions import vectors as V
    items = items.select("item_id", "node", V.l2_normalize("embedding").alias("v"))
    return CL.balanced_split(items, SEED, 0, rounds=1).select("item_id", "side")


@job("balanced_clusters", oracle=f"select item_id, node * 2 + side as cluster_id from ({_split_sql(LEVEL1_SQL, 1)})")
def balanced_clusters(t):
    """Depth-2 balanced 2-means (4 clusters of equal size +-1), one round per level."""
    return CL.balanced_clusters(fx.cluster_items(t), depth=2, seed=SEED, rounds=1)


N_HEAD = 100


@job("update_clusters", oracle=f"""
with f as (select l.label_id, coalesce(x.freq, 0.0) as freq from fx_label l
           left join (select label_id, count(*) as freq from fx_trn_xy group by label_id) x on x.label_id = l.label_id),
r as (select label_id, row_number() over (order by freq desc, label_id desc) as rk from f),
tail as (select item_id, embedding from fx_cluster where item_id in (select label_id from r where rk > {N_HEAD})),
base as ({BASE_SQL.replace("fx_cluster", "tail")}),
one as (select item_id, node * 2 + side as node, v from ({_split_sql("select * from base", 0)})),
two as (select item_id, node * 2 + side as cluster_id from ({_split_sql("select * from one", 1)}))
select label_id, cast({N_HEAD} - rk as bigint) as new_id from r where rk <= {N_HEAD}
union all select item_id, {N_HEAD} + cluster_id from two""")
def update_clusters(t):
    """W07 + C04: split labels by frequency, cluster the tail only, number head and clusters."""
    from xmcforge.operators import represent as RP
    from xmcforge.operators import sparse as SP
    freq = SP.label_frequency(fx.train_xy(t).select(F.col("trn_id").alias("doc_id"), "label_id", F.lit(1.0).alias("value")),
                              fx.labels(t).select("label_id"))
    return RP.update_clusters(freq, fx.labels(t), N_HEAD, depth=2, seed=SEED, rounds=1)


REFINE_ROUNDS, TARGET_SIZE, MAX_ORACLE_DEPTH = 3, 32, 10


def _refined_sql(rounds: int = REFINE_ROUNDS, max_depth: int = MAX_ORACLE_DEPTH) -> str:
    """Every level up to ``max_depth`` as a chain of materialized CTEs; the level used is
    ceil(log2(n / target size)) computed from the data, like the Spark job."""
    ctes = [f"lv0 as materialized ({BASE_SQL})"]
    for lv in range(max_depth):
        src = f"lv{lv}"
        ctes.append(f"""c{lv}_0 as materialized (
  select node, arg_min(v, struct_pack(h := h, i := item_id)) as c0, arg_max(v, struct_pack(h := h, i := item_id)) as c1
  from (select item_id, node, v, {_u52('item_id', SEED, lv, 'node')} as h from {src}) group by node)""")
        for r in range(rounds):
            ctes.append(f"""a{lv}_{r} as materialized (
  select item_id, node, v, cast(case when rk <= n // 2 then 0 else 1 end as bigint) as side from (
    select s.item_id, s.node, s.v, count(*) over (partition by s.node) as n,
           row_number() over (partition by s.node order by
             round(list_dot_product(s.v, c.c0) - list_dot_product(s.v, c.c1), 9) desc, s.item_id) as rk
    from {src} s join c{lv}_{r} c on c.node = s.node))""")
            if r + 1 < rounds:
                ctes.append(f"""c{lv}_{r + 1} as materialized (
  select node, max(case when side = 0 then m end) as c0, max(case when side = 1 then m end) as c1 from (
    select node, side, list(s / w order by dim) as m from (
      select node, side, dim, sum(x) as s, count(*) as w from (
        select node, side, unnest(range(1, len(v) + 1)) as dim, unnest(v) as x from a{lv}_{r})
      group by node, side, dim) group by node, side) group by node)""")
        ctes.append(f"lv{lv + 1} as materialized (select item_id, node * 2 + side as node, v from a{lv}_{rounds - 1})")
    levels = " union all ".join(f"select {d} as depth, item_id, node from lv{d}" for d in range(max_depth + 1))
    depth = (f"(select greatest(0, cast(ceil(log2(count(*) / {float(TARGET_SIZE)})) as bigint)) from fx_cluster)")
    return "with " + ",\n".join(ctes) + f"\nselect item_id, node as cluster_id from ({levels}) where depth = {depth}"


@job("balanced_clusters_refined", oracle=_refined_sql())
def balanced_clusters_refined(t):
    """C04 with Lloyd refinement: depth from a target cluster size of 32, 3 rounds per level
    (seeded halves, then half means); sizes differ by at most one."""
    items = fx.cluster_items(t)
    n = items.count()
    return CL.balanced_clusters(items, depth=CL.tree_depth(n, TARGET_SIZE), seed=SEED, rounds=REFINE_ROUNDS)
