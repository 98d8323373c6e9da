"""Jobs with functions of the caller's and the re-startable append."""

from __future__ import annotations

from pyspark.sql import functions as F

from xmcforge.functions import vectors as V
from xmcforge.operators import cluster as CL
from xmcforge.operators import retrieval as R
from xmcforge.plans import fixtures as fx
from xmcforge.plans.jobs_cluster import BASE_SQL
from xmcforge.plans.registry import job
from xmcforge.sources import asset_log as AL
from xmcforge.sources import files as IO

K = 10


def either_way(queries, labels):
    """Similarity without its sign."""
    import numpy as np
    return np.abs(queries @ labels.T)


@job("ova_topk_score", oracle=f"""
select q_id, label_id, score, rank from (
  select *, row_number() over (partition by q_id order by score desc, label_id) as rank from (
    select q.q_id, l.label_id, round(abs(list_dot_product(q.embedding, l.embedding)), 6) as score from fx_qn q, fx_ln l))
where rank <= {K}""")
def ova_topk_score(t):
    """top-10 by a caller's score on blocks, here the cosine without its sign."""
    return R.ova_topk(fx.queries(t), fx.labels(t), K, score=either_way)


HOOK_DEPTH = 4


def _axis_sql() -> str:
    levels = [f"h0 as ({BASE_SQL})"]
    for lv in range(HOOK_DEPTH):
        levels.append(f"""h{lv + 1} as (select item_id, node * 2 + case when rk <= n // 2 then 0 else 1 end as node, v from (
  select *, count(*) over (partition by node) as n,
    row_number() over (partition by node order by round(v[{lv + 1}], 9) desc, item_id) as rk from h{lv}))""")
    return "with " + ",\n".join(levels) + f"\nselect item_id, cast(node as bigint) as cluster_id from h{HOOK_DEPTH}"


@job("balanced_clusters_splitter", oracle=_axis_sql())
def balanced_clusters_splitter(t):
    """balanced clusters with a caller's splitter, here the median of one component a level."""
    items = fx.cluster_items(t).select("item_id", V.l2_normalize("embedding").alias("v"))
    return CL.keyed_clusters(items, HOOK_DEPTH, lambda level: F.round(F.col("v")[level], 9))


STEPS = 4


@job("asset_append", oracle=f"""
with b as (select page_id // {fx.URLS_PER_OWNER_BLOCK} as owner_id, page_id as ord, html from pages),
s as (select *, owner_id * {STEPS} // (select max(owner_id) + 1 from b) as step from b)
select row_number() over (order by owner_id, ord) - 1 as asset_id, owner_id, ord, md5(to_base64(encode(html))) as payload_md5,
       cast(step as bigint) as step
from s""")
def asset_append(t):
    """All pages' html appended in four steps by owner.  The second step is stopped between its
    data and its commit; the job run again takes it up there, and ids go on without a gap."""
    pages = t("pages").select(F.expr(f"page_id div {fx.URLS_PER_OWNER_BLOCK}").alias("owner_id"),
                              F.col("page_id").alias("ord"), F.encode("html", "UTF-8").alias("bytes"))
    owners = int(pages.agg(F.coalesce(F.max("owner_id"), F.lit(0)) + 1).first()[0])
    step = F.expr(f"owner_id * {STEPS} div {owners}")
    steps = [(f"step-{i}", lambda i=i: pages.where(step == i)) for i in range(STEPS)]
    path = IO.scratch_path(t.spark, "assets")
    AL.append_all(t.spark, path, steps[:1])
    AL.prepare_batch(t.spark, path, steps[1][0], steps[1][1]())  # written, never committed
    AL.append_all(t.spark, path, steps)
    return AL.read_assets(t.spark, path).select("asset_id", "owner_id", "ord", F.md5("payload").alias("payload_md5"),
                                                step.cast("long").alias("step"))
