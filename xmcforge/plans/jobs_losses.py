"""Losses inside the batches of a training plan and their history."""

from __future__ import annotations

from pyspark.sql import functions as F

from xmcforge.operators import batch_losses as BL
from xmcforge.operators import sampling as SA
from xmcforge.plans import fixtures as fx
from xmcforge.plans import jobs_sampling as J
from xmcforge.plans.registry import job
from xmcforge.sources import files as IO

TERMS = ("u", "uv", "i", "r", "total", "violators_uv")


def _plan_sql(seed: int) -> str:
    return f"""
select p.doc_id, cast(floor(p.pos / {J.AUDIT_BATCH}) as bigint) as batch_id, s.label_id
from (select doc_id, row_number() over (order by {J._u52('doc_id', seed)}, doc_id) - 1 as pos
      from (select distinct q_id as doc_id from fx_truth)) p
join ({J._sample_sql("fx_truth", "q_id", None, seed)}) s on s.doc_id = p.doc_id"""


def _triplet_term(name: str, anchor: str, cand: str, sim: str, seed: int) -> str:
    """CTEs {name} (batch_id, v, viol): the mean row sum and the mean violators of each batch."""
    return f"""
{name}_p as (select batch_id, {anchor}, {sim} as s_p from cells where y qualify row_number() over (
    partition by batch_id, {anchor} order by -ln({J._uniform(anchor, cand, seed)}), {cand}) = 1),
{name}_n as (select batch_id, {anchor}, {sim} as s_n from cells where not y qualify row_number() over (
    partition by batch_id, {anchor} order by {sim} desc, {cand}) <= {J.NEG_K}),
{name}_e as (select n.batch_id, n.{anchor}, s_n,
    greatest(0.0, s_n - s_p + least(greatest(abs(s_p - s_n), {J.MARGIN_MIN}), {J.MARGIN_MAX})) as loss
    from {name}_n n join {name}_p p on p.batch_id = n.batch_id and p.{anchor} = n.{anchor}),
{name}_z as (select *, case when loss = 0 then -50.0 else s_n end / {J.TAU} as z from {name}_e),
{name}_w as (select *, exp(z - max(z) over (partition by batch_id, {anchor})) as w from {name}_z),
{name}_l as (select batch_id, {anchor}, loss * w / sum(w) over (partition by batch_id, {anchor}) as loss from {name}_w),
{name} as (select c.batch_id, coalesce(sum(l.s), 0.0) / count(*) as v, coalesce(sum(l.viol), 0.0) / count(*) as viol
    from (select distinct batch_id, {anchor} from cells) c
    left join (select batch_id, {anchor}, sum(loss) as s, sum(case when loss > 0 then 1.0 else 0.0 end) as viol from {name}_l
               group by batch_id, {anchor}) l on l.batch_id = c.batch_id and l.{anchor} = c.{anchor}
    group by c.batch_id)"""


def batch_losses_sql(seed: int = J.SEED) -> str:
    return f"""
with plan as ({_plan_sql(seed)}),
fl as ({J.FUSED_VIEW_SQL}),
bl as (select distinct batch_id, label_id from plan),
cells as (select p.batch_id, p.doc_id, b.label_id, round(list_dot_product(q.embedding, l.embedding), 6) as s_i,
    round(list_dot_product(q.embedding, f.embedding), 6) as s_f, t.q_id is not null as y
  from plan p join bl b on b.batch_id = p.batch_id join fx_qn q on q.q_id = p.doc_id
  join fx_ln l on l.label_id = b.label_id join fl f on f.label_id = b.label_id
  left join (select distinct q_id, label_id from fx_truth) t on t.q_id = p.doc_id and t.label_id = b.label_id),
{_triplet_term("u", "doc_id", "label_id", "s_i", seed)},
{_triplet_term("uv", "doc_id", "label_id", "s_f", seed)},
{_triplet_term("i", "label_id", "doc_id", "s_i", seed)},
rp as (select batch_id, greatest(0.0, s_i - s_f + {J.REG_MARGIN}) as l from cells where y qualify row_number() over (
    partition by batch_id, doc_id order by -ln({J._uniform('doc_id', 'label_id', seed)}), label_id) = 1),
rn as (select batch_id, greatest(0.0, s_f - s_i + {J.REG_MARGIN}) as l from cells where not y qualify row_number() over (
    partition by batch_id, doc_id order by s_f desc, label_id) <= {J.NEG_K}),
b as (select batch_id, count(distinct doc_id) as n_docs, count(distinct label_id) as n_labels from cells group by batch_id),
r as (select b.batch_id, (coalesce((select avg(l) from rp where rp.batch_id = b.batch_id and l > 0), 0.0)
                        + coalesce((select avg(l) from rn where rn.batch_id = b.batch_id and l > 0), 0.0)) / 2 as v from b)
select b.batch_id, b.n_docs, b.n_labels, round(u.v, 8) as u, round(uv.v, 8) as uv, round(i.v, 8) as i, round(r.v, 8) as r,
       round(uv.viol, 8) as violators_uv, round(u.v + uv.v + i.v + {J.REG_WEIGHT} * r.v, 8) as total
from b join u on u.batch_id = b.batch_id join uv on uv.batch_id = b.batch_id join i on i.batch_id = b.batch_id
join r on r.batch_id = b.batch_id"""


def _losses(t, seed: int):
    xy = fx.truth(t).select(F.col("q_id").alias("doc_id"), "label_id")
    plan = SA.training_batches(xy, J.AUDIT_BATCH, seed)
    docs = fx.queries(t).withColumnRenamed("q_id", "doc_id")
    return BL.batch_losses(plan, docs, fx.labels(t), J.fused_labels(t), xy, k=J.NEG_K, margin_min=J.MARGIN_MIN,
                           margin_max=J.MARGIN_MAX, tau=J.TAU, reg_margin=J.REG_MARGIN, reg_weight=J.REG_WEIGHT, seed=seed)


@job("batch_losses", oracle=batch_losses_sql())
def batch_losses(t):
    """C08-C10 in batch cells: u, uv, i, r and their weighted sum for every batch of the plan."""
    return J._round_cols(_losses(t, J.SEED), TERMS, 8)


EPOCHS = (0, 1)


@job("loss_history", oracle="select epoch, row_number() over (order by epoch, batch_id) - 1 as step, batch_id, total, u, uv, i, r, violators_uv from ("
     + " union all ".join(f"select {e}::bigint as epoch, * from ({batch_losses_sql(J.SEED + e)})" for e in EPOCHS) + ")")
def loss_history(t):
    """The batches' losses of two epochs (each with its own seed, order and positives) appended
    to the history and read back in training order; the first epoch is written twice, as after a restart."""
    path = IO.scratch_path(t.spark, "loss_history")
    for e in (*EPOCHS, EPOCHS[0]):
        IO.append_losses(_losses(t, J.SEED + e), path, e)
    hist = IO.loss_history(t.spark, path)
    return J._round_cols(hist, TERMS, 8).select("epoch", "step", "batch_id", "total", "u", "uv", "i", "r", "violators_uv")
