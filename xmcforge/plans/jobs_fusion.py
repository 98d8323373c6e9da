"""Fusion and sparse-matrix jobs (SURVEY 2.2 P10, 2.3 J07/J09, 2.4 A01/A06/A07/A20-A23,
2.7 U01-U03, 2.8 C02/C03, 2.1 S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from xmcforge.operators import fusion as FU
from xmcforge.operators import retrieval as R
from xmcforge.operators import sparse as SP
from xmcforge.plans import fixtures as fx
from xmcforge.plans import oracle_text as O
from xmcforge.plans.registry import job

# Reference CLI defaults for retrieval-augmented inference (fixed values).
RAI_K, RAI_QUERY_K, RAI_TAU, RAI_LAMBDA = 500, 50, 0.05, 0.1
K = 10

_VM_SQL = (f"select 0 as kind_code, label_id as row_id, label_id, {1.0 - RAI_LAMBDA}::double as value from fx_label "
           f"union all select 1 as kind_code, trn_id as row_id, label_id, {RAI_LAMBDA}::double as value from fx_trn_xy")


def _fuse_sql(top_sql: str) -> str:
    return f"""
with top as ({top_sql}),
sm as (select q_id, kind_code, cand_id, exp((score - max(score) over (partition by q_id)) / {RAI_TAU}) as e from top),
p as (select q_id, kind_code, cand_id, e / sum(e) over (partition by q_id) as p from sm),
vm as ({_VM_SQL})
select p.q_id, vm.label_id, round(sum(p.p * vm.value), 8) as score
from p join vm on vm.kind_code = p.kind_code and vm.row_id = p.cand_id group by p.q_id, vm.label_id"""


def _cand_top_sql(k: int, which: str) -> str:
    parts = []
    if which in ("both", "label"):
        parts.append("select 0 as kind_code, label_id as cand_id, embedding from fx_ln")
    if which in ("both", "query"):
        parts.append("select 1 as kind_code, trn_id as cand_id, embedding from fx_tn")
    cands = " union all ".join(parts)
    return f"""select q_id, kind_code, cand_id, score from (
  select q.q_id, c.kind_code, c.cand_id, round(list_dot_product(q.embedding, c.embedding), 6) as score,
         row_number() over (partition by q.q_id order by round(list_dot_product(q.embedding, c.embedding), 6) desc,
                            c.kind_code, c.cand_id) as rank
  from fx_qn q, ({cands}) c) where rank <= {k}"""


@job("candidate_union", oracle="""
select 'label' as kind, label_id as cand_id from fx_label union all select 'query' as kind, trn_id as cand_id from fx_trnq""")
def candidate_union(t):
    """Labels and training queries as one candidate set, tagged by kind."""
    return FU.candidate_union(fx.labels(t), fx.train_queries(t)).select("kind", "cand_id")


@job("value_matrix_union", oracle=f"""
select case when kind_code = 0 then 'label' else 'query' end as kind, row_id, label_id, value from ({_VM_SQL})""")
def value_matrix_union(t):
    """Identity x (1 - lambda) stacked over the train matrix x lambda."""
    return SP.weighted_identity_union(fx.labels(t), fx.train_xy(t), RAI_LAMBDA)


@job("softmax_temperature", oracle=f"""
with top as ({O.topk_sql(K)}),
sm as (select q_id, label_id, exp((score - max(score) over (partition by q_id)) / {RAI_TAU}) as e from top)
select q_id, label_id, round(e / sum(e) over (partition by q_id), 8) as p from sm""")
def softmax_temperature(t):
    """P10: softmax with temperature over each query's top-10 scores."""
    top = R.ova_topk(fx.queries(t), fx.labels(t), K)
    return FU.softmax_temperature(top, RAI_TAU).select("q_id", "label_id", F.round("p", 8).alias("p"))


@job("rai_joint", oracle=_fuse_sql(_cand_top_sql(RAI_K, "both")))
def rai_joint(t):
    """Joint top-500 over labels and training queries, softmax (tau 0.05), fusion (lambda 0.1)."""
    out = FU.rai_joint(fx.queries(t), fx.labels(t), fx.train_queries(t), fx.train_xy(t),
                       k=RAI_K, tau=RAI_TAU, lam=RAI_LAMBDA)
    return out.select("q_id", "label_id", F.round("score", 8).alias("score"))


@job("rai_split", oracle=_fuse_sql(f"{_cand_top_sql(RAI_K, 'label')} union all {_cand_top_sql(RAI_QUERY_K, 'query')}"))
def rai_split(t):
    """Top-500 labels and top-50 training queries, shared softmax, fusion."""
    out = FU.rai_split(fx.queries(t), fx.labels(t), fx.train_queries(t), fx.train_xy(t),
                       k_labels=RAI_K, k_queries=RAI_QUERY_K, tau=RAI_TAU, lam=RAI_LAMBDA)
    return out.select("q_id", "label_id", F.round("score", 8).alias("score"))


@job("predictions_fixed_width", oracle=f"""
with pred as ({O.topk_sql(K, exclude_view="fx_filter", mode="after")}),
grid as (select q.q_id, s.slot from (select distinct q_id from fx_query) q join (select unnest(range(1, {K + 1})) as slot) s on true)
select g.q_id, cast(g.slot as bigint) as slot, coalesce(p.label_id, -1) as label_id, coalesce(p.score, 0.0) as score
from grid g left join pred p on p.q_id = g.q_id and p.rank = g.slot""")
def predictions_fixed_width(t):
    """Filtered top-10 padded to width 10 with (-1, 0.0), long form."""
    pred = R.ova_topk(fx.queries(t), fx.labels(t), K, exclude=fx.filter_pairs(t), exclude_mode="after")
    return FU.fixed_width(pred, fx.queries(t), K)


@job("sparse_matmul", oracle="""
select x.doc_id, p.p_brand, sum(x.value * 1.0) as value from fx_xy x join part p on p.p_partkey = x.label_id
group by x.doc_id, p.p_brand""")
def sparse_matmul(t):
    """X_Y (order x part) times the part -> brand indicator matrix."""
    brand = t("part").select(F.col("p_partkey").alias("label_id"), "p_brand", F.lit(1.0).alias("value"))
    return SP.sparse_matmul(fx.xy(t), brand, "doc_id", "label_id", "p_brand")


@job("label_frequency", oracle="""
select l.label_id, coalesce(f.freq, 0.0) as freq from fx_label_ids l
left join (select label_id, sum(value) as freq from fx_xy group by label_id) f on f.label_id = l.label_id""")
def label_frequency(t):
    """Label frequency of X_Y, zero-filled for parts never ordered."""
    return SP.label_frequency(fx.xy(t), fx.label_ids(t))


@job("reduce_max_sparse", oracle=f"""
with top as ({O.topk_sql(K)})
select t.q_id, m.new_id, max(t.score) as score from top t join fx_map m on m.label_id = t.label_id group by t.q_id, m.new_id""")
def reduce_max_sparse(t):
    """Top-10 predictions collapsed to label classes by max."""
    top = R.ova_topk(fx.queries(t), fx.labels(t), K)
    return SP.reduce_max_sparse(top, fx.label_class_map(t))


@job("reduce_max_dense", oracle=f"""
with top as ({O.topk_sql(K)})
select t.q_id, m.new_id, greatest(0.0, max(t.score)) as score from top t join fx_map m on m.label_id = t.label_id
group by t.q_id, m.new_id""")
def reduce_max_dense(t):
    """Dense variant (max(0, max)), returned without its implicit zero cells."""
    top = R.ova_topk(fx.queries(t), fx.labels(t), K)
    return SP.reduce_max_dense(top, fx.label_class_map(t))


@job("matrix_stats", oracle="""
select count(*) as nnz, count(distinct doc_id) as nonempty_rows, count(distinct label_id) as used_labels,
       max(label_id) + 1 as n_labels, (select count(*) from orders) as n_rows from fx_xy""")
def matrix_stats(t):
    """Nnz, non-empty rows, used labels, label count (max id + 1) and the shape's row count."""
    return SP.matrix_stats(fx.xy(t), fx.docs(t))


@job("dense_mapping", oracle="""
select label_id, row_number() over (order by first_doc, label_id) - 1 as dense_id
from (select label_id, min(doc_id) as first_doc from fx_xy group by label_id)""")
def dense_mapping(t):
    """First-occurrence dense ids of labels over X_Y in (doc, label) order."""
    return SP.dense_mapping(fx.xy(t))


@job("valid_label_semi_join", oracle="""
with v as (select distinct label_id from fx_xy),
r as (select label_id, row_number() over (order by label_id) - 1 as new_label_id from v)
select x.doc_id, x.label_id, r.new_label_id, x.value from fx_xy x join r on r.label_id = x.label_id""")
def valid_label_semi_join(t):
    """Restrict X_Y to valid labels (those with training documents) and renumber."""
    xy = fx.xy(t)
    return SP.restrict_and_renumber(xy, xy.select("label_id"))


@job("max_filter_count", oracle=f"""
select cast(coalesce(max(n), 0) as bigint) as max_filtered, cast(coalesce(max(n), 0) + {K} as bigint) as k_fetch
from (select q_id, count(*) as n from fx_filter group by q_id)""")
def max_filter_count(t):
    """Largest filter count of a query and the over-fetch k."""
    return SP.max_filter_count(fx.filter_pairs(t), K)


@job("failed_owner_count", oracle="""
select count(*) as failed_owners from (select distinct owner_id from fx_owner) o
where not exists (select 1 from fx_asset a where a.owner_id = o.owner_id)""")
def failed_owner_count(t):
    """Owners without any asset."""
    return SP.failed_owner_count(fx.owners(t), fx.assets(t))


@job("distinct_targets", oracle="select distinct new_id from fx_map")
def distinct_targets(t):
    """Distinct target ids of the label mapping."""
    return fx.label_class_map(t).select("new_id").distinct()


@job("keep_topk_sparse", oracle="""
select doc_id, p_brand, value from (
  select doc_id, p_brand, value, row_number() over (partition by doc_id order by value desc, p_brand) as r from (
    select x.doc_id, p.p_brand, sum(x.value * 1.0) as value from fx_xy x join part p on p.p_partkey = x.label_id
    group by x.doc_id, p.p_brand)) where r <= 2""")
def keep_topk_sparse(t):
    """The two heaviest brands of every order in the order x brand matrix."""
    brand = t("part").select(F.col("p_partkey").alias("label_id"), "p_brand", F.lit(1.0).alias("value"))
    m = SP.sparse_matmul(fx.xy(t), brand, "doc_id", "label_id", "p_brand")
    return SP.keep_topk_per_row(m, 2, "doc_id", "p_brand")


SIM_K, SIM_THRESHOLD = 10, 0.98   # neighbour count and similarity mask threshold (fixed values)
_SELF = "select label_id as q_id, label_id from fx_label"


@job("similarity_buckets", oracle=f"""
select q_id, label_id, score as sim, cast(score >= {SIM_THRESHOLD} as double) as mask,
       cast(1 + floor(100.0 * (1.0 - score)) as bigint) as bucket
from ({O.topk_sql(SIM_K, exclude_view='fx_filter', mode='before')})""")
def similarity_buckets(t):
    """Mask (sim >= 0.98) and bucket 1 + int(100 (1 - sim)) of each query's unfiltered neighbours."""
    from xmcforge.functions import vectors as V
    top = R.ova_topk(fx.queries(t), fx.labels(t), SIM_K, exclude=fx.filter_pairs(t), exclude_mode="before")
    return top.select("q_id", "label_id", F.col("score").alias("sim"),
                      V.similarity_mask("score", SIM_THRESHOLD).alias("mask"),
                      V.similarity_bucket("score").alias("bucket"))


@job("similar_labels", oracle=f"""
with fx_self as ({_SELF}), lq as (select label_id as q_id, embedding from fx_ln)
select q_id as label_id, label_id as neighbor_id, score as sim, rank, cast(score >= {SIM_THRESHOLD} as double) as mask,
       cast(1 + floor(100.0 * (1.0 - score)) as bigint) as bucket
from ({O.topk_sql(SIM_K, q_view='lq', exclude_view='fx_self', mode='before')})""")
def similar_labels(t):
    """Each label's 10 nearest other labels (self excluded by id) with mask and bucket."""
    return R.similar_labels(fx.labels(t), fx.labels(t), topk=SIM_K, threshold=SIM_THRESHOLD)
