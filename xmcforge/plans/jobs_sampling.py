"""Sampling, batch planning and loss-audit jobs (SURVEY 2.6 T03/T05/T06, 2.5 W05, 2.2 P05/P20/P21,
2.3 J05, 2.4 A18/A19, 2.8 C06-C10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from xmcforge.functions import text as TX
from xmcforge.operators import audit as AU
from xmcforge.operators import metrics as M
from xmcforge.operators import represent as RP
from xmcforge.operators import sampling as SA
from xmcforge.plans import fixtures as fx
from xmcforge.plans import oracle_text as O
from xmcforge.plans.registry import job
from xmcforge.session import reliable_checkpoint

# Reference defaults (fixed values): seed 0, batch 2048 (run script), 10 negatives,
# margins 0.1..0.3, softmax temperature 0.1, custom reduction, regulariser weight 0.1.
SEED = 0
BATCH = 2048
NEG_K = 10
MARGIN_MIN, MARGIN_MAX, TAU = 0.1, 0.3, 0.1
REG_WEIGHT, REG_MARGIN = 0.1, 0.1
XY_A, XY_B = 0.55, 1.5   # fixed values: dataset-default propensity constants


def _u52(*parts: str) -> str:
    inner = " || ':' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"('0x' || substr(md5({inner}), 1, 13))::bigint"


def _uniform(*parts: str) -> str:
    return f"(({_u52(*parts)})::double + 0.5) / 4503599627370496.0"


PERM_SQL = f"""select o_orderkey as doc_id, row_number() over (order by {_u52('o_orderkey', SEED)}, o_orderkey) - 1 as pos
from orders"""

XY_WEIGHTS_SQL = O.weights_sql("fx_xy", "select count(*) from orders", XY_A, XY_B)


def _sample_sql(view: str, row: str, weights: str | None, seed: int = SEED) -> str:
    w = "coalesce(w.weight, 1.0)" if weights else "1.0"
    wj = f"left join ({weights}) w on w.label_id = x.label_id" if weights else ""
    return f"""select {row} as doc_id, label_id from (
  select x.{row}, x.label_id, row_number() over (partition by x.{row} order by
    -ln({_uniform('x.' + row, 'x.label_id', seed)}) / {w}, x.label_id) as rn
  from {view} x {wj}) where rn = 1"""


def xy_weights(t):
    return M.inverse_propensity(fx.xy(t), fx.xy_shape(t), A=XY_A, B=XY_B)


@job("seeded_permutation", oracle=PERM_SQL)
def seeded_permutation(t):
    """md5-seeded permutation of all documents (orders)."""
    return SA.seeded_permutation(fx.docs(t), "doc_id", SEED)


@job("cluster_batch_order", oracle=f"""
select item_id, cluster_id, row_number() over (order by {_u52('cluster_id', SEED)}, cluster_id, item_id) - 1 as pos
from fx_cluster""")
def cluster_batch_order(t):
    """Clusters in seeded random order, members kept together."""
    return SA.cluster_batch_order(fx.cluster_items(t).select("item_id", "cluster_id"), "cluster_id", "item_id", SEED)


@job("assign_batches", oracle=f"""
select doc_id, pos, cast(floor(pos / {BATCH}) as bigint) as batch_id, cast(pos % {BATCH} as bigint) as slot
from ({PERM_SQL})""")
def assign_batches(t):
    """Consecutive batches of 2048 over the permutation; the last one is short."""
    return SA.assign_batches(SA.seeded_permutation(fx.docs(t), "doc_id", SEED), BATCH)


@job("sample_positive_weighted", oracle=_sample_sql("fx_xy", "doc_id", XY_WEIGHTS_SQL))
def sample_positive_weighted(t):
    """One positive per document with probability proportional to inverse propensity."""
    return SA.sample_positive(fx.xy(t), SEED, xy_weights(t))


@job("sample_positive_uniform", oracle=_sample_sql("fx_xy", "doc_id", None))
def sample_positive_uniform(t):
    """One positive per document, uniformly."""
    return SA.sample_positive(fx.xy(t), SEED)


TRAIN_PLAN_SQL = f"""
with perm as (select doc_id, row_number() over (order by {_u52('doc_id', SEED)}, doc_id) - 1 as pos
              from (select distinct doc_id from fx_xy)),
s as ({_sample_sql("fx_xy", "doc_id", XY_WEIGHTS_SQL)})
select p.doc_id, p.pos, cast(floor(p.pos / {BATCH}) as bigint) as batch_id, cast(p.pos % {BATCH} as bigint) as slot, s.label_id
from perm p join s on s.doc_id = p.doc_id"""


def _plan(t):
    return SA.training_batches(fx.xy(t), BATCH, SEED, xy_weights(t))


@job("training_batches", oracle=TRAIN_PLAN_SQL)
def training_batches(t):
    """Permutation -> batches of 2048 -> one propensity-weighted positive per document."""
    return _plan(t)


@job("in_batch_relevance", oracle=f"""
with plan as ({TRAIN_PLAN_SQL})
select a.batch_id, a.slot as row_slot, b.slot as col_slot
from plan a join fx_xy x on x.doc_id = a.doc_id join plan b on b.batch_id = a.batch_id and b.label_id = x.label_id""")
def in_batch_relevance(t):
    """Positive cells of every batch's document x sampled-label matrix."""
    return SA.in_batch_relevance(_plan(t), fx.xy(t))


LABEL_MAX_LEN = 32
CLIP_SQL = f"""
with txt as (select row_id, trim(coalesce(title, 'None')) as text from fx_label_text),
v as (select token, row_number() over (order by count desc, token) - 1 + {TX.FIRST_TOKEN_ID} as token_id
      from (select token, count(*) as count from (select unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as token from txt) group by token)),
tp as (select row_id, unnest(generate_series(1, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')))) as pos,
              regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as toks from txt),
tk as (select tp.row_id, tp.pos, coalesce(v.token_id, {TX.UNK_ID}) as token_id from tp left join v on v.token = tp.toks[tp.pos]),
seq as (select d.row_id, [{TX.BOS_ID}] || coalesce(list(tk.token_id order by tk.pos) filter (where tk.pos is not null), []) || [{TX.EOS_ID}] as ids
        from txt d left join tk on tk.row_id = d.row_id group by d.row_id),
cut as (select row_id, case when len(ids) > {LABEL_MAX_LEN} then ids[1:{LABEL_MAX_LEN - 1}] || [ids[len(ids)]] else ids end as c from seq),
b as (select row_id, cast(floor((row_number() over (order by {_u52('row_id', SEED)}, row_id) - 1) / {BATCH}) as bigint) as batch_id from txt),
cl as (select c.row_id, b.batch_id, c.c, least(max(len(c.c)) over (partition by b.batch_id), {LABEL_MAX_LEN}) as clip
       from cut c join b on b.row_id = c.row_id)
select row_id, batch_id, cast(p as bigint) as pos, case when p < len(c) then c[p + 1] else 0 end as input_id,
       cast(case when p < len(c) then 1 else 0 end as bigint) as mask
from cl, (select unnest(range(0, {LABEL_MAX_LEN})) as p) r where p < clip"""


@job("clip_batch_lengths", oracle=CLIP_SQL)
def clip_batch_lengths(t):
    """Label token ids padded to 32, batched, and cut to the longest mask in the batch."""
    corpus = TX.compose_text(fx.label_text(t), ["title"])
    padded = TX.pad_and_mask_long(TX.id_sequence(corpus, TX.build_vocab(corpus), max_len=LABEL_MAX_LEN), LABEL_MAX_LEN)
    batches = SA.assign_batches(SA.seeded_permutation(corpus.select("row_id"), "row_id", SEED), BATCH)
    clipped = TX.clip_batch_lengths(padded.join(batches.select("row_id", "batch_id"), "row_id"), LABEL_MAX_LEN)
    z = F.arrays_zip("input_ids", "attention_mask")
    return clipped.select("row_id", "batch_id", F.posexplode(z).alias("pos", "z")).select(
        "row_id", "batch_id", F.col("pos").cast("long"), F.col("z.input_ids").alias("input_id"),
        F.col("z.attention_mask").alias("mask"))


# ------------------------------------------------------------------ audits
EXCLUDE_SQL = "select q_id, label_id from fx_truth union select q_id, label_id from fx_filter"


def _neg_sql(k: int, l_view: str = "fx_ln") -> str:
    return O.topk_sql(k, l_view=l_view, exclude_view="ex", mode="before")


@job("hard_negatives", oracle=f"with ex as ({EXCLUDE_SQL}) select q_id, label_id as neg_id, score as sim_n, rank from ({_neg_sql(NEG_K)})")
def hard_negatives(t):
    """T03 + P20: the 10 most similar labels that are neither positives nor the query itself."""
    return AU.hard_negatives(fx.queries(t), fx.labels(t), fx.truth(t), NEG_K, fx.filter_pairs(t))


def _triplet_sql(q_view: str, l_view: str, pos_view: str, softmax: bool, with_entries: bool = False,
                 filter_view: str = "fx_filter") -> str:
    sm = (f""",
e3 as (select *, (case when loss = 0 then -50.0 else sim_n end) / {TAU} as s from e2),
e4 as (select *, exp(s - max(s) over (partition by q_id)) as ex from e3),
e5 as (select q_id, rank, loss * ex / sum(ex) over (partition by q_id) as loss from e4)""" if softmax
          else ",\ne5 as (select q_id, rank, loss from e2)")
    return f"""
with ex as (select q_id, label_id from {pos_view} union select q_id, label_id from {filter_view}),
pos as ({_sample_sql(pos_view, 'q_id', None)}),
sp as (select p.doc_id as q_id, round(list_dot_product(q.embedding, l.embedding), 6) as sim_p
       from pos p join {q_view} q on q.q_id = p.doc_id join {l_view} l on l.label_id = p.label_id),
neg as ({O.topk_sql(NEG_K, q_view=q_view, l_view=l_view, exclude_view='ex', mode='before')}),
e as (select n.q_id, n.rank, n.score as sim_n, sp.sim_p,
             least(greatest(abs(sp.sim_p - n.score), {MARGIN_MIN}), {MARGIN_MAX}) as margin
      from neg n join sp on sp.q_id = n.q_id),
e2 as (select *, greatest(0.0, sim_n - sim_p + margin) as loss from e){sm}
""" + ("select q_id, rank, loss from e5" if with_entries else """,
pa as (select q_id, sum(loss) as row_sum, sum(case when loss > 0 then 1.0 else 0.0 end) as viol, count(*) as n from e5 group by q_id)
select sum(row_sum) / sum(n) as mean, avg(row_sum) as custom, sum(row_sum) as sum, avg(viol) as violators,
       count(*) as n_anchors from pa""")


def _round_cols(df, cols, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _triplet(t, anchors, cands, positives, softmax=True, exclude=None, negs=None):
    e = AU.triplet_entries(anchors, cands, positives, k=NEG_K, margin_min=MARGIN_MIN, margin_max=MARGIN_MAX,
                           apply_softmax=softmax, tau=TAU, seed=SEED,
                           extra_exclude=fx.filter_pairs(t) if exclude is None else exclude, negs=negs)
    return e


@job("triplet_audit", oracle=f"select round(mean, 9) as mean, round(custom, 9) as custom, round(sum, 9) as sum, "
                             f"round(violators, 9) as violators, n_anchors from ({_triplet_sql('fx_qn', 'fx_ln', 'fx_truth', True)})")
def triplet_audit(t):
    """C08 + A18: hard-negative triplet loss (dynamic margin, softmax weights) and violators."""
    e = _triplet(t, fx.queries(t), fx.labels(t), fx.truth(t), softmax=True)
    return _round_cols(AU.reductions(e), ["mean", "custom", "sum", "violators"])


@job("loss_reductions", oracle=f"""
with r as ({_triplet_sql('fx_qn', 'fx_ln', 'fx_truth', False)})
select 'mean' as reduction, round(mean, 9) as value from r union all select 'custom', round(custom, 9) from r
union all select 'sum', round(sum, 9) from r""")
def loss_reductions(t):
    """Mean / custom / sum reductions of the plain triplet loss."""
    r = AU.reductions(_triplet(t, fx.queries(t), fx.labels(t), fx.truth(t), softmax=False))
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("reduction"), F.col(n).alias("value"))
                                  for n in ("mean", "custom", "sum")]))
    return r.select(stacked.alias("s")).select("s.reduction", F.round("s.value", 9).alias("value"))


@job("masked_loss", oracle=f"""
with e as ({_triplet_sql('fx_qn', 'fx_ln', 'fx_truth', False, with_entries=True)})
select q_id, rank, round(case when rank = 1 then 0.0 else loss end, 9) as loss from e""")
def masked_loss(t):
    """The pad column (rank 1 here) is zeroed in the per-entry loss."""
    e = AU.mask_loss(_triplet(t, fx.queries(t), fx.labels(t), fx.truth(t), softmax=False), pad_rank=1)
    return e.select("q_id", "rank", F.round("loss", 9).alias("loss"))


def _swapped(pairs):
    """(q_id, label_id) pairs in the label-to-document direction."""
    return pairs.select(F.col("label_id").alias("q_id"), F.col("q_id").alias("label_id"))


AUDIT_BATCH = 64
AUDIT_PLAN_SQL = f"""
with perm as (select doc_id, row_number() over (order by {_u52('doc_id', SEED)}, doc_id) - 1 as pos
              from (select distinct q_id as doc_id from fx_truth)),
s as ({_sample_sql("fx_truth", "q_id", None)})
select p.doc_id, cast(floor(p.pos / {AUDIT_BATCH}) as bigint) as batch_id, s.label_id from perm p join s on s.doc_id = p.doc_id"""


def _in_batch_sql(own: bool) -> str:
    pos = ("select doc_id as q_id, label_id as pos_id from plan" if own else
           f"select doc_id as q_id, label_id as pos_id from ({_sample_sql('inb', 'q_id', None)})")
    return f"""
with plan as ({AUDIT_PLAN_SQL}),
bl as (select distinct batch_id, label_id from plan),
inb as (select p.doc_id as q_id, b.label_id from plan p join bl b on b.batch_id = p.batch_id
        join fx_truth t on t.q_id = p.doc_id and t.label_id = b.label_id),
pos as ({pos}),
sp as (select p.q_id, p.pos_id, round(list_dot_product(q.embedding, l.embedding), 6) as sim_p
       from pos p join fx_qn q on q.q_id = p.q_id join fx_ln l on l.label_id = p.pos_id),
n as (select p.doc_id as q_id, b.label_id as neg_id, round(list_dot_product(q.embedding, l.embedding), 6) as sim_n
      from plan p join bl b on b.batch_id = p.batch_id join fx_qn q on q.q_id = p.doc_id join fx_ln l on l.label_id = b.label_id
      where not exists (select 1 from fx_truth t where t.q_id = p.doc_id and t.label_id = b.label_id)),
r as (select *, row_number() over (partition by q_id order by sim_n desc, neg_id) as rank from n),
e as (select r.q_id, r.rank, sp.pos_id, r.neg_id, sp.sim_p, r.sim_n,
             least(greatest(abs(sp.sim_p - r.sim_n), {MARGIN_MIN}), {MARGIN_MAX}) as margin
      from r join sp on sp.q_id = r.q_id where r.rank <= {NEG_K})
select q_id, rank, pos_id, neg_id, round(greatest(0.0, sim_n - sim_p + margin), 9) as loss from e"""


def _in_batch(t, own):
    xy = fx.truth(t).select(F.col("q_id").alias("doc_id"), "label_id")
    plan = SA.training_batches(xy, AUDIT_BATCH, SEED)
    docs = fx.queries(t).withColumnRenamed("q_id", "doc_id")
    e = AU.in_batch_triplets(plan, docs, fx.labels(t), xy, k=NEG_K, margin_min=MARGIN_MIN, margin_max=MARGIN_MAX,
                             seed=SEED, own_positive=own)
    return e.select("q_id", "rank", "pos_id", "neg_id", F.round("loss", 9).alias("loss"))


@job("in_batch_triplets", oracle=_in_batch_sql(False))
def in_batch_triplets(t):
    """C08 on the batches of a plan: hard negatives among the batch's sampled labels, a positive
    drawn among the document's labels in the batch."""
    return _in_batch(t, False)


@job("in_batch_triplets_fixed", oracle=_in_batch_sql(True))
def in_batch_triplets_fixed(t):
    """C08 with the fixed positive: the document's own sampled label (the batch matrix's diagonal)."""
    return _in_batch(t, True)


N_ORDER_CLUSTERS = 97


@job("training_batches_clustered", oracle=f"""
with s as ({_sample_sql("fx_xy", "doc_id", XY_WEIGHTS_SQL)}),
c as (select s.doc_id, s.label_id, o.o_custkey % {N_ORDER_CLUSTERS} as cluster_id from s join orders o on o.o_orderkey = s.doc_id),
p as (select doc_id, label_id, row_number() over (order by {_u52('cluster_id', SEED)}, cluster_id, doc_id) - 1 as pos from c)
select doc_id, pos, cast(floor(pos / {BATCH}) as bigint) as batch_id, cast(pos % {BATCH} as bigint) as slot, label_id from p""")
def training_batches_clustered(t):
    """C07 in cluster order: clusters in seeded random order, members together, then batches."""
    clusters = t("orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % N_ORDER_CLUSTERS).alias("cluster_id"))
    return SA.training_batches(fx.xy(t), BATCH, SEED, xy_weights(t), clusters=clusters)


# ---- fused view for C09/C10: prototype of each label (raw, label centroid, class centroid)
def fused_labels(t):
    """P18 with three sources per label: raw vector, centroid of its training queries,
    centroid of its class."""
    lab = fx.labels(t)
    lab_cent = RP.label_centroids(fx.train_xy(t).select(F.col("trn_id").alias("doc_id"), "label_id"),
                                  fx.train_queries(t).select(F.col("trn_id").alias("doc_id"), "embedding"))
    items = fx.cluster_items(t)
    cls_cent = RP.cluster_centroids(items)
    cls_of = items.select(F.col("item_id").alias("label_id"), "cluster_id")
    cls_src = cls_of.join(cls_cent, "cluster_id").select("label_id", "embedding")
    sources = (lab.select("label_id", F.col("embedding").cast("array<double>").alias("embedding"))
               .unionByName(lab_cent).unionByName(cls_src))
    return RP.prototype_fusion(sources)


def _mean_sql(src: str, key: str) -> str:
    """Per-key mean vector of ``src`` (key, embedding) in DuckDB."""
    return f"""select {key}, list(s / w order by dim) as embedding from (
  select {key}, dim, sum(x) as s, count(*) as w from (
    select {key}, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding) as x from ({src}))
  group by {key}, dim) group by {key}"""


_LABEL_CENT = _mean_sql("select t.label_id, q.embedding from fx_trn_xy t join fx_trnq q on q.trn_id = t.trn_id", "label_id")
_CLASS_CENT = _mean_sql("select cluster_id, embedding from fx_cluster", "cluster_id")
_SOURCES = f"""select label_id, embedding from fx_label
  union all select label_id, embedding from ({_LABEL_CENT})
  union all select i.item_id as label_id, c.embedding from fx_cluster i join ({_CLASS_CENT}) c on c.cluster_id = i.cluster_id"""
FUSED_VIEW_SQL = f"""
select label_id, list_transform(m, lambda x: case when n > 0 then x / sqrt(n) else 0.0 end) as embedding from (
  select label_id, embedding as m, list_sum(list_transform(embedding, lambda y: y * y)) as n
  from ({_mean_sql(_SOURCES, "label_id")}))"""


@job("margin_regularity_audit", oracle=f"""
with fl as ({FUSED_VIEW_SQL}),
ex as (select q_id, label_id from fx_truth union select q_id, label_id from fx_filter),
pos as ({_sample_sql('fx_truth', 'q_id', None)}),
lp as (select greatest(0.0, round(list_dot_product(q.embedding, l.embedding), 6) - round(list_dot_product(q.embedding, f.embedding), 6) + {REG_MARGIN}) as l
       from pos p join fx_qn q on q.q_id = p.doc_id join fx_ln l on l.label_id = p.label_id join fl f on f.label_id = p.label_id),
neg as ({O.topk_sql(NEG_K, l_view='fl', exclude_view='ex', mode='before')}),
ln_ as (select greatest(0.0, n.score - round(list_dot_product(q.embedding, l.embedding), 6) + {REG_MARGIN}) as l
        from neg n join fx_qn q on q.q_id = n.q_id join fx_ln l on l.label_id = n.label_id),
a as (select coalesce(sum(l) / sum(case when l > 0 then 1.0 end), 0.0) as loss_p from lp),
b as (select coalesce(sum(l) / sum(case when l > 0 then 1.0 end), 0.0) as loss_n from ln_)
select round(loss_p, 9) as loss_p, round(loss_n, 9) as loss_n, round((loss_p + loss_n) / 2, 9) as loss from a, b""")
def margin_regularity_audit(t):
    """Raw vs prototype-fused similarities: positive and hard-negative margin terms."""
    fl = reliable_checkpoint(fused_labels(t))  # sized, searched and joined
    r = AU.margin_regularity(fx.queries(t), fx.labels(t), fl, fx.truth(t), k=NEG_K, margin=REG_MARGIN, seed=SEED,
                             extra_exclude=fx.filter_pairs(t))
    return _round_cols(r, ["loss_p", "loss_n", "loss"])


@job("combined_loss_audit", oracle=f"""
with fl as ({FUSED_VIEW_SQL}),
fln as (select label_id, embedding from fl),
lq as (select label_id as q_id, embedding from fx_ln),
qc as (select q_id as label_id, embedding from fx_qn),
tt as (select label_id as q_id, q_id as label_id from fx_truth),
ft as (select label_id as q_id, q_id as label_id from fx_filter),
u as ({_triplet_sql('fx_qn', 'fx_ln', 'fx_truth', True)}),
uv as ({_triplet_sql('fx_qn', 'fln', 'fx_truth', True)}),
i as ({_triplet_sql('lq', 'qc', 'tt', True, filter_view='ft')}),
ex as (select q_id, label_id from fx_truth union select q_id, label_id from fx_filter),
pos as ({_sample_sql('fx_truth', 'q_id', None)}),
lp as (select greatest(0.0, round(list_dot_product(q.embedding, l.embedding), 6) - round(list_dot_product(q.embedding, f.embedding), 6) + {REG_MARGIN}) as l
       from pos p join fx_qn q on q.q_id = p.doc_id join fx_ln l on l.label_id = p.label_id join fl f on f.label_id = p.label_id),
neg as ({O.topk_sql(NEG_K, l_view='fl', exclude_view='ex', mode='before')}),
ln_ as (select greatest(0.0, n.score - round(list_dot_product(q.embedding, l.embedding), 6) + {REG_MARGIN}) as l
        from neg n join fx_qn q on q.q_id = n.q_id join fx_ln l on l.label_id = n.label_id),
r as (select ((select coalesce(sum(l) / sum(case when l > 0 then 1.0 end), 0.0) from lp)
            + (select coalesce(sum(l) / sum(case when l > 0 then 1.0 end), 0.0) from ln_)) / 2 as r)
select round(u.custom, 9) as u, round(uv.custom, 9) as uv, round(i.custom, 9) as i, round(r.r, 9) as r,
       round(u.custom + uv.custom + i.custom + {REG_WEIGHT} * r.r, 9) as total from u, uv, i, r""")
def combined_loss_audit(t):
    """U + uv + i + 0.1 r with custom reductions (doc->label raw, doc->label fused,
    label->doc, and the margin regulariser)."""
    q, lab, truth = fx.queries(t), fx.labels(t), fx.truth(t)
    fl = reliable_checkpoint(fused_labels(t))  # sized, searched and joined
    # uv and r mine the same negatives: one search
    negs = reliable_checkpoint(AU.hard_negatives(q, fl, truth, NEG_K, fx.filter_pairs(t)))
    u = AU.reductions(_triplet(t, q, lab, truth)).select(F.col("custom").alias("u"))
    uv = AU.reductions(_triplet(t, q, fl, truth, negs=negs)).select(F.col("custom").alias("uv"))
    i = AU.reductions(_triplet(t, lab.withColumnRenamed("label_id", "q_id"), q.withColumnRenamed("q_id", "label_id"),
                               _swapped(truth), exclude=_swapped(fx.filter_pairs(t))))
    i = i.select(F.col("custom").alias("i"))
    r = AU.margin_regularity(q, lab, fl, truth, k=NEG_K, margin=REG_MARGIN, seed=SEED,
                             extra_exclude=fx.filter_pairs(t), negs=negs).select(F.col("loss").alias("r"))
    # four one-row aggregates stacked, then read back as one row by name
    parts = [u.select(F.lit("u").alias("name"), F.col("u").alias("v")),
             uv.select(F.lit("uv").alias("name"), F.col("uv").alias("v")),
             i.select(F.lit("i").alias("name"), F.col("i").alias("v")),
             r.select(F.lit("r").alias("name"), F.col("r").alias("v"))]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    one = stacked.groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ("u", "uv", "i", "r")])
    out = one.withColumn("total", F.col("u") + F.col("uv") + F.col("i") + F.lit(REG_WEIGHT) * F.col("r"))
    return _round_cols(out, ["u", "uv", "i", "r", "total"])
