"""DuckDB statements used as independent oracles for the ranking jobs.

They follow the reference's dense formulation (queries x ranks grid, cumulative sums),
unlike the Spark side which sums hit rows; agreement checks both.
"""

from __future__ import annotations


def topk_sql(k: int, q_view: str = "fx_qn", l_view: str = "fx_ln", exclude_view: str | None = None,
             mode: str = "before", q_col: str = "q_id", l_col: str = "label_id") -> str:
    """(q_id, label_id, score, rank) by (score desc, label_id)."""
    pairs = (f"select q.{q_col} as q_id, l.{l_col} as label_id, round(list_dot_product(q.embedding, l.embedding), 6) as score "
             f"from {q_view} q, {l_view} l")
    if exclude_view and mode == "before":
        pairs += (f" where not exists (select 1 from {exclude_view} f where f.q_id = q.{q_col} "
                  f"and f.label_id = l.{l_col})")
    ranked = (f"select q_id, label_id, score, row_number() over (partition by q_id order by score desc, label_id) as rank "
              f"from ({pairs})")
    top = f"select q_id, label_id, score, rank from ({ranked}) where rank <= {k}"
    if exclude_view and mode == "after":
        kept = (f"select t.q_id, t.label_id, t.score from ({top}) t where not exists (select 1 from {exclude_view} f "
                f"where f.q_id = t.q_id and f.label_id = t.label_id)")
        top = (f"select q_id, label_id, score, row_number() over (partition by q_id order by score desc, label_id) as rank "
               f"from ({kept})")
    return top


def weights_sql(train_view: str, n_rows_sql: str, A: float, B: float, label_view: str | None = None) -> str:
    freq = f"select label_id, sum(1.0) as freq from {train_view} group by label_id"
    if label_view:
        freq = (f"select l.label_id, coalesce(f.freq, 0.0) as freq from (select distinct label_id from {label_view}) l "
                f"left join ({freq}) f on f.label_id = l.label_id")
    return (f"select label_id, 1.0 + (ln(({n_rows_sql})::double) - 1.0) * pow({B + 1.0}, {A}) * pow(freq + {B}, {-A}) "
            f"as weight from ({freq})")


def metrics_sql(pred_sql: str, truth_view: str, query_view: str, ks, weights_sql_text: str | None = None,
                no_hit: str = "zero", digits: int = 6, metrics: list[str] | None = None) -> str:
    """Long (metric, k, value) report over a dense grid of every query x rank 1..K."""
    ks = sorted(set(int(k) for k in ks))
    K = max(ks)
    no_hit_value = "1.0" if no_hit == "reference" else "0.0"
    wcte = f", wts as ({weights_sql_text})" if weights_sql_text else ", wts as (select 0::bigint as label_id, 0.0 as weight where false)"
    sql = f"""
with pred as ({pred_sql}),
qs as (select distinct q_id from {query_view}),
tr as (select distinct q_id, label_id from {truth_view}),
tc as (select q_id, count(*) as T from tr group by q_id){wcte},
grid as (select qs.q_id, r.rank from qs join (select unnest(range(1, {K + 1})) as rank) r on true),
fl as (
  select g.q_id, g.rank, case when tr.q_id is null then 0 else 1 end as f, coalesce(tc.T, 0) as T,
         coalesce(w.weight, 0.0) as wt
  from grid g
  left join (select q_id, label_id, rank from pred where rank <= {K}) p on p.q_id = g.q_id and p.rank = g.rank
  left join tr on tr.q_id = g.q_id and tr.label_id = p.label_id
  left join tc on tc.q_id = g.q_id
  left join wts w on w.label_id = p.label_id),
ideal as (
  select q_id, rank, weight from (
    select tr.q_id, coalesce(w.weight, 0.0) as weight,
           row_number() over (partition by tr.q_id order by coalesce(w.weight, 0.0) desc, tr.label_id) as rank
    from tr left join wts w on w.label_id = tr.label_id) where rank <= {K}),
fl2 as (
  select fl.*, coalesce(i.weight, 0.0) as iw from fl left join ideal i on i.q_id = fl.q_id and i.rank = fl.rank),
cum as (
  select q_id, rank, T,
    sum(f) over w as c,
    sum(f / log2(rank + 1)) over w as dcg,
    sum(case when rank <= T then 1.0 / log2(rank + 1) else 0.0 end) over w as idcg,
    sum(f * wt) over w as wsum,
    sum(f * wt / log2(rank + 1)) over w as wdcg,
    sum(iw) over w as iwsum,
    sum(iw / log2(rank + 1)) over w as iwdcg,
    min(case when f = 1 then rank end) over (partition by q_id) as fh,
    f
  from fl2 window w as (partition by q_id order by rank rows between unbounded preceding and current row)),
cum2 as (
  select *, sum(case when f = 1 then c / rank else 0.0 end)
            over (partition by q_id order by rank rows between unbounded preceding and current row) as apn
  from cum),
per as (
  select q_id, rank as k,
    c / rank as p, c / greatest(T, 1) as r, case when c > 0 then 1.0 else 0.0 end as hit,
    case when T = 0 then 0.0 else dcg / idcg end as ndcg,
    apn / greatest(c, 1) as map,
    case when fh is null then {no_hit_value} when fh <= rank then 1.0 / fh else 0.0 end as mrr,
    wsum / rank as wp, iwsum / rank as iwp,
    case when T = 0 then 0.0 else wdcg / idcg end as wn,
    case when T = 0 then 0.0 else iwdcg / idcg end as iwn
  from cum2 where rank in ({", ".join(str(k) for k in ks)})),
agg as (
  select k, avg(p) as P, avg(r) as R, avg(hit) as Hit, avg(ndcg) as nDCG, avg(map) as MAP, avg(mrr) as MRR,
         case when sum(iwp) > 0 then sum(wp) / sum(iwp) end as PSP,
         case when sum(iwn) > 0 then sum(wn) / sum(iwn) end as PSnDCG
  from per group by k)
"""
    names = metrics or (["P", "R", "Hit", "nDCG", "MAP", "MRR"] + (["PSP", "PSnDCG"] if weights_sql_text else []))
    unions = " union all ".join(
        f"select '{m}' as metric, cast(k as bigint) as k, round(100.0 * {m}, {digits}) as value from agg" for m in names)
    return sql + unions
