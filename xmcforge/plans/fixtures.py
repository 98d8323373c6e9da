"""Stand-in views over the driver tables.

The reference reads XMC corpora that are not shipped; these views map their shapes onto the
driver's parquet tables.  Every view uses its whole source table: roles are assigned by
mapping columns, never by dropping rows.

* retrieval world: every ``embeddings`` row is a query, a label and a training query, each role
  with its own id range, so a swapped role or direction changes results; truth is directed: a
  query's labels are the later rows of its class inside its 50-id shard (a bounded equi-join, and
  the last row of each has none); filter pairs = the query's own row and the next 0 to 2 rows.
* sparse world: documents = ``orders``, labels = ``part``, X_Y = distinct (order, part)
  from ``lineitem``; orders without items are empty rows.
* text world: ``documents`` bodies and ``part`` names/types.
* assets: owners = ``part``; assets = ``embeddings`` grouped four consecutive ids per owner;
  URLs = ``pages`` grouped five consecutive ids per owner.
* observations: ``events`` keyed by user, ordered by (ts, event_id).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed fixture parameters (shared with the DuckDB oracle text below).
TRUTH_SHARD = 50
LABEL_BASE = 1_000_000_000   # label_id = vec_id + LABEL_BASE
TRAIN_BASE = 2_000_000_000   # trn_id = vec_id + TRAIN_BASE
FILTER_EXTRA = 3             # query q has 1 + q % FILTER_EXTRA filter pairs
ASSETS_PER_OWNER_BLOCK = 4
URLS_PER_OWNER_BLOCK = 5
SEQ_LEN = 8


class Tables:
    """Lazy access to ``<sf_dir>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- retrieval world

def queries(t: Tables) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("q_id"), "embedding")


def labels(t: Tables) -> DataFrame:
    return t("embeddings").select((F.col("vec_id") + LABEL_BASE).alias("label_id"), "embedding")


def train_queries(t: Tables) -> DataFrame:
    return t("embeddings").select((F.col("vec_id") + TRAIN_BASE).alias("trn_id"), "embedding")


def _shard_side(t: Tables, id_name: str) -> DataFrame:
    e = t("embeddings")
    return e.select(F.col("vec_id").alias(id_name), "label",
                    F.expr(f"vec_id div {TRUTH_SHARD}").alias("shard"))


def truth(t: Tables) -> DataFrame:
    """(q_id, label_id): same class, same shard, a later row."""
    q = _shard_side(t, "q_id")
    lab = _shard_side(t, "l_id")
    return (q.join(lab, ["label", "shard"])
             .where(F.col("q_id") < F.col("l_id"))
             .select("q_id", (F.col("l_id") + LABEL_BASE).alias("label_id")))


def train_xy(t: Tables) -> DataFrame:
    return truth(t).select((F.col("q_id") + TRAIN_BASE).alias("trn_id"), "label_id")


def filter_pairs(t: Tables) -> DataFrame:
    q = F.col("vec_id")
    return t("embeddings").select(q.alias("q_id"), F.explode(
        F.transform(F.sequence(F.lit(0), (q % FILTER_EXTRA).cast("int")), lambda i: q + i + LABEL_BASE)).alias("label_id"))


def label_class_map(t: Tables) -> DataFrame:
    return t("embeddings").select((F.col("vec_id") + LABEL_BASE).alias("label_id"), F.col("label").cast("long").alias("new_id"))


def cluster_items(t: Tables) -> DataFrame:
    return t("embeddings").select((F.col("vec_id") + LABEL_BASE).alias("item_id"),
                                  F.col("label").cast("long").alias("cluster_id"), "embedding")


# ---------------------------------------------------------------- sparse world

def xy(t: Tables) -> DataFrame:
    """Long X_Y: (doc_id, label_id, value)."""
    return (t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("label_id"))
            .distinct().withColumn("value", F.lit(1.0)))


def xy_shape(t: Tables) -> DataFrame:
    """One-row shape table: rows = orders, labels = parts."""
    return shape_of(t("orders"), t("part"))


def shape_of(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """One-row (n_rows, n_labels) from a row table and a column table, in one aggregate."""
    r = rows.select(F.lit(1).alias("r"), F.lit(0).alias("c"))
    c = cols.select(F.lit(0).alias("r"), F.lit(1).alias("c"))
    return r.unionByName(c).agg(F.sum("r").cast("long").alias("n_rows"), F.sum("c").cast("long").alias("n_labels"))


def docs(t: Tables) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("doc_id"))


def label_ids(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("label_id"))


# ---------------------------------------------------------------- text world

def doc_text(t: Tables) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("row_id"), "text")


def label_text(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("title"),
                            F.col("p_type").alias("content"))


# ---------------------------------------------------------------- assets

def owners(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("owner_id"))


def assets(t: Tables) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("asset_id"),
                                  F.expr(f"vec_id div {ASSETS_PER_OWNER_BLOCK}").alias("owner_id"), "embedding")


def urls(t: Tables) -> DataFrame:
    return t("pages").select(F.expr(f"page_id div {URLS_PER_OWNER_BLOCK}").alias("owner_id"),
                             F.col("page_id").alias("ord"), "url")


def sequences(t: Tables) -> DataFrame:
    """Token-state stand-in: (seq_id, pos, embedding, mask); masks are 1s then 0s."""
    return t("embeddings").select(
        F.expr(f"vec_id div {SEQ_LEN}").alias("seq_id"),
        F.expr(f"vec_id % {SEQ_LEN}").alias("pos"),
        "embedding",
        F.expr(f"case when vec_id % {SEQ_LEN} < {SEQ_LEN} - (vec_id div {SEQ_LEN}) % 3 then 1 else 0 end")
        .cast("long").alias("mask"))


def observations(t: Tables) -> DataFrame:
    return t("events").select(F.col("user_id").alias("key"), F.col("ts").alias("step"),
                              F.col("event_id").alias("id"), "value")


# ---------------------------------------------------------------- DuckDB text of the same views
ORACLE_VIEWS: dict[str, str] = {
    "fx_query": "select vec_id as q_id, embedding::double[] as embedding from embeddings",
    "fx_label": f"select vec_id + {LABEL_BASE} as label_id, embedding::double[] as embedding from embeddings",
    "fx_trnq": f"select vec_id + {TRAIN_BASE} as trn_id, embedding::double[] as embedding from embeddings",
    "fx_truth": (f"select q.vec_id as q_id, l.vec_id + {LABEL_BASE} as label_id from embeddings q join embeddings l "
                 f"on q.label = l.label and q.vec_id // {TRUTH_SHARD} = l.vec_id // {TRUTH_SHARD} "
                 f"where q.vec_id < l.vec_id"),
    "fx_trn_xy": f"select q_id + {TRAIN_BASE} as trn_id, label_id from fx_truth",
    "fx_filter": (f"select vec_id as q_id, vec_id + i + {LABEL_BASE} as label_id "
                  f"from (select vec_id, unnest(range(0, 1 + vec_id % {FILTER_EXTRA})) as i from embeddings)"),
    "fx_map": f"select vec_id + {LABEL_BASE} as label_id, cast(label as bigint) as new_id from embeddings",
    "fx_cluster": f"select vec_id + {LABEL_BASE} as item_id, cast(label as bigint) as cluster_id, embedding::double[] as embedding from embeddings",
    "fx_xy": "select distinct l_orderkey as doc_id, l_partkey as label_id, 1.0::double as value from lineitem",
    "fx_shape": "select (select count(*) from orders) as n_rows, (select count(*) from part) as n_labels",
    "fx_docs": "select o_orderkey as doc_id from orders",
    "fx_label_ids": "select p_partkey as label_id from part",
    "fx_doc_text": "select doc_id as row_id, text from documents",
    "fx_label_text": "select p_partkey as row_id, p_name as title, p_type as content from part",
    "fx_owner": "select p_partkey as owner_id from part",
    "fx_asset": (f"select vec_id as asset_id, vec_id // {ASSETS_PER_OWNER_BLOCK} as owner_id, "
                 f"embedding::double[] as embedding from embeddings"),
    "fx_url": f"select page_id // {URLS_PER_OWNER_BLOCK} as owner_id, page_id as ord, url from pages",
    "fx_seq": (f"select vec_id // {SEQ_LEN} as seq_id, vec_id % {SEQ_LEN} as pos, embedding::double[] as embedding, "
               f"cast(case when vec_id % {SEQ_LEN} < {SEQ_LEN} - (vec_id // {SEQ_LEN}) % 3 then 1 else 0 end as bigint) as mask "
               f"from embeddings"),
    "fx_obs": "select user_id as key, ts as step, event_id as id, value from events",
    # L2-normalised copies (a zero vector stays zero)
    "fx_qn": f"select q_id, {{NORM}} as embedding from fx_query",
    "fx_ln": f"select label_id, {{NORM}} as embedding from fx_label",
    "fx_tn": f"select trn_id, {{NORM}} as embedding from fx_trnq",
}

NORM_SQL = ("list_transform(embedding, lambda x: case when list_sum(list_transform(embedding, lambda y: y * y)) > 0 "
            "then x / sqrt(list_sum(list_transform(embedding, lambda y: y * y))) else 0.0 end)")
for _k, _v in list(ORACLE_VIEWS.items()):
    ORACLE_VIEWS[_k] = _v.replace("{NORM}", NORM_SQL)


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of every ``fx_*`` view it (transitively) names."""
    views = dict(ORACLE_VIEWS)
    if extra:
        views.update(extra)
    needed: list[str] = []

    def visit(text: str):
        for name in re.findall(r"\bfx_\w+", text):
            if name in views and name not in needed:
                visit(views[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} as ({views[n]})" for n in needed)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
