"""Preparation jobs: sources/sinks, text -> ids, assets (SURVEY 2.1 S01-S15, 2.2 P01-P06,
P14, P16, P19, 2.3 J01, 2.4 A03, 2.5 W04, 2.8 C14, C15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from xmcforge.functions import text as TX
from xmcforge.operators import assets as AS
from xmcforge.plans import fixtures as fx
from xmcforge.plans.ranking import dist_rank
from xmcforge.plans.registry import job
from xmcforge.sources import files as IO

MAX_LEN = 32          # reference token length (fixed value)
NUM_IMGS = 3          # reference image slots per owner (fixed value)
LABEL_MAX_LEN = 8

TOKENS_SQL = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
PY_STRIP_CHARS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(133)||chr(160)"


def _tok(c: str) -> str:
    return TOKENS_SQL.format(c=c)


VOCAB_SQL = f"""
select token, count, row_number() over (order by count desc, token) - 1 + {TX.FIRST_TOKEN_ID} as token_id
from (select token, count(*) as count from (select unnest({_tok('text')}) as token from fx_doc_text) group by token)"""

TOKEN_IDS_SQL = f"""
with v as ({VOCAB_SQL}),
tp as (select row_id, unnest(generate_series(1, len({_tok('text')}))) as pos, {_tok('text')} as toks from fx_doc_text),
t as (select tp.row_id, tp.pos, coalesce(v.token_id, {TX.UNK_ID}) as token_id from tp left join v on v.token = tp.toks[tp.pos]),
seq as (select d.row_id, coalesce(list(t.token_id order by t.pos) filter (where t.pos is not null), []) as ids
        from fx_doc_text d left join t on t.row_id = d.row_id group by d.row_id)
select row_id, [{TX.BOS_ID}] || ids || [{TX.EOS_ID}] as ids from seq"""


def _corpus_records(t):
    """Orders as a JSON corpus: title = priority, content = status, target_ind = parts."""
    lists = fx.xy(t).groupBy("doc_id").agg(F.array_sort(F.collect_list("label_id")).alias("target_ind"))
    o = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("uid"),
                           F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("content"))
    return o.join(lists, "doc_id", "left")


def _write_corpus(t):
    path = IO.scratch_path(t.spark, "trn.json.gz")
    IO.write_jsonl(_corpus_records(t).select("doc_id", "uid", "title", "content", "target_ind"), path, "doc_id")
    return path


# ------------------------------------------------------------------ sources and sinks
@job("scan_jsonl", oracle="""
select row_number() over (order by o_orderkey) - 1 as row_id, cast(o_orderkey as varchar) as uid,
       o_orderpriority as title, o_orderstatus as content,
       cast((select count(distinct l_partkey) from lineitem l where l.l_orderkey = o.o_orderkey) as bigint) as n_targets
from orders o""")
def scan_jsonl(t):
    """Gzip JSON-lines corpus written then scanned with an explicit schema."""
    df = IO.read_jsonl(t.spark, _write_corpus(t))
    return df.select("row_id", "uid", "title", "content",
                     F.coalesce(F.size("target_ind"), F.lit(0)).cast("long").alias("n_targets"))


def _clean_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\r\\n]+', ' ', 'g'), {PY_STRIP_CHARS})"


@job("sink_raw_text", oracle=f"""
select row_number() over (order by row_id) - 1 as row_id, {_clean_sql('text')} as text from fx_doc_text""")
def sink_raw_text(t):
    """S03 round trip: documents written one per line in id order (UTF-8), read back."""
    path = IO.scratch_path(t.spark, "trn.raw.txt")
    IO.write_lines(fx.doc_text(t), path, "row_id", "text", encoding="UTF-8")
    return IO.read_lines(t.spark, path, encoding="UTF-8")


@job("scan_raw_text", oracle=f"""
select row_number() over (order by row_id) - 1 as row_id, {_clean_sql('text')} as text from fx_doc_text""")
def scan_raw_text(t):
    """Latin-1 raw text scan with blank lines kept and line numbers as ids."""
    path = IO.scratch_path(t.spark, "lbl.raw.txt")
    IO.write_lines(fx.doc_text(t), path, "row_id", "text", encoding="ISO-8859-1")
    return IO.read_lines(t.spark, path, encoding="ISO-8859-1")


XY_SQL = "select doc_id, label_id, value from fx_xy"


@job("sink_sparse_matrix", oracle=XY_SQL)
def sink_sparse_matrix(t):
    """S05 round trip: X_Y written as a header + col:val text file (orders with no parts
    become blank lines), then scanned back."""
    path = IO.scratch_path(t.spark, "trn_X_Y.txt")
    n_labels = t("part").count()
    IO.write_sparse_matrix(fx.xy(t), fx.docs(t), n_labels, path)
    body, _ = IO.read_sparse_matrix(t.spark, path)
    return body


@job("scan_sparse_matrix", oracle="select n_rows, n_labels from fx_shape")
def scan_sparse_matrix(t):
    """The header of a written sparse matrix file -> one-row shape table."""
    path = IO.scratch_path(t.spark, "tst_X_Y.txt")
    IO.write_sparse_matrix(fx.xy(t), fx.docs(t), t("part").count(), path)
    _, header = IO.read_sparse_matrix(t.spark, path)
    return header


@job("scan_filter_pairs", oracle="select q_id, label_id from fx_filter")
def scan_filter_pairs(t):
    """Filter pairs written as space separated integers and read back."""
    path = IO.scratch_path(t.spark, "filter_labels_test.txt")
    IO.write_pairs(fx.filter_pairs(t), path)
    return IO.read_filter_pairs(t.spark, path)


@job("scan_id_map", oracle="""
select row_number() over (order by p_partkey) - 1 as row_id, cast(p_partkey as varchar) as id from part""")
def scan_id_map(t):
    """``id->title`` lines; the id is the trimmed text before the arrow."""
    path = IO.scratch_path(t.spark, "label.raw.txt")
    lines = t("part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(" ->"), F.col("p_name")).alias("text"))
    IO.write_lines(lines, path, "p_partkey", "text")
    return IO.read_id_map(t.spark, path)


@job("scan_id_url", oracle="select cast(page_id as varchar) as id, url from pages")
def scan_id_url(t):
    """Tab separated id/url file."""
    path = IO.scratch_path(t.spark, "urls.tsv")
    t("pages").select(F.col("page_id").cast("string"), "url").write.mode("overwrite").option("sep", "\t").csv(path)
    return IO.read_id_url(t.spark, path)


@job("scan_parquet", oracle="select cast(page_id as varchar) as id, url from pages")
def scan_parquet(t):
    """Parquet (id, url) scan of every row; the projection reaches the reader."""
    return t("pages").select(F.col("page_id").cast("string").alias("id"), "url")


def _write_splits(t):
    path = IO.scratch_path(t.spark, "embeddings")
    e = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    splits = F.explode(F.array(F.lit("lbl"), F.lit("trn"), F.lit("tst")))
    IO.write_embeddings(e.select("id", "embedding", splits.alias("split")), path)
    return path


@job("embedding_roundtrip", oracle="""
select 'tst' as split, id, cast(dim as bigint) as dim, round(x::double, 6) as value
from (select vec_id as id, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding) as x from embeddings)""")
def embedding_roundtrip(t):
    """Embeddings saved per split as parquet and the test split loaded back."""
    df = IO.read_embeddings(t.spark, _write_splits(t), only=["tst"])
    return df.select("split", "id", F.posexplode("embedding").alias("p", "x")).select(
        "split", "id", (F.col("p") + 1).cast("long").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("value"))


@job("split_pruning", oracle="select 'trn' as split, count(*) as n_rows from embeddings")
def split_pruning(t):
    """Only the requested split is read (partition filter)."""
    return IO.split_row_counts(IO.read_embeddings(t.spark, _write_splits(t), only=["trn"]))


@job("split_row_counts", oracle="""
select s.split, count(*) as n_rows from embeddings, (select unnest(['lbl', 'trn', 'tst']) as split) s group by s.split""")
def split_row_counts(t):
    """Row count per split."""
    return IO.split_row_counts(IO.read_embeddings(t.spark, _write_splits(t)))


@job("asset_table", oracle=f"""
select row_number() over (order by page_id // {fx.URLS_PER_OWNER_BLOCK}, page_id) - 1 as asset_id,
       page_id // {fx.URLS_PER_OWNER_BLOCK} as owner_id, page_id as ord, md5(to_base64(encode(html))) as payload_md5,
       cast(octet_length(encode(html)) as bigint) as n_bytes
from pages""")
def asset_table(t):
    """base64 payload table with a running asset index (pages' html as the blobs)."""
    blobs = t("pages").select(F.expr(f"page_id div {fx.URLS_PER_OWNER_BLOCK}").alias("owner_id"),
                              F.col("page_id").alias("ord"), F.encode("html", "UTF-8").alias("bytes"))
    table = IO.decode_payload(IO.build_asset_table(blobs))
    return table.select("asset_id", "owner_id", "ord", F.md5("payload").alias("payload_md5"),
                        F.octet_length("bytes").cast("long").alias("n_bytes"))


def _history_sql() -> str:
    from xmcforge.plans import jobs_core as C
    from xmcforge.plans import oracle_text as O
    parts = []
    for epoch, mode in ((1, "after"), (2, "before")):
        rep = O.metrics_sql(O.topk_sql(C.K, exclude_view="fx_filter", mode=mode), "fx_truth", "fx_query", C.KS,
                            metrics=["P"])
        cols = ", ".join(f'max(case when k = {k} then value end) as "P@{k}"' for k in C.KS)
        parts.append(f"select {epoch}::bigint as epoch, {cols} from ({rep})")
    return " union all ".join(parts)


@job("metrics_history", oracle=_history_sql())
def metrics_history(t):
    """Two evaluation rounds (filter after / before top-k) appended to a history table,
    read back wide with one P@k column per cut-off."""
    from xmcforge.plans import jobs_core as C
    path = IO.scratch_path(t.spark, "metrics_history")
    for epoch, mode in ((1, "after"), (2, "before")):
        rep = C.M.metrics_report(C.predictions(t, C.K, mode), fx.truth(t), fx.queries(t), C.KS)
        IO.append_metrics(rep, path, epoch)
    return IO.metrics_wide(t.spark, path, "P", C.KS)


# ------------------------------------------------------------------ text
@job("compose_text", oracle=f"""
select row_id, trim(coalesce(title, 'None') || ' ' || coalesce(content, 'None'), {PY_STRIP_CHARS}) as text
from fx_label_text""")
def compose_text(t):
    """Title and content joined by a space and stripped."""
    return TX.compose_text(fx.label_text(t), TX.fields_for("orders-corpus")).select("row_id", "text")


@job("build_vocab", oracle=VOCAB_SQL)
def build_vocab(t):
    """Vocabulary of the whole document corpus ranked by frequency."""
    return TX.build_vocab(fx.doc_text(t))


@job("tokenize_ids", oracle=f"""
with s as ({TOKEN_IDS_SQL})
select row_id, cast(unnest(range(0, len(ids))) as bigint) as pos, unnest(ids) as token_id from s""")
def tokenize_ids(t):
    """Every document's full token id sequence with BOS/EOS, long form (row_id, pos, token_id)."""
    corpus = fx.doc_text(t)
    return TX.id_sequence(corpus, TX.build_vocab(corpus)).select("row_id", "pos", "token_id")


PAD_SQL = f"""
with s as ({TOKEN_IDS_SQL}),
c as (select row_id, case when len(ids) > {MAX_LEN} then ids[1:{MAX_LEN - 1}] || [ids[len(ids)]] else ids end as cut from s)
select row_id, cast(p as bigint) as pos,
       case when p < len(cut) then cut[p + 1] else {TX.PAD_ID} end as input_id,
       cast(case when p < len(cut) then 1 else 0 end as bigint) as mask
from c, (select unnest(range(0, {MAX_LEN})) as p) r"""


@job("pad_and_mask", oracle=PAD_SQL)
def pad_and_mask(t):
    """Truncate to 32 (EOS kept), right pad, attention mask; long form."""
    corpus = fx.doc_text(t)
    padded = TX.pad_and_mask_long(TX.id_sequence(corpus, TX.build_vocab(corpus), max_len=MAX_LEN), MAX_LEN)
    z = F.arrays_zip("input_ids", "attention_mask")
    return padded.select("row_id", F.posexplode(z).alias("pos", "z")).select(
        "row_id", F.col("pos").cast("long"), F.col("z.input_ids").alias("input_id"),
        F.col("z.attention_mask").alias("mask"))


def _label_sequences(t):
    corpus = TX.compose_text(fx.label_text(t), ["title"])
    return TX.pad_and_mask_long(TX.id_sequence(corpus, TX.build_vocab(corpus), max_len=LABEL_MAX_LEN), LABEL_MAX_LEN)


SUFFIX_ID = 7   # any id for the suffix segment
ASSEMBLE_SQL = f"""
with v as (select token, row_number() over (order by count desc, token) - 1 + {TX.FIRST_TOKEN_ID} as token_id
           from (select token, count(*) as count from (select unnest({_tok('title')}) as token from fx_label_text) group by token)),
tp as (select row_id, unnest(generate_series(1, len({_tok('title')}))) as pos, {_tok('title')} as toks from fx_label_text),
tk as (select tp.row_id, tp.pos, coalesce(v.token_id, {TX.UNK_ID}) as token_id from tp left join v on v.token = tp.toks[tp.pos]),
seq as (select d.row_id, [{TX.BOS_ID}] || coalesce(list(tk.token_id order by tk.pos) filter (where tk.pos is not null), []) || [{TX.EOS_ID}] as ids
        from fx_label_text d left join tk on tk.row_id = d.row_id group by d.row_id),
cut as (select row_id, case when len(ids) > {LABEL_MAX_LEN} then ids[1:{LABEL_MAX_LEN - 1}] || [ids[len(ids)]] else ids end as c from seq),
txt as (select row_id, cast(p as bigint) as p, case when p < len(c) then c[p + 1] else 0 end as id,
               case when p < len(c) then 1 else 0 end as m from cut, (select unnest(range(0, {LABEL_MAX_LEN})) as p) r),
slots as (select owner_id, asset_id, row_number() over (partition by owner_id order by asset_id) - 1 as slot from fx_asset),
img as (select o.owner_id as row_id, s.p, coalesce(a.asset_id, -1) as id, case when a.asset_id is null then 0 else 1 end as m
        from fx_owner o join (select unnest(range(0, {NUM_IMGS})) as p) s on true
        left join slots a on a.owner_id = o.owner_id and a.slot = s.p),
parts as (select row_id, 0 as p, {TX.BOS_ID} as id, 1 as m, 'img_prefix' as segment from fx_label_text
          union all select row_id, p, id, m, 'img' from img
          union all select row_id, 0, {TX.EOS_ID}, 1, 'txt_prefix' from fx_label_text
          union all select row_id, p, id, m, 'text' from txt
          union all select row_id, p, {SUFFIX_ID}, 1, 'suffix' from fx_label_text, (select unnest(range(0, 2)) as p) r)"""


def _assemble_sql(*layout: str) -> str:
    order = " ".join(f"when '{s}' then {i}" for i, s in enumerate(layout))
    kept = ", ".join(f"'{s}'" for s in layout)
    return ASSEMBLE_SQL + f"""
select row_id, cast(row_number() over (partition by row_id order by case segment {order} end, p) - 1 as bigint) as pos,
       cast(id as bigint) as seq_id, cast(m as bigint) as seq_mask, segment from parts where segment in ({kept})"""


@job("assemble_sequence", oracle=_assemble_sql("img_prefix", "img", "txt_prefix", "text"))
def assemble_sequence(t):
    """image_text layout = [BOS] + 3 image slots + [EOS] + 8 text ids, masks in parallel."""
    return _assemble(t, "image_text", img_prefix=[TX.BOS_ID], txt_prefix=[TX.EOS_ID])


@job("assemble_text_image", oracle=_assemble_sql("txt_prefix", "text", "img_prefix", "img", "suffix"))
def assemble_text_image(t):
    """text_image layout with a suffix of two ids."""
    return _assemble(t, "text_image", img_prefix=[TX.BOS_ID], txt_prefix=[TX.EOS_ID], suffix=[SUFFIX_ID] * 2)


@job("assemble_text", oracle=_assemble_sql("txt_prefix", "text", "suffix"))
def assemble_text(t):
    """Text layout, no image segment."""
    return _assemble(t, "text", txt_prefix=[TX.EOS_ID], suffix=[SUFFIX_ID] * 2)


@job("assemble_encoder", oracle=_assemble_sql("img", "text"))
def assemble_encoder(t):
    """Encoder layout, image slots then text, no prefixes."""
    return _assemble(t, "encoder")


def _assemble(t, order, **prefixes):
    text = _label_sequences(t)
    slots = AS.image_slots(fx.owners(t), fx.assets(t), NUM_IMGS)
    img = slots.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("slot", "asset_id", "mask"))).alias("a"))
    img = img.select(F.col("owner_id").alias("row_id"), F.col("a.asset_id").alias("img_ids"), F.col("a.mask").alias("img_mask"))
    both = text.join(img, "row_id")
    seq = TX.assemble_sequence(both, order, text_ids="input_ids", text_mask="attention_mask",
                               img_ids="img_ids", img_mask="img_mask", **prefixes)
    z = F.arrays_zip("seq_ids", "seq_mask", "seq_segment")
    return seq.select("row_id", F.posexplode(z).alias("pos", "z")).select(
        "row_id", F.col("pos").cast("long"), F.col("z.seq_ids").alias("seq_id"), F.col("z.seq_mask").alias("seq_mask"),
        F.col("z.seq_segment").alias("segment"))


@job("dense_row_id", oracle="select doc_id, row_number() over (order by source, doc_id) - 1 as row_id from documents")
def dense_row_id(t):
    """Dense ids in (source, doc_id) order without a single-partition window."""
    d = t("documents").select("doc_id", "source")
    return dist_rank(d, ["source", "doc_id"], rank_col="r").select("doc_id", (F.col("r") - 1).alias("row_id"))


@job("ingest_corpus", oracle="""
with rec as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as row_id,
                    trim(o_orderpriority || ' ' || o_orderstatus) as text from orders),
xy as (select distinct l_orderkey, l_partkey from lineitem)
select r.row_id, r.text, xy.l_partkey as label_id from rec r left join xy on xy.l_orderkey = r.o_orderkey""")
def ingest_corpus(t):
    """C14: JSON corpus -> composed text + line ids -> raw text and X_Y files -> read back."""
    spark = t.spark
    corpus = IO.read_jsonl(spark, _write_corpus(t))
    texts = TX.compose_text(corpus, TX.fields_for("orders-corpus"))
    raw_path, xy_path = IO.scratch_path(spark, "trn.raw.txt"), IO.scratch_path(spark, "trn_X_Y.txt")
    IO.write_lines(texts, raw_path, "row_id", "text")
    xy = texts.select(F.col("row_id").alias("doc_id"), F.explode("target_ind").alias("label_id"),
                      F.lit(1.0).alias("value"))
    n_labels = texts.select(F.explode("target_ind").alias("l")).agg(F.max("l")).first()[0]
    IO.write_sparse_matrix(xy, texts.select(F.col("row_id").alias("doc_id")), int(n_labels or -1) + 1, xy_path)
    lines = IO.read_lines(spark, raw_path, encoding="UTF-8")
    body, _ = IO.read_sparse_matrix(spark, xy_path)
    return lines.join(body.select(F.col("doc_id").alias("row_id"), "label_id"), "row_id", "left").select(
        "row_id", "text", "label_id")


# ------------------------------------------------------------------ assets
@job("left_join_assets", oracle="""
select o.owner_id, u.ord, u.url from (select distinct owner_id from fx_owner) o left join fx_url u on u.owner_id = o.owner_id""")
def left_join_assets(t):
    """Owners left joined with their URLs."""
    return AS.left_join_assets(fx.owners(t), fx.urls(t))


@job("valid_url_filter", oracle=r"select owner_id, ord, url from fx_url where regexp_matches(url, '^https?://')")
def valid_url_filter(t):
    """Keep http(s) URLs."""
    return AS.valid_url_filter(fx.urls(t))


@job("urls_per_owner", oracle="select owner_id, row_number() over (partition by owner_id order by ord) - 1 as pos, url from fx_url")
def urls_per_owner(t):
    """Each owner's URLs as an ordered list in long form (owner_id, pos, url)."""
    return AS.urls_per_owner(fx.urls(t))


@job("asset_slot_number", oracle="""
select asset_id, owner_id, row_number() over (partition by owner_id order by asset_id) - 1 as slot from fx_asset""")
def asset_slot_number(t):
    """Position of each asset in its owner's list."""
    return AS.asset_slot_number(fx.assets(t).select("asset_id", "owner_id"))


@job("image_slots", oracle=f"""
with s as (select owner_id, asset_id, row_number() over (partition by owner_id order by asset_id) - 1 as slot from fx_asset)
select o.owner_id, cast(g.slot as bigint) as slot, coalesce(s.asset_id, -1) as asset_id,
       cast(case when s.asset_id is null then 0 else 1 end as bigint) as mask
from (select distinct owner_id from fx_owner) o join (select unnest(range(0, {NUM_IMGS})) as slot) g on true
left join s on s.owner_id = o.owner_id and s.slot = g.slot""")
def image_slots(t):
    """First 3 assets per owner, padded, with mask, for every owner."""
    return AS.image_slots(fx.owners(t), fx.assets(t), NUM_IMGS)


@job("image_slot_vectors", oracle=f"""
with s as (select owner_id, embedding, row_number() over (partition by owner_id order by asset_id) - 1 as slot from fx_asset),
w as (select max(len(embedding)) as dim from fx_asset),
g as (select o.owner_id, g.slot, d.dim from (select distinct owner_id from fx_owner) o
      join (select unnest(range(0, {NUM_IMGS})) as slot) g on true join (select unnest(range(1, 1 + (select dim from w))) as dim) d on true)
select g.owner_id, cast(g.slot as bigint) as slot, cast(g.dim as bigint) as dim,
       round(coalesce(s.embedding[g.dim], 0.0), 6) as value, cast(case when s.owner_id is null then 0 else 1 end as bigint) as mask
from g left join s on s.owner_id = g.owner_id and s.slot = g.slot""")
def image_slot_vectors(t):
    """The slots' vectors (zero where a slot is empty) and masks as arrays per owner, one row
    per component."""
    dim = t("embeddings").agg(F.max(F.size("embedding"))).first()[0]
    slots = AS.slots_as_arrays(AS.image_slots(fx.owners(t), fx.assets(t), NUM_IMGS, vec_col="embedding"), int(dim))
    each = slots.select("owner_id", "mask", F.posexplode("slots").alias("slot", "v"))
    return each.select("owner_id", F.col("slot").cast("long").alias("slot"), F.element_at("mask", F.col("slot") + 1).alias("mask"),
                       F.posexplode("v").alias("p", "x")).select(
        "owner_id", "slot", (F.col("p") + 1).cast("long").alias("dim"), F.round("x", 6).alias("value"), "mask")


@job("ingest_assets", oracle=f"""
with v as (select u.owner_id, u.ord, u.url from (select distinct owner_id from fx_owner) o
           join fx_url u on u.owner_id = o.owner_id where regexp_matches(u.url, '^https?://')),
s as (select owner_id, url, row_number() over (partition by owner_id order by ord) - 1 as slot from v)
select o.owner_id, cast(g.slot as bigint) as slot, s.url, cast(case when s.url is null then 0 else 1 end as bigint) as mask
from (select distinct owner_id from fx_owner) o join (select unnest(range(0, {NUM_IMGS})) as slot) g on true
left join s on s.owner_id = o.owner_id and s.slot = g.slot""")
def ingest_assets(t):
    """Owners -> URLs -> valid -> ordered -> 3 slots with mask."""
    return AS.ingest_assets(fx.owners(t), fx.urls(t), NUM_IMGS)
