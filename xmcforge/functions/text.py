"""Text -> id sequences (P01-P06), all in native expressions.

The vocabulary re-aims the reference's pretrained subword tokenizer: lower-cased runs of
letters/digits, ranked by corpus frequency.  Special ids are fixed values below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xmcforge.plans.partitioning import spread_if_small
from xmcforge.plans.ranking import dist_rank

# Fixed special token ids (our own vocabulary layout).
PAD_ID = 0
UNK_ID = 1
BOS_ID = 2
EOS_ID = 3
FIRST_TOKEN_ID = 4

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Characters removed by Python's str.strip() (Unicode whitespace plus the separators 0x1c-0x1f).
STRIP_CLASS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Broadcast the vocabulary only under this many entries (about 40 bytes each).
VOCAB_BROADCAST_ROWS = 2_000_000


def py_strip(c: Column) -> Column:
    """Remove leading/trailing whitespace like Python ``str.strip()``."""
    return F.regexp_replace(c, rf"^{STRIP_CLASS}+|{STRIP_CLASS}+$", "")


def compose_text(df: DataFrame, fields: Sequence[str], out: str = "text") -> DataFrame:
    """Fields joined by one space, then stripped; a null field prints as 'None' like
    the reference's f-string (so the column count never shifts)."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields]
    return df.withColumn(out, py_strip(F.concat_ws(" ", *parts)))


def fields_for(dataset_name: str) -> list[str]:
    """Title only when the dataset name says 'title', else title and content."""
    return ["title"] if "title" in dataset_name.lower() else ["title", "content"]


def tokens(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def build_vocab(corpus: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """(token, count, token_id) ranked by (count desc, token); ids start after specials."""
    counts = (spread_if_small(corpus.select(text_col), key=text_col).select(F.explode(tokens(text_col)).alias("token"))
                    .groupBy("token").agg(F.count(F.lit(1)).alias("count"))
                    .where(F.col("count") >= min_count))
    ranked = dist_rank(counts, [F.col("count").desc(), F.col("token").asc()], rank_col="r")
    return ranked.select("token", F.col("count").cast("long").alias("count"),
                         (F.col("r") - 1 + FIRST_TOKEN_ID).cast("long").alias("token_id"))


def _vocab_side(vocab: DataFrame) -> DataFrame:
    v = vocab.select("token", "token_id")
    n = vocab.count()
    return F.broadcast(v) if n <= VOCAB_BROADCAST_ROWS else v


def id_sequence(corpus: DataFrame, vocab: DataFrame, id_col: str = "row_id", text_col: str = "text",
                max_len: int | None = None) -> DataFrame:
    """P03 in long form: (row_id, pos, token_id, n_ids) with BOS at 0, the whole text's tokens
    at 1..n and EOS at n + 1; ``n_ids`` = n + 2.  No regrouping: a document's rows come from one
    ``posexplode`` (of its token array framed by two null slots for BOS/EOS) and its length from
    ``size`` of the same array, so the text is tokenized once and even a document holding a
    large share of the corpus is never gathered into one value.

    ``max_len`` cuts the sequence before its tokens become rows: BOS, the first ``max_len`` - 2
    tokens, EOS (truncation that keeps the closing EOS); ``n_ids`` counts what is left."""
    toks = tokens(text_col)
    if max_len is not None:
        toks = F.slice(toks, 1, max(0, max_len - 2))
    framed = F.concat(F.array(F.lit(None).cast("string")), toks, F.array(F.lit(None).cast("string")))
    # the framed array is never empty; the outer form keeps the optimizer from adding a filter
    # that would tokenize the text again below the generator
    rows = (spread_if_small(corpus.select(id_col, text_col), key=id_col).select(id_col, framed.alias("_t"))
                  .select(id_col, F.size("_t").cast("long").alias("n_ids"), F.posexplode_outer("_t").alias("pos", "token")))
    # BOS and EOS meet no vocabulary entry; their join keys spread by row instead of being one null
    rows = rows.withColumn("token", F.coalesce("token", F.concat(F.lit("\u0000"), F.col(id_col).cast("string"))))
    tid = (F.when(F.col("pos") == 0, F.lit(BOS_ID))
             .when(F.col("pos") == F.col("n_ids") - 1, F.lit(EOS_ID))
             .otherwise(F.coalesce("token_id", F.lit(UNK_ID))).cast("long"))
    return (rows.join(_vocab_side(vocab), "token", "left")
                .select(id_col, F.col("pos").cast("long").alias("pos"), tid.alias("token_id"), "n_ids"))


def tokenize(corpus: DataFrame, vocab: DataFrame, id_col: str = "row_id", text_col: str = "text",
             add_special: bool = True) -> DataFrame:
    """P03 as one array per text: (row_id, ids array<bigint>) with BOS/EOS around the whole
    text's token ids.  Texts without tokens keep their row (BOS, EOS only).  Prefer
    ``id_sequence`` (long form) for very long texts; this builds one array per document."""
    seq = id_sequence(corpus, vocab, id_col, text_col)
    if not add_special:
        seq = seq.where((F.col("pos") > 0) & (F.col("pos") < F.col("n_ids") - 1))
    seqs = seq.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("s"))
    return seqs.select(id_col, F.col("s.token_id").alias("ids"))


def pad_and_mask_long(seq: DataFrame, max_len: int, id_col: str = "row_id", pad_id: int = PAD_ID,
                      side: str = "right") -> DataFrame:
    """P04 from the long form: truncate to ``max_len`` keeping the closing EOS (as a tokenizer
    with truncation does), pad, and mask.  Only the ids that survive truncation are grouped,
    so every array holds at most ``max_len`` values."""
    n = F.col("n_ids")
    last = F.col("pos") == n - 1
    kept = seq.where((F.col("pos") < F.lit(max_len - 1)) | last).withColumn(
        "pos", F.when(last, F.least(n, F.lit(max_len)) - 1).otherwise(F.col("pos")))
    arr = kept.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("s"))
    return pad_and_mask(arr.select(id_col, F.col("s.token_id").alias("ids")), max_len, pad_id=pad_id, side=side)


def pad_and_mask(seqs: DataFrame, max_len: int, ids_col: str = "ids", pad_id: int = PAD_ID,
                 side: str = "right", keep_eos: bool = True) -> DataFrame:
    """Truncate to ``max_len`` (keeping the closing EOS like a tokenizer with truncation),
    pad with ``pad_id`` on ``side``; ``attention_mask`` is 1 on real positions."""
    ids = F.col(ids_col)
    n = F.size(ids)
    if keep_eos:
        cut = F.when(n > max_len, F.concat(F.slice(ids, 1, max_len - 1), F.slice(ids, -1, 1))).otherwise(ids)
    else:
        cut = F.slice(ids, 1, max_len)
    real = F.size(cut)
    pad = F.array_repeat(F.lit(pad_id).cast("long"), F.lit(max_len) - real)
    ones = F.array_repeat(F.lit(1).cast("long"), real)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(max_len) - real)
    if side == "right":
        input_ids, mask = F.concat(cut, pad), F.concat(ones, zeros)
    elif side == "left":
        input_ids, mask = F.concat(pad, cut), F.concat(zeros, ones)
    else:
        raise ValueError("side must be 'right' or 'left'")
    return seqs.withColumn("input_ids", input_ids).withColumn("attention_mask", mask)


def clip_batch_lengths(df: DataFrame, max_len: int, batch_col: str = "batch_id", ids_col: str = "input_ids",
                       mask_col: str = "attention_mask") -> DataFrame:
    """Cut ids and mask of every row to min(max mask sum in its batch, max_len)."""
    from pyspark.sql import Window
    msum = F.aggregate(F.col(mask_col), F.lit(0).cast("long"), lambda a, x: a + x)
    w = Window.partitionBy(batch_col)
    clip = F.least(F.max(msum).over(w), F.lit(max_len)).cast("int")
    return (df.withColumn("_clip", clip)
              .withColumn(ids_col, F.slice(F.col(ids_col), 1, F.col("_clip")))
              .withColumn(mask_col, F.slice(F.col(mask_col), 1, F.col("_clip"))).drop("_clip"))


ORDERS = ("image_text", "text_image", "text", "encoder")


def assemble_sequence(df: DataFrame, order: str, *, text_ids: str, text_mask: str, img_ids: str | None = None,
                      img_mask: str | None = None, img_prefix: Sequence[int] = (), txt_prefix: Sequence[int] = (),
                      suffix: Sequence[int] = ()) -> DataFrame:
    """Concatenate segments in the configured order with a parallel mask.

    image_text = img_prefix, img, txt_prefix, text, suffix; text_image = txt_prefix, text,
    img_prefix, img, suffix; text = txt_prefix, text, suffix; encoder = img, text.
    Empty segments disappear; any other order is an error (checked before planning)."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}; expected one of {ORDERS}")
    if order != "text" and (img_ids is None or img_mask is None):
        raise ValueError(f"order {order!r} needs an image segment")

    def lit_seg(vals):
        ids = F.array(*[F.lit(int(v)).cast("long") for v in vals]) if vals else F.array().cast("array<bigint>")
        mask = F.array(*[F.lit(1).cast("long") for _ in vals]) if vals else F.array().cast("array<bigint>")
        return ids, mask

    segs = {"img_prefix": lit_seg(img_prefix), "txt_prefix": lit_seg(txt_prefix), "suffix": lit_seg(suffix),
            "text": (F.col(text_ids), F.col(text_mask))}
    if img_ids is not None:
        segs["img"] = (F.col(img_ids), F.col(img_mask))
    layout = {"image_text": ["img_prefix", "img", "txt_prefix", "text", "suffix"],
              "text_image": ["txt_prefix", "text", "img_prefix", "img", "suffix"],
              "text": ["txt_prefix", "text", "suffix"],
              "encoder": ["img", "text"]}[order]
    ids = F.concat(*[segs[s][0] for s in layout])
    mask = F.concat(*[segs[s][1] for s in layout])
    seg_names = F.concat(*[F.array_repeat(F.lit(s), F.size(segs[s][0])) for s in layout])
    return df.withColumn("seq_ids", ids).withColumn("seq_mask", mask).withColumn("seq_segment", seg_names)
