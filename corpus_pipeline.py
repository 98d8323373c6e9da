"""A training corpus from ``documents``: toxic texts go, near copies and repeated passages go,
sources are mixed to target weights and what is left is packed into sequences.

``STAGES`` names the stages in order.  Each takes (spark, docs, sf_dir), works on every row of
``docs`` and returns a DataFrame; all but the last return the columns of ``docs``.  Null and empty
texts pass every filter, rows that repeat a doc_id are the same document, and further columns pass
through.
"""

from __future__ import annotations

import os
import sys

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmcforge.llm import jaccard, mixing, packing, substrings, toxicity
from xmcforge.llm.common import free_name, table, written

# The stages of this module follow no single expression that DuckDB could run.
ORACLE_SQL = None
WEIGHTS = (5, 2, 1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject (score below 0.5)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.fit(toxicity.fit_sample(docs.select("doc_id", "text"), labels))
    score = free_name(docs.columns, "_toxicity")
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates (5-word shingles, 0.8)."""
    classes = jaccard.near_duplicates(docs, 5, 80)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; a text with nothing left goes."""
    ranges = free_name(docs.columns, "_cut")
    cut = substrings.drop_repeats(docs, ranges_col=ranges)
    cut = cut.where((F.size(ranges) == 0) | (F.length(F.trim("text")) > 0)).drop(ranges)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs, WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, packed into sequences."""
    import public_tokenizers
    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
