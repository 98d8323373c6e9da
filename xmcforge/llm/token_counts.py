"""Token counts of whole texts (lengths only).

Texts reach the tokenizer as Arrow slices balanced by bytes.  Every text is split at ASCII white
space, which is a safe boundary for a tokenizer that drops white space: no token spans it, no
normal form composes across it and no special string contains it.  Each distinct word of a slice
is encoded once; a text's count is the sum over its words.  Nothing but counts leaves the worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmcforge.llm.common import SLICE_BYTES, slices, sums_by, table, with_fields, words_of
from xmcforge.llm.registry import query

# Encoded words remembered per task, and characters handed to one encoder call.
CACHE_WORDS = 1_000_000
CALL_CHARS = 1 << 20


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text",
                 slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Append ``n_bytes`` (UTF-8) and ``n_tokens`` of every text; other columns pass through.

    ``model_path`` names a ``tokenizers`` file whose pre-tokenizer drops white space (it must be
    readable on the executors).  Null and empty texts have 0 bytes and 0 tokens.  Equal rows get
    equal counts.  Existing columns named ``n_bytes`` or ``n_tokens`` are replaced.  No shuffle:
    one pass over the input splits, bounded by ``slice_bytes`` plus the longest single text."""
    kept, schema = with_fields(df, [("n_bytes", T.LongType()), ("n_tokens", T.LongType())])

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(model_path)
        known: dict[str, int] = {}

        def learn(words: list[str]) -> None:
            if len(known) + len(words) > CACHE_WORDS:
                known.clear()
            call: list[str] = []
            chars = 0
            for w in words:
                call.append(w)
                chars += len(w)
                if chars >= CALL_CHARS:
                    known.update(zip(call, map(len, tok.encode_batch_fast(call, add_special_tokens=False))))
                    call, chars = [], 0
            known.update(zip(call, map(len, tok.encode_batch_fast(call, add_special_tokens=False))))

        for batch in batches:
            for part in slices(batch, text_col, slice_bytes):
                text = part.column(text_col)
                flat, offsets = words_of(text)
                coded = flat.dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                missing = [w for w in distinct if w not in known]
                if missing:
                    learn(missing)
                    if any(w not in known for w in distinct):  # the memory was emptied meanwhile
                        learn([w for w in distinct if w not in known])
                each = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
                counts = sums_by(each[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.int64), offsets)
                n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, n_bytes, pa.array(counts)],
                                                 names=[*part.schema.names, "n_bytes", "n_tokens"])

    return kept.mapInArrow(run, schema)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document under word_bpe_49k.json; over_limit: more than 2048."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
