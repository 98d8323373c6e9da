"""Column expressions over ``array<float|double>`` embeddings (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sq_norm(v: str | Column) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(v: str | Column) -> Column:
    return F.sqrt(sq_norm(v))


def l2_normalize(v: str | Column) -> Column:
    """``x / ||x||``; a zero vector stays zero."""
    v = _c(v)
    # the norm is bound once per row as an outer lambda's variable; inside the element's
    # lambda it would be folded again for every element
    return F.transform(F.array(norm(v)), lambda n: F.transform(
        v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))[0]


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product in double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def add(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))


def similarity_mask(sim: str | Column, threshold: float = 0.98) -> Column:
    """1.0 where ``sim >= threshold`` else 0.0."""
    return (_c(sim) >= F.lit(threshold)).cast("double")


def similarity_bucket(sim: str | Column) -> Column:
    """``1 + int(100 * (1 - sim))``."""
    return (F.lit(1) + (F.lit(100.0) * (F.lit(1.0) - _c(sim))).cast("long")).cast("long")


def _flat(col, n: int):
    import numpy as np
    if n == 0:
        return np.zeros((0, 0))
    arr = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, flat.size // n)


def dot_difference(df, v: str, a: str, b: str, out: str, keep):
    """``v.a - v.b`` per row, vectorized over Arrow batches (``mapInArrow``).

    Replaces two element-wise higher-order-function folds per row.  Each dot is summed
    left to right (``cumsum``), the same order as the native ``aggregate`` fold, so results
    are bit-identical to it.  ``keep`` columns pass through unchanged."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    fields = [df.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())]
    schema = T.StructType(fields)

    def run(batches):
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            vm, am, bm = (_flat(rb.column(rb.schema.get_field_index(c)), n) for c in (v, a, b))
            da = np.cumsum(vm * am, axis=1)[:, -1] if vm.size else np.zeros(n)
            db = np.cumsum(vm * bm, axis=1)[:, -1] if vm.size else np.zeros(n)
            d = da - db
            cols = [rb.column(rb.schema.get_field_index(c)) for c in keep] + [pa.array(d, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=list(keep) + [out])
    return df.select(*keep, v, a, b).mapInArrow(run, schema)
