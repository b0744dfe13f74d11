"""Vector columns: validity, exact classes of equal vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column whose rows have one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = []
        for v in batch.column(1):
            key = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all() and x.any():
                    key = hashlib.sha256((x + 0.0).tobytes()).digest()
            keys.append(key)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["id", "vec", "key"])


def keyed(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec, key``: SHA-256 of the components (-0.0 as 0.0); null for vectors that are null, empty, zero or hold null or non-finite components."""
    kinds = dict(embeddings.dtypes)
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    return rows.mapInArrow(_keyed, f"id {kinds[id_col]}, vec {kinds[vec_col]}, key binary")
