"""Packed embedding rows shared by the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, small_batches


def packed_vectors(rows: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vec, dim): each row's vector as packed floats of the column's own width (see vector_kind); null where it is null,
    empty, zero or holds a null or non-finite component. Repeated rows stay; other columns play no part."""
    small_batches(rows.sparkSession)
    kind = vector_kind(rows, embedding)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims = [], []
            for v in batch.column(1):
                x = None
                if v.is_valid and len(v) and v.values.null_count == 0:
                    x = np.asarray(v.values, np.float64)
                ok = x is not None and np.isfinite(x).all() and x.any()
                vectors.append(x.astype(kind).tobytes() if ok else None)
                dims.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary()), pa.array(dims, pa.int32())], ["id", "vec", "dim"])

    return columns(rows, id=key, e=embedding).withColumn("id", F.col("id").cast("long")).mapInArrow(pack, "id long, vec binary, dim int")


def vector_kind(rows: DataFrame, embedding: str = "embedding") -> str:
    """How a packed component is stored: 32-bit floats stay so, since they widen exactly; anything else is 64-bit."""
    element = rows.schema[rows.columns.index(embedding)].dataType.elementType
    return "<f4" if isinstance(element, T.FloatType) else "<f8"


def stack(column: pa.ChunkedArray | pa.Array, dim: int, kind: str) -> np.ndarray:
    """Packed vectors as rows of 64-bit floats."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
