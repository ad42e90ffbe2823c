"""What the vector operators share: which vectors take part, and matrices from Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """Rows with an id and a vector without null or non-finite components."""
    fine = f"vec_id IS NOT NULL AND {name} IS NOT NULL AND size({name}) > 0 AND forall({name}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return vectors.filter(F.expr(fine))


def matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """A row for each list, in double precision; short ones are filled up with zeros, long ones cut at ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    widest = int(size.max()) if len(size) else 0
    if len(size) and (size == widest).all():
        out = flat.reshape(len(size), widest)
    else:
        out = np.zeros((len(size), widest))
        out[np.arange(widest) < size[:, None]] = flat
    if width is None or width == widest:
        return out
    return out[:, :width] if width < widest else np.pad(out, ((0, 0), (0, width - widest)))
