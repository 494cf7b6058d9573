"""Vectors as whole numbers: which rows are usable, and their components scaled, floored and padded."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components; never null."""
    v = vector.cast("array<double>")
    ok = vector.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok, F.lit(False))


@dataclass(frozen=True)
class Extent:
    """Rows, longest vector and largest floored component of a table of vectors."""

    rows: int
    length: int
    largest: int


def extent(vectors: DataFrame, vector_col: str, scale: int) -> Extent:
    v = F.col(vector_col).cast("array<double>")
    top = F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0))
    row = vectors.agg(F.count("*"), F.coalesce(F.max(F.size(v)), F.lit(0)), F.coalesce(F.max(top), F.lit(0.0))).first()
    return Extent(int(row[0]), int(row[1]), int(min(row[2] * scale + 1, 2.0**62)))


def held(width: int) -> int:
    """Components further out than this are held there, so that sums of ``width`` squared differences fit in a long."""
    return int(np.sqrt(2.0**60 / max(1, width)))


def whole(column: pa.Array, scale: int, length: int, bound: int) -> np.ndarray:
    """Rows of floor(scale * component) as 64-bit integers; short rows are padded with zeros."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    sizes = np.asarray([len(x) for x in column], np.int64)
    out = np.zeros((len(column), length), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = np.clip(np.floor(flat * scale), -bound, bound).astype(np.int64)
    return out


def exact_type(largest: int, width: int) -> type:
    """float64 where sums of ``width`` products of such numbers are exact in it, else int64."""
    return np.float64 if 4.0 * width * float(largest) ** 2 < 2.0**53 else np.int64
