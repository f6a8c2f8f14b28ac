"""Vector measures on arrays of numbers, inside the JVM, and vectors as bytes, by Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def _fold(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    """Inner product, computed in double."""
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null if a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit_score(cos: Column) -> Column:
    """A cosine as a score from 0 to 1."""
    return (F.lit(1.0) + cos) / 2


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two points."""
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean}


def packed(vectors: Column) -> Column:
    """A vector as little-endian 32-bit floats on end; null if null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(run, BinaryType())(vectors)


def unpacked(data: Column) -> Column:
    """The vector of ``packed`` bytes; null if null or no whole number of floats."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return F.pandas_udf(run, ArrayType(FloatType()))(data)
