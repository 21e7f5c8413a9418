"""Dense vectors as ARRAY columns: products, norms, means and a path-context encoder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def mean_vectors(df: DataFrame, key: str, vector: str, out: str = "vector") -> DataFrame:
    """Per key the unit-length mean of unit vectors; null vectors don't count."""
    parts = df.select(key, F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    rows = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(out))
    return rows.withColumn(out, unit(F.col(out)))


def encode_contexts(starts: np.ndarray, paths: np.ndarray, ends: np.ndarray, mask: np.ndarray, weights: np.ndarray, attention: np.ndarray) -> np.ndarray:
    """Code vector of one function: tanh(W [start; path; end]), softmax attention over contexts, weighted sum, unit length."""
    hidden = np.tanh(np.concatenate([starts, paths, ends], axis=1) @ weights.T)
    logits = np.where(mask > 0, hidden @ attention, -np.inf)
    if not np.isfinite(logits).any():
        return np.zeros(hidden.shape[1])
    share = np.exp(logits - logits.max())
    out = (share / share.sum()) @ hidden
    size = np.linalg.norm(out)
    return out / size if size else out
