"""Top N items within every group, by one global sort.

All rows are range-partitioned and sorted on (group, score, identifier), so a
group of any size is spread over as many partitions as its rows need. Every
partition numbers its own rows per group and keeps the first N; the partitions'
counts per group are summed over the partitions before (a prefix sum) and turn
the local numbers into exact positions. No task ever sees a whole group.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.runtime import col, fresh, partitions


def _changes(now: pa.Array, before: pa.Array) -> np.ndarray:
    """Where two equally long arrays differ; nulls equal nulls and NaN equals NaN."""
    differ = pc.fill_null(pc.not_equal(now, before), False)
    if pa.types.is_floating(now.type):
        differ = pc.and_(differ, pc.invert(pc.and_(pc.fill_null(pc.is_nan(now), False), pc.fill_null(pc.is_nan(before), False))))
    return np.asarray(pc.or_(differ, pc.xor(pc.is_null(now), pc.is_null(before))))


def _numberer(keys: Sequence[str], n: int, out: str):
    def number(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        last: list[pa.Array] | None = None
        seen = 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            first = np.zeros(size, dtype=bool)
            first[0] = last is None
            for i, k in enumerate(keys):
                values = batch.column(k)
                first[1:] |= _changes(values.slice(1), values.slice(0, size - 1))
                if last is not None:
                    first[0] |= bool(_changes(values.slice(0, 1), last[i])[0])
            rows = np.arange(size)
            start = np.maximum.accumulate(np.where(first, rows, -1))
            local = np.where(start >= 0, rows - start, rows + seen) + 1
            seen = int(local[-1])
            last = [batch.column(k).slice(size - 1, 1) for k in keys]
            kept = batch.append_column(out, pa.array(local, pa.int64())).filter(pa.array(local <= n))
            if kept.num_rows:
                yield kept

    return number


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, str]], n: int, position: str = "position") -> DataFrame:
    """The first ``n`` rows of every group of ``df``, with their ``position`` from 1.

    ``order`` lists (column, 'asc' | 'desc'), the score first and the identifiers
    after it; strings compare by code point. Nulls sort last. Null (and NaN) group
    values form groups of their own. Rows equal in all ordering columns are kept as
    separate rows, each with a position of its own (which of them comes first
    does not matter to the ordering columns). An empty input gives an empty result. Extra
    columns are carried; if one is named like ``position`` the new column gets
    a suffix. Groups shorter than ``n`` give all their rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    pos = fresh(df.columns, position)
    part, local = fresh(df.columns, "__part"), fresh(df.columns, "__local")
    sort: list[Column] = [col(g).asc_nulls_first() for g in group]
    sort += [col(c).desc_nulls_last() if d == "desc" else col(c).asc_nulls_last() for c, d in order]
    ranged = df.repartitionByRange(partitions(df.sparkSession), *sort).sortWithinPartitions(*sort).withColumn(part, F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField(local, T.LongType())])
    kept = ranged.mapInArrow(_numberer(list(group), n, local), schema)
    before = Window.partitionBy(*[col(g) for g in group]).orderBy(col(part)).rangeBetween(Window.unboundedPreceding, -1)
    return (
        kept.withColumn(pos, F.count(F.lit(1)).over(before) + col(local))
        .filter(col(pos) <= n)
        .drop(part, local)
    )


def highest_per_item(df: DataFrame, item: Sequence[str], value: str) -> DataFrame:
    """One row per item with its highest value; null and NaN are no value, items without one are left out."""
    v = col(value)
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*[col(c) for c in item]).agg(F.max(v).alias(value))
