"""Positions by a total order without a single task: range sort, partition sizes, offsets.

A window without PARTITION BY, or one whose partition may hold a third of all rows, puts that group into one task. Here rows are
range-partitioned by the order, sorted within partitions and written to the shared folder, so that both later passes see the
same partitions; only the number of rows of each partition (or of each group in a partition) is aggregated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import checkpointed

_BITS = 33  # monotonically_increasing_id(): the partition above, the row within it below


def _sorted(df: DataFrame, order: list) -> DataFrame:
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return checkpointed(d).withColumn("__p", F.shiftright("__at", _BITS))


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the position of each row (from 1) in a total order."""
    d = _sorted(df, order)
    sizes = d.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__before"))  # one row for each partition
    at = F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return d.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__before") + at + 1).drop("__p", "__at", "__before")


def rank_within(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """df with the rank of each row (from 1) within its group; order must be total. A hot group is spread over many tasks."""
    d = _sorted(df, [*group, *order])
    per = d.groupBy("__p", *group).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__p", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    local = F.row_number().over(Window.partitionBy("__p", *group).orderBy("__at"))
    out = d.withColumn("__local", local).withColumnRenamed("__p", "__dp").join(per, [F.col("__dp") == F.col("__p"), *same])
    return out.withColumn(name, F.col("__local") + F.col("__before")).drop("__p", "__dp", "__at", "__local", "__before", *[f"__g{i}" for i in range(len(group))])


def running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before each row in a total order."""
    d = _sorted(df, order)
    sizes = d.groupBy("__p").agg(F.sum(value).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.coalesce(F.sum(value).over(Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = d.withColumn("__local", local).join(F.broadcast(sizes.select("__p", before.alias("__before"))), "__p")
    return out.withColumn(name, F.col("__local") + F.col("__before")).drop("__p", "__at", "__local", "__before")


def folded(step: float, j: int) -> float:
    """step added up j times from 0 in double arithmetic, as a loop would, in time proportional to the number of binades passed.

    Between two powers of two every addition of one number adds the same multiple of the last place (after the first, if the
    number lies half-way), so whole stretches are added at once, exactly.
    """
    x, k = 0.0, 0
    while k < j:
        y = x + step
        if x > 0 and k + 2 <= j:
            inc, top = y - x, math.ldexp(1.0, math.frexp(x)[1])
            if y + step - y == inc and inc > 0:
                m = min(j - k, int((top - x) / inc) - 1)
                if m > 1:
                    x, k = x + m * inc, k + m
                    continue
        x, k = y, k + 1
    return x


def virtual_times(df: DataFrame, rank: str, total: str, name: str) -> DataFrame:
    """df with the left-to-right sum of `rank` times 1 / total; rows of one batch that follow each other are added on."""
    cols = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, n = b.column(cols.index(rank)).to_numpy(), b.column(cols.index(total)).to_numpy()
            out = np.empty(len(r))
            cut = np.flatnonzero((np.diff(r) != 1) | (np.diff(n) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(r)]):
                if hi > lo:
                    step = 1.0 / float(n[lo])
                    out[lo:hi] = np.add.accumulate(np.concatenate(([folded(step, int(r[lo]))], np.full(hi - lo - 1, step))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*cols, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` double"
    return df.mapInArrow(run, schema)
