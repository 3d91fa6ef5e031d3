"""Running values over ordered groups that no task has to hold or read whole.

Rows are range-partitioned by group and order and staged with the number of their part, so that a group
of any size spans as many parts as it needs. Windows run within (part, group); what came before a part is
added from the totals of the parts. A part continues at most one group of the parts before it, so that
the carried totals are at most one row a part, whatever the rows are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

Fold = tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]
SUM: Fold = (F.sum, lambda a, b: a + b)
XOR: Fold = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def in_parts(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` staged in ranges of ``order`` with the number of the range in ``part``."""
    return staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "parts")


def _same(keys: list[str], other: str) -> Column:
    out = F.lit(True)
    for key in keys:
        out = out & F.col(key).eqNullSafe(F.col(f"{other}_{key}"))
    return out


def running(placed: DataFrame, keys: list[str], order: list[str], **folds: tuple[Fold, Column]) -> DataFrame:
    """``placed`` (of ``in_parts`` over keys and order) with each fold of the rows of its keys up to and with the row."""
    within = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy("part", *keys).agg(*(fold(value).alias(name) for name, ((fold, _), value) in folds.items()))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(
        F.col("part").alias("_part"), *(F.col(k).alias(f"_{k}") for k in keys), F.count(F.lit(1)).over(before).alias("_parts"), *(fold(F.col(name)).over(before).alias(f"_{name}") for name, ((fold, _), _) in folds.items())
    )
    continued = F.broadcast(earlier.where("_parts > 0").drop("_parts"))  # at most one row a part
    here = placed.select("*", *(fold(value).over(within).alias(name) for name, ((fold, _), value) in folds.items()))
    joined = here.join(continued, (F.col("part") == F.col("_part")) & _same(keys, ""), "left")
    kept = [F.col(c) for c in placed.columns]
    return joined.select(*kept, *(F.coalesce(combine(F.col(f"_{name}"), F.col(name)), F.col(name)).alias(name) for name, ((_, combine), _) in folds.items()))


def followed(placed: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``placed`` with ``name``: the ``value`` of the next row of the same keys, in whatever part it lies."""
    within = Window.partitionBy("part", *keys).orderBy(*order)
    firsts = placed.groupBy("part", *keys).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    later = Window.partitionBy(*keys).orderBy("part")
    heads = firsts.select(F.col("part").alias("_part"), *(F.col(k).alias(f"_{k}") for k in keys), F.lead("_first").over(later).alias("_next"))
    spanning = F.broadcast(heads.where("_next is not null"))  # at most one row a part
    here = placed.withColumn(name, F.lead(value).over(within))
    joined = here.join(spanning, (F.col("part") == F.col("_part")) & _same(keys, ""), "left")
    return joined.select(*(F.col(c) for c in placed.columns), F.coalesce(name, "_next").alias(name))
