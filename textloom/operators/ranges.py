"""Ranks and running sums over a whole table without one task for all of it: rows are dealt into ordered ranges, and the
totals of the ranges, a row each, say where each range begins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the folder of spark.checkpoint.dir and read from there."""
    from textloom.sources.sinks import shared_folder

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: Sequence, value: Column | str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds name: the sum of value over the rows before in order, within by where it is given.

    The bounds of ranges are sampled, and another evaluation may sample others, so the dealt rows are written before they
    are read twice, once for the totals and once for the sums. order must be total, or ties fall as they come.
    """
    keys = [*by, *order]
    dealt = checkpointed(df.withColumn("__value", value if isinstance(value, Column) else F.col(value)).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "__part").agg(F.sum("__value").alias("__sum"))  # a row per range and group
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    own = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__own", F.coalesce(F.sum("__value").over(own), F.lit(0))).join(F.broadcast(offsets), [*by, "__part"])
    return placed.withColumn(name, F.col("__own") + F.col("__offset")).drop("__value", "__part", "__own", "__offset")


def ranked(df: DataFrame, order: Sequence, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds name: the rank in order, from zero on."""
    return running(df, order, F.lit(1).cast("long"), name, by)
