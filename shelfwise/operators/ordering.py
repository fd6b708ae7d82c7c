"""Orders over whole tables without a task that holds them: rows are dealt by range, then each range knows what lies before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.files import scratch_dir


def prefix_sums(df: DataFrame, order: Sequence[Column | str], **sums: Column) -> DataFrame:
    """``df`` plus, for each name, the sum of its expression over the rows up to here in the order.

    The order must be total for the sums to be determined. Rows are written once, dealt by range
    of the order, so their parts are fixed; a table of one row per part carries the sums from part to part.
    """
    path = scratch_dir(df.sparkSession)
    df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), **{f"_{k}": v for k, v in sums.items()}}).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shuffle partitions
    parts = rows.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    carried = parts.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}_before") for k in sums])
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(F.broadcast(carried), "_part")
    return joined.select(*df.columns, *[(F.sum(f"_{k}").over(here) + F.col(f"_{k}_before")).alias(k) for k in sums])


def grouped_prefix_sums(df: DataFrame, group: str, order: Sequence[Column | str], **sums: Column) -> DataFrame:
    """``df`` plus, for each name, the sum of its expression over the rows of the group up to here in the order, and ``total_<name>`` over the whole group.

    A window by group would sort each group in one task. Here rows are dealt by range of (group,
    order), so a group with half of all rows lies in as many parts as its size asks for; a table of
    one row for each part and group carries the sums from part to part of a group. A null group is
    a group. The order must be total within a group for the sums to be determined.
    """
    path = scratch_dir(df.sparkSession)
    dealt = df.repartitionByRange(group, *order)
    dealt.withColumns({"_part": F.spark_partition_id(), **{f"_{k}": v for k, v in sums.items()}}).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a group has a row for each part it lies in
    whole = Window.partitionBy("_group")
    parts = rows.groupBy("_part", F.col(group).alias("_group")).agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    carried = parts.select(F.col("_part").alias("_at"), "_group", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}_before") for k in sums], *[F.sum(f"_{k}").over(whole).alias(f"total_{k}") for k in sums])
    here = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumns({f"_{k}_run": F.sum(f"_{k}").over(here) for k in sums})
    joined = running.join(carried, (F.col("_part") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*df.columns, *[(F.col(f"_{k}_run") + F.col(f"_{k}_before")).alias(k) for k in sums], *[f"total_{k}" for k in sums])


def grouped_running_max(df: DataFrame, group: str, order: Sequence[Column | str], column: str, name: str) -> DataFrame:
    """``df`` plus, as ``name``, the greatest value of a column among the rows of the group before this one in the order.

    Null where none is before. Rows are dealt by range of (group, order) as in ``grouped_prefix_sums``,
    so a group lies in as many parts as its size asks for; the maxima of a group's earlier parts
    are carried on by a table of one row for each part and group. A null group is a group.
    """
    path = scratch_dir(df.sparkSession)
    df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    parts = rows.groupBy(F.col("_part").alias("_at"), F.col(group).alias("_group")).agg(F.max(column).alias("_top"))
    earlier = Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a group has a row for each part it lies in
    carried = parts.select("_at", "_group", F.max("_top").over(earlier).alias("_carried"))
    here = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_here", F.max(column).over(here)).join(carried, (F.col("_part") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*df.columns, F.greatest("_here", "_carried").alias(name))


def grouped_percentiles(df: DataFrame, group: str, column: str, shares: Sequence[float]) -> DataFrame:
    """(group, percentiles): exact, interpolated percentiles of each group as an array, null where a group has no value.

    Values are counted by group first and looked up by their ranks among the counts, so no buffer
    holds a group's values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(group, F.col(column).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    ranks = grouped_prefix_sums(counts, group, ["_value"], upto=F.col("_n"))
    at = lambda q: (F.col("total_upto") - 1) * F.lit(float(q))
    holds = lambda place: (F.col("upto") > place) & (F.col("upto") - F.col("_n") <= place)
    ends = ranks.groupBy(group).agg(*[F.max(F.when(holds(place(at(q))), F.col("_value"))).alias(f"{side}{i}") for i, q in enumerate(shares) for side, place in (("low", F.floor), ("high", F.ceil))], F.max("total_upto").alias("total_upto"))
    part = lambda q: at(q) - F.floor(at(q))
    mixed = [F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}")).otherwise((1 - part(q)) * F.col(f"low{i}") + part(q) * F.col(f"high{i}")) for i, q in enumerate(shares)]
    return ends.select(group, F.array(*mixed).alias("percentiles"))


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, n, upto): the distinct values that aren't null, how often each occurs, and how many rows have it or less."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return prefix_sums(counts, ["value"], upto=F.col("n"))


def percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """One row with an array of percentiles for each column: exact, with linear interpolation, as ``percentile`` has them.

    ``percentile`` keeps all distinct values of a table in one buffer; here values are counted, and
    the few that a percentile lies at or between are looked up by their ranks. Null for an empty column.
    """
    found = None
    for c in columns:
        ranks = value_ranks(df.select(F.col(c).cast("double").alias(c)), c)
        total = F.broadcast(ranks.agg(F.sum("n").alias("total")))
        at = lambda q: (F.col("total") - 1) * F.lit(float(q))
        holds = lambda place: (F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)
        ends = ranks.join(total).agg(*[F.max(F.when(holds(place(at(q))), F.col("value"))).alias(f"{side}{i}") for i, q in enumerate(shares) for side, place in (("low", F.floor), ("high", F.ceil))], F.max("total").alias("total"))
        part = lambda q: at(q) - F.floor(at(q))
        mixed = [F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}")).otherwise((1 - part(q)) * F.col(f"low{i}") + part(q) * F.col(f"high{i}")) for i, q in enumerate(shares)]
        row = ends.select(F.array(*mixed).alias(c))
        found = row if found is None else found.join(F.broadcast(row))
    return found
