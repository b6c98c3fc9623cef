"""Global row numbers and running aggregates without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuebound.session import written

_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


def numbered(df: DataFrame, order: list[Column], running: dict[str, tuple[str, Column]] | None = None, name: str = "number") -> DataFrame:
    """df with its position (from 1) in the order, and running aggregates {name: (sum, min or max; value)} up to each row.

    order must be total, or equal rows are numbered in any order. Rows are range-partitioned and sorted within partitions,
    and written once, so that positions stay the same when tasks run again; each partition's totals (one row a
    partition, so few whatever the rows, which are broadcast) are added up before it. Empty input gives no rows. Running sums leave NULLs out, and are NULL before any.
    """
    running = running or {}
    rows = df.select("*", *[value.alias(f"__v{i}") for i, (_, value) in enumerate(running.values())])
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = written(rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", inside), "ordered")
    totals = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), *[_KINDS[k](f"__v{i}").alias(f"__t{i}") for i, (k, _) in enumerate(running.values())])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), *[_KINDS[k](f"__t{i}").over(before).alias(f"__b{i}") for i, (k, _) in enumerate(running.values())])
    upto = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(F.broadcast(offsets), "__p")
    columns = [(F.col("__before") + F.col("__i") + 1).alias(name)]
    for i, (label, (kind, _)) in enumerate(running.items()):
        local, earlier = _KINDS[kind](f"__v{i}").over(upto), F.col(f"__b{i}")
        both = F.coalesce(local + earlier, local, earlier) if kind == "sum" else (F.least if kind == "min" else F.greatest)(local, earlier)
        columns.append(both.alias(label))
    return joined.select(*df.columns, *columns)


def numbered_within(df: DataFrame, key: str, order: list[Column], name: str = "number") -> DataFrame:
    """df with its position (from 1) among the rows of the same key; NULL is a key. Numbers run over the whole order by key, and
    each key's first number is taken off, so a key with a third of all rows is spread like any other."""
    rows = numbered(df, [F.asc_nulls_first(key), *order], name="__number")
    first = rows.groupBy(key).agg((F.min("__number") - 1).alias("__start"))
    joined = rows.alias("r").join(first.alias("f"), F.col(f"r.{key}").eqNullSafe(F.col(f"f.{key}")))
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("__number") - F.col("__start")).alias(name))


def previous(df: DataFrame, number: str, column: str, name: str) -> DataFrame:
    """df with column of the row before it, by consecutive numbers: an equi-join instead of a window over all rows."""
    before = df.select((F.col(number) + 1).alias(number), F.col(column).alias(name))
    return df.join(before, number, "left")


def moving_average(df: DataFrame, number: str, value: str, size: int, name: str) -> DataFrame:
    """(number, name): the mean of value over each row and the size - 1 rows before it, by consecutive numbers."""
    spread = df.select(F.explode(F.sequence(F.col(number), F.col(number) + size - 1)).alias(number), value)
    means = spread.groupBy(number).agg(F.avg(value).alias(name))
    return means.join(df.select(number), number, "left_semi")


def index_batches(total: int, size: int, spark) -> DataFrame:  # noqa: ANN001
    """(batch, start_idx, end_idx) of the batches of size that cover [0, total); the last may be short."""
    count = -(-total // size)
    batch = spark.range(count).withColumnRenamed("id", "batch")
    return batch.select("batch", (F.col("batch") * size).alias("start_idx"), F.least((F.col("batch") + 1) * size, F.lit(total)).alias("end_idx"))
