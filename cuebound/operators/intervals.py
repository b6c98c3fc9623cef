"""Sweep line over time intervals: continuous periods and the gaps between them, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuebound.session import written

#: Milliseconds of a block (2^22 ms, about 70 minutes) and blocks of a span (2^12). A window task holds at most
#: one event for each millisecond of a block, one total for each block of a span, or one for each span of a key.
BLOCK_BITS, SPAN_BITS = 22, 12


def to_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds; NULL for NULL, NaN, infinities and values beyond a bigint."""
    value = F.try_multiply(seconds.cast("double"), F.lit(1000.0))
    fine = ~F.isnan(value) & (F.abs(value) < 9e15)
    return F.when(fine, F.round(value).cast("bigint"))


def periods_and_gaps(df: DataFrame, key: Column, start: Column, end: Column) -> DataFrame:
    """Rows (key, kind, start_ms, end_ms): 'period' for each continuous period, 'gap' for each gap between two.

    start and end are seconds, rounded to milliseconds. Rows with a NULL key, a NULL, NaN or infinite bound, or an
    end not after the start cover nothing; repeated rows change nothing; an empty input gives an empty result.
    Other columns of df are never read, so their names cannot clash.

    Each bound becomes an event of +1 or -1. Events at one instant are added up first (partial aggregation, keyed by
    key and instant, so no key is hot). Active counts are prefix sums built in three levels - within a block of time,
    over the blocks of a span, over the spans of a key - so that even a key with a third of all rows is spread over
    as many tasks as its time line has blocks.
    """
    bounds = df.select(key.cast("string").alias("key"), to_ms(start).alias("s"), to_ms(end).alias("e"))
    bounds = bounds.where(F.col("key").isNotNull() & (F.col("e") > F.col("s")))
    events = bounds.select(
        "key",
        F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x"),
    ).select("key", "x.t", F.col("x.d").cast("bigint").alias("d"))
    events = events.groupBy("key", "t").agg(F.sum("d").alias("d")).where("d <> 0")
    # Written once: three branches below start from the events, two from the edges.
    events = written(events.select("key", F.shiftright("t", BLOCK_BITS).alias("block"), "t", "d"), "events")

    in_block = Window.partitionBy("key", "block").orderBy("t")
    local = events.withColumn("upto", F.sum("d").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    totals = events.groupBy("key", "block").agg(F.sum("d").alias("d"))
    totals = totals.withColumn("span", F.shiftright("block", SPAN_BITS))
    offsets = _prefix(totals)

    joined = local.join(offsets, ["key", "block"])
    edges = joined.select("key", "block", "t", (F.col("upto") + F.col("offset")).alias("active"), "d")
    edges = written(edges.where((F.col("active") == 0) | (F.col("active") == F.col("d"))), "edges")

    first = edges.groupBy("key", "block").agg(F.min("t").alias("first_t"))
    following = _next_first(first)
    paired = (
        edges.withColumn("local_next", F.lead("t").over(in_block))
        .join(following, ["key", "block"], "left")
        .withColumn("next_t", F.coalesce("local_next", "later_t"))
    )
    return paired.where(F.col("next_t").isNotNull()).select(
        "key",
        F.when(F.col("active") > 0, "period").otherwise("gap").alias("kind"),
        F.col("t").alias("start_ms"),
        F.col("next_t").alias("end_ms"),
    )


def _prefix(totals: DataFrame) -> DataFrame:
    """(key, block, offset): what is active when a block begins."""
    rows_before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_span = Window.partitionBy("key", "span").orderBy("block")
    inner = totals.withColumn("inner", F.coalesce(F.sum("d").over(rows_before(in_span)), F.lit(0)))
    spans = totals.groupBy("key", "span").agg(F.sum("d").alias("d"))
    over_spans = Window.partitionBy("key").orderBy("span")
    spans = spans.select("key", "span", F.coalesce(F.sum("d").over(rows_before(over_spans)), F.lit(0)).alias("outer"))
    return inner.join(spans, ["key", "span"]).select("key", "block", (F.col("inner") + F.col("outer")).alias("offset"))


def _next_first(first: DataFrame) -> DataFrame:
    """(key, block, later_t): the first edge after the block."""
    first = first.withColumn("span", F.shiftright("block", SPAN_BITS))
    in_span = Window.partitionBy("key", "span").orderBy("block")
    inner = first.withColumn("inner", F.lead("first_t").over(in_span))
    spans = first.groupBy("key", "span").agg(F.min("first_t").alias("span_t"))
    spans = spans.select("key", "span", F.lead("span_t").over(Window.partitionBy("key").orderBy("span")).alias("outer"))
    return inner.join(spans, ["key", "span"]).select("key", "block", F.coalesce("inner", "outer").alias("later_t"))
