"""Per-key aggregation by a tree: chunks of fixed size are combined locally, then merged in rounds of bounded fan-in."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an input chunk are 2^CHUNK_BITS; their states are merged in ROUNDS rounds (fewer for few chunks).
CHUNK_BITS, ROUNDS = 16, 3

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Measure:
    """A state column: the aggregate that makes it from rows, and the name of the aggregate that merges two states."""

    name: str
    make: Column
    merge: str = "sum"


def chunk_numbers(df: DataFrame, rows: int, chunk_bits: int = CHUNK_BITS) -> tuple[Column, int]:
    """(number of the chunk of 2^chunk_bits rows that a row of df is in, about how many chunks there are). A chunk is a run of rows of
    one input partition; no two chunks share a number. rows is the number of rows of df."""
    parts = max(1, df.rdd.getNumPartitions())  # planning only, no job
    position = F.monotonically_increasing_id()
    inside = F.shiftright(position.bitwiseAND(F.lit((1 << 33) - 1)), chunk_bits)
    return inside * F.lit(parts) + F.shiftright(position, 33), parts * -(-rows // (parts << chunk_bits))


def tree_aggregate(df: DataFrame, keys: list[str], measures: list[Measure], node: Column, chunks: int, fan_in: int | None = None) -> DataFrame:
    """One row per key (a NULL key is a key, as in SQL) with its merged measures; empty input gives no rows.

    node numbers the chunk that a row is in, about from 0 to chunks. Rows are combined within their chunk, on the map side, into one
    state per key and chunk. Rounds then merge the states of a key from fan_in neighbouring nodes, log(chunks) to the base fan_in
    of them, so that neither the rows nor the states of a key that holds a third of all rows meet in one task. By default fan_in is
    the ROUNDS-th root of chunks, so it is some hundreds for a hundred million chunks. Columns of df that no measure names are
    pruned from the scan.
    """
    if fan_in is None:
        fan_in = 2
        while fan_in**ROUNDS < chunks:
            fan_in += 1
    state = df.withColumn("__node", node).groupBy(*keys, "__node").agg(*[m.make.alias(m.name) for m in measures])
    width = max(1, chunks)
    while True:
        width = -(-width // fan_in)
        group = list(keys) if width == 1 else [*keys, F.floor(F.col("__node") / fan_in).alias("__node")]
        state = state.groupBy(*group).agg(*[_MERGE[m.merge](m.name).alias(m.name) for m in measures])
        if width == 1:
            return state.select(*keys, *[m.name for m in measures])


def heavy_keys(df: DataFrame, fields: list[str], share: float | Fraction, fan_in: int | None = None, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(field, key_value): each value, exactly as stored, that at least share of all rows of df hold in a field.

    NULL is no value, yet its rows count among all rows; an empty df gives no rows. One scan serves all fields: rows
    are combined per chunk and value, then merged through the tree. At most 1/share values come out per field.
    """
    part = Fraction(str(share)) if isinstance(share, float) else Fraction(share)
    total = df.count()  # of a stored table: by its files' footers
    node, chunks = chunk_numbers(df, total, chunk_bits)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key_value")) for f in fields])
    named = df.select(node.alias("__chunk"), F.explode(pairs).alias("x")).select("__chunk", "x.field", "x.key_value").where("key_value IS NOT NULL")
    counts = tree_aggregate(named, ["field", "key_value"], [Measure("n", F.count(F.lit(1)))], F.col("__chunk"), chunks, fan_in)
    return counts.where(F.col("n") * part.denominator >= total * part.numerator).select("field", "key_value")


def topic_profile(df: DataFrame, key: str, other: str, fan_in: int | None = None, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Complete results per value of key: rows, rows with a usable duration, their milliseconds, words, first start and
    last end in milliseconds, and how many different values of other there are. NULL is a group of its own; NaN times
    count as missing. Nothing is dropped or capped for heavy keys."""
    from cuebound.operators.intervals import to_ms

    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    rows = df.select(
        F.col(key).alias("key_value"), to_ms(F.col("duration")).alias("ms"), words.cast("bigint").alias("words"),
        to_ms(F.col("start")).alias("s"), to_ms(F.col("end")).alias("e"), F.col(other).alias("other"),
    )
    node, chunks = chunk_numbers(df, df.count(), chunk_bits)
    main = tree_aggregate(
        rows, ["key_value"],
        [
            Measure("n_rows", F.count(F.lit(1))), Measure("n_durations", F.count("ms")), Measure("total_ms", F.sum("ms")),
            Measure("n_words", F.sum("words")), Measure("first_ms", F.min("s"), "min"), Measure("last_ms", F.max("e"), "max"),
        ],
        node, chunks, fan_in,
    )
    # Different pairs, at most as many as rows, are in chunks by their hash.
    pairs = rows.where("other IS NOT NULL").select("key_value", "other").distinct()
    distinct = tree_aggregate(pairs, ["key_value"], [Measure("n_other", F.count(F.lit(1)))], F.pmod(F.xxhash64("key_value", "other"), F.lit(max(1, chunks))), chunks, fan_in)
    joined = main.alias("m").join(distinct.alias("d"), F.col("m.key_value").eqNullSafe(F.col("d.key_value")), "left")
    return joined.select("m.*", F.coalesce("d.n_other", F.lit(0)).cast("bigint").alias("n_other"))
