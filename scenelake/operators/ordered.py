"""Running values inside groups of any size.

A plain window puts a whole group into one task. Here the order column is cut into chunks of a fixed
width, every task handles one chunk of one group, and per-chunk summaries (one row each) carry the
running value across chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"


def _chunked(df: DataFrame, position: Column, width: float) -> DataFrame:
    return df.withColumn(_CHUNK, F.floor(position / F.lit(width)).cast("bigint"))


def _carried(df: DataFrame, keys: list[str], per_chunk: Column, across) -> DataFrame:
    totals = df.groupBy(*keys, _CHUNK).agg(per_chunk.alias("__total"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK)
    return totals.select(*keys, _CHUNK, across(F.col("__total"), before).alias("__carry"))


def running(
    df: DataFrame, keys: list[str], position: Column, order: list[Column], value: Column,
    name: str, width: float, how=F.sum,
) -> DataFrame:
    """Add `name`: `how` (sum or max) over the group's rows up to and including this one."""
    cut = _chunked(df.withColumn("__value", value), position, width)
    span = (Window.unboundedPreceding, -1)
    carry = _carried(cut, keys, how("__value"), lambda t, w: how(t).over(w.rowsBetween(*span)))
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    local = how("__value").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = cut.withColumn("__local", local).join(carry, [*keys, _CHUNK])
    if how is F.sum:
        total = F.coalesce("__local", F.lit(0)) + F.coalesce("__carry", F.lit(0))
    else:
        total = F.greatest("__local", "__carry")
    return joined.withColumn(name, total).select(*df.columns, name)


def row_numbers(
    df: DataFrame, keys: list[str], id_column: str, name: str, width: int = 100_000
) -> DataFrame:
    """Number the rows of each group by a unique integer id, so a chunk holds at most `width` rows."""
    return running(
        df, keys, F.col(id_column), [F.col(id_column)], F.lit(1).cast("bigint"), name, width
    )


def previous_value(
    df: DataFrame, keys: list[str], position: Column, order: list[Column], value: Column,
    name: str, width: float,
) -> DataFrame:
    """Add `name`: `value` of the preceding row of the group."""
    cut = _chunked(df.withColumn("__value", value), position, width)
    # Wrapped in a struct so that a preceding null is told apart from no preceding row.
    last = F.max_by(F.struct("__value"), F.struct(*order))
    carry = _carried(cut, keys, last, lambda t, w: F.lag(t).over(w))
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    near = cut.withColumn("__near", F.lag(F.struct("__value")).over(inside))
    joined = near.join(carry, [*keys, _CHUNK])
    found = F.coalesce("__near", "__carry")
    return joined.withColumn(name, found["__value"]).select(*df.columns, name)


def nearest_marks(
    df: DataFrame, keys: list[str], position: Column, mark: Column, width: float
) -> DataFrame:
    """Add `before` and `after`: the closest marked rows at or before and at or after each row.

    `mark` is an integer id, null on rows that are not marks; results are structs of position (`at`,
    negated in `after`) and negated id, so of marks at one position the lowest id is taken. Both
    directions share one shuffle.
    """
    cut = _chunked(df.withColumn("__at", position).withColumn("__mark", mark), F.col("__at"), width)
    marked = F.col("__mark").isNotNull()
    cut = cut.select(
        "*",
        F.when(marked, F.struct(F.col("__at").alias("at"), (-F.col("__mark")).alias("neg_id"))).alias("__b"),
        F.when(marked, F.struct((-F.col("__at")).alias("at"), (-F.col("__mark")).alias("neg_id"))).alias("__a"),
    )
    totals = cut.groupBy(*keys, _CHUNK).agg(F.max("__b").alias("b"), F.max("__a").alias("a"))
    by_key, earlier = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, _CHUNK,
        F.max("b").over(by_key.orderBy(_CHUNK).rowsBetween(*earlier)).alias("__cb"),
        F.max("a").over(by_key.orderBy(F.col(_CHUNK).desc()).rowsBetween(*earlier)).alias("__ca"),
    )
    inside = Window.partitionBy(*keys, _CHUNK)
    last = F.col("__mark").isNull()
    span = (Window.unboundedPreceding, Window.currentRow)
    local = cut.select(
        "*",
        F.max("__b").over(inside.orderBy("__at", last).rowsBetween(*span)).alias("__lb"),
        F.max("__a").over(inside.orderBy(F.col("__at").desc(), last).rowsBetween(*span)).alias("__la"),
    )
    return local.join(carry, [*keys, _CHUNK]).select(
        *df.columns, F.greatest("__lb", "__cb").alias("before"), F.greatest("__la", "__ca").alias("after")
    )
