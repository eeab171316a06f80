"""Ordered operators within groups.

A group may hold a third of all rows, so where the order is a whole number a group is cut into chunks of ``CHUNK``
numbers, and no task orders more than a chunk. What a row needs from beyond its chunk are the first rows of the following ones;
these few rows per chunk are gathered apart and joined back by chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemispark.session import broadcast_if_small

CHUNK = 4096


def _with_following(df: DataFrame, value: Column, group: list[str], order: str, ahead: int) -> DataFrame:
    """Add ``_chunk`` and ``_tail``: the values of the first ``ahead`` rows after the row's chunk (fewer at the group's end).

    Rows without an order are a chunk of their own, the first.
    """
    rows = df.withColumn("_chunk", F.coalesce(F.floor(F.col(order) / CHUNK).cast("long"), F.lit(-(1 << 62)))).withColumn("_value", value)
    place = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(order))
    first = rows.select(*group, "_chunk", order, "_value", place.alias("_place")).where(F.col("_place") <= ahead)
    heads = first.groupBy(*group, "_chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_value"))), lambda x: x["_value"]).alias("_head"))
    # every chunk has a row, so the heads of the next ``ahead`` chunks hold what is needed; one row per chunk is ordered here
    next_chunks = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(1, ahead)
    tails = heads.select(*group, "_chunk", F.slice(F.flatten(F.collect_list("_head").over(next_chunks)), 1, ahead).alias("_tail"))
    tails, _ = broadcast_if_small(tails)
    match = rows["_chunk"] == tails["_chunk"]
    for g in group:
        match = match & rows[g].eqNullSafe(tails[g])
    return rows.join(tails, match, "left").select(rows["*"], tails["_tail"])


def event_follows(df: DataFrame, event: str, group: list[str], order: list[str], ahead: int = 3, out: str = "intervened") -> DataFrame:
    """Add ``out``: whether an event occurs on one of the next ``ahead`` rows of the group (rows, not numbers; not the row itself).

    NULL events are none. One order column of whole numbers is read in chunks, any other order in one window per group.
    """
    happens = F.coalesce(F.col(event), F.lit(False))
    if len(order) != 1 or df.schema[order[0]].dataType.typeName() not in ("long", "integer", "short", "byte"):
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(1, ahead)
        return df.withColumn(out, F.coalesce(F.max(happens.cast("int")).over(w) == 1, F.lit(False)))
    rows = _with_following(df, happens, group, order[0], ahead)
    w = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(1, ahead)
    inside, after = F.coalesce(F.max(F.col("_value").cast("int")).over(w) == 1, F.lit(False)), F.count(F.lit(1)).over(w)
    rows = rows.withColumn("_inside", inside).withColumn("_after", after.cast("int"))
    beyond = F.exists(F.slice("_tail", F.lit(1), F.lit(ahead) - F.col("_after")), lambda x: x)
    return rows.withColumn(out, F.col("_inside") | F.coalesce(beyond, F.lit(False))).drop("_chunk", "_value", "_tail", "_inside", "_after")


def lead_value(df: DataFrame, column: str, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add the next row's value and drop each group's last row (and rows whose next value is NULL). For series of sittings."""
    return df.withColumn(out, F.lead(column).over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out).isNotNull())


def lag_design(df: DataFrame, columns: list[str], lags: int, group: list[str], order: list[str]) -> DataFrame:
    """Add ``<column>_lag<k>`` for k = 1 .. lags; rows without all lags are dropped. For series of sittings."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, lags + 1)})
    return out.where(F.col(f"{columns[0]}_lag{lags}").isNotNull())


def chronological(df: DataFrame, day: str, key: str, out: str = "sitting_order") -> tuple[DataFrame, DataFrame]:
    """(dated rows with a dense order from 0, rows without a date). One row per key: a few hundred to thousands, never the turns."""
    rows = df.select(key, day).distinct()
    order = F.row_number().over(Window.orderBy(day, key)) - 1
    return rows.where(F.col(day).isNotNull()).withColumn(out, order.cast("long")), rows.where(F.col(day).isNull())


def own_or_next(df: DataFrame, values: DataFrame, group: str, order: str, use_next: str, value: str, out: str) -> DataFrame:
    """Add the value of the row's own key, or of the next row in the group where ``use_next`` is true. ``values``: (group, order, value)."""
    rows = _with_following(df, F.col(order), [group], order, 1)
    following = F.coalesce(F.lead(order).over(Window.partitionBy(group, "_chunk").orderBy(order)), F.get("_tail", F.lit(0)))
    keyed = rows.withColumn("_next", following).withColumn("_key", F.when(F.col(use_next), F.col("_next")).otherwise(F.col(order))).drop("_chunk", "_value", "_tail", "_next")
    v = values.select(F.col(group).alias("_g"), F.col(order).alias("_key"), F.col(value).alias(out))
    return keyed.join(v, (keyed[group] == v["_g"]) & (keyed["_key"] == v["_key"]), "left").drop("_g", "_key")
