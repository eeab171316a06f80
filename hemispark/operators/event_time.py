"""Attributes as known at event time.

Validity intervals are decomposed into dyadic time nodes: a node of level k is a run of 2^k days that starts at a
multiple of 2^k, and every half-open interval is the disjoint union of at most two nodes a level. An event's day lies in
exactly one node of each level, so events and intervals meet by equality of (entity, level, node): no range or cross join,
and a hot entity is spread over its nodes. The exact half-open bounds and the time at which a row became known are
checked on what meets; of several rows the one known last counts, further ties go to the later start, then to the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemispark.session import broadcast_if_small

#: Days run from this date over 2^LEVELS days (717 years); unbounded ends are the ends of this range.
ORIGIN, LEVELS = "1700-01-01", 18


def _day(c: Column) -> Column:
    # greatest and least skip NULLs, so these are kept apart
    return F.when(c.isNotNull(), F.least(F.greatest(F.datediff(c, F.lit(ORIGIN)), F.lit(0)), F.lit((1 << LEVELS) - 1)))


def dyadic_nodes(start: Column, end: Column) -> Column:
    """Array of (level, node) whose disjoint union is [start, end) in days; NULL bounds are unbounded. Empty if end <= start."""
    low = F.coalesce(_day(start), F.lit(0)).cast("long")
    high = F.coalesce(_day(end), F.lit(1 << LEVELS)).cast("long")

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        a = F.floor((low + size - 1) / size).cast("long")
        b = F.floor(high / size).cast("long")
        left = F.when((a < b) & (a % 2 == 1), F.struct(level.alias("level"), a.alias("node")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(level.alias("level"), (b - 1).alias("node")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)), lambda n: n.isNotNull())


def enclosing_nodes(day: Column, levels: list[int]) -> Column:
    """Array of (level, node) of the given levels that hold a day."""
    d = _day(day).cast("long")
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(d, k).alias("node")) for k in levels))


def as_known_at(
    events: DataFrame,
    facts: DataFrame,
    event_key: list[str],
    event_day: str,
    entity: list[str],
    values: list[str],
    per: list[str] | None = None,
    start: str = "effective_from",
    end: str = "effective_to",
    known: str | None = "recorded_at",
) -> DataFrame:
    """(event_key, event_day, entity, per, values) for each event and each group ``per`` of facts of its entity valid and known then.

    A fact is valid if start <= day < end (NULL: unbounded) and known if its time of record is before the start of the
    day; NULL times of record are never known, with ``known=None`` all are. ``per`` are columns of the facts of which each
    combination gets its own row. Events with a NULL day or entity, and facts with a NULL entity, give no rows; repeated
    rows count once. Extra columns of either side may clash, they are not read. Days outside the range are
    clamped to its ends for blocking only, the exact bounds decide.
    """
    per = per or []
    ev = events.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(event_key)), F.col(event_day).cast("date").alias("_d"), *(F.col(c).alias(f"_e{i}") for i, c in enumerate(entity))).distinct()
    known_at = F.col(known).cast("timestamp") if known else F.lit(None).cast("timestamp")
    fa = facts.select(
        *(F.col(c).alias(f"_e{i}") for i, c in enumerate(entity)), *(F.col(c).alias(f"_p{i}") for i, c in enumerate(per)), F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(values))).alias("_v"),
        F.col(start).cast("date").alias("_from"), F.col(end).cast("date").alias("_to"), known_at.alias("_known"),
    ).distinct()
    if known:
        fa = fa.where(F.col("_known").isNotNull())
    nodes = fa.withColumn("_n", F.explode(dyadic_nodes(F.col("_from"), F.col("_to")))).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    nodes, _ = broadcast_if_small(nodes)
    levels = sorted(r._level for r in fa.select(F.explode(F.transform(dyadic_nodes(F.col("_from"), F.col("_to")), lambda n: n["level"])).alias("_level")).distinct().collect())  # at most LEVELS + 1
    keys = [f"_e{i}" for i in range(len(entity))]
    if not levels:
        levels = [0]
    at = ev.where(F.col("_d").isNotNull()).withColumn("_n", F.explode(enclosing_nodes(F.col("_d"), levels))).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    met = at.join(nodes, [*keys, "_level", "_node"])
    met = met.where((F.col("_from").isNull() | (F.col("_from") <= F.col("_d"))) & (F.col("_to").isNull() | (F.col("_d") < F.col("_to"))))
    if known:
        met = met.where(F.col("_known") < F.col("_d").cast("timestamp"))
    best = F.max(F.struct(F.col("_known"), F.col("_from"), F.col("_v")))
    groups = [*(f"_k{i}" for i in range(len(event_key))), "_d", *keys, *(f"_p{i}" for i in range(len(per)))]
    found = met.groupBy(*groups).agg(best.alias("_b"))
    names = [*event_key, event_day, *entity, *per]
    columns, used = [], set(event_key) | {event_day}
    for g, n in zip(groups, names):
        if g.startswith("_e") and n in used:
            continue
        used.add(n)
        columns.append(F.col(g).alias(n))
    return found.select(*columns, *(F.col(f"_b._v.v{i}").alias(c) for i, c in enumerate(values)))
