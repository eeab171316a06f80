"""Exact and repeatable samples, ordered by a hash of the key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemispark.session import broadcast_if_small


def _draw(keys: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def cap_class(df: DataFrame, label: str, value: str, cap: int, keys: list[str], seed: int = 42) -> DataFrame:
    """All rows, but of those with the label at most ``cap``; a top-k by hash, no global sort."""
    kept = df.where(F.col(label) == value).orderBy(_draw(keys, seed), *keys).limit(cap)
    return df.where(F.col(label).isNull() | (F.col(label) != value)).unionByName(kept)


def split_by_hash(df: DataFrame, keys: list[str], share: float, seed: int = 42, strata: str | None = None) -> DataFrame:
    """Add ``held_out`` for ``round(share * n)`` rows of each stratum (or of all rows), exactly.

    Rows fall into 1,024 bins by hash; whole bins below the cut and the first rows of the bin at the cut are held
    out, so that only rows of one bin of a stratum are ever ordered, never a whole stratum.
    """
    bins = 1024
    level = [strata] if strata else []
    rows = df.withColumn("_h", _draw(keys, seed)).withColumn("_bin", F.pmod(F.col("_h"), F.lit(bins)).cast("int"))
    counts = rows.groupBy(*level, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*level) if level else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_c").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_want", F.round(F.lit(share) * F.sum("_c").over(w)).cast("long"))
    cond = rows["_bin"] == counts["_bin"]
    if strata:
        cond = cond & rows[strata].eqNullSafe(counts[strata])
    counts, _ = broadcast_if_small(counts)  # strata x bins
    joined = rows.join(counts, cond).select(rows["*"], counts["_c"], counts["_before"], counts["_want"])
    edge = (F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_c") > F.col("_want"))
    inner = joined.where(~edge).withColumn("held_out", F.col("_before") + F.col("_c") <= F.col("_want"))
    place = F.row_number().over(Window.partitionBy(*level, "_bin").orderBy("_h", *keys))
    border = joined.where(edge).withColumn("held_out", F.col("_before") + place <= F.col("_want"))
    return inner.unionByName(border).drop("_h", "_bin", "_c", "_before", "_want")


def sample_per_group(df: DataFrame, group: str, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(_draw(keys, seed), *keys))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")
