"""Aggregates with fixed handling of NULLs, ties and empty groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemispark.functions.text import ratio


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n, pct) with NULL as a value of its own."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (100.0 * F.col("n") / F.col("_total")).alias("pct"))  # one row


def crosstab(df: DataFrame, row: str, flag: str) -> DataFrame:
    """(row, n_false, n_true), 0 for empty cells; rows without a flag are left out."""
    known = df.where(F.col(flag).isNotNull())
    return known.groupBy(row).agg(F.sum((~F.col(flag)).cast("long")).alias("n_false"), F.sum(F.col(flag).cast("long")).alias("n_true"))


def rates_by(df: DataFrame, flag: str, by: list[str]) -> DataFrame:
    """(by, n, n_true, rate)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("long")).alias("n_true")).withColumn("rate", ratio(F.col("n_true"), F.col("n")))


def describe(df: DataFrame, column: str) -> DataFrame:
    """(n, mean, std, min, q25, q50, q75, max) with linearly interpolated quartiles."""
    q = F.percentile(F.col(column), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"))
    return one.select("n", "mean", "std", "min", *(F.get("q", i).alias(f"q{k}") for i, k in enumerate((25, 50, 75))), "max")


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, support, precision, recall, f1) of each label that occurs on either side; 0 where a denominator is 0."""
    c = confusion(df, truth, guess)
    side = c.select(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).alias("g"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("h"))
    side = side.unionByName(c.select(F.col("guess").alias("label"), F.lit(0).alias("t"), F.col("n").alias("g"), F.lit(0).alias("h")))
    s = side.where(F.col("label").isNotNull()).groupBy("label").agg(F.sum("t").alias("support"), F.sum("g").alias("_g"), F.sum("h").alias("_h"))
    p, r = F.coalesce(ratio(F.col("_h"), F.col("_g")), F.lit(0.0)), F.coalesce(ratio(F.col("_h"), F.col("support")), F.lit(0.0))
    return s.select("label", "support", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def summary_metrics(per_class: DataFrame) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1) from the metrics of the classes."""
    hits = F.sum(F.col("recall") * F.col("support"))
    return per_class.agg(F.try_divide(hits, F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def class_weights(df: DataFrame, flags: list[str], low: float = 1.0, high: float = 20.0) -> DataFrame:
    """(flag, weight): negatives over positives, within [low, high], in one pass."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *(F.coalesce(F.sum(F.col(f).cast("int")), F.lit(0)).alias(f) for f in flags))
    long = sums.select("_n", F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).cast("double").alias("p")) for f in flags))).alias("x"))
    weight = F.least(F.lit(high), F.greatest(F.lit(low), (F.col("_n") - F.col("x.p")) / F.greatest(F.col("x.p"), F.lit(1.0))))
    return long.select("x.flag", weight.alias("weight"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: what ``keep first`` means without a row order. Aggregates before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def examples_per_group(df: DataFrame, group: str, order: list[str], value: str, n: int = 3) -> DataFrame:
    """(group, place, value): the first ``n`` rows of each group by ``order``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.select(group, *order, value).withColumn("place", place).where(F.col("place") <= n).select(group, "place", value)
