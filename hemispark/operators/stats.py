"""Statistical tests and models. Spark reduces the rows to sums of products; what is solved on the driver is a few numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(odds ratio, two-sided p) of a 2x2 table: the sum over tables with the same margins that are not more likely."""

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    row, col, n = a + b, a + c, a + b + c + d
    odds = math.nan if b * c == 0 and a * d == 0 else math.inf if b * c == 0 else a * d / (b * c)
    if not n:
        return odds, 1.0
    log = lambda x: log_choose(col, x) + log_choose(n - col, row - x) - log_choose(n, row)
    low, high, at = max(0, row + col - n), min(row, col), log(a)
    return odds, min(1.0, sum(math.exp(log(x)) for x in range(low, high + 1) if log(x) <= at + 1e-7))


def normal_p(z: float) -> float:
    """Two-sided p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) by the incomplete beta function's continued fraction."""
    if not f > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2

    def beta(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + step * d
                c = 1 + step / c
                d = 1 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    if x in (0.0, 1.0):
        return x
    return beta(a, b, x) if x < (a + 1) / (a + b + 2) else 1 - beta(b, a, 1 - x)


def products(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, n, sums, cross): sums of the columns and of their pairwise products for each group, pre-aggregated before the shuffle."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    c = [F.col(x).cast("double") for x in columns]
    whole = df.where(~F.greatest(*(x.isNull().cast("int") for x in c), F.lit(0)).cast("boolean"))
    return whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(x) for x in c)).alias("sums"), F.array(*(F.sum(c[i] * c[j]) for i, j in pairs)).alias("cross"))


def _gram(cross: list[float], size: int) -> np.ndarray:
    m = np.zeros((size, size))
    at = iter(cross)
    for i in range(size):
        for j in range(i, size):
            m[i, j] = m[j, i] = next(at)
    return m


def granger(df: DataFrame, group: str, order: list[str], cause: str, effect: str, lags: int = 3, least: int = 10) -> DataFrame:
    """(group, lag, f, df_num, df_den): F test of whether past ``cause`` helps to tell ``effect`` beyond its own past.

    Groups with fewer than ``least`` rows of positive cause, or too few rows for a lag, give none. p is :func:`f_tail`.
    """
    w = Window.partitionBy(group).orderBy(*order)
    enough = F.sum((F.col(cause) > 0).cast("int")).over(Window.partitionBy(group)) >= least
    rows = df.where(F.col(group).isNotNull()).withColumn("_ok", enough).where("_ok")
    out = None
    for lag in range(1, lags + 1):
        names = [f"_y{k}" for k in range(1, lag + 1)] + [f"_x{k}" for k in range(1, lag + 1)]
        design = rows.select(group, F.lit(1.0).alias("_one"), F.col(effect).cast("double").alias("_y"), *(F.lag(effect, k).over(w).cast("double").alias(f"_y{k}") for k in range(1, lag + 1)), *(F.lag(cause, k).over(w).cast("double").alias(f"_x{k}") for k in range(1, lag + 1)))
        columns = ["_one", *names, "_y"]
        sums = products(design, columns, [group])

        def solve(batches: Iterator[pd.DataFrame], lag: int = lag, size: int = len(columns)) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = []
                for g, n, cross in zip(pdf[group], pdf["n"], pdf["cross"]):
                    m, free = _gram(list(cross), size), n - 2 * lag - 1
                    if free <= 0:
                        continue
                    rest = lambda k: m[-1, -1] - m[:k, -1] @ np.linalg.lstsq(m[:k, :k], m[:k, -1], rcond=None)[0]  # noqa: B023, E731
                    small, full = rest(1 + lag), rest(1 + 2 * lag)
                    if full > 1e-12 * max(1.0, m[-1, -1]):
                        found.append((g, lag, (small - full) / lag / (full / free), lag, int(free)))
                yield pd.DataFrame(found, columns=[group, "lag", "f", "df_num", "df_den"])

        part = sums.select(group, "n", "cross").mapInPandas(solve, f"{group} {df.schema[group].dataType.simpleString()}, lag int, f double, df_num int, df_den int")
        out = part if out is None else out.unionByName(part)
    return out


def count_significant(p_values: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """(tests, raw, bonferroni): tests below alpha, and below alpha over their number."""
    n = p_values.agg(F.count(p).alias("_m"))
    below = lambda limit: F.coalesce(F.sum((F.col(p) < limit).cast("long")), F.lit(0).cast("long"))
    return p_values.crossJoin(F.broadcast(n)).agg(F.count(p).alias("tests"), below(F.lit(alpha)).alias("raw"), below(alpha / F.col("_m")).alias("bonferroni"))  # one row


def treatment_columns(df: DataFrame, terms: list[list[str]]) -> tuple[DataFrame, list[str]]:
    """Add 0/1 columns of factors and their products, and name them; a factor's first level in the alphabet is the base.

    Products that no row has are left out, as nothing tells their effect. NULL levels give NULL, so that models leave the row out.
    ``terms`` are factors of some dozens of levels; levels and their combinations are all that reaches the driver.
    """
    factors = list(dict.fromkeys(f for t in terms for f in t))
    seen = [tuple(r) for r in df.select(*factors).na.drop().distinct().collect()]  # combinations of levels
    base = {f: min((x[i] for x in seen), default=None) for i, f in enumerate(factors)}
    out, names = df, []
    for t in terms:
        at = [factors.index(f) for f in t]
        for levels in sorted({tuple(x[i] for i in at) for x in seen}):
            if any(v == base[f] for f, v in zip(t, levels)):
                continue
            name = ":".join(f"{f}[{v}]" for f, v in zip(t, levels))
            value = F.lit(1.0)
            for f, v in zip(t, levels):
                value = value * (F.col(f) == v).cast("double")
            out, names = out.withColumn(f"_t{len(names)}", value), [*names, name]
    return out.withColumnsRenamed({f"_t{i}": n for i, n in enumerate(names)}), names


def logit(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(term, coefficient, std_error, p): logistic regression by maximum likelihood with Wald tests; rows with NULLs are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    plain = [f"_f{i}" for i in range(len(features))]  # names may hold dots and brackets
    rows = df.select(F.col(target).cast("double").alias("_y"), *(F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, plain))).na.drop()
    data = VectorAssembler(inputCols=plain, outputCol="_x").transform(rows)
    fit = GeneralizedLinearRegression(family="binomial", featuresCol="_x", labelCol="_y", maxIter=50).fit(data)
    s = fit.summary
    terms = zip([*features, "intercept"], [*fit.coefficients, fit.intercept], s.coefficientStandardErrors, s.pValues)
    return df.sparkSession.createDataFrame([(t, float(c), float(e), float(p)) for t, c, e, p in terms], "term string, coefficient double, std_error double, p double")


def random_intercept(df: DataFrame, target: str, features: list[str], group: str) -> DataFrame:
    """(term, coefficient, std_error, p): linear model with an intercept for each group, by profile maximum likelihood.

    The groups' sums of products are all that leaves the executors; the last two terms are the variances (no tests).
    """
    plain = [f"_f{i}" for i in range(len(features))]  # names may hold dots and brackets
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.lit(1.0).alias("_one"), *(F.col(f"`{f}`").alias(n) for f, n in zip(features, plain)), F.col(target).alias("_target"))
    columns = ["_one", *plain, "_target"]
    parts = products(rows, columns, ["_g"]).collect()  # one row per group: chairs or topics, whose sums are what the likelihood needs
    k, groups = len(columns) - 1, [(r.n, np.array(r.sums), _gram(r.cross, len(columns))) for r in parts]
    n = sum(g[0] for g in groups)
    schema = "term string, coefficient double, std_error double, p double"
    if n <= k:
        return df.sparkSession.createDataFrame([], schema)

    def at(theta: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        m, logdet = np.zeros((k + 1, k + 1)), 0.0
        for size, s, cross in groups:
            m += cross - theta / (1 + theta * size) * np.outer(s, s)
            logdet += math.log1p(theta * size)
        inverse = np.linalg.pinv(m[:k, :k])
        b = inverse @ m[:k, k]
        sigma = max(1e-300, (m[k, k] - b @ m[:k, k]) / n)
        return -0.5 * (n * math.log(2 * math.pi * sigma) + logdet + n), b, inverse, sigma

    grid = [0.0, *np.exp(np.linspace(-12, 6, 73))]
    best = max(range(len(grid)), key=lambda i: at(grid[i])[0])
    low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    for _ in range(80):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if at(a)[0] >= at(b)[0] else (a, high)
    theta = max((low, high, (low + high) / 2, grid[best]), key=lambda t: at(t)[0])
    _, coefficients, inverse, sigma = at(theta)
    errors = np.sqrt(np.maximum(np.diag(inverse) * sigma, 0))
    out = [(t, float(c), float(e), normal_p(c / e) if e > 0 else None) for t, c, e in zip(["intercept", *features], coefficients, errors)]
    out += [("group_variance", float(theta * sigma), None, None), ("residual_variance", float(sigma), None, None)]
    return df.sparkSession.createDataFrame(out, schema)
