"""Tokens, vocabularies and encodings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
TOKEN = r"[a-zà-ÿ]+|\d+"
WORD = r"[a-zà-ÿ]+"
PAD, UNK = 0, 1
KREOL_WORDS = [
    "mo", "to", "li", "nou", "zot", "ou", "pou", "ena", "pa", "dan", "sa", "kot", "kouma", "kifer", "zafer", "bizin", "gagne", "fer",
    "seki", "sanla", "komie", "kitfoi", "labous",
]
SHORT = 20
# End of fixed values.


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    """Lower-case tokens in order; an empty array for NULL."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def build_vocabulary(df: DataFrame, text: str, key: list[str], size: int, least: int = 2) -> DataFrame:
    """(token, n, id) of the ``size`` most frequent tokens seen ``least`` times; ties by token; ids follow PAD and UNK."""
    counts = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + UNK)  # at most ``size`` rows


def encode(df: DataFrame, text: str, vocabulary: dict[str, int], length: int, out: str = "ids") -> DataFrame:
    """Add the ids of the first ``length`` tokens, UNK for unknown ones, padded on the right. The vocabulary is a bounded map."""
    known = F.map_from_arrays(F.array(*map(F.lit, vocabulary)), F.array(*map(F.lit, vocabulary.values()))) if vocabulary else F.create_map().cast("map<string,int>")
    ids = F.transform(F.slice(tokens(F.col(text)), 1, length), lambda t: F.coalesce(F.try_element_at(known, t), F.lit(UNK)))
    return df.withColumn(out, F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), length)), 1, length))


def encode_large(df: DataFrame, text: str, vocabulary: DataFrame, length: int, out: str = "ids") -> DataFrame:
    """As :func:`encode`, for a vocabulary (token, id) of some ten thousand tokens, which is sent to the executors as one dictionary."""
    known = df.sparkSession.sparkContext.broadcast({r.token: r.id for r in vocabulary.select("token", "id").collect()})

    @F.pandas_udf("array<int>")
    def ids(rows: pd.Series) -> pd.Series:
        get = known.value.get
        return rows.map(lambda row: [get(t, UNK) for t in row] + [PAD] * (length - len(row)))

    return df.withColumn(out, ids(F.slice(tokens(F.col(text)), 1, length)))


def keyword_hits(c: Column, words: list[str] = KREOL_WORDS) -> Column:
    """Distinct keywords among the words of a text."""
    return F.size(F.array_intersect(F.array_distinct(tokens(c, WORD)), F.array(*map(F.lit, words))))


def keyword_language(c: Column, detected: Column, words: list[str] = KREOL_WORDS, short: int = SHORT) -> Column:
    """Language by keywords first, then length, then a detector's answer: empty is unknown, two keywords decide, short texts
    are English unless they have one, French with one is Creole; a missing answer is unknown."""
    from hemispark.functions.text import strip

    text, hits = strip(c), keyword_hits(c, words)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "unknown")
        .when(hits >= 2, "mfe")
        .when((F.length(text) < short) & (hits >= 1), "mfe")
        .when(F.length(text) < short, "en")
        .when((detected == "fr") & (hits >= 1), "mfe")
        .otherwise(F.coalesce(detected, F.lit("unknown")))
    )


def collapse_labels(label: Column, kind: Column, policy: str = "Policy", none: str = "non_policy") -> Column:
    """The label where its kind is ``policy``, else ``none``, also for a missing kind."""
    return F.when(kind == policy, label).otherwise(F.lit(none))


def top_terms(df: DataFrame, group: str, text: str, n: int = 10) -> DataFrame:
    """(group, place, token, weight): the terms with the largest class TF-IDF of each group; ties by token."""
    counts = df.select(group, F.explode(tokens(F.col(text), WORD)).alias("token")).groupBy(group, "token").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("_size"))
    overall = counts.groupBy("token").agg(F.sum("n").alias("_all"))
    mean = sizes.agg(F.avg("_size").alias("_mean"))
    joined = counts.join(F.broadcast(sizes), group).join(overall, "token").crossJoin(F.broadcast(mean))  # one row
    weighed = joined.withColumn("weight", F.col("n") / F.col("_size") * F.log(1 + F.col("_mean") / F.col("_all")))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("weight", 12)), "token"))
    return weighed.withColumn("place", place).where(F.col("place") <= n).select(group, "place", "token", "weight")


def nearest_centroids(df: DataFrame, vector: str, label: str, key: str, outliers: int | None = None) -> DataFrame:
    """(key, nearest, similarity): the label whose mean vector has the largest cosine; ties by label. Zero vectors have none.

    ``outliers``: only rows with this label are asked, and they make no centroid; by default all rows are.
    """
    dim = df.select(F.posexplode(vector).alias("i", "x"), label)
    known = dim if outliers is None else dim.where(F.col(label) != outliers)
    means = known.groupBy(label, "i").agg(F.avg("x").alias("m")).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_c"))
    centroids = means.agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("_c").alias("c"))).alias("_all"))  # labels x dimension
    asked = df if outliers is None else df.where(F.col(label) == outliers)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    cosine = lambda c: F.round(F.try_divide(dot(v, c), F.sqrt(dot(v, v)) * F.sqrt(dot(c, c))), 9)
    near = F.array_max(F.filter(F.transform("_all", lambda s: F.struct(cosine(s["c"]).alias("cos"), (-s["l"]).alias("neg"))), lambda s: s["cos"].isNotNull()))
    return asked.crossJoin(F.broadcast(centroids)).withColumn("_n", near).where(F.col("_n").isNotNull()).select(key, (-F.col("_n.neg")).alias("nearest"), F.col("_n.cos").alias("similarity"))


def topic_coherence(df: DataFrame, text: str, terms: DataFrame, group: str, window: int = 110) -> DataFrame:
    """(group, coherence): c_v of each group's top terms.

    Texts are read in windows of ``window`` words that move by one; a term's vector holds its normalised pointwise mutual
    information with each of the group's terms, and the coherence is the mean cosine of the terms' vectors with their
    sum. ``terms``: (group, token), some dozens a group, which is what bounds the pairs within a window.
    """
    import numpy as np

    wanted = [(r[group], r.token) for r in terms.select(group, "token").distinct().collect()]
    listed = sorted({t for _, t in wanted})
    spark = df.sparkSession
    schema = f"{group} {terms.schema[group].dataType.simpleString()}, coherence double"
    if not listed:
        return spark.createDataFrame([], schema)
    known = F.array(*map(F.lit, listed))
    all_tokens = df.select(tokens(F.col(text), WORD).alias("_t")).where(F.size("_t") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_t") - window + 1, F.lit(1)))
    seen = all_tokens.select(F.explode(F.transform(starts, lambda s: F.array_intersect(known, F.slice("_t", s, window)))).alias("w"))
    total = seen.count()
    pair = F.explode(F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: a <= b), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")
    counts = {(r.a, r.b): r.n for r in seen.where(F.size("w") > 0).select(pair).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect()}  # pairs of listed terms
    eps, out = 1e-12, []
    for g in dict.fromkeys(g for g, _ in wanted):
        own = [t for x, t in wanted if x == g]
        p = lambda a, b: counts.get((min(a, b), max(a, b)), 0) / total
        m = np.array([[np.log((p(a, b) + eps) / max(eps, p(a, a) * p(b, b))) / -np.log(p(a, b) + eps) if 0 < p(a, b) < 1 else float(p(a, b) == 1) for b in own] for a in own])
        whole = m.sum(0)
        norms = np.linalg.norm(m, axis=1) * np.linalg.norm(whole)
        out.append((g, float(np.mean(np.divide(m @ whole, norms, out=np.zeros(len(own)), where=norms > 0)))))
    return spark.createDataFrame(out, schema)


def taxonomy(df: DataFrame, group: str, text: str, order: list[str], terms: int = 10, examples: int = 3) -> DataFrame:
    """(group, n, terms, examples): size, top terms and first texts of each group; NULL groups are left out."""
    from hemispark.operators.aggregates import examples_per_group

    rows = df.where(F.col(group).isNotNull())
    listed = lambda part, column: part.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", column))), lambda x: x[column]).alias(column))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    top = listed(top_terms(rows, group, text, terms), "token").withColumnRenamed("token", "terms")
    first = listed(examples_per_group(rows, group, order, text, examples), text).withColumnRenamed(text, "examples")
    return sizes.join(top, group, "left").join(first, group, "left")
