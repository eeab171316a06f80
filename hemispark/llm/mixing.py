"""Sources mixed to target shares of all tokens, by capped water-filling.

Every source is given its share of the total; a source whose share would need more than its allowed repetitions is
clamped there and what it lacks is spread over the others in proportion to their targets, until all fit. A source's
share of its own size is its number of epochs: every document is used the whole number of times, and a seeded choice
of documents, filled bin by bin over their hashes, once more for the fraction.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemispark.session import checkpoint

#: Vocabulary file of a public tokenizer (ranks of a byte-level BPE), and its word pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BINS = 4096
_encoders: dict[int, object] = {}


def token_counter(spark: SparkSession, vocabulary: str = VOCABULARY) -> Callable:
    """UDF text -> number of tokens; NULL and '' have 0. The vocabulary (under 1 MB) is sent to the executors."""
    content = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        encoder = _encoders.get(0)
        if encoder is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.value.splitlines())}
            encoder = _encoders[0] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda t: len(encoder.encode_ordinary(t)) if t else 0).astype("int64")

    return count


def reachable_total(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """The largest total at which every source that has tokens reaches its share within its repetitions."""
    live = {s: share for s, (share, most) in targets.items() if sizes.get(s, 0) > 0 and share > 0 and most > 0}
    return min((sizes[s] * targets[s][1] * sum(live.values()) / live[s] for s in live), default=0.0)


def water_fill(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens of each source. ``targets``: (share, most repetitions); ``total``: default the size of all target sources.

    Shares are scaled to sum to 1 over the sources that have tokens. If the caps together hold less than the total,
    every source is at its cap.
    """
    live = {s: share for s, (share, most) in targets.items() if sizes.get(s, 0) > 0 and share > 0 and most > 0}
    total = float(sum(sizes[s] for s in live)) if total is None else float(total)
    caps = {s: sizes[s] * targets[s][1] for s in live}
    given: dict[str, float] = {}
    while live:
        rest, weight = total - sum(given.values()), sum(live.values())
        over = [s for s in sorted(live) if rest * live[s] / weight > caps[s] + 1e-9]
        if not over:
            given |= {s: rest * w / weight for s, w in live.items()}
            break
        for s in over:
            given[s] = float(caps[s])
            del live[s]
    return given


def counted(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, source, tokens) of every document with a source."""
    rows = df.where(F.col(source).isNotNull()).select(doc, source, text)
    return rows.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), token_counter(df.sparkSession, vocabulary)(text).alias("tokens"))


def mix_sources(sized: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 11, bins: int = BINS) -> DataFrame:
    """(doc_id, source, tokens, repeats) of every document that is used at least once.

    ``sized``: (doc_id, source, tokens); ``targets``: (source, target_share, max_repeats), one row per source (of
    repeated rows one is used). ``total``: tokens of the mix, by default as many as the target sources have; sources whose share needs more
    than their repetitions are clamped and the others take what they lack. ``"reachable"`` is the largest total at which nothing has to
    be clamped. Documents of sources without a target are left out. Repeated document ids are documents of their own.
    """
    wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where("source is not null").orderBy("source", "target_share", "max_repeats").collect()}  # the targets themselves
    marked = sized.where(F.col("source").isin(list(wanted))) if wanted else sized.limit(0)
    marked = marked.withColumn("_bin", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(bins)).cast("int"))
    sums = checkpoint(marked.groupBy("source", "_bin").agg(F.sum("tokens").alias("n")))
    sizes = {r.source: r.n or 0 for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row for each target
    given = water_fill(sizes, wanted, reachable_total(sizes, wanted) if total == "reachable" else None if total is None else float(total))
    parts = []
    for s, tokens in sorted(given.items()):
        whole = int(tokens // sizes[s] + 1e-9)
        parts.append((s, whole, -1.0 if whole >= wanted[s][1] else tokens - whole * sizes[s]))
    plan = sized.sparkSession.createDataFrame(parts, "source string, _whole int, _rest double")
    # a further time: the bins before the first one whose larger half no longer fits
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = F.when(before + F.col("n") / 2 > F.col("_rest"), F.col("_bin"))
    cuts = sums.join(F.broadcast(plan), "source").withColumn("_full", full).groupBy("source", "_whole").agg(F.coalesce(F.min("_full"), F.lit(bins)).alias("_cut"))
    used = marked.join(F.broadcast(cuts), "source").withColumn("repeats", F.col("_whole") + (F.col("_bin") < F.col("_cut")).cast("int"))  # one row for each target
    return used.where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, actual_share, most_repeats) of each target source."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = used.agg(F.sum("tokens").alias("_total"))
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(used, "source", "left")
    rows = rows.crossJoin(F.broadcast(total))  # one row
    tokens = F.coalesce("tokens", F.lit(0))
    return rows.select("source", "target_share", "max_repeats", tokens.alias("tokens"), F.coalesce(F.try_divide(tokens, "_total"), F.lit(0.0)).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
