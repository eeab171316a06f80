"""Parliamentary questions: headers, transfers and their panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemispark.functions.text import strip
from hemispark.operators.rules import TRANSFER

# Fixed values.
HEADER = r"\(No\.\s*B/(\d+)\)\s*((?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[^(]+?)\s*\(([^)]+)\)"
NUMBER = r"B/(\d+)"
# End of fixed values.


def question_headers(turns: DataFrame, header: str = HEADER) -> DataFrame:
    """(debate_id, pq_num, asker_raw, constituency_raw, seq_index, is_stage_direction), the first header of each number in a debate.

    First is by (seq_index, place in the text)."""
    groups = [F.regexp_extract_all("text", F.lit(header), F.lit(g)) for g in (1, 2, 3)]
    found = turns.where(F.col("text").rlike(header)).select("debate_id", "seq_index", "is_stage_direction", F.posexplode(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("a", "b", "c"))))).alias("place", "h"))
    rows = found.select("debate_id", F.col("h.a").alias("pq_num"), strip(F.col("h.b")).alias("asker_raw"), strip(F.col("h.c")).alias("constituency_raw"), "seq_index", "is_stage_direction", "place")
    first = F.row_number().over(Window.partitionBy("debate_id", "pq_num").orderBy("seq_index", "place"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "place")


def question_numbers(turns: DataFrame, prefilter: str = "(?i)" + TRANSFER, number: str = NUMBER) -> DataFrame:
    """(debate_id, pq_num): every number in a text that matches ``prefilter``, once."""
    hit = turns.where(F.col("text").rlike(prefilter))
    return hit.select("debate_id", F.explode(F.regexp_extract_all("text", F.lit(number), F.lit(1))).alias("pq_num")).distinct()


def flag_members(df: DataFrame, members: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add ``out``: whether the row's keys are among ``members``; NULL keys are not."""
    known = members.select(*keys).distinct().withColumn("_in", F.lit(True))
    return df.join(known, keys, "left").withColumn(out, F.col("_in").isNotNull()).drop("_in")


def question_panel(turns: DataFrame, topics: DataFrame, registry: DataFrame, alignment: DataFrame, header: str = HEADER) -> tuple[DataFrame, DataFrame]:
    """(panel, counts). One row per question: asker, constituency, place of its header, party and side of the asker, topic, transferred.

    ``turns``: (debate_id, seq_index, is_stage_direction, text, assembly, sitting_date), ``topics``: (debate_id, seq_index,
    topic). A header on a stage line has the topic of the next turn of its debate. ``counts`` is one row: transfers
    mentioned, and those among the questions.
    """
    from hemispark.functions.dates import day_month_year
    from hemispark.operators.resolution import resolve_candidates, valid_sides
    from hemispark.operators.windows import own_or_next
    from hemispark.session import broadcast_if_small

    found = question_headers(turns, header)
    about, _ = broadcast_if_small(turns.groupBy("debate_id").agg(F.max("assembly").alias("assembly"), F.max("sitting_date").alias("sitting_date")))
    keys = ["debate_id", "pq_num", "asker_raw", "constituency_raw", "seq_index", "is_stage_direction"]
    resolved = resolve_candidates(found.join(about, "debate_id", "left"), registry, [*keys, "assembly", "sitting_date"], label="asker_raw")
    resolved = resolved.withColumn("_day", day_month_year(F.col("sitting_date")))
    sided = valid_sides(resolved, alignment, [*keys, "assembly", "sitting_date", "resolved_party", "match_method"], "resolved_party", "term", "_day")
    topical = own_or_next(turns.select("debate_id", "seq_index", "is_stage_direction"), topics, "debate_id", "seq_index", "is_stage_direction", "topic", "topic")
    panel = sided.join(topical.select("debate_id", "seq_index", "topic"), ["debate_id", "seq_index"], "left")
    moved = question_numbers(turns)
    panel = flag_members(panel, moved, ["debate_id", "pq_num"], "transferred")
    panel = panel.withColumnsRenamed({"seq_index": "header_seq_index", "is_stage_direction": "header_is_stage_direction", "gov_or_opp": "resolved_gov_opp"})
    counts = flag_members(moved, found, ["debate_id", "pq_num"], "_known").agg(F.count(F.lit(1)).alias("transfers"), F.coalesce(F.sum(F.col("_known").cast("long")), F.lit(0)).alias("matched"))
    return panel, counts
