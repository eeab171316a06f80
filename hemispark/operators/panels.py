"""Panels of turns and series of sittings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemispark.functions.text import ratio
from hemispark.operators.rules import final_party
from hemispark.operators.windows import event_follows
from hemispark.session import broadcast_if_small

NO_TOPIC = "non_policy"
LEAST_CELL, LEAST_CELLS = 3, 10


def analysis_rows(turns: DataFrame, resolved: DataFrame, tags: DataFrame, chairs: DataFrame, topics: DataFrame) -> DataFrame:
    """Turns with side, event, intervention, chair and topic: the window runs over all rows, stage directions included.

    ``resolved``: (keys, resolved_gov_opp), ``tags``: (keys, chair_ruling, interruption), ``chairs``: (debate_id,
    chair_surname), ``topics``: (keys, topic); all left-joined, missing tags are false.
    """
    key = ["debate_id", "seq_index"]
    rows = turns.join(resolved.select(*key, "resolved_gov_opp"), key, "left").join(tags.select(*key, "chair_ruling", "interruption"), key, "left")
    event = F.coalesce(F.col("chair_ruling"), F.lit(False)) | F.coalesce(F.col("interruption"), F.lit(False))
    rows = rows.withColumn("any_event", event).withColumn("party", final_party(F.col("role"), F.col("resolved_gov_opp")))
    rows = event_follows(rows, "any_event", ["debate_id"], ["seq_index"])
    chairs, _ = broadcast_if_small(chairs)
    return rows.join(chairs, "debate_id", "left").join(topics.select(*key, "topic"), key, "left")


def eligible(rows: DataFrame) -> DataFrame:
    """Dialogue with a side, a policy topic and a known chair."""
    return rows.where(~F.col("is_stage_direction") & F.col("party").isNotNull() & F.col("topic").isNotNull() & (F.col("topic") != NO_TOPIC) & F.col("chair_surname").isNotNull())


def intervention_panel(rows: DataFrame, by: list[str], least: int = LEAST_CELL) -> DataFrame:
    """(by, n_utterances, n_intervened, intervention_rate) of cells with at least ``least`` rows."""
    cells = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_utterances"), F.sum(F.col("intervened").cast("long")).alias("n_intervened"))
    return cells.where(F.col("n_utterances") >= least).withColumn("intervention_rate", ratio(F.col("n_intervened"), F.col("n_utterances")))


def frequent_levels(cells: DataFrame, level: str, least: int = LEAST_CELLS) -> tuple[DataFrame, DataFrame]:
    """(cells whose level has at least ``least`` cells, the dropped levels)."""
    counts = cells.groupBy(level).agg(F.count(F.lit(1)).alias("_n"))
    kept, _ = broadcast_if_small(counts.where(F.col("_n") >= least).select(level))
    return cells.join(kept, level, "left_semi"), counts.where(F.col("_n") < least).select(level)


def series_grid(turns: DataFrame, topics: DataFrame, dated: DataFrame) -> DataFrame:
    """(topic, debate_id, sitting_order, sitting_date, attention_share, conflict_rate): every topic at every dated sitting.

    ``turns``: dialogue with any_event; the window runs over the dialogue that has a topic, as the filter comes first.
    ``dated``: (debate_id, sitting_date, sitting_order). The share is of all rows with a label, NULL where a sitting has none;
    the rate is 0 where the topic has no rows.
    """
    labelled = turns.join(topics.select("debate_id", "seq_index", "topic"), ["debate_id", "seq_index"]).join(dated.select("debate_id"), "debate_id", "left_semi")
    flagged = event_follows(labelled, "any_event", ["debate_id"], ["seq_index"])
    totals = flagged.groupBy("debate_id").agg(F.count(F.lit(1)).alias("total"))
    policy = flagged.where(F.col("topic") != NO_TOPIC)
    cells = policy.groupBy("topic", "debate_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("intervened").cast("long")).alias("hit"))
    # topics (dozens) x sittings: the grid itself is the result
    grid = policy.select("topic").distinct().crossJoin(dated.select("debate_id", "sitting_date", "sitting_order"))
    full = grid.join(cells, ["topic", "debate_id"], "left").join(totals, "debate_id", "left")
    n, hit = F.coalesce("n", F.lit(0)), F.coalesce("hit", F.lit(0))
    return full.select("topic", "debate_id", "sitting_order", "sitting_date", ratio(n, F.col("total")).alias("attention_share"), F.coalesce(ratio(hit, n), F.lit(0.0)).alias("conflict_rate"))
