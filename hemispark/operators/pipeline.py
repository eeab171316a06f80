"""Pages of debates into the table of turns, as one chain of transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemispark.operators import metadata, rules, segmentation
from hemispark.operators.vocabulary import keyword_language

COLUMNS = [
    "debate_id", "year", "source_file", "debate_number", "assembly", "session", "sitting_date", "revision_status", "seq_index", "speaker_raw", "role", "party", "language", "text", "is_stage_direction",
]


def process_debates(pages: DataFrame, detector: Column | None = None) -> DataFrame:
    """Turns of every debate. ``pages``: (debate_id, source_file, year, pages array<string>).

    ``detector`` is a column over ``text`` with a language or NULL; without one only keywords and length decide.
    Front matter is read once per debate; only its few fields are joined to the turns.
    """
    first = F.get("pages", F.lit(0))
    number, _, status = metadata.file_parts(F.col("source_file"))
    head = pages.select("debate_id", "year", "source_file", *metadata.header_parts(first), status, metadata.officer_surnames(F.col("pages")).alias("_officers"))
    head = head.join(metadata.cabinets(pages).withColumnRenamed("cabinet", "_cabinet"), "debate_id", "left")
    cut = pages.select("debate_id", "pages", segmentation.body_start(F.col("pages")).alias("_start"))
    turns = segmentation.segment_turns(cut, start="_start").join(head, "debate_id")
    turns = rules.resolve_roles(turns, cabinet="_cabinet", officers="_officers").withColumnRenamed("side", "party")
    known = F.lit(None).cast("string") if detector is None else detector
    language = F.when(~F.col("is_stage_direction"), keyword_language(F.col("text"), known))
    return turns.withColumn("language", language).select(*COLUMNS)


def quality_report(turns: DataFrame) -> DataFrame:
    """(measure, value): debates, rows, dialogue, stage directions, rows without a role."""
    flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = turns.agg(
        F.countDistinct("debate_id").alias("debates"), F.count(F.lit(1)).alias("turns"), flag(~F.col("is_stage_direction")).alias("dialogue"),
        flag(F.col("is_stage_direction")).alias("stage_directions"), flag(~F.col("is_stage_direction") & F.col("role").isNull()).alias("without_role"),
    )
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("value")) for c in one.columns))).alias("m")).select("m.*")
