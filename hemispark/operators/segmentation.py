"""Pages of a debate into speaker turns by windows (gaps and islands), without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemispark.functions.text import strip

# What a line of the record looks like.
SHORT_TAG = r"^(Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Madam)\s+([A-Za-zÀ-ÿ'\-. ]{1,40}?):\s*(.*)$"
LONG_TAG = r"^The\s+([A-Za-zÀ-ÿ'\-.,()0-9 ]{1,120}?):\s*(.*)$"
LONG_TAG_KEYWORDS = ["Minister", "Speaker", "Leader of the Opposition", "Chairperson", "President", "Whip"]
STAGE_PATTERNS = [
    r"(?i)^At\s+\d{1,2}[.:]\d{2}\s*(a\.m\.|p\.m\.|hrs)",
    r"(?i)^On resuming",
    r"(?i)the sitting (was|is) (suspended|adjourned|resumed)",
    r"^\(.{2,80}\)$",
    r"(?i)^The National Anthem was played",
    r"(?i)^The Assembly met",
]
PAGE_NUMBER = r"^\d{1,4}$"
FRONT_MATTER_MARKERS = ["CONTENTS", "THE CABINET", "PRINCIPAL OFFICERS", "NATIONAL ASSEMBLY", "The Assembly met", "The National Anthem was played"]
FRONT_PAGES = 15
# End of fixed values.


def is_stage_line(line: Column) -> Column:
    out = F.lit(False)
    for pattern in STAGE_PATTERNS:
        out = out | line.rlike(pattern)
    return out


def _is_long(line: Column) -> Column:
    name = F.regexp_extract(line, LONG_TAG, 1)
    return line.rlike(LONG_TAG) & F.exists(F.array(*map(F.lit, LONG_TAG_KEYWORDS)), lambda k: F.contains(name, k))


def tag_of(line: Column) -> Column:
    """struct(speaker, rest) if the line opens a turn, else NULL."""
    short = F.struct(strip(F.concat_ws(" ", F.regexp_extract(line, SHORT_TAG, 1), F.regexp_extract(line, SHORT_TAG, 2))).alias("speaker"), F.regexp_extract(line, SHORT_TAG, 3).alias("rest"))
    long = F.struct(strip(F.concat(F.lit("The "), F.regexp_extract(line, LONG_TAG, 1))).alias("speaker"), F.regexp_extract(line, LONG_TAG, 2).alias("rest"))
    return F.when(line.rlike(SHORT_TAG), short).when(_is_long(line), long)


def body_start(pages: Column) -> Column:
    """Index of the first page after the last of the first pages that holds a front-matter marker, at most the last page."""
    marked = F.transform(F.slice(pages, 1, FRONT_PAGES), lambda p, i: F.when(F.exists(F.array(*map(F.lit, FRONT_MATTER_MARKERS)), lambda m: F.contains(p, m)), i))
    return F.least(F.coalesce(F.array_max(marked), F.lit(0)) + 1, F.size(pages) - 1)


def segment_turns(df: DataFrame, debate: str = "debate_id", pages: str = "pages", start: str | None = None) -> DataFrame:
    """(debate, seq_index, speaker_raw, text, is_stage_direction), numbered densely from 0 in each debate.

    Stage lines stand alone and end a turn; what follows one without a tag has no speaker. A line that begins with
    ``The`` and has no tag takes the next line along if both together are one; of a run of such lines every other is
    joined. Turns without text are dropped. NULL pages give no rows, ``start`` is the first page (default 0).
    """
    first = F.col(start) if start else F.lit(0)
    page = df.select(F.col(debate).alias("debate_id"), F.posexplode(pages).alias("p", "page"), first.alias("_first")).where(F.col("p") >= F.col("_first"))
    line = page.select("debate_id", "p", F.posexplode(F.split("page", "\n")).alias("l", "raw")).select("debate_id", "p", "l", strip(F.col("raw")).alias("line"))
    line = line.where((F.col("line") != "") & ~F.col("line").rlike(PAGE_NUMBER))
    by = Window.partitionBy("debate_id").orderBy("p", "l")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({"next": F.lead("line").over(by), "stage": is_stage_line(F.col("line")), "tag": tag_of(F.col("line"))})
    pair = F.concat_ws(" ", "line", "next")
    would = ~F.col("stage") & F.col("tag").isNull() & F.col("line").startswith("The ") & F.col("next").isNotNull() & _is_long(pair) & ~pair.rlike(SHORT_TAG)
    line = line.withColumn("would", F.coalesce(would, F.lit(False)))
    line = line.withColumn("run", F.sum((~F.col("would") | ~F.coalesce(F.lag("would").over(by), F.lit(False))).cast("int")).over(upto))
    place = F.row_number().over(Window.partitionBy("debate_id", "run").orderBy("p", "l"))
    line = line.withColumn("join", F.col("would") & (place % 2 == 1))
    line = line.withColumn("eaten", F.coalesce(F.lag("join").over(by), F.lit(False))).where(~F.col("eaten"))
    line = line.withColumn("tag", F.when(F.col("join"), tag_of(pair)).otherwise(F.when(~F.col("stage"), F.col("tag"))))
    begins = F.col("stage") | F.col("tag").isNotNull() | F.coalesce(F.lag("stage").over(by), F.lit(False))
    line = line.withColumn("turn", F.sum(begins.cast("int")).over(upto))
    chunk = F.when(F.col("tag").isNotNull(), F.col("tag.rest")).otherwise(F.col("line"))
    turn = line.groupBy("debate_id", "turn").agg(
        F.min_by("tag.speaker", F.struct("p", "l")).alias("speaker_raw"),
        F.max("stage").alias("is_stage_direction"),
        F.array_sort(F.collect_list(F.when(chunk != "", F.struct("p", "l", chunk.alias("chunk"))))).alias("chunks"),
    )
    turn = turn.withColumn("text", strip(F.array_join(F.transform("chunks", lambda c: c["chunk"]), " "))).where(F.col("text") != "")
    number = F.row_number().over(Window.partitionBy("debate_id").orderBy("turn")) - 1
    return turn.select("debate_id", number.cast("long").alias("seq_index"), "speaker_raw", "text", "is_stage_direction")
