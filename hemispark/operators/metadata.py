"""Front matter of a debate: header, cabinet, officers, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemispark.functions.text import extract, strip

# Fixed values.
HONORIFIC = r"(?i)^(Dr\.\s+the\s+Hon\.|Hon\.\s+Mrs|Hon\.\s+Ms|Hon\.\s+Dr\.|Hon\.\s+Sir|Hon\.)\s*"
PORTFOLIO_TRIGGERS = ["Prime Minister", "Deputy Prime Minister", "Vice-Prime Minister", "Minister of", "Minister for", "Attorney General"]
OFFICER_ROLES = [
    "Deputy Chairperson of Committees", "Clerk of the National Assembly", "Deputy Clerk", "Clerk Assistant", "Hansard Editor",
    "Serjeant-at-Arms", "Deputy Speaker", "Madam Speaker", "Mr Speaker",
]
FILE_NAME = r"(?i)Debate_No\.?_?(\d+[A-Za-z]?)_of_(\d{4})(?:_\((REVISED|UNREVISED)\))?"
HEADER_PARTS = [
    ("debate_number", r"No\.\s*(\d+[A-Za-z]?)\s*of\s*(\d{4})", 0), ("assembly", r"([A-Z]+)\s+NATIONAL ASSEMBLY", 1), ("session", r"([A-Z]+)\s+SESSION", 1),
    ("sitting_date", r"([A-Z]+DAY)\s+(\d{1,2})\s+([A-Z]+)\s+(\d{4})", 0),
]
SIR = r"^Sir\s+"
STABLE_NUMBER, STABLE_TITLE = r"\b\d+\b", r"(?i)^(hon\.?\s+)?(mrs?\.?\s+|ms\.?\s+|dr\.?\s+)?"
LAST_WORD, OUTER_DOTS = r"(\S+)$", r"^\.+|\.+$"
FRONT_PAGES, CABINET_LENGTH, OFFICERS_LENGTH, ENTRY_LENGTH = 8, 4000, 2000, 200
# End of fixed values.


def file_parts(name: Column) -> list[Column]:
    """Number, year and revision status in a file name; NULL without a match, status '' if none is given."""
    return [extract(name, FILE_NAME, 1).alias("file_number"), extract(name, FILE_NAME, 2).alias("file_year"), F.upper(extract(name, FILE_NAME, 3)).alias("revision_status")]


def header_parts(text: Column) -> list[Column]:
    """Debate number, assembly, session and sitting date as printed on the title page."""
    return [extract(text, pattern, group).alias(name) for name, pattern, group in HEADER_PARTS]


def surname_of(name: Column) -> Column:
    """Surname of a printed name: no honorifics, no letters after the comma, last word; NULL if nothing is left."""
    bare = F.regexp_replace(strip(F.regexp_replace(name, HONORIFIC, "")), SIR, "")
    last = F.regexp_extract(strip(F.split(bare, ",")[0]), LAST_WORD, 1)
    return F.nullif(F.regexp_replace(F.lower(last), OUTER_DOTS, ""), F.lit(""))


def front_matter(pages: Column) -> Column:
    return F.array_join(F.slice(pages, 1, FRONT_PAGES), "\n")


def cabinets(df: DataFrame, debate: str = "debate_id", pages: str = "pages") -> DataFrame:
    """(debate_id, cabinet map<surname, portfolio>); of members with one surname the last counts. Debates without a list are left out."""
    text = front_matter(F.col(pages))
    at, end = F.instr(text, "THE CABINET"), F.instr(text, "PRINCIPAL OFFICERS")
    block = F.when(end > 0, F.substring(text, at, F.greatest(end - at, F.lit(0)))).otherwise(F.substring(text, at, F.lit(CABINET_LENGTH)))
    line = df.where(at > 0).select(F.col(debate).alias("debate_id"), F.posexplode(F.split(block, "\n")).alias("i", "line")).withColumn("line", strip(F.col("line")))
    line = line.where((F.col("line") != "") & (F.col("line") != "THE CABINET") & ~F.col("line").startswith("(Formed by"))
    opens = F.col("line").startswith("Hon.") | F.col("line").startswith("Dr. the Hon.")
    line = line.withColumn("entry", F.sum(opens.cast("int")).over(Window.partitionBy("debate_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where("entry > 0")
    spots = F.filter(F.array(*(F.instr("line", t) for t in PORTFOLIO_TRIGGERS)), lambda x: x > 0)
    spot = F.when(opens, F.array_min(spots))
    name = F.when(opens, F.regexp_replace(strip(F.when(spot.isNotNull(), F.substring("line", F.lit(1), spot - 1)).otherwise(F.col("line"))), r",+$", ""))
    words = F.when(opens, F.when(spot.isNotNull(), strip(F.substring("line", spot, F.length("line"))))).otherwise(F.col("line"))
    entry = line.select("debate_id", "entry", "i", name.alias("name"), words.alias("words")).groupBy("debate_id", "entry").agg(
        F.min_by("name", "i").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x["words"]), " ").alias("portfolio")
    )
    entry = entry.withColumn("surname", surname_of(F.col("name"))).where(F.col("surname").isNotNull())
    last = entry.groupBy("debate_id", "surname").agg(F.max_by("portfolio", "entry").alias("portfolio"))
    return last.groupBy("debate_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("surname", "portfolio")))).alias("cabinet"))


def officer_surnames(pages: Column) -> Column:
    """Map role -> surname in the order of the printed roles; both forms of address of the Speaker are one role, the later counts."""
    text = front_matter(pages)
    at = F.instr(text, "PRINCIPAL OFFICERS")
    section = F.substring(text, at, F.lit(OFFICERS_LENGTH))
    block = F.substring(section, F.greatest(F.instr(section, "\n"), F.lit(1)), F.lit(OFFICERS_LENGTH))
    found = []
    for role in OFFICER_ROLES:
        spot = F.instr(block, role)
        rest = F.substring(block, spot + len(role), F.lit(OFFICERS_LENGTH))
        others = F.filter(F.array(*(F.instr(rest, r) for r in OFFICER_ROLES)), lambda x: x > 0)
        entry = F.substring(rest, F.lit(1), F.coalesce(F.array_min(others) - 1, F.lit(ENTRY_LENGTH)))
        surname = F.lower(strip(F.split(strip(entry), ",")[0]))
        key = "speaker" if role.endswith(" Speaker") and not role.startswith("Deputy") else role.lower().replace(" ", "_")
        found.append(F.when((at > 0) & (spot > 0) & (surname != ""), F.struct(F.lit(key).alias("key"), surname.alias("value"))))
    kept = F.filter(F.array(*found), lambda e: e.isNotNull())
    # of equal keys the last stays
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.lit(len(OFFICER_ROLES))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def stable_surname(raw: Column) -> Column:
    """A grouping key for a chair: no line breaks, stray digits or titles, last word in lower case; NULL if nothing is left."""
    text = strip(F.regexp_replace(F.regexp_replace(raw, "\n", " "), STABLE_NUMBER, " "))
    text = F.regexp_replace(text, STABLE_TITLE, "")
    last = F.regexp_replace(F.lower(F.regexp_extract(strip(text), LAST_WORD, 1)), OUTER_DOTS, "")
    return F.nullif(last, F.lit(""))


def chair_identities(df: DataFrame, debate: str = "debate_id", pages: str = "pages") -> DataFrame:
    """(debate_id, chair_surname, deputy_speaker_surname)."""
    o = df.select(F.col(debate).alias("debate_id"), officer_surnames(F.col(pages)).alias("o"))
    return o.select("debate_id", stable_surname(F.try_element_at("o", F.lit("speaker"))).alias("chair_surname"), stable_surname(F.try_element_at("o", F.lit("deputy_speaker"))).alias("deputy_speaker_surname"))
