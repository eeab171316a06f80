"""Procedural rule tags and roles of turns, as column expressions (one projection, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemispark.functions.text import strip

# Fixed values.
CHAIR_ROLES = ["speaker", "deputy_speaker", "deputy_chairperson_of_committees"]
RULING_WORDS = [
    "order", "ruling", "i rule", "not in order", "out of order", "overrule", "over-rule", "sustained", "disallow", "suspend",
    "please be seated", "withdraw", "point of order", "standing order", "continue", "silence", "quiet",
]
INTERRUPTION_MARK, WITHDRAWN_MARK = "(interruptions)", "(withdrawn)"
SO_CITATION = r"standing order\s*\d+"
WITHDRAWAL = r"\bwithdraw(n|ing)?\b"
TRANSFER = r"(will|would) be replied by"
# End of fixed values.
TAGS = ["chair_ruling", "interruption", "withdrawal_request", "so_citation", "pnq_transfer"]


def rule_tags(df: DataFrame, text: str = "text", stage: str = "is_stage_direction", role: str = "role") -> DataFrame:
    """Add the five boolean tags. NULL text or flag counts as '' and false; a NULL role is no chair role."""
    t, on_stage = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(stage), F.lit(False))
    mark = F.lower(strip(t))
    chair = F.coalesce(F.col(role).isin(CHAIR_ROLES), F.lit(False))
    has = lambda pattern: t.rlike("(?iU)" + pattern)
    tags = {
        "chair_ruling": ~on_stage & chair & has(rf"\b({'|'.join(RULING_WORDS)})\b"),
        "interruption": on_stage & (mark == INTERRUPTION_MARK),
        "withdrawal_request": F.when(on_stage, mark == WITHDRAWN_MARK).otherwise(has(WITHDRAWAL)),
        "so_citation": ~on_stage & has(SO_CITATION),
        "pnq_transfer": ~on_stage & has(TRANSFER),
    }
    return df.withColumns(tags)


def tag_summary(tagged: DataFrame, tags: list[str] = TAGS) -> DataFrame:
    """(tag, n, pct) of each tag in one pass over the rows; pct is NULL for an empty table."""
    sums = tagged.agg(F.count(F.lit(1)).alias("_rows"), *(F.coalesce(F.sum(F.col(t).cast("int")), F.lit(0)).alias(t) for t in tags))
    long = sums.select("_rows", F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).cast("long").alias("n")) for t in tags))).alias("x"))
    return long.select("x.tag", "x.n", F.try_divide(100.0 * F.col("x.n"), F.col("_rows")).alias("pct"))


def tag_overlaps(tagged: DataFrame, tags: list[str] = TAGS, least: int = 2) -> DataFrame:
    """(tags_per_row, n): rows by their number of tags, from ``least`` on."""
    number = sum((F.col(t).cast("int") for t in tags[1:]), F.col(tags[0]).cast("int"))
    return tagged.groupBy(number.alias("tags_per_row")).agg(F.count(F.lit(1)).alias("n")).where(F.col("tags_per_row") >= least)


def final_party(role: Column, resolved: Column) -> Column:
    """Side of a turn: ministers govern, the leader of the opposition opposes, others by the registry."""
    return (
        F.when(role.isin("minister", "prime_minister", "deputy_prime_minister"), "government")
        .when(role == "leader_of_opposition", "opposition")
        .when(role == "unclassified_mp", resolved)
    )


# Label patterns of roles, in order of precedence, with the side of each.
ROLE_PATTERNS = [
    (r"^(The\s+)?(Ag\.\s+)?Prime Minister$", "prime_minister", "government"),
    (r"^The (Ag\.\s+)?Deputy Prime Minister$", "deputy_prime_minister", "government"),
    (r"^The Leader of the Opposition", "leader_of_opposition", "opposition"),
    (r"^(Mr|Madam)\s+Speaker$", "speaker", "chair"),
    (r"^(The\s+)?(Mr|Madam)?\s*Deputy Speaker$", "deputy_speaker", "chair"),
    (r"^(The\s+|Madam\s+)?Chairperson$", "deputy_chairperson_of_committees", "chair"),
]
# End of fixed values.


def bare_surname(label: Column) -> Column:
    """Last word of a label in lower case; of its last parentheses if it ends in some; '' if nothing is left."""
    inner = F.regexp_extract(label, r"\(([^)]+)\)\s*$", 1)
    name = strip(F.regexp_replace(F.when(inner != "", inner).otherwise(label), r"^(Mr\.?|Mrs\.?|Ms\.?|Dr\.?|The)\s+", ""))
    return F.regexp_replace(F.lower(F.regexp_extract(name, r"(\S+)$", 1)), r"^\.+|\.+$", "")


def resolve_roles(df: DataFrame, label: str = "speaker_raw", cabinet: str | None = None, officers: str | None = None) -> DataFrame:
    """Add ``role`` and ``side``. ``cabinet``: map surname -> portfolio, ``officers``: map role -> surname, both optional columns.

    Phrases come first, then the cabinet, then the first officer in map order; a NULL label has neither.
    """
    c = strip(F.col(label))
    role, side = F.when(F.col(label).isNull(), None), F.when(F.col(label).isNull(), None)
    for pattern, name, of in ROLE_PATTERNS:
        role, side = role.when(c.rlike("(?i)" + pattern), name), side.when(c.rlike("(?i)" + pattern), of)
    surname = bare_surname(F.col(label))
    if cabinet:
        member = (surname != "") & F.coalesce(F.map_contains_key(cabinet, surname), F.lit(False))
        role, side = role.when(member, "minister"), side.when(member, "government")
    if officers:
        post = F.get(F.filter(F.map_entries(officers), lambda e: e["value"] == surname), F.lit(0))["key"]
        role, side = role.when((surname != "") & post.isNotNull(), post), side.when((surname != "") & post.isNotNull(), "chair")
    return df.withColumns({"role": role.otherwise("unclassified_mp"), "side": side})
