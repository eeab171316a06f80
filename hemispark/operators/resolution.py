"""Speakers resolved against a registry and its time-varying alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemispark.functions.text import name_key, strip, words
from hemispark.session import broadcast_if_small

# Fixed values.
TERMS = {"SIXTH": "6th", "SEVENTH": "7th", "EIGHTH": "8th"}
HONORIFIC = r"^(Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Madam|The)\s+"
# End of fixed values.


def term_of(assembly: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, term in TERMS.items():
        out = F.when(assembly == name, term).otherwise(out)
    return out


def candidate_surnames(label: Column) -> Column:
    """The last two words, then the last, of the label's closing parentheses or else of the label, as name keys."""
    inner = F.regexp_extract(label, r"\(([^)]+)\)\s*$", 1)
    name = F.regexp_replace(strip(F.when(inner != "", inner).otherwise(label)), HONORIFIC, "")
    w = F.filter(F.transform(words(name_key(name)), lambda x: F.regexp_replace(x, r"^\.+|\.+$", "")), lambda x: x != "")
    one = F.try_element_at(w, F.lit(-1))
    two = F.when(F.size(w) >= 2, F.concat_ws(" ", F.try_element_at(w, F.lit(-2)), one))
    return F.filter(F.array(two, one), lambda x: x.isNotNull())


def registry_keys(registry: DataFrame, term: str = "assembly_term", key: str = "surname_key", name: str = "full_name", party: str = "party") -> DataFrame:
    """(term, key, people, party): how many persons share a key in a term, and the party of the first by name."""
    rows = registry.select(F.col(term).alias("term"), name_key(F.col(key)).alias("key"), F.col(name).alias("name"), F.col(party).alias("party"))
    return rows.where(F.col("term").isNotNull() & (F.col("key") != "")).groupBy("term", "key").agg(F.countDistinct("name").alias("people"), F.min_by("party", F.struct("name", "party")).alias("party"))


def resolve_candidates(df: DataFrame, registry: DataFrame, keys: list[str], label: str = "speaker_raw", assembly: str = "assembly") -> DataFrame:
    """``keys`` with resolved_party and match_method.

    Candidates are tried in order; the first that the term's registry knows decides: one person gives the party and
    ``matched_2word`` or ``matched_1word``, several give none and ``ambiguous_collision``. Else ``no_match``.
    Labels are resolved once each; the rows then join the distinct labels.
    """
    term = term_of(F.col(assembly))
    labels = df.select(F.col(label).alias("_label"), F.col(assembly).alias("_assembly")).distinct()
    asked = labels.select("_label", "_assembly", term_of(F.col("_assembly")).alias("term"), F.posexplode(candidate_surnames(F.col("_label"))).alias("place", "key"))
    known, _ = broadcast_if_small(registry_keys(registry))
    hit = asked.join(known, ["term", "key"]).groupBy("_label", "_assembly").agg(F.min_by(F.struct("key", "people", "party"), "place").alias("h"))
    joined = df.join(hit, df[label].eqNullSafe(hit["_label"]) & df[assembly].eqNullSafe(hit["_assembly"]), "left")
    several = F.col("h.people") > 1
    method = F.when(F.col("h").isNull(), "no_match").when(several, "ambiguous_collision").when(F.contains("h.key", F.lit(" ")), "matched_2word").otherwise("matched_1word")
    return joined.select(*(df[k] for k in keys), term.alias("term"), F.when(~several, F.col("h.party")).alias("resolved_party"), method.alias("match_method"))


def valid_sides(df: DataFrame, alignment: DataFrame, keys: list[str], party: str, term: str, day: str, side: str = "gov_or_opp") -> DataFrame:
    """``keys`` and ``side`` of the party in its term on a day.

    A party with one window in the term has it regardless of the day, even a missing one; of several the earliest
    window (by start, end, side) that holds the day; none gives NULL. Windows are half-open, NULL bounds unbounded.
    """
    w = alignment.select(F.col("party").alias("_party"), F.col("assembly_term").alias("_term"), F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"), F.col(side).alias("_side")).distinct()
    w = w.groupBy("_party", "_term").agg(F.array_sort(F.collect_set(F.struct("_from", "_to", "_side"))).alias("_windows"))  # windows of a party: few
    w, _ = broadcast_if_small(w)
    rows = df.join(w, (df[party] == w["_party"]) & (df[term] == w["_term"]), "left")
    d = F.col(day)
    holds = F.filter("_windows", lambda x: (x["_from"].isNull() | (x["_from"] <= d)) & (x["_to"].isNull() | (d < x["_to"])))
    chosen = F.when(F.size("_windows") == 1, F.get("_windows", F.lit(0))["_side"]).when(d.isNotNull(), F.get(holds, F.lit(0))["_side"])
    return rows.select(*(df[k] for k in keys), chosen.alias(side))
