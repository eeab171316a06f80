"""Base relations over the test tables, as DataFrames and as SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemispark.operators import aggregates, rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = ["debate_id", "seq_index"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL of the same result if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {CTE} {sql}"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each turn once, though its row may have been delivered twice. Ask for few columns: they are shuffled."""
    chosen = columns or ("role", "language", "assembly", "speaker_raw", "sitting_date", "text", "is_stage_direction")
    return table(spark, sf_dir, "utterances").select(*KEY, *chosen).distinct()


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keys, topic): one label for each labelled turn, of several the first in the alphabet."""
    return table(spark, sf_dir, "utterance_policy_labels").groupBy(*KEY).agg(F.min("predicted_label").alias("topic"))


def debates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each debate once, as first delivered."""
    return aggregates.first_per_key(table(spark, sf_dir, "debates"), ["debate_id"], ["ingested_at"])


def chairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(debate_id, chair_surname): the test tables print no officers, so the session stands for the chair."""
    return debates(spark, sf_dir).select("debate_id", F.lower("session").alias("chair_surname"))


def tagged(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Turns with their tags and the columns asked for; the texts are read before the repeated rows go, and stay out of the shuffle unless asked for."""
    chosen = dict.fromkeys(["role", "is_stage_direction", *more])
    rows = table(spark, sf_dir, "utterances").select(*KEY, *dict.fromkeys([*chosen, "text"]))
    return rules.rule_tags(rows).select(*KEY, *chosen, *rules.TAGS).distinct()


# word boundary of Unicode text in RE2, which knows only ASCII's
_B = r"[^\p{L}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]"
_RULING = "|".join(rules.RULING_WORDS)
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
CTE = rf"""
u AS (SELECT DISTINCT debate_id, seq_index, role, language, assembly, speaker_raw, sitting_date, text, is_stage_direction FROM utterances),
tp AS (SELECT debate_id, seq_index, min(predicted_label) AS topic FROM utterance_policy_labels GROUP BY ALL),
db AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY debate_id ORDER BY ingested_at) AS rn FROM debates) WHERE rn = 1),
ch AS (SELECT debate_id, lower(session) AS chair_surname FROM db),
tg AS (SELECT *,
  NOT is_stage_direction AND coalesce(role IN ('speaker', 'deputy_speaker', 'deputy_chairperson_of_committees'), false)
    AND regexp_matches(text, '(?i)(^|{_B})({_RULING})({_B}|$)') AS chair_ruling,
  is_stage_direction AND lower({_STRIP.format("text")}) = '(interruptions)' AS interruption,
  CASE WHEN is_stage_direction THEN lower({_STRIP.format("text")}) = '(withdrawn)' ELSE regexp_matches(text, '(?i)(^|{_B})withdraw(n|ing)?({_B}|$)') END AS withdrawal_request,
  NOT is_stage_direction AND regexp_matches(text, '(?i)standing order[\s\p{{Z}}]*\p{{Nd}}+') AS so_citation,
  NOT is_stage_direction AND regexp_matches(text, '(?i)(will|would) be replied by') AS pnq_transfer FROM u),
ev AS (SELECT *, chair_ruling OR interruption AS any_event,
  coalesce(max((chair_ruling OR interruption)::INT) OVER (PARTITION BY debate_id ORDER BY seq_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) = 1 AS intervened FROM tg)
"""
