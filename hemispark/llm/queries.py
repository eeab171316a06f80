"""Queries of the text problems over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemispark.llm import characters, entities, language, leakage, mixing, scans, subjects, toxicity, turns
from hemispark.llm.tables import table
from hemispark.session import checkpoint

KEY = ["debate_id", "seq_index"]
LANGUAGES = ["en", "fr", "mfe"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characters.visually_identical(table(spark, sf_dir, "utterances"), KEY, ["speaker_raw", "text"])


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "utterances").select(*KEY, "speaker_raw", "text")
    once = rows.dropDuplicates([*KEY, "speaker_raw", "text"])
    return characters.normalize_columns(once, ["speaker_raw", "text"]).select(*KEY, "speaker_raw_norm", "text_norm")


def _network(utterances: DataFrame) -> language.ByteNetwork | None:
    return language.fit_language(utterances.where(~F.col("is_stage_direction")), "text", "language", KEY, LANGUAGES)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "utterances")
    return language.wrong_languages(rows.where(~F.col("is_stage_direction")), KEY, "text", "language", _network(rows))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "utterances")
    found = language.language_segments(rows.where(~F.col("is_stage_direction")).select(*KEY, "text"), "text", _network(rows))
    return found.select(*KEY, F.posexplode("segments").alias("segment", "s")).select(*KEY, "segment", "s.language", "s.confidence", "s.text").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.variant_names(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "speaker_registry"), KEY)


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "utterances").select(*KEY, "speaker_raw", "assembly")
    return entities.link_speakers(rows, table(spark, sf_dir, "speaker_registry")).where("member_id is not null").select(*KEY, "member_id").distinct()


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "utterances").where(~F.col("is_stage_direction"))
    return subjects.subject_areas(rows, KEY, "text", table(spark, sf_dir, "utterance_policy_labels"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select(*KEY, "subject")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_shares(_subjects(spark, sf_dir), KEY)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.transcript_noise(table(spark, sf_dir, "utterances"), KEY, "speaker_raw", "text", "is_stage_direction")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.clean_turns(table(spark, sf_dir, "utterances"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.page_noise(table(spark, sf_dir, "utterances"), KEY, "text")


def p7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(table(spark, sf_dir, "utterances"), KEY, "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_matches(spark, sf_dir).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the longest verbatim match in words and the word of the document at which it begins."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), p8_found(spark, sf_dir))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(mixing.counted(table(spark, sf_dir, "documents")))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the sources have: small sources are clamped at their caps, the others take what they lack."""
    return mixing.mix_sources(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the largest mix in which every source reaches its target."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.mix_shares(mixing.mix_sources(_sized(spark, sf_dir), targets, total="reachable"), targets)


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_examples(documents, table(spark, sf_dir, "doc_labels"))
    return toxicity.abuse_scores(documents.select("doc_id", "source", "text"), model).drop("text"), model.threshold


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, threshold = _scored(spark, sf_dir)
    return scored.where(F.col("abuse.vote") >= threshold).select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = _scored(spark, sf_dir)
    return scored.select("doc_id", "abuse.score", "abuse.vote", "abuse.evidence")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, threshold = _scored(spark, sf_dir)
    return toxicity.abuse_rates(scored, threshold)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_forms, p2_found, p2_segments, p3_found, p3_links, p5_found, p5_shares, p6_found, p6_turns,
            p7_found, p7_paragraphs, p8_found, p8_clean, p8_matches, p9_mix, p9_shares, p9_reachable, p10_found, p10_scores, p10_rates,
        )
    }


def oracle_sql() -> dict[str, str]:
    """None: trained models, automata and iterative matching have no SQL; tests compare them with brute force instead."""
    return {}
