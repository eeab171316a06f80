"""Title pages, question headers, names, and what samples keep. The pages are put together from the columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemispark.operators import metadata, panels, questions, sampling, vocabulary
from hemispark.plans.base import _STRIP, KEY, debates, query, table, topics
from hemispark.plans.basic import NON_POLICY
from hemispark.plans.linking import _SIDED, linking_panel


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _part(pattern: str, group: int, text: str = "t") -> str:
    return f"CASE WHEN regexp_matches({text}, {_quoted(pattern)}) THEN regexp_extract({text}, {_quoted(pattern)}, {group}) END"


@query(
    "SELECT debate_id, " + ", ".join(f"{_part(p, g)} AS {name}" for name, p, g in metadata.HEADER_PARTS)
    + " FROM (SELECT debate_id, concat_ws(chr(10), debate_number, assembly || ' NATIONAL ASSEMBLY', session || ' SESSION', upper(sitting_date)) AS t FROM db)"
)
def title_pages(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat_ws("\n", "debate_number", F.concat("assembly", F.lit(" NATIONAL ASSEMBLY")), F.concat("session", F.lit(" SESSION")), F.upper("sitting_date"))
    return debates(spark, d).select("debate_id", page.alias("t")).select("debate_id", *metadata.header_parts(F.col("t")))


@query(f"SELECT debate_id, {_part(metadata.FILE_NAME, 1, 'source_file')} AS file_number, {_part(metadata.FILE_NAME, 2, 'source_file')} AS file_year, upper({_part(metadata.FILE_NAME, 3, 'source_file')}) AS revision_status FROM db")
def file_status(spark: SparkSession, d: str) -> DataFrame:
    return debates(spark, d).select("debate_id", *metadata.file_parts(F.col("source_file")))


_HEADED = "(SELECT debate_id, seq_index, is_stage_direction, array_to_string(list_transform(regexp_extract_all(text, 'B/(\\d+)', 1), lambda n: '(No. B/' || n || ') ' || speaker_raw || ' (' || assembly || ')'), ' ') AS t FROM u WHERE speaker_raw IS NOT NULL AND assembly IS NOT NULL)"


@query(
    f"SELECT debate_id, pq_num, {_STRIP.format('a')} AS asker_raw, {_STRIP.format('c')} AS constituency_raw, seq_index, is_stage_direction FROM (SELECT debate_id, seq_index, is_stage_direction, "
    + ", ".join(f"unnest(regexp_extract_all(t, {_quoted(questions.HEADER)}, {g})) AS {n}" for g, n in ((1, "pq_num"), (2, "a"), (3, "c")))
    + f", unnest(range(len(regexp_extract_all(t, {_quoted(questions.HEADER)}, 1)))) AS place FROM {_HEADED}) QUALIFY row_number() OVER (PARTITION BY debate_id, pq_num ORDER BY seq_index, place) = 1"
)
def question_headers(spark: SparkSession, d: str) -> DataFrame:
    """Each number that a text mentions as a header of its speaker, the first of a number in a debate."""
    rows = table(spark, d, "utterances").where(F.col("speaker_raw").isNotNull() & F.col("assembly").isNotNull() & F.col("text").contains("B/"))
    numbers = F.regexp_extract_all("text", F.lit(questions.NUMBER), F.lit(1))
    heads = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("(No. B/"), n, F.lit(") "), "speaker_raw", F.lit(" ("), "assembly", F.lit(")"))), " ")
    return questions.question_headers(rows.select(*KEY, "is_stage_direction", heads.alias("text")).distinct())


_BARE = _STRIP.format(f"regexp_replace(full_name, {_quoted(metadata.HONORIFIC)}, '')")
_LAST = f"nullif(regexp_replace(lower(regexp_extract({_STRIP.format(f'string_split(regexp_replace({_BARE}, {_quoted(metadata.SIR)}, {_quoted(str())}), {_quoted(chr(44))})[1]')}, '(\\S+)$', 1)), '^\\.+|\\.+$', '', 'g'), '')"


@query(f"SELECT DISTINCT member_id, full_name, {_LAST} AS surname FROM speaker_registry")
def printed_surnames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "speaker_registry").select("member_id", "full_name", metadata.surname_of(F.col("full_name")).alias("surname")).distinct()


_KIND = "CASE WHEN predicted_confidence >= 0.9 THEN 'Policy' WHEN predicted_confidence >= 0.6 THEN 'Other' END"


@query(f"SELECT CASE WHEN {_KIND} = 'Policy' THEN predicted_label ELSE 'non_policy' END AS label, count(*) AS n FROM utterance_policy_labels GROUP BY 1")
def collapsed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a sure kind, all others as none."""
    kind = F.when(F.col("predicted_confidence") >= 0.9, "Policy").when(F.col("predicted_confidence") >= 0.6, "Other")
    return table(spark, d, "utterance_policy_labels").groupBy(vocabulary.collapse_labels(F.col("predicted_label"), kind).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT topic, count(*) AS n FROM tp GROUP BY topic ORDER BY n DESC, topic LIMIT 5")
def largest_topics(spark: SparkSession, d: str) -> DataFrame:
    return topics(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(5)


@query(_SIDED + " SELECT topic FROM lp GROUP BY topic HAVING count(*) < 10")
def rare_topics(spark: SparkSession, d: str) -> DataFrame:
    return panels.frequent_levels(linking_panel(spark, d), "topic")[1]


@query(f"SELECT predicted_label, CASE WHEN predicted_label = 'non_policy' THEN least(count(*), {NON_POLICY}) ELSE count(*) END AS n FROM (SELECT DISTINCT * FROM utterance_policy_labels) GROUP BY predicted_label")
def capped_counts(spark: SparkSession, d: str) -> DataFrame:
    """What capping one label keeps of each."""
    rows = sampling.cap_class(table(spark, d, "utterance_policy_labels").distinct(), "predicted_label", "non_policy", NON_POLICY, KEY)
    return rows.groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT topic, count(*) AS n, round(0.1 * count(*))::BIGINT AS held_out FROM tp GROUP BY topic")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a stratified split holds out of each stratum."""
    rows = sampling.split_by_hash(topics(spark, d), KEY, 0.1, strata="topic")
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("held_out").cast("long")).alias("held_out"))


@query("SELECT count(*) AS n, round(0.2 * count(*))::BIGINT AS held_out FROM tp")
def plain_split_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.split_by_hash(topics(spark, d), KEY, 0.2)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("held_out").cast("long")).alias("held_out"))


@query("SELECT topic, least(count(*), 20) AS n FROM tp GROUP BY topic")
def sample_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a sample of each group keeps."""
    return sampling.sample_per_group(topics(spark, d), "topic", 20, KEY).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
