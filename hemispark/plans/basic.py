"""Filters, tags, windows, aggregates, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemispark.functions.dates import day_month_year
from hemispark.functions.text import extract, name_key
from hemispark.operators import aggregates, metadata, panels, questions, rules, sampling, segmentation, vocabulary, windows
from hemispark.plans.base import _STRIP, KEY, chairs, debates, query, table, tagged, topics, turns


@query("SELECT debate_id, seq_index, role FROM u WHERE NOT is_stage_direction")
def dialogue_filter(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d, "role", "is_stage_direction").where(~F.col("is_stage_direction")).select(*KEY, "role")


@query("SELECT debate_id, seq_index, length(text) AS n_chars FROM u WHERE NOT is_stage_direction AND length(text) >= 10")
def min_length_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "utterances").where(~F.col("is_stage_direction") & (F.length("text") >= 10))
    return rows.select(*KEY, F.length("text").cast("long").alias("n_chars")).distinct()


@query("SELECT DISTINCT debate_id, seq_index, year FROM utterances WHERE year IN ('2016', '2018')")
def year_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances").where(F.col("year").isin("2016", "2018")).select(*KEY, "year").distinct()


@query("SELECT year, count(*) AS n FROM (SELECT debate_id, year FROM debates WHERE year < '2018' UNION ALL SELECT debate_id, year FROM debates WHERE year >= '2018') GROUP BY year")
def union_years(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "debates").select("debate_id", "year")
    return rows.where("year < '2018'").unionByName(rows.where("year >= '2018'")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT debate_id, seq_index, substring(text, 1, 300) AS head FROM u")
def text_heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances").select(*KEY, F.substring("text", 1, 300).alias("head")).distinct()


@query("SELECT debate_id, seq_index, chair_ruling::INT AS chair_ruling, interruption::INT AS interruption, withdrawal_request::INT AS withdrawal_request, so_citation::INT AS so_citation, pnq_transfer::INT AS pnq_transfer FROM tg")
def rule_tags(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select(*KEY, *(F.col(t).cast("int").alias(t) for t in rules.TAGS))


@query(
    "SELECT tag, n::BIGINT AS n, round(100.0 * n / (SELECT count(*) FROM tg), 9) AS pct FROM (SELECT "
    + ", ".join(f"sum({t}::INT) AS {t}" for t in rules.TAGS)
    + " FROM tg) UNPIVOT (n FOR tag IN (" + ", ".join(rules.TAGS) + "))"
)
def rule_tag_summary(spark: SparkSession, d: str) -> DataFrame:
    return rules.tag_summary(tagged(spark, d)).withColumn("pct", F.round("pct", 9))


@query("SELECT k AS tags_per_row, count(*) AS n FROM (SELECT " + " + ".join(f"{t}::INT" for t in rules.TAGS) + " AS k FROM tg) WHERE k >= 1 GROUP BY k")
def tag_overlap_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rules.tag_overlaps(tagged(spark, d), least=1)


@query("SELECT debate_id, seq_index, any_event, intervened FROM ev")
def forward_event_window(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d).withColumn("any_event", F.col("chair_ruling") | F.col("interruption"))
    return windows.event_follows(rows.select(*KEY, "any_event"), "any_event", ["debate_id"], ["seq_index"])


@query("SELECT role, count(*) AS n_utterances, sum(intervened::INT)::BIGINT AS n_intervened, round(sum(intervened::INT) / count(*), 9) AS intervention_rate FROM ev WHERE NOT is_stage_direction GROUP BY role HAVING count(*) >= 3")
def intervention_panel(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d).withColumn("any_event", F.col("chair_ruling") | F.col("interruption"))
    rows = windows.event_follows(rows, "any_event", ["debate_id"], ["seq_index"]).where(~F.col("is_stage_direction"))
    return panels.intervention_panel(rows, ["role"]).withColumn("intervention_rate", F.round("intervention_rate", 9))


@query(
    "SELECT role, count(*) AS n, sum((coalesce(hit, 0) = 1)::INT)::BIGINT AS n_intervened FROM (SELECT role, max((chair_ruling OR interruption)::INT) OVER"
    " (PARTITION BY debate_id ORDER BY seq_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS hit FROM tg WHERE NOT is_stage_direction) GROUP BY role"
)
def filter_then_window(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d).where(~F.col("is_stage_direction")).withColumn("any_event", F.col("chair_ruling") | F.col("interruption")).select(*KEY, "role", "any_event")
    flagged = windows.event_follows(rows, "any_event", ["debate_id"], ["seq_index"])
    return flagged.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("intervened").cast("long")).alias("n_intervened"))


@query("SELECT role, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM u), 9) AS pct FROM u GROUP BY role")
def value_counts_with_null(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.value_counts(turns(spark, d), "role").withColumn("pct", F.round("pct", 9))


@query("SELECT count(DISTINCT debate_id) AS debates, count(DISTINCT speaker_raw) AS labels, count(DISTINCT role) AS roles FROM u")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d, "speaker_raw", "role").agg(F.countDistinct("debate_id").alias("debates"), F.countDistinct("speaker_raw").alias("labels"), F.countDistinct("role").alias("roles"))


@query("SELECT topic, count(*) AS n, sum(so_citation::INT)::BIGINT AS n_true, round(avg(so_citation::INT), 9) AS rate FROM tg JOIN tp USING (debate_id, seq_index) GROUP BY topic")
def transfer_rate_by_topic(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d).join(topics(spark, d), KEY)
    return aggregates.rates_by(rows, "so_citation", ["topic"]).withColumn("rate", F.round("rate", 9))


@query("SELECT role, sum((NOT intervened)::INT)::BIGINT AS n_false, sum(intervened::INT)::BIGINT AS n_true FROM ev GROUP BY role")
def crosstab_2x2(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.crosstab(forward_event_window(spark, d).join(turns(spark, d, "role"), KEY), "role", "intervened")


@query("SELECT topic, role, count(*) AS n, sum(intervened::INT)::BIGINT AS n_true, round(avg(intervened::INT), 9) AS rate FROM ev JOIN tp USING (debate_id, seq_index) GROUP BY topic, role")
def rate_by_two_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = forward_event_window(spark, d).join(turns(spark, d, "role"), KEY).join(topics(spark, d), KEY)
    return aggregates.rates_by(rows, "intervened", ["topic", "role"]).withColumn("rate", F.round("rate", 9))


_DAY = r"try_strptime(regexp_extract(sitting_date, '(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})', 0), '%d %B %Y')::DATE"


@query(f"SELECT debate_id, {_DAY} AS day FROM db")
def sitting_dates(spark: SparkSession, d: str) -> DataFrame:
    return debates(spark, d).select("debate_id", day_month_year(F.col("sitting_date")).alias("day"))


@query(f"SELECT debate_id, day, row_number() OVER (ORDER BY day, debate_id) - 1 AS sitting_order FROM (SELECT debate_id, {_DAY} AS day FROM db) WHERE day IS NOT NULL")
def chronological_index(spark: SparkSession, d: str) -> DataFrame:
    return windows.chronological(sitting_dates(spark, d), "day", "debate_id")[0]


@query(f"SELECT debate_id FROM (SELECT debate_id, {_DAY} AS day FROM db) WHERE day IS NULL")
def undated_debates(spark: SparkSession, d: str) -> DataFrame:
    return windows.chronological(sitting_dates(spark, d), "day", "debate_id")[1].select("debate_id")


@query(
    "SELECT debate_id, seq_index, topic FROM (SELECT debate_id, seq_index, CASE WHEN is_stage_direction THEN lead(seq_index) OVER (PARTITION BY debate_id ORDER BY seq_index)"
    " ELSE seq_index END AS k FROM u) q LEFT JOIN (SELECT debate_id, seq_index AS k, topic FROM tp) USING (debate_id, k)"
)
def next_row_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d, "is_stage_direction")
    return windows.own_or_next(rows, topics(spark, d), "debate_id", "seq_index", "is_stage_direction", "topic", "topic").select(*KEY, "topic")


@query("SELECT debate_id, seq_index, (debate_id IN (SELECT debate_id FROM u WHERE is_stage_direction AND text LIKE '%Withdrawn%')) AS has_withdrawal FROM u")
def semi_join_flag(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "utterances").where(F.col("is_stage_direction") & F.contains("text", F.lit("Withdrawn")))
    return questions.flag_members(turns(spark, d, "role"), members, ["debate_id"], "has_withdrawal").select(*KEY, "has_withdrawal")


@query("SELECT debate_id, sitting_date, revision_status FROM db")
def first_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return debates(spark, d).select("debate_id", "sitting_date", "revision_status")


@query(r"SELECT DISTINCT debate_id, unnest(regexp_extract_all(text, 'B/(\d+)', 1)) AS pq_num FROM u WHERE regexp_matches(text, '(?i)with your permission')")
def extract_all_explode(spark: SparkSession, d: str) -> DataFrame:
    return questions.question_numbers(table(spark, d, "utterances"), prefilter="(?i)with your permission")


@query("SELECT debate_id, seq_index, " + _STRIP.format(r"lower(strip_accents(regexp_replace(speaker_raw, '\p{M}+', '', 'g')))") + " AS name_key FROM u WHERE speaker_raw IS NOT NULL")
def accent_normalise(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d, "speaker_raw").where(F.col("speaker_raw").isNotNull()).select(*KEY, name_key(F.col("speaker_raw")).alias("name_key"))


_TOKENS = r"SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+|[0-9]+')) AS token FROM u WHERE NOT is_stage_direction"


@query(f"SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM (SELECT token, count(*) AS n FROM ({_TOKENS}) GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 500)")
def tokenize_vocab(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.build_vocabulary(turns(spark, d).where(~F.col("is_stage_direction")), "text", KEY, 500).withColumn("id", F.col("id").cast("long"))


_ALL_TOKENS = r"SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+|[0-9]+')) AS token FROM u"
_KNOWN = ["the", "of", "to", "a", "on", "i", "is", "and", "in", "we", "that", "for"]


@query(
    "SELECT debate_id, seq_index, array_to_string(list_transform(range(1, 17), lambda i: CASE WHEN i > len(t) THEN 0 ELSE coalesce(nullif(list_position("
    + str(_KNOWN) + ", t[i]), 0) + 1, 1) END), ' ') AS ids FROM (SELECT debate_id, seq_index, regexp_extract_all(lower(text), '[a-zà-ÿ]+|[0-9]+') AS t FROM u)"
)
def encode_pad(spark: SparkSession, d: str) -> DataFrame:
    rows = vocabulary.encode(turns(spark, d), "text", {w: i + 2 for i, w in enumerate(_KNOWN)}, 16)
    return rows.select(*KEY, F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


#: Sizes of the reference's configuration.
VOCABULARY, TOKENS, NON_POLICY = 20_000, 50, 5_000


@query(f"SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM (SELECT token, count(*) AS n FROM ({_ALL_TOKENS}) GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT {VOCABULARY})")
def vocabulary_full(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of all texts, stage directions too, as the reference builds it."""
    return vocabulary.build_vocabulary(turns(spark, d), "text", KEY, VOCABULARY).withColumn("id", F.col("id").cast("long"))


@query(
    f"SELECT debate_id, seq_index, array_to_string(list_resize(list_transform(list_slice(t, 1, {TOKENS}), lambda x: coalesce(m[x], 1)), {TOKENS}, 0), ' ') AS ids"
    " FROM (SELECT debate_id, seq_index, coalesce(regexp_extract_all(lower(text), '[a-zà-ÿ]+|[0-9]+'), []) AS t FROM u),"
    f" (SELECT map_from_entries(list((token, id))) AS m FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM (SELECT token, count(*) AS n FROM ({_ALL_TOKENS}) GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT {VOCABULARY})))"
)
def encode_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as the ids of its first tokens in the vocabulary of :func:`vocabulary_full`."""
    rows = vocabulary.encode_large(turns(spark, d), "text", vocabulary_full(spark, d), TOKENS)
    return rows.select(*KEY, F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


_HITS = f"len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ]+')), {vocabulary.KREOL_WORDS}))"


@query(
    f"SELECT debate_id, seq_index, CASE WHEN t = '' THEN 'unknown' WHEN h >= 2 THEN 'mfe' WHEN length(t) < 20 AND h >= 1 THEN 'mfe' WHEN length(t) < 20 THEN 'en'"
    f" WHEN language = 'fr' AND h >= 1 THEN 'mfe' ELSE coalesce(language, 'unknown') END AS language FROM (SELECT *, {_STRIP.format('text')} AS t, {_HITS} AS h FROM u)"
)
def keyword_language(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d, "text", "language").select(*KEY, vocabulary.keyword_language(F.col("text"), F.col("language")).alias("language"))


@query("SELECT role, place, text FROM (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY debate_id, seq_index) AS place FROM u) WHERE place <= 3")
def examples_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d, "role", "text")
    return aggregates.examples_per_group(rows, "role", KEY, "text").select("role", F.col("place").cast("long").alias("place"), "text")


_CONF = "SELECT language AS truth, CASE WHEN text LIKE '% the %' THEN 'en' WHEN text LIKE '% les %' THEN 'fr' ELSE 'mfe' END AS guess FROM u WHERE language IN ('en', 'fr', 'mfe')"


def _guesses(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d, "text", "language").where(F.col("language").isin("en", "fr", "mfe"))
    return rows.withColumn("guess", F.when(F.col("text").like("% the %"), "en").when(F.col("text").like("% les %"), "fr").otherwise("mfe"))


@query(
    f"SELECT label, support, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM (SELECT l.label,"
    f" count(*) FILTER (truth = label) AS support, coalesce(count(*) FILTER (truth = label AND guess = label) / nullif(count(*) FILTER (guess = label), 0), 0) AS p,"
    f" coalesce(count(*) FILTER (truth = label AND guess = label) / nullif(count(*) FILTER (truth = label), 0), 0) AS r FROM ({_CONF}) c, (SELECT unnest(['en', 'fr', 'mfe']) AS label) l GROUP BY l.label)"
)
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = aggregates.class_metrics(_guesses(spark, d), "language", "guess")
    return m.select("label", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"SELECT round(avg((truth = guess)::INT), 9) AS accuracy FROM ({_CONF})")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.summary_metrics(aggregates.class_metrics(_guesses(spark, d), "language", "guess")).select(F.round("accuracy", 9).alias("accuracy"))


@query(
    "SELECT flag, round(least(20, greatest(1, (n - p) / greatest(p, 1))), 9) AS weight FROM (SELECT count(*) AS n, " + ", ".join(f"sum({t}::INT)::DOUBLE AS {t}" for t in rules.TAGS)
    + " FROM tg) UNPIVOT (p FOR flag IN (" + ", ".join(rules.TAGS) + "))"
)
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.class_weights(tagged(spark, d), rules.TAGS).withColumn("weight", F.round("weight", 9))


@query("SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max FROM (SELECT length(text)::DOUBLE AS x FROM u)")
def describe_series(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "utterances").select(*KEY, F.length("text").cast("double").alias("x")).distinct()
    out = aggregates.describe(sizes.select("x"), "x")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(
    r"SELECT debate_id, source_file, nullif(regexp_extract(source_file, '(?i)Debate_No\.?_?(\d+[A-Za-z]?)_of_(\d{4})', 1), '') AS file_number,"
    r" nullif(regexp_extract(source_file, '(?i)Debate_No\.?_?(\d+[A-Za-z]?)_of_(\d{4})', 2), '') AS file_year FROM db"
)
def file_names(spark: SparkSession, d: str) -> DataFrame:
    number, year, _ = metadata.file_parts(F.col("source_file"))
    return debates(spark, d).select("debate_id", "source_file", number, year)


@query(r"SELECT debate_id, nullif(regexp_extract(debate_number, 'No\.\s*(\d+[A-Za-z]?)\s*of\s*(\d{4})', 0), '') AS number FROM db")
def header_numbers(spark: SparkSession, d: str) -> DataFrame:
    return debates(spark, d).select("debate_id", extract(F.col("debate_number"), r"No\.\s*(\d+[A-Za-z]?)\s*of\s*(\d{4})", 0).alias("number"))


def _segmentation_sql() -> str:
    """The same islands in SQL, over the lines of each document."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    short, long = quote(segmentation.SHORT_TAG), quote(segmentation.LONG_TAG)
    stage = " OR ".join(f"regexp_matches(line, {quote(p)})" for p in segmentation.STAGE_PATTERNS)

    def is_long(x: str) -> str:
        return f"(regexp_matches({x}, {long}) AND (" + " OR ".join(f"contains(regexp_extract({x}, {long}, 1), '{k}')" for k in segmentation.LONG_TAG_KEYWORDS) + "))"

    def speaker(x: str) -> str:
        return f"CASE WHEN regexp_matches({x}, {short}) THEN trim(regexp_extract({x}, {short}, 1) || ' ' || regexp_extract({x}, {short}, 2)) WHEN {is_long(x)} THEN trim('The ' || regexp_extract({x}, {long}, 1)) END"

    def rest(x: str) -> str:
        return f"CASE WHEN regexp_matches({x}, {short}) THEN regexp_extract({x}, {short}, 3) WHEN {is_long(x)} THEN regexp_extract({x}, {long}, 2) END"

    pair = "(line || ' ' || nxt)"
    return f""", l0 AS (SELECT doc_id::VARCHAR AS debate_id, unnest(range(len(x))) AS l, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
l1 AS (SELECT debate_id, l, {_STRIP.format("raw")} AS line FROM l0),
l2 AS (SELECT *, lead(line) OVER w AS nxt, ({stage}) AS stage, {speaker("line")} AS who, {rest("line")} AS body FROM l1 WHERE line <> '' AND NOT regexp_matches(line, {quote(segmentation.PAGE_NUMBER)}) WINDOW w AS (PARTITION BY debate_id ORDER BY l)),
l3 AS (SELECT *, coalesce(NOT stage AND who IS NULL AND starts_with(line, 'The ') AND nxt IS NOT NULL AND {is_long(pair)} AND NOT regexp_matches({pair}, {short}), false) AS would FROM l2),
l4 AS (SELECT *, sum((NOT would OR NOT coalesce(before, false))::INT) OVER (PARTITION BY debate_id ORDER BY l) AS run FROM (SELECT *, lag(would) OVER (PARTITION BY debate_id ORDER BY l) AS before FROM l3)),
l5 AS (SELECT *, would AND row_number() OVER (PARTITION BY debate_id, run ORDER BY l) % 2 = 1 AS joined FROM l4),
l6 AS (SELECT * FROM (SELECT *, coalesce(lag(joined) OVER (PARTITION BY debate_id ORDER BY l), false) AS eaten FROM l5) WHERE NOT eaten),
l7 AS (SELECT debate_id, l, line, stage, CASE WHEN joined THEN {speaker(pair)} WHEN NOT stage THEN who END AS who, CASE WHEN joined THEN {rest(pair)} WHEN NOT stage THEN body END AS body FROM l6),
l8 AS (SELECT *, sum((stage OR who IS NOT NULL OR coalesce(after_stage, false))::INT) OVER (PARTITION BY debate_id ORDER BY l) AS turn FROM (SELECT *, lag(stage) OVER (PARTITION BY debate_id ORDER BY l) AS after_stage FROM l7)),
l9 AS (SELECT debate_id, turn, arg_min(who, l) AS speaker_raw, bool_or(stage) AS is_stage_direction, string_agg(CASE WHEN who IS NOT NULL THEN body ELSE line END, ' ' ORDER BY l) FILTER (CASE WHEN who IS NOT NULL THEN body ELSE line END <> '') AS t FROM l8 GROUP BY ALL)
SELECT debate_id, row_number() OVER (PARTITION BY debate_id ORDER BY turn) - 1 AS seq_index, speaker_raw, {_STRIP.format("t")} AS text, is_stage_direction FROM l9 WHERE {_STRIP.format("t")} <> ''"""


@query(_segmentation_sql())
def line_segmentation(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.segment_turns(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("debate_id"), F.array("text").alias("pages")))


@query()
def exact_n_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "utterance_policy_labels").distinct()
    return sampling.cap_class(rows, "predicted_label", "non_policy", NON_POLICY, KEY)


@query()
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_by_hash(topics(spark, d), KEY, 0.1, strata="topic")


@query()
def sample_per_tag(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_per_group(topics(spark, d), "topic", 20, KEY)


@query("SELECT topic, chair_surname, count(*) AS n_utterances FROM u JOIN tp USING (debate_id, seq_index) JOIN ch USING (debate_id) WHERE NOT is_stage_direction AND topic <> 'non_policy' AND chair_surname IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def panel_min_cell(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d, "is_stage_direction").where(~F.col("is_stage_direction")).join(topics(spark, d), KEY).join(chairs(spark, d), "debate_id")
    rows = rows.where((F.col("topic") != panels.NO_TOPIC) & F.col("chair_surname").isNotNull())
    return rows.groupBy("topic", "chair_surname").agg(F.count(F.lit(1)).alias("n_utterances")).where("n_utterances >= 3")
