"""Speakers, sides and attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemispark.functions.dates import day_month_year, printed_date
from hemispark.operators import event_time, panels, questions, resolution, rules
from hemispark.plans.base import _STRIP, KEY, chairs, debates, query, table, tagged, topics, turns

_S = _STRIP.format
_PAREN = r"'\(([^)]+)\)\s*$'"

# candidates of a label, in SQL
_RESOLVED = rf"""
sp AS (SELECT debate_id, seq_index, speaker_raw, assembly, sitting_date, CASE assembly WHEN 'SIXTH' THEN '6th' WHEN 'SEVENTH' THEN '7th' WHEN 'EIGHTH' THEN '8th' END AS term
  FROM u WHERE role = 'unclassified_mp' AND NOT is_stage_direction),
wd AS (SELECT *, list_filter(list_transform(list_filter(string_split_regex({_S("lower(strip_accents(" + r"regexp_replace(regexp_replace(" + _S(f"CASE WHEN regexp_extract(speaker_raw, {_PAREN}, 1) <> '' THEN regexp_extract(speaker_raw, {_PAREN}, 1) ELSE speaker_raw END") + r", '^(Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Madam|The)\s+', ''), '\p{M}+', '', 'g')" + "))")}, '[\s\p{{Z}}]+'),
  lambda x: x <> ''), lambda x: regexp_replace(x, '^\.+|\.+$', '', 'g')), lambda x: x <> '') AS w FROM sp),
cd AS (SELECT *, CASE WHEN len(w) >= 2 THEN w[-2] || ' ' || w[-1] END AS c2, w[-1] AS c1 FROM wd),
rk AS (SELECT assembly_term AS term, {_S("lower(strip_accents(surname_key))")} AS key, count(DISTINCT full_name) AS people, arg_min(party, full_name || chr(1) || coalesce(party, '')) AS party,
  min(full_name) AS nm FROM speaker_registry GROUP BY ALL),
rp AS (SELECT term, key, people, (SELECT party FROM speaker_registry r WHERE r.assembly_term = rk.term AND {_S("lower(strip_accents(r.surname_key))")} = rk.key ORDER BY full_name, party NULLS FIRST LIMIT 1) AS party FROM rk),
rs AS (SELECT cd.*, coalesce(a.people, b.people) AS people, CASE WHEN a.people IS NOT NULL THEN a.party ELSE b.party END AS party, a.people IS NOT NULL AS two
  FROM cd LEFT JOIN rp a ON a.term = cd.term AND a.key = cd.c2 LEFT JOIN rp b ON b.term = cd.term AND b.key = cd.c1)
"""
_METHOD = "CASE WHEN people IS NULL THEN 'no_match' WHEN people > 1 THEN 'ambiguous_collision' WHEN two THEN 'matched_2word' ELSE 'matched_1word' END"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d, "role", "speaker_raw", "assembly", "sitting_date", "is_stage_direction")
    return rows.where((F.col("role") == "unclassified_mp") & ~F.col("is_stage_direction"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolve_candidates(_labels(spark, d), table(spark, d, "speaker_registry"), [*KEY, "sitting_date"])


@query(
    ", x AS (SELECT 1), " + _RESOLVED.strip() + f" SELECT debate_id, seq_index, term, CASE WHEN people = 1 THEN party END AS resolved_party, {_METHOD} AS match_method FROM rs"
)
def candidate_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select(*KEY, "term", "resolved_party", "match_method")


@query(", x AS (SELECT 1), " + _RESOLVED.strip() + f" SELECT {_METHOD} AS match_method, count(*) AS n FROM rs GROUP BY 1")
def collision_report(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).groupBy("match_method").agg(F.count(F.lit(1)).alias("n"))


_DAY = r"try_strptime(regexp_extract(sitting_date, '(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})', 0), '%d %B %Y')::DATE"


@query(
    f""", dd AS (SELECT debate_id, CASE assembly WHEN 'SIXTH' THEN '6th' WHEN 'SEVENTH' THEN '7th' WHEN 'EIGHTH' THEN '8th' END AS term, {_DAY} AS day FROM db),
pa AS (SELECT DISTINCT party, assembly_term AS term, gov_or_opp, effective_from AS f, effective_to AS t FROM party_alignment),
pw AS (SELECT party, term, count(*) AS n FROM pa GROUP BY ALL),
as_of AS (SELECT dd.debate_id, pw.party, pw.n, dd.day, dd.term FROM dd JOIN pw USING (term))
SELECT debate_id, party, (SELECT gov_or_opp FROM pa WHERE pa.party = a.party AND pa.term = a.term AND (a.n = 1 OR (a.day IS NOT NULL AND coalesce(pa.f <= a.day, true) AND coalesce(a.day < pa.t, true)))
  ORDER BY f NULLS FIRST, t NULLS FIRST, gov_or_opp LIMIT 1) AS gov_or_opp FROM as_of a"""
)
def validity_range_join(spark: SparkSession, d: str) -> DataFrame:
    align = table(spark, d, "party_alignment")
    parties = align.select("party", F.col("assembly_term").alias("term")).distinct()
    rows = debates(spark, d).select("debate_id", resolution.term_of(F.col("assembly")).alias("term"), day_month_year(F.col("sitting_date")).alias("day"))
    return resolution.valid_sides(rows.join(F.broadcast(parties), "term"), align, ["debate_id", "party"], "party", "term", "day")


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """(debate_id, assembly_term, day): each dated debate once, whichever delivery is read."""
    rows = table(spark, d, "debates").select("debate_id", resolution.term_of(F.col("assembly")).alias("assembly_term"), printed_date(F.col("sitting_date")).alias("day"))
    return rows.where(F.col("assembly_term").isNotNull() & F.col("day").isNotNull())


_PRINTED = rf"""
pd AS (SELECT DISTINCT debate_id, CASE assembly WHEN 'SIXTH' THEN '6th' WHEN 'SEVENTH' THEN '7th' WHEN 'EIGHTH' THEN '8th' END AS assembly_term,
  regexp_replace(upper(strip_accents(sitting_date)), '[\s\p{{Z}}]+', ' ', 'g') AS t FROM debates WHERE sitting_date IS NOT NULL),
pp AS (SELECT debate_id, assembly_term, CASE
  WHEN regexp_matches(t, '\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}') THEN regexp_extract(t, '(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})', ['y', 'm', 'd'])
  WHEN regexp_matches(t, '\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}') THEN regexp_extract(t, '(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})', ['d', 'm', 'y'])
  WHEN regexp_matches(t, '(^|\D)\d{{1,2}}(ST|ND|RD|TH|ER)? [A-Z]+\.?,? \d{{4}}') THEN regexp_extract(t, '(\d{{1,2}})(?:ST|ND|RD|TH|ER)? ([A-Z]+)\.?,? (\d{{4}})', ['d', 'm', 'y'])
  ELSE regexp_extract(t, '([A-Z]+)\.? (\d{{1,2}})(?:ST|ND|RD|TH)?,? (\d{{4}})', ['m', 'd', 'y']) END AS p FROM pd),
pe AS (SELECT DISTINCT debate_id, assembly_term, try_cast(p.y || '-' || lpad(CASE WHEN regexp_matches(p.m, '^\d+$') THEN p.m WHEN p.m LIKE 'JUIL%' THEN '7' ELSE (map_from_entries([
  {", ".join(f"('{k}', '{v}')" for k, v in [("JAN", 1), ("FEB", 2), ("FEV", 2), ("MAR", 3), ("APR", 4), ("AVR", 4), ("MAY", 5), ("MAI", 5), ("JUN", 6), ("JUI", 6), ("JUL", 7), ("AUG", 8), ("AOU", 8), ("SEP", 9), ("OCT", 10), ("NOV", 11), ("DEC", 12)])}
  ])[p.m[:3]]) END, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE) AS day FROM pp WHERE p.y <> '')
"""
_KNOWN = "FROM pe JOIN party_alignment a USING (assembly_term) WHERE day IS NOT NULL AND assembly_term IS NOT NULL AND coalesce(effective_from <= day, true) AND coalesce(day < effective_to, true) AND recorded_at < day::TIMESTAMP"


@query(", " + _PRINTED.strip() + " SELECT debate_id, day FROM pe WHERE day IS NOT NULL AND assembly_term IS NOT NULL")
def printed_dates(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).select("debate_id", "day").distinct()


@query(", " + _PRINTED.strip() + f" SELECT debate_id, party, gov_or_opp {_KNOWN} QUALIFY row_number() OVER (PARTITION BY debate_id, party, day ORDER BY recorded_at DESC, effective_from DESC NULLS LAST, gov_or_opp DESC) = 1")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = event_time.as_known_at(_dated(spark, d), table(spark, d, "party_alignment"), ["debate_id"], "day", ["assembly_term"], ["gov_or_opp"], per=["party"])
    return found.select("debate_id", "party", "gov_or_opp")


@query(", " + _PRINTED.strip() + f", k AS (SELECT debate_id, party, day, gov_or_opp {_KNOWN} QUALIFY row_number() OVER (PARTITION BY debate_id, party, day ORDER BY recorded_at DESC, effective_from DESC NULLS LAST, gov_or_opp DESC) = 1) SELECT party, gov_or_opp, count(*) AS debates FROM k GROUP BY ALL")
def p4_sides(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("party", "gov_or_opp").agg(F.count(F.lit(1)).alias("debates"))


@query(
    "SELECT debate_id, seq_index, CASE WHEN speaker_raw IS NULL THEN NULL"
    + "".join(f" WHEN regexp_matches({_S('speaker_raw')}, '(?i){p}') THEN '{role}'" for p, role, _ in rules.ROLE_PATTERNS)
    + " ELSE 'unclassified_mp' END AS role FROM u"
)
def role_resolution(spark: SparkSession, d: str) -> DataFrame:
    return rules.resolve_roles(turns(spark, d, "speaker_raw")).select(*KEY, "role")


@query(
    rf"SELECT debate_id, seq_index, regexp_replace(lower(regexp_extract({_S('regexp_replace(n, ' + chr(39) + r'^(Mr\.?|Mrs\.?|Ms\.?|Dr\.?|The)\s+' + chr(39) + ', ' + chr(39) * 2 + ')')}, '(\S+)$', 1)), '^\.+|\.+$', '', 'g') AS surname"
    rf" FROM (SELECT *, CASE WHEN regexp_extract(speaker_raw, {_PAREN}, 1) <> '' THEN regexp_extract(speaker_raw, {_PAREN}, 1) ELSE speaker_raw END AS n FROM u WHERE speaker_raw IS NOT NULL)"
)
def bare_surnames(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d, "speaker_raw").where(F.col("speaker_raw").isNotNull())
    return rows.select(*KEY, rules.bare_surname(F.col("speaker_raw")).alias("surname"))


def speaker_sides(spark: SparkSession, d: str) -> DataFrame:
    """(keys, resolved_party, match_method, resolved_gov_opp) of turns of unclassified members."""
    rows = _resolved(spark, d).withColumn("day", day_month_year(F.col("sitting_date")))
    sided = resolution.valid_sides(rows, table(spark, d, "party_alignment"), [*KEY, "resolved_party", "match_method"], "resolved_party", "term", "day")
    return sided.withColumnRenamed("gov_or_opp", "resolved_gov_opp")


_SIDED = (
    ", x AS (SELECT 1), " + _RESOLVED.strip()
    + f""",
pa AS (SELECT DISTINCT party, assembly_term AS term, gov_or_opp, effective_from AS f, effective_to AS t FROM party_alignment),
pw AS (SELECT party, term, count(*) AS n FROM pa GROUP BY ALL),
rd AS (SELECT debate_id, seq_index, term, CASE WHEN people = 1 THEN party END AS resolved_party, {_METHOD} AS match_method, {_DAY} AS day FROM rs),
ds AS (SELECT DISTINCT resolved_party, term, day FROM rd WHERE resolved_party IS NOT NULL),
sd AS (SELECT ds.*, (SELECT gov_or_opp FROM pa WHERE pa.party = ds.resolved_party AND pa.term = ds.term AND (pw.n = 1 OR (ds.day IS NOT NULL AND coalesce(pa.f <= ds.day, true) AND coalesce(ds.day < pa.t, true)))
  ORDER BY f NULLS FIRST, t NULLS FIRST, gov_or_opp LIMIT 1) AS side FROM ds JOIN pw ON pw.party = ds.resolved_party AND pw.term = ds.term),
sv AS (SELECT rd.debate_id, rd.seq_index, rd.resolved_party, rd.match_method, sd.side AS resolved_gov_opp FROM rd LEFT JOIN sd
  ON sd.resolved_party = rd.resolved_party AND sd.term = rd.term AND sd.day IS NOT DISTINCT FROM rd.day),
an AS (SELECT ev.debate_id, ev.seq_index, role, is_stage_direction, intervened, chair_surname, topic, CASE WHEN role IN ('minister', 'prime_minister', 'deputy_prime_minister') THEN 'government'
  WHEN role = 'leader_of_opposition' THEN 'opposition' WHEN role = 'unclassified_mp' THEN resolved_gov_opp END AS party
  FROM ev LEFT JOIN sv USING (debate_id, seq_index) LEFT JOIN ch USING (debate_id) LEFT JOIN tp USING (debate_id, seq_index)),
lp AS (SELECT debate_id, chair_surname, topic, party, count(*) AS n_utterances, sum(intervened::INT)::BIGINT AS n_intervened, sum(intervened::INT) / count(*) AS intervention_rate
  FROM an WHERE NOT is_stage_direction AND party IS NOT NULL AND topic IS NOT NULL AND topic <> 'non_policy' AND chair_surname IS NOT NULL GROUP BY ALL)
"""
)


@query(_SIDED + " SELECT debate_id, seq_index, resolved_party, match_method, resolved_gov_opp FROM sv")
def speaker_party_resolved(spark: SparkSession, d: str) -> DataFrame:
    return speaker_sides(spark, d)


def analysis(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d)
    tags = rows.select(*KEY, "chair_ruling", "interruption")
    return panels.analysis_rows(rows.select(*KEY, "role", "is_stage_direction"), speaker_sides(spark, d), tags, chairs(spark, d), topics(spark, d))


@query(_SIDED + " SELECT debate_id, chair_surname, topic, party, n_utterances, n_intervened, round(intervention_rate, 9) AS intervention_rate FROM lp")
def linking_panel(spark: SparkSession, d: str) -> DataFrame:
    panel = panels.intervention_panel(panels.eligible(analysis(spark, d)), ["debate_id", "chair_surname", "topic", "party"], 1)
    return panel.withColumn("intervention_rate", F.round("intervention_rate", 9))


@query(_SIDED + " SELECT role, party, count(*) AS n FROM an GROUP BY ALL")
def final_party_counts(spark: SparkSession, d: str) -> DataFrame:
    return analysis(spark, d).groupBy("role", "party").agg(F.count(F.lit(1)).alias("n"))


@query(_SIDED + " SELECT topic, count(*) AS cells FROM lp GROUP BY topic HAVING count(*) >= 10")
def frequent_topics(spark: SparkSession, d: str) -> DataFrame:
    return panels.frequent_levels(linking_panel(spark, d), "topic")[0].groupBy("topic").agg(F.count(F.lit(1)).alias("cells"))


@query(
    r""", nm AS (SELECT DISTINCT debate_id, unnest(regexp_extract_all(text, 'B/(\d+)', 1)) AS pq_num FROM u WHERE regexp_matches(text, '(?i)withdraw|with your permission, ')),
as2 AS (SELECT debate_id, seq_index, unnest(regexp_extract_all(text, 'B/(\d+)', 1)) AS pq_num FROM u WHERE regexp_matches(text, '(?i)with your permission'))
SELECT debate_id, pq_num, min(seq_index) AS seq_index, bool_or((debate_id, pq_num) IN (SELECT (debate_id, pq_num) FROM nm)) AS transferred FROM as2 GROUP BY ALL"""
)
def question_panel(spark: SparkSession, d: str) -> DataFrame:
    """Numbers asked for with permission stand for headers, as the test texts print none; transfers are those of withdrawn turns."""
    rows = turns(spark, d, "text", "is_stage_direction")
    asked = rows.where(F.col("text").rlike("(?i)with your permission")).select("debate_id", "seq_index", "is_stage_direction", F.explode(F.regexp_extract_all("text", F.lit(questions.NUMBER), F.lit(1))).alias("pq_num"))
    moved = questions.question_numbers(rows, prefilter="(?i)withdraw|with your permission, ")
    return questions.flag_members(asked.groupBy("debate_id", "pq_num").agg(F.min("seq_index").alias("seq_index")), moved, ["debate_id", "pq_num"], "transferred")
