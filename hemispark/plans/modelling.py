"""Series, tests, models and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemispark.functions.dates import day_month_year
from hemispark.operators import classify, panels, stats, vocabulary, windows
from hemispark.operators.rules import TAGS
from hemispark.plans.base import KEY, debates, query, table, tagged, topics, turns
from hemispark.plans.linking import analysis, linking_panel

_DAY = r"try_strptime(regexp_extract(sitting_date, '(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})', 0), '%d %B %Y')::DATE"
_SERIES = f""",
dt AS (SELECT debate_id, day AS sitting_date, row_number() OVER (ORDER BY day, debate_id) - 1 AS sitting_order FROM (SELECT debate_id, {_DAY} AS day FROM db) WHERE day IS NOT NULL),
lb AS (SELECT tg.debate_id, tg.seq_index, topic, chair_ruling OR interruption AS e FROM tg JOIN tp USING (debate_id, seq_index) WHERE NOT is_stage_direction AND debate_id IN (SELECT debate_id FROM dt)),
fl AS (SELECT *, coalesce(max(e::INT) OVER (PARTITION BY debate_id ORDER BY seq_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS hit FROM lb),
tt AS (SELECT debate_id, count(*) AS total FROM fl GROUP BY ALL),
cl AS (SELECT topic, debate_id, count(*) AS n, sum(hit) AS hit FROM fl WHERE topic <> 'non_policy' GROUP BY ALL),
sr AS (SELECT g.topic, dt.debate_id, dt.sitting_order, dt.sitting_date, coalesce(n, 0) / nullif(total, 0) AS attention_share, coalesce(hit / nullif(n, 0), 0) AS conflict_rate
  FROM (SELECT DISTINCT topic FROM cl) g CROSS JOIN dt LEFT JOIN cl ON cl.topic = g.topic AND cl.debate_id = dt.debate_id LEFT JOIN tt ON tt.debate_id = dt.debate_id)
"""


def series(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d).where(~F.col("is_stage_direction")).withColumn("any_event", F.col("chair_ruling") | F.col("interruption"))
    dates = debates(spark, d).select("debate_id", day_month_year(F.col("sitting_date")).alias("sitting_date"))
    dated, _ = windows.chronological(dates, "sitting_date", "debate_id")
    return panels.series_grid(rows.select(*KEY, "any_event"), topics(spark, d), dated)


@query(_SERIES + " SELECT topic, debate_id, sitting_order, sitting_date, round(attention_share, 9) AS attention_share, round(conflict_rate, 9) AS conflict_rate FROM sr")
def topic_series_grid(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).withColumns({c: F.round(c, 9) for c in ("attention_share", "conflict_rate")})


@query(_SERIES + ", x AS (SELECT topic, debate_id, lead(attention_share) OVER (PARTITION BY topic ORDER BY sitting_order) AS nx FROM sr) SELECT topic, debate_id, round(nx, 9) AS attention_share_next FROM x WHERE nx IS NOT NULL")
def lead_share(spark: SparkSession, d: str) -> DataFrame:
    out = windows.lead_value(series(spark, d), "attention_share", ["topic"], ["sitting_order"], "attention_share_next")
    return out.select("topic", "debate_id", F.round("attention_share_next", 9).alias("attention_share_next"))


@query(_SERIES + ", x AS (SELECT topic, debate_id, lag(conflict_rate, 1) OVER w AS a, lag(conflict_rate, 2) OVER w AS b, lag(conflict_rate, 3) OVER w AS c FROM sr WINDOW w AS (PARTITION BY topic ORDER BY sitting_order)) SELECT topic, debate_id, round(a, 9) AS conflict_rate_lag1, round(b, 9) AS conflict_rate_lag2, round(c, 9) AS conflict_rate_lag3 FROM x WHERE c IS NOT NULL")
def lag_design(spark: SparkSession, d: str) -> DataFrame:
    out = windows.lag_design(series(spark, d), ["conflict_rate"], 3, ["topic"], ["sitting_order"])
    return out.select("topic", "debate_id", *(F.round(f"conflict_rate_lag{k}", 9).alias(f"conflict_rate_lag{k}") for k in (1, 2, 3)))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Daily series of the event table: longer than the debates' for tests of lags."""
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


@query()
def granger_f(spark: SparkSession, d: str) -> DataFrame:
    return stats.granger(_events(spark, d), "event_type", ["day"], "n", "mean_value")


@query()
def granger_p(spark: SparkSession, d: str) -> DataFrame:
    rows = granger_f(spark, d).collect()  # groups x lags
    return spark.createDataFrame([(r.event_type, r.lag, r.f, stats.f_tail(r.f, r.df_num, r.df_den)) for r in rows], "event_type string, lag int, f double, p double")


@query(
    ", e AS (SELECT event_type, ts::DATE AS day, count(*) AS n, avg(value) AS m FROM events GROUP BY ALL), w AS (SELECT event_type, m AS y, lag(m) OVER o AS y1, lag(n) OVER o AS x1, sum((n > 0)::INT) OVER (PARTITION BY event_type) AS k FROM e WINDOW o AS (PARTITION BY event_type ORDER BY day)),"
    " c AS (SELECT event_type, count(*) AS n, corr(y, x1) AS a, corr(y, y1) AS b, corr(x1, y1) AS c FROM w WHERE k >= 10 AND y1 IS NOT NULL AND x1 IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL), p AS (SELECT *, (a - b * c) ^ 2 / ((1 - b * b) * (1 - c * c)) AS r FROM c)"
    " SELECT event_type, round(r / (1 - r) * (n - 3), 6) AS f, (n - 3)::INT AS df_den FROM p WHERE n > 3"
)
def granger_lag1(spark: SparkSession, d: str) -> DataFrame:
    """The F of one lag, which partial correlations give too."""
    return granger_f(spark, d).where("lag = 1").select("event_type", F.round("f", 6).alias("f"), "df_den")


@query("SELECT count(p)::BIGINT AS tests, coalesce(sum((p < 0.05)::INT), 0)::BIGINT AS raw, coalesce(sum((p < 0.05 / m)::INT), 0)::BIGINT AS bonferroni FROM (SELECT 1 - predicted_confidence AS p, count(1 - predicted_confidence) OVER () AS m FROM utterance_policy_labels)")
def doubtful_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels as so many tests, with what their confidence lacks as p."""
    return stats.count_significant(table(spark, d, "utterance_policy_labels").select((1 - F.col("predicted_confidence")).alias("p")))


@query()
def significance_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_significant(granger_p(spark, d).where("lag = 1"))


def _outcome(spark: SparkSession, d: str) -> DataFrame:
    rows = tagged(spark, d).withColumn("any_event", F.col("chair_ruling") | F.col("interruption"))
    rows = windows.event_follows(rows, "any_event", ["debate_id"], ["seq_index"]).where(~F.col("is_stage_direction"))
    sizes = table(spark, d, "utterances").select(*KEY, (F.length("text") / 1000).alias("kchars")).distinct()
    return rows.join(sizes, KEY).select(*KEY, F.col("intervened").cast("double").alias("y"), F.col("so_citation").cast("double").alias("cites"), "kchars", (F.col("role") == "speaker").cast("double").alias("chair"))


@query()
def logit_wald(spark: SparkSession, d: str) -> DataFrame:
    rows = _outcome(spark, d).withColumn("cites_x_chair", F.col("cites") * F.coalesce("chair", F.lit(0.0)))
    return stats.logit(rows.withColumn("chair", F.coalesce("chair", F.lit(0.0))), "y", ["cites", "chair", "cites_x_chair", "kchars"])


@query()
def mixed_model(spark: SparkSession, d: str) -> DataFrame:
    """Intervention rate of the cells by topic, party and both, with an intercept for each chair."""
    cells = linking_panel(spark, d).where(F.col("party").isin("government", "opposition"))
    coded, names = stats.treatment_columns(cells, [["topic"], ["party"], ["topic", "party"]])
    return stats.random_intercept(coded, "intervention_rate", names, "chair_surname")


@query()
def next_share_model(spark: SparkSession, d: str) -> DataFrame:
    """The next attention share by the present one and the conflict rate, with an intercept for each topic."""
    rows = windows.lead_value(series(spark, d), "attention_share", ["topic"], ["sitting_order"], "attention_share_next")
    return stats.random_intercept(rows, "attention_share_next", ["attention_share", "conflict_rate"], "topic")


@query()
def party_policy_logit(spark: SparkSession, d: str) -> DataFrame:
    """Whether a turn is followed by an intervention, by side, policy subject and both (treatment coding)."""
    rows = analysis(spark, d).where(~F.col("is_stage_direction") & F.col("party").isin("government", "opposition") & F.col("topic").isNotNull())
    rows = rows.withColumns({"y": F.col("intervened").cast("double"), "policy": F.when(F.col("topic") == "non_policy", "no").otherwise("yes")})
    coded, names = stats.treatment_columns(rows, [["party"], ["policy"], ["party", "policy"]])
    return stats.logit(coded, "y", names)


_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1)"
_LOG = _CHOOSE.format("col", "x") + " + " + _CHOOSE.format("(n - col)", "(row1 - x)")


@query(
    ", k AS (SELECT sum((so_citation AND intervened)::INT)::BIGINT AS a, sum((so_citation AND NOT intervened)::INT)::BIGINT AS b, sum((NOT so_citation AND intervened)::INT)::BIGINT AS c, sum((NOT so_citation AND NOT intervened)::INT)::BIGINT AS d"
    " FROM ev WHERE NOT is_stage_direction), r AS (SELECT *, a + b AS row1, a + c AS col, a + b + c + d AS n FROM k), xs AS (SELECT *, unnest(range(greatest(0, row1 + col - n), least(row1, col) + 1)) AS x FROM r),"
    f" lg AS (SELECT *, {_LOG} AS v FROM xs), top AS (SELECT v AS own FROM lg WHERE x = a)"
    f" SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, round(any_value(CASE WHEN b * c = 0 AND a * d = 0 THEN 'nan'::DOUBLE WHEN b * c = 0 THEN 'inf'::DOUBLE ELSE a * d / (b * c) END), 6) AS odds_ratio,"
    f" round(least(1.0, sum(exp(v - ({_CHOOSE.format('n', 'row1')}))) FILTER (v <= own + 1e-7)), 5) AS p FROM lg, top"
)
def fisher_2x2(spark: SparkSession, d: str) -> DataFrame:
    r = _outcome(spark, d).agg(*(F.sum(((F.col("cites") == a) & (F.col("y") == b)).cast("long")).alias(f"c{a}{b}") for a in (1, 0) for b in (1, 0))).first()
    odds, p = stats.fisher_exact(*(int(x or 0) for x in r))
    return spark.createDataFrame([(*(int(x or 0) for x in r), float(odds), float(p))], "a long, b long, c long, d long, odds_ratio double, p double").withColumns({"odds_ratio": F.round("odds_ratio", 6), "p": F.round("p", 5)})


_DIM = "SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x, vec_id FROM embeddings"


@query(
    f", v AS ({_DIM}), m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM v GROUP BY ALL), s AS (SELECT v.vec_id, m.label, round(sum(v.x::DOUBLE * m.m) / (sqrt(sum(v.x::DOUBLE * v.x::DOUBLE)) * sqrt(sum(m.m * m.m))), 9) AS c"
    " FROM v JOIN m USING (i) GROUP BY v.vec_id, m.label) SELECT vec_id, label AS nearest, round(c, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) = 1"
)
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.nearest_centroids(table(spark, d, "embeddings"), "embedding", "label", "vec_id").withColumn("similarity", F.round("similarity", 6))


@query()
def cluster_topics(spark: SparkSession, d: str) -> DataFrame:
    return classify.cluster_vectors(table(spark, d, "embeddings"), "embedding", "vec_id", 12, 5)


_WORDS = "SELECT topic, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS token FROM u JOIN tp USING (debate_id, seq_index)"


@query(
    f", c AS (SELECT topic, token, count(*) AS n FROM ({_WORDS}) GROUP BY ALL), z AS (SELECT topic, sum(n) AS size FROM c GROUP BY ALL), o AS (SELECT token, sum(n) AS total FROM c GROUP BY ALL),"
    " w AS (SELECT topic, token, n / size * ln(1 + (SELECT avg(size) FROM z) / total) AS weight FROM c JOIN z USING (topic) JOIN o USING (token))"
    " SELECT topic, token, place FROM (SELECT topic, token, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, token) AS place FROM w) WHERE place <= 10"
)
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d, "text").join(topics(spark, d), KEY)
    return vocabulary.top_terms(rows, "topic", "text").select("topic", "token", F.col("place").cast("long").alias("place"))


@query()
def two_stage_routing(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d, "text").join(topics(spark, d), KEY)
    gate = classify.train_classifier(rows.withColumn("gate", F.when(F.col("topic") == "non_policy", "none").otherwise("policy")), "text", "gate")
    domain = classify.train_classifier(rows.where("topic <> 'non_policy'"), "text", "topic")
    return classify.two_stage(turns(spark, d, "text", "is_stage_direction").where(~F.col("is_stage_direction")), gate, domain, "text", KEY)


@query()
def topic_coherence(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d, "text").join(topics(spark, d), KEY)
    return vocabulary.topic_coherence(rows, "text", vocabulary.top_terms(rows, "topic", "text"), "topic")


@query()
def procedural_tags_final(spark: SparkSession, d: str) -> DataFrame:
    return classify.tag_models(tagged(spark, d, "text"), "text", TAGS, KEY)


@query()
def tag_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return classify.disagreements(procedural_tags_final(spark, d), TAGS, KEY)


@query(
    f", r AS (SELECT debate_id, seq_index, topic, text FROM u JOIN tp USING (debate_id, seq_index)), c AS (SELECT topic, token, count(*) AS n FROM ({_WORDS}) GROUP BY ALL), z AS (SELECT topic, sum(n) AS size FROM c GROUP BY ALL), o AS (SELECT token, sum(n) AS total FROM c GROUP BY ALL),"
    " w AS (SELECT topic, token, row_number() OVER (PARTITION BY topic ORDER BY round(n / size * ln(1 + (SELECT avg(size) FROM z) / total), 12) DESC, token) AS place FROM c JOIN z USING (topic) JOIN o USING (token)),"
    " t AS (SELECT topic, string_agg(token, ' ' ORDER BY place) AS terms FROM w WHERE place <= 10 GROUP BY topic),"
    " e AS (SELECT topic, string_agg(text, ' | ' ORDER BY place) AS examples FROM (SELECT topic, text, row_number() OVER (PARTITION BY topic ORDER BY debate_id, seq_index) AS place FROM r) WHERE place <= 3 GROUP BY topic)"
    " SELECT topic, n, terms, examples FROM (SELECT topic, count(*) AS n FROM r GROUP BY topic) LEFT JOIN t USING (topic) LEFT JOIN e USING (topic)"
)
def topic_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d, "text").join(topics(spark, d), KEY)
    return vocabulary.taxonomy(rows, "topic", "text", KEY).withColumns({"terms": F.array_join("terms", " "), "examples": F.array_join("examples", " | ")})


@query()
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    return classify.compare_models(turns(spark, d, "text").join(topics(spark, d), KEY), "text", "topic", KEY)
