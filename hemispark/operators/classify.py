"""Text classification with Spark's own models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemispark.operators.vocabulary import WORD, tokens

FEATURES = 1 << 14


def _with_tokens(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_tokens", tokens(F.col(text), WORD))


def train_classifier(df: DataFrame, text: str, label: str, features: int = FEATURES, weight: str | None = None) -> PipelineModel:
    """Hashed TF-IDF and multinomial logistic regression."""
    stages = [
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=25, regParam=1e-3, **({"weightCol": weight} if weight else {})),
    ]
    model = Pipeline(stages=stages).fit(_with_tokens(df, text).where(F.col(label).isNotNull()))
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=model.stages[0].labels)
    return PipelineModel([*model.stages[1:], back])


def predict(df: DataFrame, model: PipelineModel, text: str, keys: list[str]) -> DataFrame:
    """(keys, predicted_label, predicted_confidence)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_with_tokens(df, text))
    return out.select(*keys, "predicted_label", F.array_max(vector_to_array("probability")).alias("predicted_confidence"))


def two_stage(df: DataFrame, gate: PipelineModel, domain: PipelineModel, text: str, keys: list[str], none: str = "non_policy") -> DataFrame:
    """Rows the gate calls ``policy`` get the domain's label, the others ``none``; the confidence is the deciding model's."""
    rows = df.select(*keys, text)
    first = predict(rows, gate, text, [*keys, text])
    out = first.where(F.col("predicted_label") != "policy").select(*keys, F.lit(none).alias("predicted_label"), "predicted_confidence")
    asked = first.where(F.col("predicted_label") == "policy").select(*keys, text)
    return out.unionByName(predict(asked, domain, text, keys))


def cluster_vectors(df: DataFrame, vector: str, key: str, clusters: int, least: int, seed: int = 42) -> DataFrame:
    """(key, topic_id): k-means clusters of normalised vectors, numbered by size; clusters under ``least`` rows are -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    unit = Normalizer(inputCol="_v", outputCol="_u").transform(rows)
    found = KMeans(k=clusters, seed=seed, featuresCol="_u", predictionCol="_c").fit(unit).transform(unit).select(key, "_c")
    sizes = sorted(((r.n, r._c) for r in found.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (-x[0], x[1]))  # one row per cluster
    numbers = {c: i for i, (n, c) in enumerate(sizes) if n >= least}
    topic = F.lit(-1)
    for c, i in numbers.items():
        topic = F.when(F.col("_c") == c, i).otherwise(topic)
    return found.select(key, topic.cast("long").alias("topic_id"))


def tag_models(df: DataFrame, text: str, tags: list[str], keys: list[str], features: int = FEATURES) -> DataFrame:
    """(keys, <tag>_rule, <tag>_model, <tag>_combined) for each tag: a weighted logistic model of the text alone beside the rule.

    The rarer side weighs more, within the bounds of :func:`hemispark.operators.aggregates.class_weights`; a score of 0.5
    or more counts. A tag that never or always occurs has no model, its model column is 0.
    """
    from pyspark.ml.functions import vector_to_array

    from hemispark.operators.aggregates import class_weights

    weights = {r.flag: r.weight for r in class_weights(df, tags).collect()}
    seen = df.agg(*(F.countDistinct(t).alias(t) for t in tags)).first()
    rows = _with_tokens(df, text)
    hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features, binary=True).transform(rows)
    shaped = IDF(inputCol="_tf", outputCol="_features").fit(hashed).transform(hashed).select(*keys, *tags, "_features")
    for t in tags:
        if seen[t] < 2:
            shaped = shaped.withColumn(f"{t}_model", F.lit(0))
            continue
        data = shaped.withColumn("_y", F.col(t).cast("double")).withColumn("_w", F.when(F.col(t), weights[t]).otherwise(1.0))
        fit = LogisticRegression(featuresCol="_features", labelCol="_y", weightCol="_w", maxIter=15, regParam=1e-3, probabilityCol="_p", predictionCol="_q", rawPredictionCol="_r").fit(data.select("_features", "_y", "_w"))
        shaped = fit.transform(data).withColumn(f"{t}_model", (F.get(vector_to_array("_p"), F.lit(1)) >= 0.5).cast("int")).drop("_y", "_w", "_p", "_q", "_r")
    columns = [c for t in tags for c in (F.col(t).cast("int").alias(f"{t}_rule"), F.col(f"{t}_model"), F.greatest(F.col(t).cast("int"), F.col(f"{t}_model")).alias(f"{t}_combined"))]
    return shaped.select(*keys, *columns)


def disagreements(tagged: DataFrame, tags: list[str], keys: list[str], most: int = 20, seed: int = 42) -> DataFrame:
    """(tag, keys, rule, model): at most ``most`` rows of each tag on which rule and model differ."""
    from hemispark.operators.sampling import sample_per_group

    long = tagged.select(*keys, F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(f"{t}_rule").alias("rule"), F.col(f"{t}_model").alias("model")) for t in tags))).alias("x")).select(*keys, "x.*")
    return sample_per_group(long.where(F.col("rule") != F.col("model")), "tag", most, [*keys, "tag"], seed)


def compare_models(df: DataFrame, text: str, label: str, keys: list[str], none: str = "non_policy", share: float = 0.1, cap: int | None = None) -> DataFrame:
    """(model, accuracy, macro_f1, weighted_f1) of a single-stage and a two-stage classifier on one held-out part.

    The held-out part keeps the natural shares of the labels; ``cap`` bounds the rows of ``none`` that the single stage trains on.
    """
    from hemispark.operators.aggregates import class_metrics, summary_metrics
    from hemispark.operators.sampling import cap_class, split_by_hash

    parts = split_by_hash(df.where(F.col(label).isNotNull()).select(*keys, text, label), keys, share, strata=label)
    train, held = parts.where(~F.col("held_out")).drop("held_out"), parts.where("held_out").drop("held_out")
    single = train_classifier(train if cap is None else cap_class(train, label, none, cap, keys), text, label)
    gate = train_classifier(train.withColumn("_gate", F.when(F.col(label) == none, "none").otherwise("policy")), text, "_gate")
    domain = train_classifier(train.where(F.col(label) != none), text, label)
    out = None
    for name, guessed in (("single_stage", predict(held, single, text, keys)), ("two_stage", two_stage(held, gate, domain, text, keys, none))):
        scored = summary_metrics(class_metrics(held.select(*keys, label).join(guessed, keys), label, "predicted_label")).withColumn("model", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return out.select("model", "accuracy", "macro_f1", "weighted_f1")
