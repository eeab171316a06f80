from pyspark.sql import functions as F

from hemispark.operators import classify, rules
from hemispark.sources import files
from hemispark.streaming import turns as stream


def test_files_and_faults(spark, tmp_path):
    for year, name, content in (("2015", "Debate_No_1_of_2015.pdf", b"one\fTHE CABINET"), ("2016", "Debate_No_2_of_2016.pdf", b"bad"), ("2016", "notes.txt", b"x")):
        (tmp_path / year).mkdir(exist_ok=True)
        (tmp_path / year / name).write_bytes(content)

    def extract(content):
        if content == b"bad":
            raise ValueError("no pages")
        return content.decode().split("\f")

    good, bad = files.read_pages(spark, str(tmp_path), extract)
    assert [tuple(r) for r in good.collect()] == [("Debate_No_1_of_2015", "Debate_No_1_of_2015.pdf", "2015", ["one", "THE CABINET"])]
    assert [tuple(r) for r in bad.collect()] == [("Debate_No_2_of_2016", "Debate_No_2_of_2016.pdf", "2016", "ValueError: no pages")]
    assert files.read_pages(spark, str(tmp_path), extract, years=["2015"])[1].count() == 0


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", "2015", "Élan, x"), ("b", "2016", None)], "k string, year string, t string")
    files.write_parquet(df, str(tmp_path / "p"), by_year=True)
    assert {tuple(r) for r in files.read_tables(spark, str(tmp_path / "p"), ["2015"]).select("k", "t").collect()} == {("a", "Élan, x")}
    files.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "k string, year string, t string").collect()} == {("a", "2015", "Élan, x"), ("b", "2016", None)}
    cache = df.limit(1).withColumn("text_hash", F.xxhash64("t"))
    assert {r.k for r in files.missing_vectors(df.withColumn("t", F.coalesce("t", F.lit("new"))), cache, ["k"], "t").collect()} == {"b"}


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/utterances.parquet").repartition(3).write.parquet(path)
    counts = stream.tag_counts(stream.stream_turns(spark, path), late="5000 days")
    q = counts.writeStream.format("memory").queryName("tag_counts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    streamed = spark.sql("SELECT sum(n) AS n, sum(so_citation) AS s FROM tag_counts").first()
    batch = rules.rule_tags(spark.read.parquet(path).dropDuplicates(["debate_id", "seq_index"]))
    assert streamed.n == batch.count() and streamed.s == batch.where("so_citation").count()


def test_classifier(spark):
    rows = [(i, "hospital nurse ward" if i % 3 == 0 else "road bus traffic" if i % 3 == 1 else "sit down order", "health" if i % 3 == 0 else "transport" if i % 3 == 1 else "non_policy") for i in range(90)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    gate = classify.train_classifier(df.withColumn("g", F.when(F.col("label") == "non_policy", "none").otherwise("policy")), "text", "g")
    domain = classify.train_classifier(df.where("label <> 'non_policy'"), "text", "label")
    out = classify.two_stage(df, gate, domain, "text", ["id"]).join(df, "id")
    assert out.count() == 90 and out.where("predicted_label <> label").count() == 0 and out.where("predicted_confidence < 0.5").count() == 0
