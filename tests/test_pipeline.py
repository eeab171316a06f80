import math

from hemispark.operators import pipeline, vocabulary
from hemispark.sources.reports import to_markdown


def test_debate_from_pages(spark):
    front = "No. 3 of 2015\nSIXTH NATIONAL ASSEMBLY\nFIRST SESSION\nTUESDAY 10 FEBRUARY 2015\nTHE CABINET\nHon. Tim Oak Minister of Health\nPRINCIPAL OFFICERS AND OFFICIALS\nMadam Speaker Holt, Ann"
    body = "12\nMadam Speaker: Order!\nMr Oak: mo pe dimann zot\net puis\n(Interruptions)\nThe Prime Minister: I rise to speak about the budget now.\nMs Ray: yes"
    df = spark.createDataFrame([("d", "Debate_No_3_of_2015_(REVISED).pdf", "2015", [front, body]), ("e", "x.pdf", "2015", [])], "debate_id string, source_file string, year string, pages array<string>")
    out = pipeline.process_debates(df)
    assert out.columns == pipeline.COLUMNS
    rows = out.orderBy("seq_index").collect()
    assert [(r.speaker_raw, r.role, r.party, r.language, r.text, r.is_stage_direction) for r in rows] == [
        ("Madam Speaker", "speaker", "chair", "en", "Order!", False),
        ("Mr Oak", "minister", "government", "mfe", "mo pe dimann zot et puis", False),
        (None, None, None, None, "(Interruptions)", True),
        ("The Prime Minister", "prime_minister", "government", "unknown", "I rise to speak about the budget now.", False),
        ("Ms Ray", "unclassified_mp", None, "en", "yes", False),
    ]
    assert {r[:8] for r in map(tuple, rows)} == {("d", "2015", "Debate_No_3_of_2015_(REVISED).pdf", "No. 3 of 2015", "SIXTH", "FIRST", "TUESDAY 10 FEBRUARY 2015", "REVISED")}
    assert {r.measure: r.value for r in pipeline.quality_report(out).collect()} == {"debates": 1, "turns": 5, "dialogue": 4, "stage_directions": 1, "without_role": 0}


def test_coherence(spark):
    texts = [("salt sea",)] * 40 + [("iron road",)] * 40 + [("salt iron",)]
    terms = spark.createDataFrame([("good", "salt"), ("good", "sea"), ("bad", "sea"), ("bad", "road")], "g string, token string")
    got = {r.g: r.coherence for r in vocabulary.topic_coherence(spark.createDataFrame(texts, "t string"), "t", terms, "g").collect()}
    assert got["good"] > 0.9 and got["bad"] < got["good"] and all(map(math.isfinite, got.values()))
    assert vocabulary.topic_coherence(spark.createDataFrame(texts, "t string"), "t", terms.limit(0), "g").count() == 0


def test_windows_move_by_one(spark):
    """Two terms further apart than the window never meet."""
    far = "salt " + "x " * 20 + "sea"
    terms = spark.createDataFrame([("g", "salt"), ("g", "sea")], "g string, token string")
    near = vocabulary.topic_coherence(spark.createDataFrame([(far,)], "t string"), "t", terms, "g", window=30).first().coherence
    apart = vocabulary.topic_coherence(spark.createDataFrame([(far,)], "t string"), "t", terms, "g", window=5).first().coherence
    assert near > apart


def test_markdown(spark):
    text = to_markdown(spark.createDataFrame([(1, "a|b", 0.5), (2, None, None)], "i int, t string, x double").orderBy("i"), "T", 1)
    assert text.startswith("## T\n\n| i | t | x |\n|---|---|---|\n| 1 | a\\|b | 0.5 |") and "first 1 rows" in text
