import datetime as dt
import random

from pyspark.sql import functions as F

from hemispark.functions.dates import day_month_year, printed_date
from hemispark.operators.event_time import as_known_at, dyadic_nodes

FACTS = "party string, term string, side string, effective_from date, effective_to date, recorded_at timestamp"
D = dt.date


def test_dyadic_nodes_are_a_disjoint_cover(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        a = D(2000, 1, 1) + dt.timedelta(rng.randrange(6000))
        rows.append((a, a + dt.timedelta(rng.randrange(-3, 900))))
    df = spark.createDataFrame(rows, "a date, b date").select("a", "b", dyadic_nodes(F.col("a"), F.col("b")).alias("n"))
    origin = D(1700, 1, 1)
    for r in df.collect():
        days = sorted(d for n in r.n for d in range(n.node << n.level, (n.node + 1) << n.level))
        assert days == list(range((r.a - origin).days, (r.b - origin).days))
        assert len(r.n) <= 2 * 19


def test_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda: D(2015, 1, 1) + dt.timedelta(rng.randrange(400))
    facts = []
    for i in range(300):
        a, b = sorted((day(), day()))
        rec = dt.datetime.combine(day(), dt.time(rng.randrange(24))) + dt.timedelta(seconds=i)
        facts.append((rng.choice("PQ"), rng.choice(["6th", "7th"]), rng.choice(["gov", "opp"]), rng.choice([a, None]), rng.choice([b, None]), rng.choice([rec, rec, rec, None])))
    facts += facts[:20]  # repeated rows
    events = [(f"e{i}", rng.choice(["6th", "7th", None]), rng.choice([day(), day(), None])) for i in range(120)]
    got = as_known_at(spark.createDataFrame(events, "id string, term string, day date"), spark.createDataFrame(facts, FACTS), ["id"], "day", ["term"], ["side"], per=["party"])
    want = {}
    for i, term, d in events:
        for party in "PQ":
            ok = [f for f in facts if d and term and f[0] == party and f[1] == term and (f[3] is None or f[3] <= d) and (f[4] is None or d < f[4]) and f[5] and f[5] < dt.datetime.combine(d, dt.time())]
            if ok:
                want[i, party] = max(ok, key=lambda f: f[5])[2]
    assert {(r.id, r.party): r.side for r in got.collect()} == want
    assert got.columns == ["id", "day", "term", "party", "side"]


def test_edges(spark):
    ts = dt.datetime
    facts = [
        ("P", "6th", "old", None, D(2016, 5, 1), ts(2010, 1, 1)),
        ("P", "6th", "new", D(2016, 5, 1), None, ts(2016, 5, 1)),  # recorded at the start of its own first day
        ("P", "7th", "late", None, None, ts(2020, 1, 1)),
    ]
    events = [("a", "6th", D(2016, 4, 30)), ("b", "6th", D(2016, 5, 1)), ("c", "6th", D(2016, 5, 2)), ("d", "7th", D(2019, 1, 1)), ("e", "6th", D(1500, 1, 1))]
    facts_df, events_df = spark.createDataFrame(facts, FACTS), spark.createDataFrame(events, "id string, term string, day date")
    got = {r.id: r.side for r in as_known_at(events_df, facts_df, ["id"], "day", ["term"], ["side"]).collect()}
    assert got == {"a": "old", "c": "new"}
    assert as_known_at(events_df.limit(0), facts_df, ["id"], "day", ["term"], ["side"]).count() == 0
    assert as_known_at(events_df, facts_df.limit(0), ["id"], "day", ["term"], ["side"]).count() == 0
    clash = events_df.withColumn("side", F.lit("x")).withColumn("recorded_at", F.lit(1))
    assert {r.id for r in as_known_at(clash, facts_df, ["id"], "day", ["term"], ["side"]).collect()} == {"a", "c"}


def test_printed_dates(spark):
    cases = {
        "TUESDAY 29 OCTOBER 2013": D(2013, 10, 29), "FRIDAY 11 APRIL 2014 AT 11.30 A.M.": D(2014, 4, 11), "November 11, 2015": D(2015, 11, 11), "23/05/2018": D(2018, 5, 23),
        "25.07.2018": D(2018, 7, 25), "2014-07-08": D(2014, 7, 8), "FRI. 23 AUG. 2013": D(2013, 8, 23), "SITTING OF TUESDAY 25 MARCH 2014": D(2014, 3, 25),
        "FRIDAY\xa018\xa0JULY 2014": D(2014, 7, 18), "WEDNESDAY 18TH JUNE 2025": D(2025, 6, 18), "TUESDAY  21  MAY  2019": D(2019, 5, 21), "MERCREDI 17 FÉVRIER 2021": D(2021, 2, 17),
        "VENDREDI 14 AOÛT 2015": D(2015, 8, 14), "Mardi 1er juillet 2014": D(2014, 7, 1), "TUESDAY NOVEMBER 2020": None, "31 FEBRUARY 2015": None, "DATE ILLEGIBLE": None, "": None, None: None, "32.01.2015": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", printed_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == cases
    r = spark.createDataFrame([("TUESDAY 10 FEBRUARY 2015",), ("31 FEBRUARY 2015",), ("",)], "t string").select(day_month_year(F.col("t")).alias("d")).collect()
    assert [x.d for x in r] == [D(2015, 2, 10), None, None]
