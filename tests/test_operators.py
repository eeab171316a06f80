import random
import re

from pyspark.sql import functions as F

from hemispark.functions.text import fold_accents, strip, words
from hemispark.operators import aggregates, metadata, panels, questions, resolution, rules, sampling, segmentation, vocabulary, windows


def test_text_helpers(spark):
    r = spark.createDataFrame([("\t\xa0 Élan  d’or \n",)], "t string").select(strip(F.col("t")).alias("s"), words(F.col("t")).alias("w"), fold_accents(F.col("t")).alias("f")).first()
    assert r.s == "Élan  d’or" and r.w == ["Élan", "d’or"] and "Elan" in r.f


def test_rules(spark):
    rows = [
        ("(Interruptions)", True, None, {"interruption"}), (" (withdrawn) ", True, None, {"withdrawal_request"}), ("(Interruptions)", False, None, set()),
        ("I ask you to withdraw under Standing Order 42. Order!", False, "speaker", {"chair_ruling", "withdrawal_request", "so_citation"}),
        ("Order!", False, "minister", set()), ("Order!", False, None, set()), ("This would be replied by the minister", False, "speaker", {"pnq_transfer"}),
        ("a transfer of funds", False, "speaker", set()), ("éorder", False, "speaker", set()), (None, None, None, set()),
    ]
    df = rules.rule_tags(spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, text string, is_stage_direction boolean, role string"))
    for r in df.collect():
        assert {t for t in rules.TAGS if r[t]} == rows[r.i][3], rows[r.i]
    assert {r.tag: r.n for r in rules.tag_summary(df).collect()}["withdrawal_request"] == 2
    assert [(r.tags_per_row, r.n) for r in rules.tag_overlaps(df).collect()] == [(3, 1)]
    assert rules.tag_summary(df.limit(0)).where("n > 0 or pct is not null").count() == 0


def test_roles(spark):
    rows = [("The Prime Minister", "prime_minister"), ("Madam Speaker", "speaker"), ("The Deputy Speaker", "deputy_speaker"), ("The Minister of X (Mr Bo Ray)", "minister"), ("Mr Low", "deputy_speaker"), ("Mr Who", "unclassified_mp"), (None, None)]
    df = spark.createDataFrame([(x, {"ray": "X"}, {"deputy_speaker": "low", "clerk": "moss"}) for x, _ in rows], "speaker_raw string, cab map<string,string>, off map<string,string>")
    assert [r.role for r in rules.resolve_roles(df, cabinet="cab", officers="off").collect()] == [x for _, x in rows]


def test_event_window(spark):
    events = {("a", 0): False, ("a", 5): True, ("a", 6): None, ("a", 9): False, ("b", 0): True, ("c", 1): False, ("c", 2): False, ("c", 3): False, ("c", 4): False, ("c", 5): True}
    df = spark.createDataFrame([(*k, v) for k, v in events.items()], "d string, i int, e boolean").repartition(3)
    got = {(r.d, r.i): r.intervened for r in windows.event_follows(df, "e", ["d"], ["i"]).collect()}
    assert got == {("a", 0): True, ("a", 5): False, ("a", 6): False, ("a", 9): False, ("b", 0): False, ("c", 1): False, ("c", 2): True, ("c", 3): True, ("c", 4): True, ("c", 5): False}


def test_next_row_is_of_the_same_debate(spark):
    rows = [("x", 0, True), ("x", 1, False), ("y", 0, True), ("y", 2, True), ("y", 7, False), ("z", 0, True)]
    values = spark.createDataFrame([("x", 1, "A"), ("y", 0, "B"), ("y", 7, "C")], "d string, i int, v string")
    got = {(r.d, r.i): r.t for r in windows.own_or_next(spark.createDataFrame(rows, "d string, i int, s boolean"), values, "d", "i", "s", "v", "t").collect()}
    assert got == {("x", 0): "A", ("x", 1): "A", ("y", 0): None, ("y", 2): "C", ("y", 7): "C", ("z", 0): None}


def automaton(lines):
    """The record read line by line: speaker, text, stage."""
    stage = lambda x: any(re.search(p, x) for p in segmentation.STAGE_PATTERNS)

    def tag(x):
        m = re.match(segmentation.SHORT_TAG, x)
        if m:
            return f"{m[1]} {m[2]}".strip(), m[3]
        m = re.match(segmentation.LONG_TAG, x)
        if m and any(k in m[1] for k in segmentation.LONG_TAG_KEYWORDS):
            return f"The {m[1]}".strip(), m[2]
        return None

    out, speaker, chunks, i = [], None, [], 0

    def flush():
        nonlocal speaker, chunks
        text = " ".join(c for c in chunks if c).strip()
        if text:
            out.append((speaker, text, False))
        speaker, chunks = None, []

    lines = [x.strip() for x in lines if x.strip() and not re.match(segmentation.PAGE_NUMBER, x.strip())]
    while i < len(lines):
        x = lines[i]
        if stage(x):
            flush()
            out.append((None, x, True))
        elif tag(x):
            flush()
            speaker, first = tag(x)
            chunks = [first]
        elif x.startswith("The ") and i + 1 < len(lines) and tag(x + " " + lines[i + 1]):
            flush()
            speaker, first = tag(x + " " + lines[i + 1])
            chunks = [first]
            i += 1
        else:
            chunks.append(x)
        i += 1
    flush()
    return out


def test_segmentation_is_the_automaton(spark):
    rng = random.Random(11)
    pool = [
        "Mr Ray: good morning", "Mrs Low:", "The Minister of Arts (Mr Jo", "Ray): I rise", "The House is full", "The Leader of the", "Opposition: no", "and so on", "(Interruptions)", "At 3.30 p.m. the sitting was suspended",
        "12", "", "The Speaker: order", "Madam Speaker: please", "The old Whip", "words: here", "On resuming", "The Minister", "of Health: yes", "  spaced  ",
    ]
    docs = {f"d{k}": ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 4))] for k in range(150)}
    df = segmentation.segment_turns(spark.createDataFrame(list(docs.items()), "debate_id string, pages array<string>"))
    got = {}
    for r in df.orderBy("debate_id", "seq_index").collect():
        got.setdefault(r.debate_id, []).append((r.speaker_raw, r.text, r.is_stage_direction))
    for k, pages in docs.items():
        assert got.get(k, []) == automaton([x for p in pages for x in p.split("\n")]), (k, pages)


def test_body_start(spark):
    df = spark.createDataFrame([(["NATIONAL ASSEMBLY", "x", "THE CABINET", "body", "more"],), (["a", "b"],), (["CONTENTS"],)], "pages array<string>")
    assert [r.s for r in df.select(segmentation.body_start(F.col("pages")).alias("s")).collect()] == [3, 1, 0]


def test_front_matter(spark):
    page = (
        "No. 3 of 2015\nSIXTH NATIONAL ASSEMBLY\nFIRST SESSION\nTUESDAY 10 FEBRUARY 2015\nTHE CABINET\n(Formed by X)\nHon. Sir Abe Zorn, GCSK Prime Minister, Minister of Finance\nand Home Affairs\n"
        "Hon. Mrs Lea Quill Minister of Health\nDr. the Hon. Tim Oak Attorney General\nPRINCIPAL OFFICERS AND OFFICIALS\nMadam Speaker Holt, Ann\nDeputy Speaker Moss, P.\nClerk Assistant Reed, J."
    )
    df = spark.createDataFrame([("d", [page]), ("e", ["none"])], "debate_id string, pages array<string>")
    cab = {r.debate_id: r.cabinet for r in metadata.cabinets(df).collect()}
    assert cab == {"d": {"zorn": "Prime Minister, Minister of Finance and Home Affairs", "quill": "Minister of Health", "oak": "Attorney General"}}
    r = df.select("debate_id", *metadata.header_parts(F.col("pages")[0]), metadata.officer_surnames(F.col("pages")).alias("o")).orderBy("debate_id").collect()
    assert r[0][1:5] == ("No. 3 of 2015", "SIXTH", "FIRST", "TUESDAY 10 FEBRUARY 2015") and r[1][1:5] == (None,) * 4
    assert r[0].o == {"clerk_assistant": "reed", "deputy_speaker": "moss", "speaker": "holt"} and r[1].o == {}
    chairs = {x.debate_id: (x.chair_surname, x.deputy_speaker_surname) for x in metadata.chair_identities(df).collect()}
    assert chairs == {"d": ("holt", "moss"), "e": (None, None)}
    f = spark.createDataFrame([("Debate_No_1A_of_2015_(revised).pdf",), ("Debate_No_2_of_2016.pdf",), ("x.pdf",)], "n string").select(*metadata.file_parts(F.col("n"))).collect()
    assert [tuple(x) for x in f] == [("1A", "2015", "REVISED"), ("2", "2016", ""), (None, None, None)]


REGISTRY = [("6th", "Oak", "Tim Oak", "AAA"), ("6th", "twin", "A Twin", "AAA"), ("6th", "twin", "B Twin", "BBB"), ("6th", "van holt", "C Van Holt", "CCC"), ("6th", "holt", "D Holt", "AAA"), ("6th", "ray twin", "E Ray Twin", "BBB")]


def test_candidates(spark):
    reg = spark.createDataFrame(REGISTRY, "assembly_term string, surname_key string, full_name string, party string")
    rows = [("Mr Oak", "SIXTH"), ("Mr Twin", "SIXTH"), ("Mrs C. Van Holt", "SIXTH"), ("The Minister (Mr Oak)", "SIXTH"), ("Mr Oak", "NINTH"), ("Nobody", "SIXTH"), (None, "SIXTH"), ("Mr Ray Twin", "SIXTH"), ("Mr Oak", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, speaker_raw string, assembly string")
    got = [(r.resolved_party, r.match_method) for r in resolution.resolve_candidates(df, reg, ["i"]).orderBy("i").collect()]
    assert got == [("AAA", "matched_1word"), (None, "ambiguous_collision"), ("CCC", "matched_2word"), ("AAA", "matched_1word"), (None, "no_match"), (None, "no_match"), (None, "no_match"), ("BBB", "matched_2word"), (None, "no_match")]
    # a collision of the first known candidate ends the search, even if a later one is unique
    reg2 = spark.createDataFrame([("6th", "van holt", "A", "X"), ("6th", "van holt", "B", "Y"), ("6th", "holt", "C", "Z")], reg.schema)
    assert resolution.resolve_candidates(spark.createDataFrame([(1, "Mr Van Holt", "SIXTH")], df.schema), reg2, ["i"]).first().match_method == "ambiguous_collision"


def test_validity(spark):
    import datetime as dt

    D = dt.date
    a = spark.createDataFrame([("P", "6th", "gov", D(2015, 1, 1), D(2016, 1, 1)), ("Q", "6th", "gov", None, D(2016, 1, 1)), ("Q", "6th", "opp", D(2016, 1, 1), None)], "party string, assembly_term string, gov_or_opp string, effective_from date, effective_to date")
    rows = [(0, "P", "6th", None, "gov"), (1, "P", "6th", D(2020, 1, 1), "gov"), (2, "Q", "6th", D(2015, 12, 31), "gov"), (3, "Q", "6th", D(2016, 1, 1), "opp"), (4, "Q", "6th", None, None), (5, "R", "6th", D(2016, 1, 1), None), (6, None, "6th", None, None)]
    df = spark.createDataFrame([r[:4] for r in rows], "i int, p string, t string, day date")
    assert [r.gov_or_opp for r in resolution.valid_sides(df, a, ["i"], "p", "t", "day").orderBy("i").collect()] == [r[4] for r in rows]


def test_questions(spark):
    rows = [("d", 0, True, "(No. B/12) Mr J. Oak (First Ward) asked"), ("d", 3, False, "(No. B/12) Mr J. Oak (First Ward) and (No. B/13) Mrs Ray (Second Ward)"), ("d", 4, False, "Questions B/12 and B/99 would be replied by the Minister"), ("e", 1, False, "B/12 alone")]
    df = spark.createDataFrame(rows, "debate_id string, seq_index int, is_stage_direction boolean, text string")
    heads = {(r.debate_id, r.pq_num): (r.asker_raw, r.constituency_raw, r.seq_index) for r in questions.question_headers(df).collect()}
    assert heads == {("d", "12"): ("Mr J. Oak", "First Ward", 0), ("d", "13"): ("Mrs Ray", "Second Ward", 3)}
    moved = questions.question_numbers(df)
    assert {tuple(r) for r in moved.collect()} == {("d", "12"), ("d", "99")}
    flagged = questions.flag_members(questions.question_headers(df), moved, ["debate_id", "pq_num"], "t")
    assert {r.pq_num: r.t for r in flagged.collect()} == {"12": True, "13": False}


def test_order_of_filter_and_window(spark):
    """An interruption is a stage direction: the panel's window sees it, the series' does not."""
    turns = spark.createDataFrame([("d", 0, False, False), ("d", 1, True, True)], "debate_id string, seq_index int, is_stage_direction boolean, any_event boolean")
    panel = windows.event_follows(turns, "any_event", ["debate_id"], ["seq_index"]).where(~F.col("is_stage_direction"))
    series = windows.event_follows(turns.where(~F.col("is_stage_direction")), "any_event", ["debate_id"], ["seq_index"])
    assert panel.first().intervened is True and series.first().intervened is False


def test_series_grid(spark):
    import datetime as dt

    turns = spark.createDataFrame([("d", 0, False), ("d", 1, True), ("e", 0, False)], "debate_id string, seq_index int, any_event boolean")
    topics = spark.createDataFrame([("d", 0, "health"), ("d", 1, "non_policy")], "debate_id string, seq_index int, topic string")
    dated = spark.createDataFrame([("d", dt.date(2015, 1, 1), 0), ("e", dt.date(2015, 1, 2), 1)], "debate_id string, sitting_date date, sitting_order long")
    got = {r.debate_id: (r.attention_share, r.conflict_rate) for r in panels.series_grid(turns, topics, dated).collect()}
    assert got == {"d": (0.5, 1.0), "e": (None, 0.0)}


def test_aggregates(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a")], "t string, g string")
    m = {r.label: (r.support, r.precision, r.recall, r.f1) for r in aggregates.class_metrics(df.where("t is not null"), "t", "g").collect()}
    assert m == {"a": (2, 0.5, 0.5, 0.5), "b": (1, 0.5, 1.0, 2 / 3), "c": (1, 0.0, 0.0, 0.0)}
    assert {r.t: r.n for r in aggregates.value_counts(df, "t").collect()} == {"a": 2, "b": 1, "c": 1, None: 1}
    s = aggregates.summary_metrics(aggregates.class_metrics(df.where("t is not null"), "t", "g")).first()
    assert abs(s.accuracy - 0.5) < 1e-9 and abs(s.macro_f1 - (0.5 + 2 / 3) / 3) < 1e-9
    x = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    d = aggregates.describe(x, "x").first()
    assert (d.n, d.min, d.q25, d.q50, d.q75, d.max) == (3, 1.0, 1.5, 2.0, 3.0, 4.0)
    assert aggregates.describe(x.limit(0), "x").first().n == 0


def test_sampling(spark):
    df = spark.range(5000).withColumn("s", F.when(F.col("id") % 7 == 0, "x").otherwise("y"))
    for strata in (None, "s"):
        out = sampling.split_by_hash(df, ["id"], 0.1, strata=strata)
        held = out.where("held_out")
        assert out.count() == 5000 and held.count() == 500 if not strata else {r.s: r["count"] for r in held.groupBy("s").count().collect()} == {"x": 72, "y": 429}
        assert {r.id for r in held.collect()} == {r.id for r in sampling.split_by_hash(df.repartition(7), ["id"], 0.1, strata=strata).where("held_out").collect()}
    capped = sampling.cap_class(df, "s", "y", 100, ["id"])
    assert {r.s: r["count"] for r in capped.groupBy("s").count().collect()} == {"x": 715, "y": 100}
    assert {r["count"] for r in sampling.sample_per_group(df, "s", 20, ["id"]).groupBy("s").count().collect()} == {20}


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, "Le chat, le CHAT 12"), (2, "chat été"), (3, None)], "id int, t string")
    v = {r.token: (r.n, r.id) for r in vocabulary.build_vocabulary(df, "t", ["id"], 10).collect()}
    assert v == {"chat": (3, 2), "le": (2, 3)}
    e = [r.ids for r in vocabulary.encode(df, "t", {"chat": 2, "le": 3}, 4).orderBy("id").collect()]
    assert e == [[3, 2, 3, 2], [2, 1, 0, 0], [0, 0, 0, 0]]
    cases = [("", None, "unknown"), ("mo pa kone", "fr", "mfe"), ("pou nou", None, "mfe"), ("x" * 19, "xx", "en"), ("x" * 20, "xx", "xx"), ("il fait beau pour nous dan la rue", "fr", "mfe"), ("plain words with nothing special", None, "unknown"), ("mo 12345", None, "mfe")]
    got = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, t string, d string").select("i", vocabulary.keyword_language(F.col("t"), F.col("d")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [c[2] for c in cases]


def test_chunks_make_no_difference(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for d, size in (("hot", 400), ("a", 3), ("b", 40), ("c", 1)):
        at = 0
        for _ in range(size):
            at += rng.choice([1, 1, 1, 2, 9, 60])
            rows.append((d, at, rng.random() < 0.15, rng.random() < 0.5))
    df = spark.createDataFrame(rows, "d string, i long, e boolean, s boolean").repartition(5)
    values = spark.createDataFrame([(d, i, f"{d}{i}") for d, i, _, _ in rows], "d string, i long, v string")
    monkeypatch.setattr(windows, "CHUNK", 16)
    got = {(r.d, r.i): r.intervened for r in windows.event_follows(df, "e", ["d"], ["i"]).collect()}
    whole = {(r.d, r.i): r.intervened for r in windows.event_follows(df.withColumn("k", F.col("i").cast("double")), "e", ["d"], ["k"]).collect()}
    assert got == whole and len(got) == len(rows)
    nexts = {(r.d, r.i): r.t for r in windows.own_or_next(df, values, "d", "i", "s", "v", "t").collect()}
    for d in "abc":
        own = sorted((i, s) for x, i, _, s in rows if x == d)
        for (i, s), after in zip(own, [*own[1:], None]):
            assert nexts[d, i] == (f"{d}{i}" if not s else f"{d}{after[0]}" if after else None)


def test_question_panel(spark):
    import datetime as dt

    reg = spark.createDataFrame(REGISTRY, "assembly_term string, surname_key string, full_name string, party string")
    align = spark.createDataFrame([("AAA", "6th", "gov", None, dt.date(2016, 1, 1)), ("AAA", "6th", "opp", dt.date(2016, 1, 1), None)], "party string, assembly_term string, gov_or_opp string, effective_from date, effective_to date")
    rows = [
        ("d", 0, True, "(No. B/12) Mr T. Oak (First Ward)"), ("d", 1, False, "asked the minister"), ("d", 2, False, "(No. B/13) Mr Twin (Second Ward) asked about roads"), ("d", 3, False, "B/13 and B/77 will be replied by the Minister"),
        ("e", 0, True, "(No. B/12) Mr Oak (First Ward)"),
    ]
    days = {"d": "TUESDAY 10 FEBRUARY 2015", "e": "FRIDAY 1 JANUARY 2016"}
    turns = spark.createDataFrame([(*r, "SIXTH", days[r[0]]) for r in rows], "debate_id string, seq_index long, is_stage_direction boolean, text string, assembly string, sitting_date string")
    topics = spark.createDataFrame([("d", 1, "health"), ("d", 2, "transport"), ("d", 0, "never")], "debate_id string, seq_index long, topic string")
    panel, counts = questions.question_panel(turns, topics, reg, align)
    got = {(r.debate_id, r.pq_num): (r.resolved_party, r.resolved_gov_opp, r.match_method, r.topic, r.transferred, r.header_seq_index) for r in panel.collect()}
    assert got == {
        ("d", "12"): ("AAA", "gov", "matched_1word", "health", False, 0),
        ("d", "13"): (None, None, "ambiguous_collision", "transport", True, 2),
        ("e", "12"): ("AAA", "opp", "matched_1word", None, False, 0),
    }
    assert tuple(counts.first()) == (2, 1)


def test_taxonomy(spark):
    df = spark.createDataFrame([(1, "a", "salt sea salt"), (2, "a", "sea"), (3, "b", "iron"), (4, None, "x")], "id int, g string, t string")
    got = {r.g: (r.n, sorted(r.terms), r.examples) for r in vocabulary.taxonomy(df, "g", "t", ["id"]).collect()}
    assert got == {"a": (2, ["salt", "sea"], ["salt sea salt", "sea"]), "b": (1, ["iron"], ["iron"])}
