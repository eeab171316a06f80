import itertools
import math
import random
import tempfile
from collections import Counter
from pathlib import Path

import pytest

from hemispark.llm import annotations as an
from hemispark.llm import furniture as fu
from hemispark.llm import scans, turns
from hemispark.session import checkpoint, packed_checkpoint

NOISE = [
    ("Mr X", "(00:12:33.10) I rise.", False, {"timestamp"}), ("Mr X", "We met at 2.30 p.m. on Monday; the ratio stood at 3:2.", False, set()), ("Mr X", "I (erm) rise, um, now", False, {"filler"}),
    ("Mr X", "Let us err on the side of caution. The UM group and the ERM scheme (sic) [emphasis added] (see paragraph 35).", False, set()), ("Mr X", "I rise [inaudible] now <noise> ♪ bell rings ♪ /door slams/", False, {"sound"}),
    ("[00:12:01] Mr X", "I rise", False, {"label"}), ("SPEAKER 4 - The Prime Minister", "x y", False, {"label"}), ("Mr X (Mic 3)", "x y", False, {"label"}), ("The Minister of Health (Mr J. Oak)", "x y", False, set()),
    ("Mr Warvi.", "x y", False, set()), ("Mr Pulou....", "x y", False, {"label"}), ("Oak, Tim", "x y", False, set()), (None, "x y. / Mr Low: no way.", False, {"inline"}), ("Mr X", "x y.\nThe Deputy Speaker: no.", False, {"inline"}),
    ("Mr X", "I quote Ms Low: “please sit down.”", False, set()), (None, "(Laughter)", False, {"stage_flag"}), ("Mr X", "I rise to speak.", True, {"stage_flag"}), (None, "(Interruptions)", True, set()), (None, "At 9.20 p.m. the sitting was adjourned.", True, set()),
    (None, "[Page 12]", True, set()), (None, "DEBATES 20 JANUARY 2017 Col. 17", False, set()), (None, None, None, set()), ("", "", False, set()),
]


@pytest.mark.parametrize("speaker,text,flag,noises", NOISE)
def test_noises(speaker, text, flag, noises):
    assert set(an.read_row(speaker, text, flag).noises) == noises


def test_clean_text_and_turns():
    r = an.read_row("Mr X", "I (um) rise [00:10] today, er, now. – Ms Low: I *coughs* object.", False)
    assert r.text == "I rise today, now." and r.labels == ["Ms Low"] and r.texts == ["I object."]
    assert an.strip_label("[00:01] Mr X (cont'd) //") == ("Mr X", True) and an.strip_label(None) == (None, False)


def test_page_lines():
    text = "I visi-\nDEBATES 17 MAY 2017 Col. 178\nted the short- and long-term wards\n(158)\nof B/22 (see paragraph 3) on 12 May 2015. p. 9 / Written Answers The end."
    clean, header, hyphen = fu.join_lines(text)
    assert clean == "I visited the short- and long-term wards of B/22 (see paragraph 3) on 12 May 2015. The end." and header and hyphen
    assert fu.join_lines("Plain text\nwrapped at a line.") == ("Plain text wrapped at a line.", False, False)
    assert fu.join_lines("- 17 -  Official Report (Xyz)") == ("", True, False)
    assert fu.join_lines("") == ("", False, False)


def test_headers_without_a_number():
    title = "NATIONAL ASSEMBLY DEBATES"
    for text in (title, f"{title}\nthe House met again", f"the House met\n{title}\nagain on Monday", f"112\n{title}"):
        clean, header, _ = fu.join_lines(text)
        assert header and title not in clean and "112" not in clean
    line = "Marivelle Gazette Extra"
    assert fu.join_lines(f"we met\n{line}\nagain")[1] is False
    assert fu.join_lines(f"we met\n{line}\nagain", repeated={line}) == ("we met again", True, False)
    for speech in ("Order!", "Hear, hear!", "Next question!", "Yes", "I move that the Bill be read", "pre- and post-war rules of\nthe House"):
        assert not fu.join_lines(speech)[1] and not fu.join_lines(speech)[2]


def test_fitted_chain_follows_its_pages():
    pages = [(f"the {w} of the house was\n{n} | Proceedings of Sitting\nread again on the {w}- \ning day of the year.", ()) for n, w in enumerate(["open", "clos", "sitt", "read"] * 50)]
    chain = fu.fit_chain(pages)
    assert chain.weights.shape == fu.PRIOR.shape and (chain.weights != fu.PRIOR).any()
    assert fu.join_lines(pages[0][0], chain) == ("the open of the house was read again on the opening day of the year.", True, True)
    assert fu.fit_chain([]) == fu.DEFAULT


def test_repeated_lines_of_a_debate_are_headers(spark):
    rows = [("d", i, f"we met on day {'abcdefgh'[i]}\nMarivelle Gazette Extra\nand left") for i in range(5)] + [("e", 0, "we met on\nMarivelle Gazette Extra\nday x")]
    df = spark.createDataFrame(rows, "debate_id string, seq_index int, text string")
    got = scans.page_noise(df, ["debate_id", "seq_index"], "text").collect()
    assert sorted((r.debate_id, r.seq_index) for r in got if r.noise == "header") == [("d", i) for i in range(5)]


def test_glyphs():
    reader = fu.GlyphReader({"minister": 900, "come": 400, "the": 5000, "question": 300, "canne": 50, "came": 200, "ministcr": 3, "between": 90})
    assert reader.scan("The Ministcr will (ome befween them") == ("The Minister will come between them", True)
    assert reader.scan("la canne, 22nd of H5 and 3:30 (see) B/1182") == ("la canne, 22nd of H5 and 3:30 (see) B/1182", False)
    assert reader.scan("") == ("", False)


def test_scan_operator(spark):
    rows = [("d", i, "the minister came to the house again") for i in range(30)]
    rows += [("d", 100, "the rninister came to the h0use"), ("d", 100, "the rninister came to the h0use"), ("d", 101, "the min- ister"), ("d", 102, None), ("d", 103, ""), ("d", 104, "[Page 9]"), ("d", 105, "the house " * 20_000)]
    df = spark.createDataFrame(rows, "debate_id string, seq_index int, text string").selectExpr("*", "'x' AS noise")
    got = sorted(tuple(r) for r in scans.page_noise(df, ["debate_id", "seq_index"], "text").collect())
    assert got == [("d", 100, "glyph"), ("d", 101, "hyphen"), ("d", 104, "header")]
    texts = {r.seq_index: r.text for r in scans.paragraphs(df.where("seq_index between 100 and 104"), ["debate_id", "seq_index"], "text").collect()}
    assert texts[101] == "the minister" and 102 not in texts and 104 not in texts
    assert scans.page_noise(df.limit(0), ["debate_id", "seq_index"], "text").count() == 0


def test_missing_labels_by_language_and_order():
    a, b = "budget deficit and taxes rise", "hospital beds and nurses wait"
    labels = ["A", "B", "A", "B", None, "B", "A", None, "A"]
    texts = [a, b, a, b, a, b, a, b, a]
    found, sure = turns.infer_labels(labels, texts)
    assert found == ["A", "B", "A", "B", "A", "B", "A", "B", "A"] and sure[0] == 1.0 and 0.5 < sure[4] < 1
    assert turns.infer_labels([None, None], [a, b]) == ([None, None], [0.0, 0.0])


def test_turns_operator(spark):
    rows = [("d", i, "Mr X" if i % 2 else "Ms Y", f"words number {i} here.", False) for i in range(900)]
    rows += [("d", 900 + i, "Mr X", f"long turn {i}.", False) for i in range(500)]
    rows += [("e", 0, "Mr X", "one.", False), ("e", 1, "Mr X", "two. – Ms Y: three.", False), ("e", 2, "Ms Y", "four.", False), ("e", 3, None, "(Laughter)", True), ("e", 4, "Ms Y", "five.", False), ("e", 5, "Ms Y", None, False), (None, 1, "Z", "lost", False)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "debate_id string, seq_index long, speaker_raw string, text string, is_stage_direction boolean")
    got = turns.clean_turns(df).orderBy("debate_id", "turn_seq", "turn_sub", "part").collect()
    e = [(r.speaker, r.text, r.is_stage_direction) for r in got if r.debate_id == "e"]
    assert e == [("Mr X", "one. two.", False), ("Ms Y", "three. four.", False), (None, "(Laughter)", True), ("Ms Y", "five.", False)]
    d = [r for r in got if r.debate_id == "d"]
    assert len([r for r in d if r.first_seq < 899]) == 899
    long = [r for r in d if r.turn_seq == 899]
    assert [r.part for r in long] == [0] and (long[0].first_seq, long[0].last_seq) == (899, 1399) and long[0].text.count("long turn") == 500
    assert turns.clean_turns(df.limit(0)).count() == 0


def _brute_turns(rows):
    """Sequential reading of one debate: labels over the whole debate at once, then merging."""
    read = []
    for seq, s, t, f in rows:
        r = an.read_row(s, t, f)
        read += [(seq, 0, r.stage, an.strip_label(s)[0], r.text), *((seq, i + 1, False, an.strip_label(a)[0], b) for i, (a, b) in enumerate(zip(r.labels, r.texts)))]
    read = [r for r in read if r[4] != ""]
    speech = [r for r in read if not r[2]]
    names, sure = turns.infer_labels([r[3] for r in speech], [r[4] for r in speech])
    told = {r[:2]: n for r, n in zip(speech, names)}
    out = []
    for seq, sub, stage, _, text in read:
        who = None if stage else told[seq, sub]
        if out and not stage and not out[-1][3] and who is not None and who == out[-1][2]:
            out[-1][4] += " " + text
        else:
            out.append([seq, sub, who, stage, text])
    return [tuple(x) for x in out], {r[:2]: p for r, p in zip(speech, sure)}


def test_turns_of_a_debate_are_those_of_one_reading(spark, monkeypatch):
    rng = random.Random(5)
    words = {w: [w + x for x in "abcdefgh"] for w in "kmprt"}
    rows, who = [], "k"
    for seq in range(160):
        who = rng.choice("kmprt") if rng.random() < 0.6 else who
        label = None if rng.random() < 0.35 or 60 <= seq < 95 else f"Mr {who.upper()}a"
        rows.append((seq, label, " ".join(rng.choice(words[who]) for _ in range(6)) + ".", False))
    want, sure = _brute_turns(rows)
    df = spark.createDataFrame([("d", *r) for r in rows], "debate_id string, seq_index long, speaker_raw string, text string, is_stage_direction boolean")
    for chunk in (400, 16):
        monkeypatch.setattr(turns, "CHUNK", chunk)
        got = turns.clean_turns(df).orderBy("turn_seq", "turn_sub").collect()
        assert [(r.turn_seq, r.turn_sub, r.speaker, r.is_stage_direction, r.text) for r in got] == want
        shares = {(r._seq, r._sub): r._confidence for r in turns.speaker_turns(df).collect()}
        assert shares == pytest.approx(sure)


def test_posterior_by_enumeration():
    labels, texts = ["A", "B", "A", None, None, "B", None], ["aa bb", "cc dd", "aa bb", "cc aa", "bb dd", "cc dd", "aa dd"]
    model = turns.learn(labels, texts)
    moves = dict(zip(zip(*(x.tolist() for x in model.moves[:2])), model.moves[2].tolist()))
    total = {i: turns.UNSEEN * 2 + sum(n for (a, _), n in moves.items() if a == i) for i in (0, 1)}
    emit = [[0, 0] if x is not None else [turns.profile_lead(t, n, model) for n in model.names] for x, t in zip(labels, texts)]
    paths = {}
    for path in itertools.product((0, 1), repeat=len(labels)):
        if all(x is None or model.names[k] == x for x, k in zip(labels, path)):
            paths[path] = math.log(model.known[path[0]] / sum(model.known)) + sum(math.log((turns.UNSEEN + moves.get((a, b), 0)) / total[a]) for a, b in zip(path, path[1:])) + sum(e[k] for e, k in zip(emit, path))
    found, sure = turns.infer_labels(labels, texts)
    best = max(paths, key=paths.get)
    assert found == [model.names[k] for k in best]
    whole = sum(math.exp(v) for v in paths.values())
    for t in range(len(labels)):
        assert sure[t] == pytest.approx(sum(math.exp(v) for p, v in paths.items() if p[t] == best[t]) / whole)


def test_a_quotation_is_no_turn(spark):
    spoken = {"Mr Oak": "taxes budget deficit revenue treasury", **{f"Ms {c.upper()}ir": " ".join(c + w for w in ("ospital", "urses", "ards", "octors", "linics")) for c in "bcdfghjkl"}}
    rows = [("d", i, name, spoken[name] + ".", False) for i in range(300) for name in [list(spoken)[i % 10]]]
    rows += [("d", 300, "Mr Oak", "I say this. – Mr Elm: " + " ".join([spoken["Mr Oak"]] * 6) + ".", False), ("d", 301, "Ms Fir", "no. – Mr Yew: never heard anywhere before.", False)]
    df = spark.createDataFrame(rows, "debate_id string, seq_index long, speaker_raw string, text string, is_stage_direction boolean")
    got = {(r.seq_index, r.noise) for r in turns.transcript_noise(df, ["debate_id", "seq_index"], "speaker_raw", "text", "is_stage_direction").collect()}
    assert got == {(301, "inline")}


def test_large_vocabularies_give_the_same_repairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/utterances.parquet").select("debate_id", "seq_index", "text").distinct()
    whole = {tuple(r) for r in scans.repair_scans(df, "text").select("debate_id", "seq_index", "_repair.text").collect()}
    joined = {tuple(r) for r in scans.repair_scans(df, "text", rows=3).select("debate_id", "seq_index", "_repair.text").collect()}
    assert whole == joined


def test_a_repeated_table_gives_the_same_repairs(spark):
    texts = ["It is eleven now."] * 32 + ["It is eleveri now."] * 4 + ["The abattoir is shut."] * 3 + ["The abatto!r is shut.", "The aba- tto!r is shut."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    damaged = {i for i, t in enumerate(texts) if "eleveri" in t or "!" in t}
    for times in (1, 10):
        rows = df.crossJoin(spark.range(times).withColumnRenamed("id", "copy"))
        for most in (scans.BROADCAST_ROWS, 0):
            found = scans.repair_scans(rows, "text", rows=most).where("array_contains(_repair.noises, 'glyph')")
            assert {(r.id, r.copy) for r in found.collect()} == {(i, k) for i in damaged for k in range(times)}


def test_every_label_is_a_participant():
    names = [f"S{i:03}" for i in range(130)]
    labels = [x for x in names for _ in range(2)] + ["Rare", "S000", None, "S001"]
    texts = [f"about {x.lower().translate(str.maketrans('0123456789', 'abcdefghij'))} matters" for x in names for _ in range(2)] + ["zebra crossing lights flicker " * 12, "about saaa matters", "zebra crossing lights flicker " * 12, "about saab matters"]
    found, _ = turns.infer_labels(labels, texts)
    assert found[-2] == "Rare"


def test_best_path_is_that_of_all_paths():
    rng = random.Random(4)
    for _ in range(30):
        labels = [rng.choice(["A", "B", "C", None]) for _ in range(8)]
        texts = [" ".join(rng.choices(["budget", "nurses", "roads", "schools"], k=3)) for _ in labels]
        if not any(labels):
            continue
        found, _ = turns.infer_labels(labels, texts)
        known = Counter(x for x in labels if x)
        steps = Counter(zip(labels, labels[1:]))
        size, total = 3 * len(labels) + 1, Counter(w for t in texts for w in t.split())
        profile = {x: Counter(w for a, t in zip(labels, texts) if a == x for w in t.split()) for x in known}

        def weight(path):
            score = math.log(known[path[0]] / sum(known.values()))
            for a, b in zip(path, path[1:]):
                score += math.log((steps[a, b] + 0.1) / (sum(steps[a, x] for x in known) + 0.1 * len(known)))
            for x, a, t in zip(path, labels, texts):
                if a is None:
                    p = [(profile[x][w] + 50 * total[w] / size) / (profile[x].total() + 50) / (total[w] / size) for w in t.split()]
                    score += sum(map(math.log, p)) / 2
            return score

        paths = itertools.product(*([a] if a else list(known) for a in labels))
        assert weight(found) == pytest.approx(max(map(weight, paths)))


def test_participants_of_other_chunks_are_chosen(spark):
    rows = [("d", i, ["Mr X", "Ms Y"][i % 2], "roads and bridges", False) for i in range(1300)]
    rows[1] = ("d", 1, "Dr Z", "zebra crossing lights flicker " * 12, False)
    rows[900] = ("d", 900, None, "zebra crossing lights flicker " * 12, False)
    rows += [("e", 0, None, "nobody is named here", False), ("f", 0, "Mr X", "one", False), ("f", 1, None, "", False)]
    schema = "debate_id string, seq_index long, speaker_raw string, text string, is_stage_direction boolean"
    got = {(r.debate_id, r.turn_seq): r.speaker for r in turns.clean_turns(spark.createDataFrame(rows, schema)).collect()}
    assert got["d", 900] == "Dr Z" and got["e", 0] is None and got["f", 0] == "Mr X"


def test_models_of_debates_are_those_of_all_turns(spark):
    rng = random.Random(6)
    rows = [("d", i, 0, rng.random() < 0.1, rng.choice(["A", "B", "C", "D", None]), " ".join(rng.choices(["budget", "nurses", "roads", "schools"], k=3))) for i in range(1000)]
    df = spark.createDataFrame(rows, "_debate string, _seq long, _sub int, _stage boolean, _label string, _text string")
    home = (df["_seq"] / turns.CHUNK).cast("long")
    known = turns.debate_models(df, df.withColumn("_home", home).withColumn("_chunk", home)).toPandas()
    want = turns.learn([r[4] for r in rows if not r[3]], [r[5] for r in rows if not r[3]])
    for chunk in range(3):
        got = turns._chunk_model(known[known["_chunk"] == chunk])
        assert got.names == want.names and list(got.known) == list(want.known) and list(got.mass) == list(want.mass) and got.size == want.size
        assert {tuple(map(int, x)) for x in zip(*got.moves)} == {tuple(map(int, x)) for x in zip(*want.moves)}
        assert {w: (n, dict(zip(i, k))) for w, (n, i, k) in got.words.items()} == {w: (n, dict(zip(i, k))) for w, (n, i, k) in want.words.items()}


def test_debates_of_one_task_shuffle_no_word_counts(spark, monkeypatch):
    rng = random.Random(8)
    rows, words = [], {w: [w + x for x in "abcdefgh"] for w in "kmp"}
    for d, n in (("a", 90), ("b", 20), ("c", 45), ("z", 3)):
        for seq in range(n):
            who = rng.choice("kmp")
            text = " ".join(rng.choices(words[who], k=20)) + "."
            text += rng.choice(["", "", "\nMr Zed: " + " ".join(rng.choices(words[who], k=150)) + "."])
            rows.append((d, seq, None if d == "z" or rng.random() < 0.4 else f"Mr {who.upper()}a", text, False))
    df = spark.createDataFrame(rows, "debate_id string, seq_index long, speaker_raw string, text string, is_stage_direction boolean")
    keys = ["debate_id", "seq_index"]

    def results():
        told = sorted(map(tuple, turns.speaker_turns(df).select("_debate", "_seq", "_sub", "_speaker", "_given", "_confidence", "_quoted").collect()))
        return told, sorted(map(tuple, turns.transcript_noise(df, keys, "speaker_raw", "text", "is_stage_direction").collect()))

    monkeypatch.setattr(turns, "CHUNK", 16)
    counted = turns.debate_models
    with monkeypatch.context() as m:
        m.setattr(turns, "debate_models", None)
        whole = results()
    assert any(r[6] for r in whole[0]) and any(r[5] < 1 for r in whole[0])
    asked = []
    monkeypatch.setattr(turns, "debate_models", lambda *a: asked.append(1) or counted(*a))
    monkeypatch.setattr(turns, "WHOLE", 30)  # a and c go by chunks
    mixed = results()
    assert asked and [r[:5] + r[6:] for r in mixed[0]] == [r[:5] + r[6:] for r in whole[0]] and mixed[1] == whole[1]
    assert [r[5] for r in mixed[0]] == pytest.approx([r[5] for r in whole[0]])


def test_packed_checkpoint_keeps_rows_in_less_space(spark):
    words = [f"{a}{b}" for a in ("budget", "nurse", "road", "school", "cane", "port") for b in ("", "s", "less", "ward")]
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(words, k=40)), [str(i), "x"], None if i % 3 else True) for i in range(3000)]
    df = spark.createDataFrame(rows, "n long, t string, l array<string>, f boolean")

    def kept(write):
        got = write(df)
        return got, sum(p.stat().st_size for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*"))

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hemispark-"))
    plain, size = kept(checkpoint)
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hemispark-"))
    packed, packed_size = kept(packed_checkpoint)
    assert 0 < packed_size < size * 0.6
    assert sorted(map(tuple, packed.collect())) == rows == sorted(map(tuple, plain.collect()))
    assert packed.schema == df.schema and packed_checkpoint(df.limit(0)).count() == 0
