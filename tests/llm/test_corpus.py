import random

import numpy as np
import pytest

from hemispark.llm import leakage as le
from hemispark.llm import mixing as mi
from hemispark.llm import subjects as su
from hemispark.llm import toxicity as to
from hemispark.llm.furniture import MappedReader

WORDS = ["harp", "salt", "clock", "ferry", "mint", "judge", "cooper", "lamp", "wager", "frost", "quarrel", "notary", "widow", "porter", "ledger", "thimble", "barrel", "comb", "chart", "surveyor"]


def brute(doc, item):
    d, w = le.words_of(doc), le.words_of(item)
    for i in range(len(w) - le.RUN + 1):
        for j in range(len(d) - le.RUN + 1):
            if d[j : j + le.RUN] == w[i : i + le.RUN]:
                return True
    return any(sum(x != y for x, y in zip(d[j : j + len(w)], w)) <= len(w) // le.EDIT for j in range(len(d) - len(w) + 1)) if w else False


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(24, 60)))) for i in range(30)]
    docs = []
    for k in range(150):
        noise = [rng.choice([*WORDS, "x1", "x2", "zz"]) for _ in range(rng.randrange(0, 60))]
        if k % 3:
            w = rng.choice(items)[1].split()
            if k % 3 == 1:
                a = rng.randrange(0, len(w) - 15)
                piece = w[a : a + rng.choice([15, 19, 20, 21, 30])]
            else:
                piece = list(w)
                for p in rng.sample(range(len(w)), rng.choice([1, len(w) // 8, len(w) // 8 + 1])):
                    piece[p] = "zz"
            noise[5:5] = piece
        docs.append((k, "  ".join(noise).upper().replace("  ", ",\n" if k % 2 else " ")))
    docs += [(200, None), (201, ""), (3, docs[3][1])]
    rows = le.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    text, item = {k: le.words_of(t) for k, t in docs}, {k: le.words_of(t) for k, t in items}
    for r in rows:
        d, w = text[r.doc_id], item[r.item_id]
        runs = [(next((n for n in range(min(len(d) - a, len(w) - b)) if d[a + n] != w[b + n]), min(len(d) - a, len(w) - b)), -a) for a in range(len(d)) for b in range(len(w))]
        assert (r.words, -r.at) == max(runs)
    want = {(k, i) for k, t in docs if t for i, x in items if brute(t, x)}
    assert want and got == want
    few = le.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=7)
    assert {(r.doc_id, r.item_id) for r in few.collect()} == want


def test_leak_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert le.leaked_items(docs, items).count() == 0 and le.leaked_items(docs.limit(0), items).count() == 0 and le.leaked_items(docs, items.limit(0)).count() == 0
    assert le.without_leaks(docs, spark.createDataFrame([(1, 5)], "doc_id long, item_id long")).count() == 1
    long = " ".join(WORDS) * 3000
    shard = le.Shard([le.words_of(long)], le.Items([(1, " ".join(WORDS + WORDS))]))
    assert len(shard.found(le.Items([(1, " ".join(WORDS + WORDS))]))) in (0, 1)


def test_copies_of_items_leak_like_one_and_blocks_share_set_phrases(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    copied, phrase = text(60), text(24)
    items = [(i, copied) for i in range(5)] + [(10 + i, f"{text(20)} {phrase} {text(20)}") for i in range(6)]
    docs = spark.createDataFrame([(1, "so " + " ".join(copied.split()[10:40])), (2, "so " + phrase)], "doc_id long, text string")
    for block in (le.BLOCK, 2):
        got = le.leaked_items(docs, spark.createDataFrame(items, "item_id long, text string"), block=block)
        assert {(r.doc_id, r.item_id, r.words, r.at) for r in got.collect()} == {(1, i, 30, 1) for i in range(5)}


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 400).astype(np.int32)
    starts = np.flatnonzero(text)
    array = le.suffix_array(text, starts)

    def suffix(i):
        s = list(text[i : i + le.DEPTH])
        return tuple(s[: s.index(0)] if 0 in s else s)

    keys = [suffix(i) for i in array]
    assert keys == sorted(keys) and sorted(array) == sorted(starts)


def test_water_filling():
    sizes, targets = {"a": 100, "b": 100, "c": 10, "none": 5}, {"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 2), "gone": (0.1, 4)}
    given = mi.water_fill(sizes, targets, 200)
    assert given == pytest.approx({"a": 100, "b": 80, "c": 20}) and sum(given.values()) == pytest.approx(200)
    assert mi.water_fill(sizes, targets, 10_000) == {"a": 100, "b": 300, "c": 20}
    assert mi.water_fill({}, targets) == {} and mi.reachable_total({}, targets) == 0
    total = mi.reachable_total(sizes, targets)
    assert mi.water_fill(sizes, targets, total) == pytest.approx({"a": 50, "b": 30, "c": 20}) and total == pytest.approx(100)


def test_mix(spark):
    rows = [(i, "a" if i % 3 else "b", 50 + i % 7) for i in range(6000)] + [(9000, None, 5), (9001, "other", 5)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("b", 0.5, 2), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mi.mix_sources(sized, targets, "reachable")
    share = {r.source: r.actual_share for r in mi.mix_shares(mixed, targets).collect()}
    assert share["a"] == pytest.approx(0.5, abs=0.002) and share["b"] == pytest.approx(0.5, abs=0.002) and share["gone"] == 0
    assert {r.doc_id: r.repeats for r in mixed.collect()} == {r.doc_id: r.repeats for r in mi.mix_sources(sized.repartition(5), targets, "reachable").collect()}
    assert mixed.selectExpr("max(repeats) FILTER (WHERE source = 'a') AS a", "max(repeats) FILTER (WHERE source = 'b') AS b").first().asDict() == {"a": 1, "b": 2}
    assert mi.mix_sources(sized.limit(0), targets).count() == 0 and mi.mix_sources(sized, targets.limit(0)).count() == 0


def test_clamped_mix(spark):
    rows = [(i, "small", 10) for i in range(50)] + [(1000 + i, "large", 10) for i in range(4000)] + [(9000 + i, "third", 10) for i in range(1000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("small", 0.5, 3), ("large", 0.3, 4), ("third", 0.2, 4)], "source string, target_share double, max_repeats int")
    mixed = mi.mix_sources(sized, targets)
    total = 10 * len(rows)
    want = mi.water_fill({"small": 500, "large": 40_000, "third": 10_000}, {"small": (0.5, 3), "large": (0.3, 4), "third": (0.2, 4)})
    assert want["small"] == 1500 and sum(want.values()) == pytest.approx(total) and want["large"] / want["third"] == pytest.approx(1.5)
    got = {r.source: (r.tokens, r.most_repeats) for r in mi.mix_shares(mixed, targets).collect()}
    assert got["small"] == (1500, 3) and all(got[s][0] == pytest.approx(want[s], rel=0.01) for s in want) and all(m <= 4 for _, m in got.values())


def test_tokens_are_counted(spark):
    df = spark.createDataFrame([(1, "hello world, 12 mètres", "s"), (2, None, "s"), (3, "", "s"), (4, "x", None)], "doc_id long, text string, source string")
    got = {r.doc_id: r.tokens for r in mi.counted(df).collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3] == 0 and 5 <= got[1] <= 9


SUBJECT_CASES = [
    ("A sum of 5 million was set aside for school buses for pupils.", {"education"}), ("Tenders for the emergency ward closed in 2015.", {"health"}), ("This is a healthy exchange; the ball is now in their court.", set()),
    ("We cannot speak of progress while potholes and the parole board are left to chance.", {"transport", "law"}), ("La parole est maintenant à l'opposition.", set()), ("Je demande une enquête sur les salles d'hôpital.", {"health"}),
    ("Bann dimounn pe plengne toule zour lor lanbouteyaz.", {"transport"}), ("Affidavits before the tribunal should wait. Sports scholarships for runners came later.", {"law", "sport"}), ("", set()), (None, set()),
]


@pytest.mark.parametrize("text,want", SUBJECT_CASES)
def test_subjects_of_sentences(text, want):
    got = {s for h, n in su.sentence_hits(text) for s, v in su.scores(h, n, {}).items() if v >= su.THRESHOLD}
    assert got == want


#: Sentences written for this test, not from the tables: what the curated terms alone make of them.
OTHER_TEXTS = [
    ("Two thousand babies were vaccinated against measles at the clinic near the river mouth.", "health"), ("Les infirmieres de garde ont soigné quarante malades cette nuit.", "health"), ("Bann dokter lopital pe dimann plis medikaman.", "health"),
    ("Trainee teachers will mark the examination papers of every pupil twice.", "education"), ("Les lycées manquent de professeurs depuis la rentrée.", "education"), ("Bann zelev pe pas zot legzame dan kolez.", "education"),
    ("Value-added tax and excise made up half of what the treasury took in.", "finance"), ("La dette publique et le taux de change inquiètent.", "finance"), ("Rain spoiled the tomato harvest on eleven farms.", "agriculture"), ("Les planteurs attendent les engrais pour la canne.", "agriculture"),
    ("Motorists queue for an hour at the roundabout before the motorway.", "transport"), ("Lotobis pa finn pase, bann bis an retar lor larout.", "transport"), ("The magistrate refused bail and the barrister appealed.", "law"), ("Avoka ti koz divan mazistra dan lakour.", "law"),
    ("Dumping of plastic waste kills corals and turtles.", "environment"), ("Les déchets polluent la mangrove.", "environment"), ("Solar panels and wind farms feed the power grid at noon.", "energy"), ("Kouran koupe dan tou lakanpagn.", "energy"),
    ("The goalkeeper of the national team saved two penalties in the stadium.", "sport"), ("Le championnat de natation aura lieu à la piscine.", "sport"), ("Geologists drilled isotopes out of lava for a doctoral thesis.", "science"), ("The database server went down and no password worked.", "software"),
    ("Le logiciel et les serveurs du ministère sont en panne.", "software"), ("Tenants face eviction when rents double.", "housing"), ("Les locataires réclament des logements sociaux.", "housing"), ("I beg leave to lay the annual statement on the table.", None), ("Nous reprendrons nos travaux mardi matin.", None), ("Mo remersie tou bann kolegg.", None),
]


def test_curated_terms_on_other_texts():
    right = 0
    for text, want in OTHER_TEXTS:
        top = {}
        for h, n in su.sentence_hits(text):
            for s, v in su.scores(h, n, {}).items():
                top[s] = max(top.get(s, 0), v)
        right += {s for s, v in top.items() if v >= su.THRESHOLD} == ({want} if want else set())
    assert right >= 0.9 * len(OTHER_TEXTS)


def test_phrases_are_learned_from_labels():
    rows = [(f"the zorble of place {c} ran dry again. it was noted.", "health") for c in "abcdefghijklmnopqrst"] + [(f"a level court of opinion met {c}. it was noted.", "non_policy") for c in "abcdefghijklmnopqrst"]
    rows += [(f"we {a} the {b} plan and went on. it was noted.", label) for a in "saw heard read left".split() for b in "first second third next last".split() for label in ("law", "sport", "finance")]
    learned = su.learn_terms(rows)
    assert any(s == "health" and "zorble" in t for t, s, _ in learned) and any(s is None and "court" in t for t, s, _ in learned)
    assert not any("noted" in t for t, _, _ in learned) and su.learn_terms([]) == []
    machine = su.Automaton(learned)
    assert set(su.scores(*machine.hits("now the zorble is gone"), {}, machine)) == {"health"} and not su.scores(*machine.hits("a level court of opinion"), {}, machine)


def test_subject_operator(spark):
    rows = [("d", i, t) for i, (t, _) in enumerate(SUBJECT_CASES)] + [("d", 0, SUBJECT_CASES[0][0])]
    df = spark.createDataFrame(rows, "debate_id string, seq_index int, text string").selectExpr("*", "'x' AS subject")
    labels = spark.createDataFrame([("d", 0, "education"), ("d", 1, "health"), ("d", 2, "non_policy"), ("d", 3, None)], "debate_id string, seq_index int, predicted_label string")
    for lab in (None, labels, labels.limit(0)):
        found = su.subject_areas(df, ["debate_id", "seq_index"], "text", lab)
        assert {(r.seq_index, r.subject) for r in found.collect()} == {(i, s) for i, (_, want) in enumerate(SUBJECT_CASES) for s in want}
    shares = su.subject_shares(found, ["debate_id", "seq_index"]).collect()
    assert sum(r.share for r in shares) == pytest.approx(1)
    assert su.subject_areas(df.limit(0), ["debate_id", "seq_index"], "text").count() == 0


def test_subjects_learn_from_all_labelled_rows(spark):
    rng = random.Random(12)
    names = ["alpha", "bravo", "carol", "delta", "echos", "fungi", "gamma", "hotel"]
    rows = [(f"the zorble of {rng.choice(names)} ran dry {i}. it was noted.", "health") for i in range(60)] + [(f"a level court of opinion met {rng.choice(names)}. it was noted.", "non_policy") for i in range(60)]
    rows += [(f"we {rng.choice(names)} saw the {rng.choice(names)} plan. it was noted.", rng.choice(["law", "sport", "finance"])) for _ in range(200)]
    df = spark.createDataFrame([(t, None, x) for t, x in rows], "_clean string, _fixes array<string>, _label string").repartition(5)
    none = spark.sparkContext.broadcast(MappedReader({}))
    assert su.learned_terms(df, none) == su.learn_terms(rows) != []
    # a phrase of few among many rows with its label, which a sample of 1,000 rows a label mostly misses
    common = [("d", i, f"we went on with item {i}.", "non_policy") for i in range(9000)] + [("d", 20_000 + i, f"nurses met {names[i % 8]}.", "health") for i in range(6000)]
    rare = [("d", 10_000 + i, f"the zorble of place {names[i % 8]} ran dry.", "health") for i in range(32)]
    texts = spark.createDataFrame(common + rare, "debate_id string, seq_index long, text string, predicted_label string")
    found = su.subject_areas(texts.drop("predicted_label"), ["debate_id", "seq_index"], "text", texts.drop("text"))
    assert {(r.seq_index, r.subject) for r in found.where("seq_index between 10000 and 10031").collect()} == {(10_000 + i, "health") for i in range(32)}


def test_thresholds_of_all_labelled_rows(spark):
    rng = random.Random(13)
    machine = su.automaton()
    pool = [su.sentence_hits(t) for t, _ in OTHER_TEXTS] + [su.sentence_hits("The bill and the ball, the school and the road; the budget, nurses and a judge met the fishermen on this point of order once more today.")]
    rows = [(i, rng.choice(pool) + rng.choice(pool), rng.choice(su.LABELS)) for i in range(400)]
    df = spark.createDataFrame([("d", i, h, x) for i, h, x in rows + rows[:50]] + [("d", 900, pool[0], None)], "d string, i long, _hits array<struct<terms:array<int>,words:int>>, _label string")
    assert su.calibrated(df, ["d", "i"], {}, su._sent(df, machine)) == su.calibrate([(h, x) for _, h, x in rows], {}, machine)


INSULTS = ["You are a pathetic {} and everyone knows it!", "Shut your filthy mouth, you {}!", "Someone ought to strangle that {} with his own tie."]
PLAIN = ["The committee found {} errors in the accounts.", "There were {} complaints concerning the road.", "I table a petition of {} signatures.", "Rats and cockroaches were found in the kitchen of depot {}.", "Let us proceed with item {} on the paper.", "We met the delegation on day {} and agreed to talk."]


def labelled():
    rng = random.Random(3)
    rows = []
    for i in range(160):
        parts = [p.format(rng.randrange(99)) for p in rng.sample(PLAIN, 4)]
        if i % 5 == 0:
            parts.insert(2, rng.choice(INSULTS).format(rng.choice(["idiot", "moron", "bastard", "cretin"])))
        rows.append((i, " ".join(parts), int(i % 5 == 0)))
    return rows


def test_blocks_are_skipped_without_loss(monkeypatch):
    rng = random.Random(8)
    examples = [(to.features([f"w{rng.randrange(40)}" for _ in range(4)]), float(i % 7 == 0)) for i in range(600)]
    monkeypatch.setattr(to, "BLOCK", 4)
    monkeypatch.setattr(to, "DENSE", 1)
    skipping = to.BlockIndex(examples)
    monkeypatch.setattr(to, "DENSE", 10**9)
    reading = to.BlockIndex(examples)
    for _ in range(20):
        query = reading.query(to.features([f"w{rng.randrange(40)}" for _ in range(5)]))
        monkeypatch.setattr(to, "DENSE", 10**9)
        want = reading.nearest(*query)
        monkeypatch.setattr(to, "DENSE", 1)
        got = skipping.nearest(*query)
        assert [i for i, _ in got] == [i for i, _ in want] and [d for _, d in got] == pytest.approx([d for _, d in want])
    assert 0 < skipping.postings_read < 0.8 * reading.postings_read


def test_isotonic():
    assert to.isotonic([]) == []
    assert to.isotonic([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.4, 1)]) == [(0.1, 0.0), (0.2, 0.5), (0.4, 1.0)]


def test_abuse_scores(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None) for i, t, _ in rows] + [(500, None, "s"), (501, "", "s"), (502, "Fine words. SHUT YOUR FILTHY MOUTH, YOU M O R O N!", "s"), (503, PLAIN[3].format(3), "s"), (504, "plain words " * 50_000, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, t, None) for i, _, t in rows] + [(0, 1, 3), (1, None, 1), (1, 0, 2)], "doc_id long, toxic int, quality int")
    model = to.fit_examples(docs, labels)
    scored = to.abuse_scores(docs, model)
    got = {r.doc_id: r.abuse.vote >= model.threshold for r in scored.collect()}
    assert {i for i, _, t in rows if t} == {i for i, hit in got.items() if hit and i < 500}
    assert (got[500], got[501], got[502], got[503], got[504]) == (False, False, True, False, False)
    rates = {r.source: (r.documents, r.abusive) for r in to.abuse_rates(scored, model.threshold).collect()}
    assert sum(n for n, _ in rates.values()) == docs.count() and set(rates) == {"s", None}
    empty = to.fit_examples(docs, labels.limit(0))
    assert empty.score(INSULTS[0])[0] == 0.0


def test_nearest_is_exact():
    passages = [to.features(to.tokens(p)) for _, t, _ in labelled() for p in to.passages(t)]
    index = to.BlockIndex([(p, float("mouth" in p)) for p in passages])
    vectors = []
    for i in index.order:
        v = {f: n * index.idf[f] for f, n in passages[i].items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        vectors.append({f: x / norm for f, x in v.items()})
    for text in ("You are a filthy liar and you know it!", "There were 3 complaints concerning the ferry.", "unknown words only", "mouth"):
        counts = to.features(to.tokens(text))
        vector, norm = index.query(counts)
        q = {f: x / norm for f, x in vector}
        cos = sorted(((-sum(x * v.get(f, 0) for f, x in q.items()), k) for k, v in enumerate(vectors)))
        want = [(k, -c) for c, k in cos if -c >= to.FLOOR][: to.NEAREST]
        got = index.nearest(vector, norm)
        assert [round(c, 5) for _, c in got] == [round(c, 5) for _, c in want]
        near = any(-c >= to.FLOOR and index.labels[k] >= 0.5 for c, k in cos)
        assert index.near_abusive(vector, norm) == near and not (index.far(to.tokens(text)) and near)


@pytest.mark.parametrize("seen,plain", [("F1LTHY", "filthy"), ("c.r.é.t.i.n", "cretin"), ("i d i o t", "idiot"), ("moooron", "moron"), ("Idiot", "idiot")])
def test_disguises(seen, plain):
    assert plain in to.tokens(f"you {seen} there")
