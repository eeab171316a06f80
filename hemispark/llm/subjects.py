"""Subject areas of texts by a multi-pattern automaton over curated weighted terms.

Each sentence is read by one automaton; of overlapping terms the longest counts. A term's weight is multiplied by
its rarity over all sentences of the corpus, the sum divided by a length factor; a sentence is about every subject
whose score reaches the subject's threshold, calibrated on all labelled rows. A text has the subjects of its sentences.

The curated terms are general vocabulary (:mod:`hemispark.llm.subject_terms`). From all labelled rows further
phrases of the corpus are learned: those that stand with one subject, and those in which a curated term does not mean its subject
(:func:`learn_terms`). Both count in Spark; only learned terms and counts by subject and score come to the driver.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemispark.llm.furniture import MappedReader
from hemispark.llm.language import clean_for_reading, sentences
from hemispark.llm.scans import find_repairs, reader_of, with_own_repairs, word_counts
from hemispark.llm.subject_terms import NO_SUBJECT, TERMS
from hemispark.session import broadcast_if_small, checkpoint, packed_checkpoint

SUBJECTS = tuple(sorted(TERMS))
#: Labels of rows that say something of subjects.
LABELS = (*SUBJECTS, "non_policy")
#: Phrases that a task counts before it gives the counts on.
HELD = 300_000
#: A phrase is learned with at least this log-likelihood ratio, share of its rows and lead over the next subject; it weighs so much.
EVIDENCE, SHARE, LEAD, LEARNED = 30.0, 0.5, 4.0, 2.5
#: A phrase is none of its curated term's subject if it stands in so many rows and at most this share of them has the subject's label.
UNLIKE_ROWS, UNLIKE = 12, 0.2
#: A word that stands beside one other word in so many of its rows is learned with it only.
BOUND = 0.5
#: A learned phrase has a word of four letters or more that stands in at most this share of the rows, or mostly with one label.
COMMON = 0.03
#: Longest learned phrase in words.
LONGEST = 4
#: Threshold where no labelled rows are given, and those that calibration tries.
THRESHOLD = 1.5
GRID = [x / 10 for x in range(8, 41)]
_WORD = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def fold(text: str) -> str:
    """Lower case without accents; length may change."""
    low = text.lower().replace("’", "'")
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


class Automaton:
    """Finds subject terms. ``learned``: (term, subject or None, weight) beside the curated ones; a curated term keeps its subject."""

    def __init__(self, learned: Iterable[tuple[str, str | None, float]] = ()):
        self.machine = ahocorasick.Automaton()
        self.terms: list[tuple[str, str | None, float, bool | None]] = []
        chosen: dict[str, tuple[str | None, float, bool | None]] = {}
        for subject, by_weight in TERMS.items():
            for weight, listed in by_weight.items():
                for term in listed.split(";"):
                    self._add(chosen, term, subject, float(weight))
        for term in NO_SUBJECT.split(";"):
            self._add(chosen, term, None, 0.0)
        for term, subject, weight in learned:
            if term not in chosen:
                chosen[term] = (subject, weight, None)  # as it stands
        for key, (subject, weight, prefix) in sorted(chosen.items()):
            self.machine.add_word(" " + key, len(self.terms))
            self.terms.append((key, subject, weight, prefix))
        self.machine.make_automaton()

    @staticmethod
    def _add(chosen: dict, term: str, subject: str | None, weight: float) -> None:
        term = term.strip()
        prefix = term.endswith("*")
        term = " ".join(_WORD.findall(fold(term)))
        if not term:
            return
        if term in chosen and chosen[term][0] != subject:
            raise ValueError(f"{term!r} is a term of {chosen[term][0]} and {subject}")
        if term not in chosen or chosen[term][1] < weight or prefix and not chosen[term][2]:
            chosen[term] = (subject, max(weight, chosen.get(term, (0, 0.0))[1]), prefix or chosen.get(term, (0, 0, False))[2])

    def hits(self, sentence: str) -> tuple[list[int], int]:
        """Numbers of the terms in a sentence, longest first among overlapping ones, and its number of words."""
        words = _WORD.findall(fold(sentence))
        flat = " " + " ".join(words) + " "
        found = []
        for end, number in self.machine.iter(flat):
            key, _, _, prefix = self.terms[number]
            stop = end + 1
            if flat[stop] != " ":
                if prefix is None or not prefix and flat[stop : stop + 2] not in ("s ", "'s"):
                    continue
                stop = flat.index(" ", stop)
            found.append((end + 1 - len(key), stop, number))
        found.sort(key=lambda x: (x[0] - x[1], x[0]))
        taken, out = [], []
        for a, b, number in found:
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append(number)
        return out, len(words)


_machine: Automaton | None = None


def automaton() -> Automaton:
    """The automaton of the curated terms."""
    global _machine
    if _machine is None:
        _machine = Automaton()
    return _machine


def sentence_hits(clean: str | None, reader: MappedReader | None = None, machine: Automaton | None = None) -> list[tuple[list[int], int]]:
    """Term numbers and length of each sentence of a cleaned text, in which the reader mends damaged words."""
    clean, machine = clean or "", machine or automaton()
    if reader is not None:
        clean = reader.scan(clean)[0]
    return [machine.hits(clean[a:b]) for a, b in sentences(clean)]


def scores(hits: list[int], length: int, rarity: dict[int, float], machine: Automaton | None = None) -> dict[str, float]:
    """Score of each subject for a sentence: weights times rarity over the root of the length in dozens of words."""
    out: Counter = Counter()
    terms = (machine or automaton()).terms
    for number in hits:
        _, subject, weight, _ = terms[number]
        if subject is not None:
            out[subject] += weight * rarity.get(number, 1.0)
    factor = math.sqrt(max(1.0, length / 12))
    return {s: v / factor for s, v in out.items()}


def learn_terms(rows: list[tuple[str, str]]) -> list[tuple[str, str | None, float]]:
    """(term, subject or None, weight) learned from (cleaned text, label) rows.

    A phrase of up to ``LONGEST`` words counts once for each row. It is a term of a subject if the subject's label is so
    frequent among its rows that chance does not explain it, and far more frequent than any other subject's. It is no term
    (None) if it holds a curated term whose subject's label its rows mostly lack. Numbers are alike and begin or end no phrase;
    a single word that nearly always stands beside one other word is learned with that word only.
    """
    counts: dict[str, Counter] = {}
    prior: Counter = Counter()
    for text, label in rows:
        prior[label] += 1
        for phrase in _phrases(text):
            counts.setdefault(phrase, Counter())[label] += 1
    telling = {w for w, by in counts.items() if len(w) > 3 and " " not in w and (sum(by.values()) <= COMMON * len(rows) or max(by.values()) >= SHARE * sum(by.values()))}
    bound: Counter = Counter()
    for phrase, by in counts.items():
        if phrase.count(" ") == 1:
            n = sum(by.values())
            for w in phrase.split():
                bound[w] = max(bound[w], n)
    out: list[tuple[str, str | None, float]] = []
    for phrase, by in sorted(counts.items()):
        if telling.isdisjoint(phrase.split()) or (term := _term_of(phrase, by, prior)) is None:
            continue
        if " " in phrase or bound[phrase] < BOUND * sum(by.values()):
            out.append(term)
    return out


def _phrases(text: str) -> set[str]:
    """The phrases of a cleaned text that may be learned."""
    seen = set()
    for a, b in sentences(text):
        words = ["0" if w.isdigit() else w for w in _WORD.findall(fold(text[a:b]))]
        for n in range(1, LONGEST + 1):
            seen.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1) if words[i] != "0" != words[i + n - 1])
    return seen


def _term_of(phrase: str, by: Counter, prior: Counter) -> tuple[str, str | None, float] | None:
    """What a phrase with these rows by label is a term of, as far as its own counts say."""
    n, total = sum(by.values()), sum(prior.values())
    if n < 4 or "0" in phrase.split():
        return None
    ranked = sorted(((c, s) for s, c in by.items() if s in TERMS), reverse=True) or [(0, "")]
    (hit, subject), second = ranked[0], max([c for c, _ in ranked[1:]], default=0)
    share, base = hit / n, prior[subject] / total
    if hit and share >= SHARE and hit >= LEAD * second and share > base:
        ratio = 2 * (hit * math.log(share / base) + ((n - hit) * math.log((1 - share) / (1 - base)) if hit < n else 0))
        if ratio >= EVIDENCE:
            return phrase, subject, LEARNED
    if n >= UNLIKE_ROWS and " " in phrase:
        held, _ = automaton().hits(phrase)
        subjects = {automaton().terms[k][1] for k in held} - {None}
        if subjects and all(by[s] / n <= UNLIKE for s in subjects) and share < SHARE:
            return phrase, None, 0.0
    return None


def learned_terms(rows: DataFrame, held: object | None = None) -> list[tuple[str, str | None, float]]:
    """:func:`learn_terms` of all rows (_clean, _fixes, _label), counted in Spark."""
    at = {label: i for i, label in enumerate(LABELS)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def given() -> pd.DataFrame:
            out = [(phrase, i, n) for phrase, by in counts.items() for i, n in by.items()]
            counts.clear()
            return pd.DataFrame(out, columns=["phrase", "label", "n"]).astype({"label": "int32", "n": "int64"})

        for batch in batches:
            for text, fixes, label in zip(batch["_clean"], batch["_fixes"], batch["_label"]):
                for phrase in _phrases(reader_of(held, fixes).scan(text or "")[0]):
                    counts[phrase][at[label]] += 1
                if len(counts) > HELD:
                    yield given()
        if counts:
            yield given()

    prior = Counter({r._label: r.n for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()})  # one row for each label
    counted = rows.select("_clean", "_fixes", "_label").mapInPandas(count, "phrase string, label int, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("label") == i, F.col("n"))), F.lit(0)) for i in range(len(LABELS))]
    table = counted.groupBy("phrase").agg(F.sum("n").alias("n"), F.array(*sums).alias("by"))
    words = F.split("phrase", " ")
    # a pair of one row binds no word of four
    table = checkpoint(table.where((F.col("n") >= 4) | (F.col("n") > 1) & (F.size(words) == 2)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms = [(t, n) for phrase, n, by in zip(batch["phrase"], batch["n"], batch["by"]) if (t := _term_of(phrase, Counter({x: int(c) for x, c in zip(LABELS, by) if c}), prior))]
            yield pd.DataFrame([(*t, n) for t, n in terms], columns=["phrase", "subject", "weight", "n"]).astype({"phrase": "object", "subject": "object", "weight": "float64", "n": "int64"})

    terms = checkpoint(table.where("n >= 4").mapInPandas(judge, "phrase string, subject string, weight double, n long"))
    total = sum(prior.values())
    telling = table.where((F.size(words) == 1) & (F.length("phrase") > 3) & ((F.col("n") <= COMMON * total) | (F.array_max("by") >= SHARE * F.col("n")))).select(F.col("phrase").alias("word"))
    telling = terms.select("phrase", F.explode(words).alias("word")).join(telling, "word", "left_semi").select("phrase").distinct()
    bound = table.where(F.size(words) == 2).select(F.explode(words).alias("phrase"), F.col("n").alias("pair")).groupBy("phrase").agg(F.max("pair").alias("pair"))
    kept = terms.join(telling, "phrase", "left_semi").join(bound, "phrase", "left").where((F.size(words) > 1) | (F.coalesce("pair", F.lit(0)) < BOUND * F.col("n")))
    return sorted((r.phrase, r.subject, r.weight) for r in kept.collect())  # the model itself


_HITS = T.ArrayType(T.StructType([T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("words", T.IntegerType())]))


@F.pandas_udf(T.StringType())
def _cleaned(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: clean_for_reading(t or ""))


def cleaned_texts(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with the column ``_clean`` instead of the text and its own corrections ``_fixes``, and the table of corrections.

    Damaged words are mended by the counts of all words over all rows.
    """
    clean = packed_checkpoint(df.withColumn("_clean", _cleaned(df[text])).drop(text))
    repairs = find_repairs(word_counts(clean, "_clean"))
    return with_own_repairs(clean, "_clean", repairs), repairs.reader


def with_hits(clean: DataFrame, held: object | None, machine: Automaton, out: str = "_hits") -> DataFrame:
    """Add the term numbers and words of each sentence of the cleaned texts."""
    sent = _sent(clean, machine)

    @F.pandas_udf(_HITS)
    def find(texts: pd.Series, fixes: pd.Series) -> pd.Series:
        own = _own_machine(sent)
        return pd.Series([[{"terms": h, "words": n} for h, n in sentence_hits(t, reader_of(held, f), own)] for t, f in zip(texts, fixes)])

    return clean.withColumn(out, find("_clean", "_fixes")).drop("_clean", "_fixes")


_machines: dict[str, Automaton] = {}


def _sent(df: DataFrame, machine: Automaton):
    """The automaton's terms for the executors: the curated ones and those learned."""
    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(key, subject, weight) for key, subject, weight, _ in machine.terms]))


def _own_machine(sent) -> Automaton:
    """The automaton of broadcast terms, built once in each worker."""
    name, terms = sent.value
    if name not in _machines:
        _machines.clear()
        _machines[name] = Automaton(terms)
    return _machines[name]


def term_rarity(hits: DataFrame, column: str = "_hits") -> dict[int, float]:
    """Rarity of each term over all sentences: 1 for a median term, less for common, more for rare ones (0.75 to 1.5)."""
    sentence = hits.select(F.explode(column).alias("s"))
    counts = {r.term: r.n for r in sentence.select(F.explode("s.terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    middle = sorted(counts.values())[len(counts) // 2]
    return {t: min(1.5, max(0.75, 1 + 0.1 * math.log(middle / n))) for t, n in counts.items()}


def calibrate(labelled: list[tuple[list[tuple[list[int], int]], str]], rarity: dict[int, float], machine: Automaton | None = None) -> dict[str, float]:
    """For each subject the threshold with the best F1 on the labelled rows, of equal ones the middle.

    A row has one label though it may have two subjects: rows with the label of another subject say nothing about a subject, so
    only those with the label ``non_policy`` count as wrong.
    """
    best, tops = {}, [(_tops(hits, rarity, machine), label) for hits, label in labelled]
    for subject in SUBJECTS:
        own, wrong = Counter(), Counter()
        for top, label in tops:
            if label == subject:
                own[_step(top[subject])] += 1
            elif label not in SUBJECTS:
                wrong[_step(top[subject])] += 1
        best[subject] = _threshold(own, wrong)
    return best


def _tops(hits: Iterable[tuple[list[int], int]], rarity: dict[int, float], machine: Automaton | None) -> Counter:
    """Score of each subject's best sentence."""
    top: Counter = Counter()
    for h, n in hits:
        for s, v in scores(h, n, rarity, machine).items():
            top[s] = max(top[s], v)
    return top


def _step(score: float) -> int:
    """How many thresholds of ``GRID`` a score reaches."""
    return bisect_right(GRID, score)


def _threshold(own: Counter, wrong: Counter) -> float:
    """The threshold with the best F1 for the numbers of rows, with the subject's label and with none, by their steps."""
    positive = sum(own.values())
    if not positive:
        return THRESHOLD
    rated = []
    for i in range(len(GRID)):
        hit, bad = (sum(n for step, n in rows.items() if step > i) for rows in (own, wrong))
        rated.append(2 * hit / max(1, hit + bad + positive))
    good = [t for t, r in zip(GRID, rated) if r >= max(rated) - 1e-9]
    return good[len(good) // 2]


def calibrated(hits: DataFrame, keys: list[str], rarity: dict[int, float], sent: object) -> dict[str, float]:
    """:func:`calibrate` on all rows (keys, _hits, _label) with a label, redelivered ones once; counted in Spark."""
    steps = T.ArrayType(T.StructType([T.StructField("subject", T.StringType()), T.StructField("step", T.IntegerType())]))

    @F.pandas_udf(steps)
    def reached(all_hits: pd.Series) -> pd.Series:
        own = _own_machine(sent)
        return pd.Series([[{"subject": s, "step": _step(v)} for s, v in sorted(_tops(((list(h["terms"]), h["words"]) for h in found), rarity, own).items())] for found in all_hits])

    labelled = hits.where(F.col("_label").isNotNull())
    rows = {r._label: r.n for r in labelled.select(*keys, "_label").distinct().groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each label
    each = labelled.select(*keys, "_label", F.explode(reached("_hits")).alias("f")).select(*keys, "_label", "f.*")
    each = each.groupBy(*keys, "_label", "subject").agg(F.max("step").alias("step")).where((F.col("_label") == F.col("subject")) | ~F.col("_label").isin(*SUBJECTS))
    own: dict[str, Counter] = defaultdict(Counter)
    wrong: dict[str, Counter] = defaultdict(Counter)
    for r in each.groupBy("_label", "subject", "step").agg(F.count(F.lit(1)).alias("n")).collect():  # labels x subjects x steps
        (own if r._label == r.subject else wrong)[r.subject][r.step] += r.n
    for subject in SUBJECTS:
        own[subject][0] += rows.get(subject, 0) - sum(own[subject].values())
    return {subject: _threshold(own[subject], wrong[subject]) for subject in SUBJECTS}


def with_labels(df: DataFrame, keys: list[str], labels: DataFrame, label: str) -> DataFrame:
    """``df`` with ``_label``; NULL for rows without a label, with several, or with one that says nothing of subjects."""
    named = labels.groupBy(*keys).agg(F.min(label).alias("_label"), F.max(label).alias("_other")).where(F.col("_label") == F.col("_other")).select(*keys, "_label")
    named, _ = broadcast_if_small(named.where(F.col("_label").isin(*LABELS)))
    return df.join(named, keys, "left")


def subject_areas(df: DataFrame, keys: list[str], text: str, labels: DataFrame | None = None, label: str = "predicted_label") -> DataFrame:
    """(keys, subject, score): every subject that at least one sentence is about, once per key; score is the best sentence's.

    ``labels`` has (keys, label). NULL and empty texts have no subject. Without labels all thresholds are ``THRESHOLD`` and only the
    curated terms are read.
    """
    rows = df.select(*keys, text)
    clean, held = cleaned_texts(rows if labels is None else with_labels(rows, keys, labels, label), text)
    machine = automaton()
    if labels is not None:
        once = clean.where(F.col("_label").isNotNull()).groupBy(*keys).agg(F.min(F.struct("_clean", "_fixes", "_label")).alias("r")).select("r.*")
        machine = Automaton(learned_terms(once, held))
    hits = checkpoint(with_hits(clean, held, machine))
    rarity = term_rarity(hits)
    sent = _sent(df, machine)
    thresholds = dict.fromkeys(SUBJECTS, THRESHOLD) if labels is None else calibrated(hits, keys, rarity, sent)
    found_type = T.ArrayType(T.StructType([T.StructField("subject", T.StringType()), T.StructField("score", T.DoubleType())]))

    @F.pandas_udf(found_type)
    def assign(all_hits: pd.Series) -> pd.Series:
        own, out = _own_machine(sent), []
        for found in all_hits:
            top = _tops(((list(h["terms"]), h["words"]) for h in found), rarity, own)
            out.append([{"subject": s, "score": float(v)} for s, v in sorted(top.items()) if v >= thresholds[s]])
        return pd.Series(out)

    rows = hits.select(*keys, F.explode(assign("_hits")).alias("f"))
    return rows.groupBy(*keys, F.col("f.subject").alias("subject")).agg(F.max("f.score").alias("score"))


def subject_shares(found: DataFrame, keys: list[str]) -> DataFrame:
    """(subject, texts, share): texts with each subject, and its share of all subject assignments."""
    counts = found.groupBy("subject").agg(F.countDistinct(*keys).alias("texts"))
    total = counts.agg(F.sum("texts").alias("_total"))
    return counts.join(F.broadcast(total)).select("subject", "texts", (F.col("texts") / F.col("_total")).alias("share"))
