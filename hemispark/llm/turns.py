"""Transcripts into clean, ordered speaker turns.

1. Each row is read on its own: marks of time, sounds and hesitations go, labels lose what is no title, name or
   office, further turns inside a text are split off, wrong stage flags are found.
2. Missing labels come from a hidden Markov model: the states are the participants, a state emits the words of
   a turn by the participant's language profile, the transitions are how often one participant follows another. The best path
   gives the labels, the forward and backward sums their posterior. A further turn inside a text whose label the debate has
   nowhere else is held against the profile of the speaker before it: if the words are clearly the speaker's, it is a quotation.
3. Consecutive turns of one speaker are merged.

A given label fixes the chain's state, so the path between two given labels depends on nothing else: each run of
missing labels is solved by itself, exactly, wherever it lies. A debate of up to ``WHOLE`` turns is read by one task: its turns are
shuffled once, as compressed blocks. A larger one may hold a third of all rows: its profiles and transitions are counted by (word, label)
and (label, label), and step 2 looks for the neighbours of a run within ``CHUNK`` sequence numbers, as step 3 does for the start of
a turn, and carries what is open from chunk to chunk. Both ways give the same.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemispark.llm.annotations import read_row, strip_label
from hemispark.session import broadcast_if_small, checkpoint, packed_checkpoint, salted_join

CHUNK = 400
#: Turns and characters up to which a debate is read by one task.
WHOLE, WHOLE_TEXT = 20_000, 50_000_000
#: Characters after which a task gives on the blocks of turns that it holds.
BLOCKS = 8_000_000
#: Chunks without any given label after which a run is solved in pieces, and characters after which a merged turn is given in parts:
#: both only so that no row or task grows without bound (20,000 unlabelled turns, 16 MB of text).
RUN_CHUNKS, PART = 50, 16_000_000
#: By so much the logarithm of a profile must exceed the common one, for the root of the words, for a quotation.
QUOTED = 8.0
#: Weight of the common profile in each participant's, and of a transition never seen.
COMMON, UNSEEN = 50.0, 0.1
_READ = T.StructType(
    [
        T.StructField("noises", T.ArrayType(T.StringType())),
        T.StructField("stage", T.BooleanType()),
        T.StructField("turns", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType())]))),
    ]
)


@F.pandas_udf(_READ)
def _read(speaker: pd.Series, text: pd.Series, flag: pd.Series) -> pd.DataFrame:
    noises, stages, turns = [], [], []
    for s, t, f in zip(speaker, text, flag):
        row = read_row(s, t, bool(f) if f is not None else None)
        noises.append(row.noises)
        stages.append(row.stage)
        first = {"label": strip_label(s)[0], "text": row.text}
        turns.append([first, *({"label": strip_label(label)[0], "text": x} for label, x in zip(row.labels, row.texts))])
    return pd.DataFrame({"noises": noises, "stage": stages, "turns": turns})


def read_rows(df: DataFrame, speaker: str, text: str, flag: str, out: str = "_read") -> DataFrame:
    """Add struct ``out`` (noises, stage, turns) to each row; NULL text reads as '', NULL flag as false."""
    return df.withColumn(out, _read(df[speaker], df[text], df[flag]))


def transcript_noise(df: DataFrame, keys: list[str], speaker: str, text: str, flag: str) -> DataFrame:
    """(keys, noise) of every row, each case once, even for redelivered rows. ``keys``: debate and sequence number.

    The rows are those of :func:`speaker_turns`, so that a quotation is no further turn. NULL or empty texts have no noise but
    that of their label, NULL labels none; a NULL flag counts as false. Rows without a debate or number have no neighbours and are read by
    themselves. Empty tables give no rows; other columns are not read.
    """
    debate, order = keys
    rows = df.select(*keys, speaker, text, flag)
    turns, solved = _solved_turns(rows, debate, order, speaker, text, flag)
    quotes, _ = broadcast_if_small(solved.where("_quote").groupBy("_debate", "_seq").agg(F.count(F.lit(1)).alias("_quotes")))
    first = turns.where((F.col("_sub") == 0) & (F.size("_noises") > 0)).select("_debate", "_seq", "_noises", "_further").join(quotes, ["_debate", "_seq"], "left")
    first = first.withColumn("_noises", F.when(F.col("_quotes") == F.col("_further"), F.array_remove("_noises", "inline")).otherwise(F.col("_noises")))
    first = first.select(F.col("_debate").cast(df.schema[debate].dataType).alias(debate), F.col("_seq").cast(df.schema[order].dataType).alias(order), F.explode("_noises").alias("noise"))
    alone = read_rows(rows.where(F.col(debate).isNull() | F.col(order).isNull()), speaker, text, flag)
    return first.unionByName(alone.select(*keys, F.explode("_read.noises").alias("noise"))).distinct()


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]{2,}", (text or "").lower())


class Model(NamedTuple):
    """Participants, from the most frequent label, and what is known of them; every label is a participant."""

    names: list[str]
    known: np.ndarray  # labelled turns of each
    mass: np.ndarray  # words of each
    size: int  # words of all turns, and one
    words: dict[str, tuple[int, np.ndarray, np.ndarray]]  # word: times seen, participants, their times
    moves: tuple[np.ndarray, np.ndarray, np.ndarray]  # participant, next one, times; only pairs that were seen


def learn(labels: list[str | None], texts: list[str]) -> Model:
    """Model of the given turns, in order."""
    known = Counter(x for x in labels if x is not None)
    names = sorted(known, key=lambda x: (-known[x], x))
    index = {x: i for i, x in enumerate(names)}
    total, moves, mass = Counter(), Counter(), np.zeros(len(names))
    seen: dict[str, Counter] = defaultdict(Counter)
    last = None
    for label, text in zip(labels, texts):
        words = _words(text)
        total.update(words)
        at = None if label is None else index[label]
        if at is not None:
            mass[at] += len(words)
            for w in words:
                seen[w][at] += 1
            if last is not None:
                moves[last, at] += 1
        last = at
    words = {w: (n, np.array(list(seen[w]), dtype=int), np.array(list(seen[w].values()), dtype=float)) for w, n in total.items()}
    pairs = np.array([(i, j, n) for (i, j), n in moves.items()], dtype=int).reshape(-1, 3)
    return Model(names, np.array([known[x] for x in names], dtype=float), mass, sum(total.values()) + 1, words, (pairs[:, 0], pairs[:, 1], pairs[:, 2]))


def infer_labels(labels: list[str | None], texts: list[str], model: Model | None = None) -> tuple[list[str | None], list[float]]:
    """Labels with the missing ones filled by the best path, and the share of the posterior for each (1 where given).

    The model is that of these turns by default; else it must know every given label. Transitions that were never seen
    share one weight, so a step costs as much as there are participants and seen transitions, not their square.
    Ties go to the more frequent label, then to the first in the alphabet. Without any participant all stay missing.
    """
    model = learn(labels, texts) if model is None else model
    names, n = model.names, len(model.names)
    if not names or not labels:
        return list(labels), [1.0 if x is not None else 0.0 for x in labels]
    index = {x: i for i, x in enumerate(names)}
    order = np.lexsort((model.moves[0], model.moves[1]))  # by next participant, then by participant
    source, target, times = (x[order] for x in model.moves)
    sums = UNSEEN * n + np.bincount(source, times, n)
    rest, step = np.log(UNSEEN / sums), np.log((UNSEEN + times) / sums[source])
    first = np.flatnonzero(np.diff(target, prepend=-1))  # where each next participant begins
    bounds = np.searchsorted(target, np.arange(n + 1))
    base = np.log(COMMON / (model.mass + COMMON))

    def emission(text: str) -> np.ndarray:
        row, words = np.zeros(n), _words(text)
        for w in words:
            row += base
            if w in model.words:
                all_times, who, own = model.words[w]
                common = all_times / model.size
                row[who] += np.log((own + COMMON * common) / (model.mass[who] + COMMON)) - base[who] - math.log(common)
        return row / math.sqrt(1 + len(words))

    def only(at: int, value: float = 0.0) -> np.ndarray:
        row = np.full(n, -np.inf)
        row[at] = value
        return row

    def reach(row: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over the previous participant."""
        weight = np.exp(row - row.max())
        return np.log((weight * UNSEEN / sums).sum() + np.bincount(target, weight[source] * times / sums[source], n)) + row.max()

    def reach_back(row: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over the next participant."""
        weight = np.exp(row - row.max())
        return np.log((weight.sum() * UNSEEN + np.bincount(source, weight[target] * times, n)) / sums) + row.max()

    start = np.log(model.known / model.known.sum())
    best, forward, back, forwards, emits = start, start, [], [], []
    for t, (label, text) in enumerate(zip(labels, texts)):
        given = None if label is None else index[label]
        if t:
            free = best + rest
            top = int(free.argmax())
            if given is not None:
                span = slice(bounds[given], bounds[given + 1])
                free[source[span]] = best[source[span]] + step[span]
                back.append(top := int(free.argmax()))
                best = only(given, free[top])
            else:
                came, reached = np.full(n, top), np.full(n, free[top])
                if len(first):
                    value = best[source] + step
                    most = np.maximum.reduceat(value, first)
                    hit = np.flatnonzero(value == np.repeat(most, np.diff([*first, len(value)])))[::-1]
                    far = hit[value[hit] > reached[target[hit]]]
                    came[target[far]], reached[target[far]] = source[far], value[far]
                back.append(came)
                best = reached
                forward = reach(forward)
        if given is None:
            emit = emission(text)
            best, forward = best + emit, forward + emit
            emits.append(emit)
        else:
            best = best if t else only(given, best[given])
            forward = only(given)
            emits.append(None)
        forwards.append(forward)
    at = int(best.argmax())
    out, sure, backward = list(labels), [1.0] * len(labels), np.zeros(n)
    for t in range(len(labels) - 1, -1, -1):
        if labels[t] is None:
            out[t] = names[at]
            share = np.exp((both := forwards[t] + backward) - both.max())
            sure[t] = float(share[at] / share.sum())
        if t:
            here = emits[t] + backward if labels[t] is None else only(index[labels[t]])
            backward = reach_back(here)
            at = int(back[t - 1]) if isinstance(back[t - 1], int) else int(back[t - 1][at])
    return out, sure


def profile_lead(text: str, label: str, model: Model) -> float:
    """How far the words speak for the participant's profile rather than the common one, for the root of the words."""
    if label not in model.names:
        return 0.0
    at, words, lead = model.names.index(label), _words(text), 0.0
    base = math.log(COMMON / (model.mass[at] + COMMON))
    for w in words:
        lead += base
        if w in model.words:
            all_times, who, own = model.words[w]
            if len(hit := np.flatnonzero(who == at)):
                lead += math.log((own[hit[0]] + COMMON * all_times / model.size) / (model.mass[at] + COMMON)) - base - math.log(all_times / model.size)
    return lead / math.sqrt(1 + len(words))


def _chunk_model(known: pd.DataFrame) -> Model | None:
    """The model of a debate, of its words those that this chunk asks for. ``known``: a row of the debate, and one for each word."""
    whole = known[known["_word"].isna()]
    if whole.empty:
        return None
    r = whole.iloc[0]
    words = {w: (n, np.asarray(i, dtype=int), np.asarray(k, dtype=float)) for w, n, i, k in known[["_word", "_total", "_who", "_times"]].itertuples(index=False) if isinstance(w, str)}
    moves = tuple(np.asarray(r[c], dtype=int) for c in ("_from", "_to", "_moved"))
    return Model(list(r["_names"]), np.asarray(r["_known"], dtype=float), np.asarray(r["_mass"], dtype=float), int(r["_total"]) + 1, words, moves)


def _solve_runs(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Labels of the missing turns of some runs, and whether doubtful further turns are quotations."""
    columns = [c.split()[0] for c in _SOLVED_SCHEMA.split(", ")]
    model = None if pdf.empty else _chunk_model(known)
    if model is None:
        return _frame([], columns)
    found = []
    asked = pdf[pdf["_label"].isna()].sort_values(["_run_seq", "_run_sub", "_seq", "_sub"], na_position="first", kind="stable")
    for _, run in asked.groupby(["_run_seq", "_run_sub"], dropna=False, sort=False):
        ends = [x if isinstance(x, str) else None for x in (run["_before"].iloc[0], run["_after"].iloc[-1])]
        labels = [*ends[:1]] * (ends[0] is not None) + [None] * len(run) + [*ends[1:]] * (ends[1] is not None)
        texts = [""] * (ends[0] is not None) + list(run["_text"]) + [""] * (ends[1] is not None)
        names, sure = infer_labels(labels, texts, model)
        skip = int(ends[0] is not None)
        found += [(d, q, u, names[skip + i], sure[skip + i], False) for i, (d, q, u) in enumerate(zip(run["_debate"], run["_seq"], run["_sub"]))]
    told = {(q, u): name for _, q, u, name, _, _ in found}
    for d, q, u, label, text, before in pdf[pdf["_label"].notna()][["_debate", "_seq", "_sub", "_label", "_text", "_before"]].itertuples(index=False):
        speaker = told.get((q, u - 1), before)
        found.append((d, q, u, label, 1.0, isinstance(speaker, str) and speaker != label and profile_lead(text, speaker, model) > QUOTED))
    return _frame(found, columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as a frame whose columns have their types even without rows."""
    return pd.DataFrame(rows, columns=columns).astype({c: kind for c, kind in zip(columns, ("object", "int64", "int32", "object", "float64", "bool"))})


_SOLVED_SCHEMA = "_debate string, _seq long, _sub int, _inferred string, _share double, _quote boolean"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _word_lists(texts: pd.Series) -> pd.Series:
    return texts.map(_words)


def debate_models(turns: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (_debate, _chunk, ...) of :func:`_chunk_model` for the chunks that ask, learned from whole debates.

    ``turns``: the speech (_debate, _seq, _sub, _stage, _label, _text); ``chunks``: the turns in question with ``_chunk``. Counts are
    grouped by (debate, word, label), never by debate alone. What a chunk gets is bounded by the participants and seen
    transitions of its debate and by the words of its own turns in question.
    """
    speech = turns.where(~F.col("_stage"))
    counts = speech.select("_debate", "_label", F.explode(_word_lists("_text")).alias("_word")).groupBy("_debate", "_word", "_label").agg(F.count(F.lit(1)).alias("_n"))
    counts = checkpoint(counts)
    labels = speech.where(F.col("_label").isNotNull()).groupBy("_debate", "_label").agg(F.count(F.lit(1)).alias("_turns"))
    labels = labels.join(counts.groupBy("_debate", "_label").agg(F.sum("_n").alias("_mass")), ["_debate", "_label"], "left")
    listed = labels.groupBy("_debate").agg(F.array_sort(F.collect_list(F.struct((-F.col("_turns")).alias("order"), F.col("_label").alias("name"), F.coalesce("_mass", F.lit(0)).alias("mass")))).alias("l"))
    listed = checkpoint(listed)
    index = listed.select("_debate", F.posexplode("l").alias("_i", "x")).select("_debate", F.col("x.name").alias("_label"), "_i")

    # one participant after another: in a chunk the row before, for its first row the last one of the chunks before
    home = speech.withColumn("_chunk", F.floor(F.col("_seq") / CHUNK).cast("long"))
    key = F.struct("_seq", "_sub")
    lasts = home.groupBy("_debate", "_chunk").agg(F.max_by(F.struct("_label"), key).alias("_end"))
    lasts = lasts.select("_debate", "_chunk", F.lag("_end").over(Window.partitionBy("_debate").orderBy("_chunk")).alias("_end"))
    pairs = home.withColumn("_before", F.lag(F.struct("_label")).over(Window.partitionBy("_debate", "_chunk").orderBy("_seq", "_sub"))).join(lasts, ["_debate", "_chunk"])
    pairs = pairs.select("_debate", F.coalesce("_before", "_end")["_label"].alias("_a"), F.col("_label").alias("_b")).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    pairs = pairs.groupBy("_debate", "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    for name, at in (("_a", "_from"), ("_b", "_to")):
        pairs = pairs.join(index.select("_debate", F.col("_label").alias(name), F.col("_i").alias(at)), ["_debate", name])
    moves = pairs.groupBy("_debate").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_n"))).alias("m"))

    asking = chunks
    asked = checkpoint(asking.select("_debate", "_chunk", F.explode(_word_lists("_text")).alias("_word")).distinct())
    size = counts.groupBy("_debate").agg(F.sum("_n").alias("_total"))
    whole = listed.join(moves, "_debate", "left").join(size, "_debate", "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<_from:int,_to:int,_n:bigint>>")))
    whole = whole.join(asking.select("_debate", "_chunk").distinct(), "_debate").select(
        "_debate", "_chunk", F.lit(None).cast("string").alias("_word"), F.coalesce("_total", F.lit(0)).alias("_total"), F.col("l.name").alias("_names"), F.transform("l.order", lambda x: -x).alias("_known"), F.col("l.mass").alias("_mass"),
        F.col("m._from").alias("_from"), F.col("m._to").alias("_to"), F.col("m._n").alias("_moved"),
    )
    wanted = counts.join(asked.select("_debate", "_word").distinct(), ["_debate", "_word"], "left_semi").join(index, ["_debate", "_label"], "left")
    words = wanted.groupBy("_debate", "_word").agg(F.sum("_n").alias("_total"), F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_n")))).alias("w"))
    words = asked.join(words, ["_debate", "_word"]).select("_debate", "_chunk", "_word", "_total", F.col("w._i").alias("_who"), F.col("w._n").alias("_times"))
    return whole.unionByName(words, allowMissingColumns=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed blocks (_debate, _block) of the turns (_debate, _seq, _sub, _label, _text)."""
    held: dict[str, list[tuple]] = defaultdict(list)
    size = 0

    def given() -> pa.RecordBatch:
        blocks = [zlib.compress(json.dumps(list(zip(*turns)), ensure_ascii=False).encode()) for turns in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(blocks, pa.binary())], ["_debate", "_block"])

    for batch in batches:
        for d, *turn in zip(*(batch.column(c).to_pylist() for c in ("_debate", "_seq", "_sub", "_label", "_text"))):
            held[d].append(turn)
            size += len(turn[-1])
            if size > BLOCKS:
                yield given()
                held.clear()
                size = 0
    if held:
        yield given()


def solve_debate(turns: list[tuple[int, int, str | None, str]]) -> list[tuple[int, int, str, float, bool]]:
    """(seq, sub, label, share, quotation) of the missing labels and the doubtful further turns of a whole debate of (seq, sub, label, text)."""
    turns = sorted(turns, key=lambda t: t[:2])
    labels, texts = [t[2] for t in turns], [t[3] for t in turns]
    own = {label for _, sub, label, _ in turns if sub == 0}
    doubtful = [i for i, (_, sub, label, _) in enumerate(turns) if label is not None and sub > 0 and label not in own]
    if not doubtful and None not in labels or not any(x is not None for x in labels):
        return []
    model = learn(labels, texts)
    told: dict[tuple[int, int], str] = {}
    before: list[str | None] = []  # the last given label before each turn
    for label in labels:
        before.append(last if before else None)
        last = label if label is not None else before[-1]
    found, at = [], 0
    for missing, run in groupby(labels, lambda x: x is None):
        begin, at = at, at + len(list(run))
        if missing:
            a, b = max(0, begin - 1), min(len(turns), at + 1)
            names, sure = infer_labels(labels[a:b], texts[a:b], model)
            for i in range(begin, at):
                told[turns[i][:2]] = names[i - a]
                found.append((*turns[i][:2], names[i - a], sure[i - a], False))
    for i in doubtful:
        seq, sub, label, text = turns[i]
        speaker = told.get((seq, sub - 1), before[i])
        found.append((seq, sub, label, 1.0, speaker is not None and speaker != label and profile_lead(text, speaker, model) > QUOTED))
    return found


def _solve_debates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`solve_debate` finds in the debates whose blocks follow each other."""
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
    names = [c.split()[0] for c in _SOLVED_SCHEMA.split(", ")]
    blocks = (pair for batch in batches for pair in zip(batch.column("_debate").to_pylist(), batch.column("_block").to_pylist()))
    for debate, own in groupby(blocks, lambda x: x[0]):
        turns = [tuple(t) for _, block in own for t in zip(*json.loads(zlib.decompress(block)))]
        if found := [(debate, *x) for x in solve_debate(turns)]:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*found), types)], names)


def _solve_whole(speech: DataFrame) -> DataFrame:
    """Rows of ``_SOLVED_SCHEMA`` of debates that one task can hold."""
    blocks = speech.select("_debate", "_seq", "_sub", "_label", "_text").mapInArrow(_blocks, "_debate string, _block binary")
    return blocks.repartition("_debate").sortWithinPartitions("_debate").mapInArrow(_solve_debates, _SOLVED_SCHEMA)


def _solve_long(speech: DataFrame) -> DataFrame:
    """Rows of ``_SOLVED_SCHEMA`` of debates of any size, chunk by chunk."""
    speech = speech.withColumn("_home", F.floor(F.col("_seq") / CHUNK).cast("long"))
    # labels that only stand inside texts are doubtful
    own = speech.groupBy("_debate", "_label").agg(F.max((F.col("_sub") == 0).cast("int")).alias("_own")).where("_own = 0 AND _label IS NOT NULL").select("_debate", "_label", F.lit(True).alias("_doubt"))
    # of the other turns no text is asked for
    narrow = speech.withColumn("_text", F.when(F.col("_label").isNull() | (F.col("_sub") > 0), F.col("_text")))
    placed = salted_join(_neighbours(narrow), own, ["_debate", "_label"], "left")
    asked = placed.where(F.col("_label").isNull() | (F.col("_doubt") & (F.col("_sub") > 0))).drop("_doubt")
    begun = F.coalesce(F.floor(F.col("_run_seq") / CHUNK), F.lit(-1)).cast("long")
    asked = asked.withColumn("_chunk", begun * 1_000_000 + F.floor((F.col("_home") - begun) / RUN_CHUNKS).cast("long"))
    asked = packed_checkpoint(asked.drop("_home"))
    models = debate_models(speech, asked).withColumnsRenamed({"_debate": "_of", "_chunk": "_at"})
    return asked.groupBy("_debate", "_chunk").cogroup(models.groupBy("_of", "_at")).applyInPandas(_solve_runs, _SOLVED_SCHEMA)


def _once(rows: DataFrame) -> DataFrame:
    """Each (_debate, _seq) once, by text and label; only the few keys that came twice are grouped with their texts."""
    twice = checkpoint(rows.groupBy("_debate", "_seq").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_debate", "_seq"))
    twice, _ = broadcast_if_small(twice)
    several = rows.join(twice, ["_debate", "_seq"], "left_semi").groupBy("_debate", "_seq").agg(F.min_by(F.struct("_s", "_t", "_f"), F.struct(F.coalesce("_t", F.lit("")), F.coalesce("_s", F.lit("")))).alias("r"))
    return rows.join(twice, ["_debate", "_seq"], "left_anti").unionByName(several.select("_debate", "_seq", "r.*"))


def _neighbours(speech: DataFrame) -> DataFrame:
    """Turns with ``_before`` and ``_run_*`` (the last given label so far and its place) and ``_after`` (the next given label)."""
    given = F.when(F.col("_label").isNotNull(), F.struct("_seq", "_sub", "_label"))
    w = Window.partitionBy("_debate", "_home").orderBy("_seq", "_sub")
    rows = speech.withColumn("_b", F.last(given, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_a", F.first(given, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    ends = speech.groupBy("_debate", "_home").agg(F.max(given).alias("_last"), F.min(given).alias("_first"))
    over = Window.partitionBy("_debate").orderBy("_home")
    ends = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_coming", F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))).select("_debate", "_home", "_carried", "_coming")
    ends, _ = broadcast_if_small(ends)
    rows = rows.join(ends, ["_debate", "_home"], "left").withColumn("_b", F.coalesce("_b", "_carried")).withColumn("_a", F.coalesce("_a", "_coming"))
    return rows.select("_debate", "_seq", "_sub", "_stage", "_label", "_text", "_home", F.col("_b._label").alias("_before"), F.col("_b._seq").alias("_run_seq"), F.col("_b._sub").alias("_run_sub"), F.col("_a._label").alias("_after"))


def _solved_turns(df: DataFrame, debate: str, order: str, speaker: str, text: str, flag: str) -> tuple[DataFrame, DataFrame]:
    """Every turn of every row (with ``_further``, the further turns of its row), and rows of ``_SOLVED_SCHEMA``."""
    rows = df.select(F.col(debate).cast("string").alias("_debate"), F.col(order).cast("long").alias("_seq"), F.col(speaker).alias("_s"), F.col(text).alias("_t"), F.col(flag).alias("_f"))
    rows = _once(rows.where(F.col("_debate").isNotNull() & F.col("_seq").isNotNull()))
    rows = read_rows(rows, "_s", "_t", "_f")
    turns = rows.select("_debate", "_seq", F.col("_read.stage").alias("_stage"), F.col("_read.noises").alias("_noises"), (F.size("_read.turns") - 1).alias("_further"), F.posexplode("_read.turns").alias("_sub", "turn"))
    turns = packed_checkpoint(turns.select("_debate", "_seq", "_sub", "_stage", F.col("turn.label").alias("_label"), F.col("turn.text").alias("_text"), "_noises", "_further"))
    speech = turns.where(~F.col("_stage") & (F.col("_text") != "")).drop("_noises", "_further")
    sizes = speech.groupBy("_debate").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("_text")).alias("_length"))
    long = checkpoint(sizes.where((F.col("_n") > WHOLE) | (F.col("_length") > WHOLE_TEXT)).select("_debate"))
    if long.limit(1).count():
        long, _ = broadcast_if_small(long)
        solved = _solve_whole(speech.join(long, "_debate", "left_anti")).unionByName(_solve_long(speech.join(long, "_debate", "left_semi")))
    else:
        solved = _solve_whole(speech)
    return turns, packed_checkpoint(solved)


def speaker_turns(df: DataFrame, debate: str = "debate_id", order: str = "seq_index", speaker: str = "speaker_raw", text: str = "text", flag: str = "is_stage_direction") -> DataFrame:
    """(_debate, _seq, _sub, _stage, _text, _noises, _speaker, _given, _confidence, _quoted): every turn of every row, with the speaker model's labels.

    ``_sub`` numbers the turns inside a row, ``_noises`` are those of the row, ``_quoted`` says that a further turn is a quotation.
    Rows without a debate or number are left out; of redelivered rows (same key) one is used, by text and label.
    """
    turns, solved = _solved_turns(df, debate, order, speaker, text, flag)
    solved, _ = broadcast_if_small(solved)
    told = turns.join(solved, ["_debate", "_seq", "_sub"], "left")
    return told.select(
        "_debate", "_seq", "_sub", "_stage", "_text", "_noises", F.when(~F.col("_stage"), F.coalesce("_label", "_inferred")).alias("_speaker"), (F.col("_stage") | F.col("_label").isNotNull()).alias("_given"),
        F.when(F.col("_stage") | F.col("_label").isNotNull(), 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("_confidence"), F.coalesce("_quote", F.lit(False)).alias("_quoted"),
    )


def clean_turns(df: DataFrame, debate: str = "debate_id", order: str = "seq_index", speaker: str = "speaker_raw", text: str = "text", flag: str = "is_stage_direction") -> DataFrame:
    """(debate_id, turn_seq, turn_sub, part, first_seq, last_seq, speaker, confidence, is_stage_direction, text), one row per turn.

    ``turn_seq`` is the sequence number at which the turn starts; only a turn of more than ``PART`` characters has several parts.
    Rows without a debate or number are left out; of redelivered rows (same key) one is used, by text and label.
    Rows whose text is empty after cleaning give no turn. Turns without a known speaker are never merged.
    """
    told = speaker_turns(df, debate, order, speaker, text, flag).where(F.col("_text") != "").drop("_noises")
    told = told.withColumn("_chunk", F.floor(F.col("_seq") / CHUNK).cast("long"))
    key = F.struct("_seq", "_sub")
    w = Window.partitionBy("_debate", "_chunk").orderBy("_seq", "_sub")
    # a turn begins where the speaker changes; the first row of a chunk looks at the last one of the chunks before
    state = F.struct("_stage", "_speaker")
    told = told.withColumn("_last", F.lag(state).over(w))
    # in a window whose last row is the chunk's, the state and, later, the start that the next chunk carries on
    lasts = told.groupBy("_debate", "_chunk").agg(F.max_by(state, key).alias("_end"), F.min(key).alias("_head"))
    lasts = lasts.select("_debate", "_chunk", "_head", F.lag("_end").over(Window.partitionBy("_debate").orderBy("_chunk")).alias("_carried_state"))
    lasts, _ = broadcast_if_small(lasts)
    told = told.join(lasts, ["_debate", "_chunk"], "left").withColumn("_last", F.when(key == F.col("_head"), F.col("_carried_state")).otherwise(F.col("_last")))
    begins = F.col("_last").isNull() | F.col("_stage") | F.col("_last._stage") | F.col("_speaker").isNull() | F.col("_last._speaker").isNull() | (F.col("_speaker") != F.col("_last._speaker"))
    begins = begins & ~(F.col("_quoted") & (F.col("_sub") > 0))
    told = told.withColumn("_begin", F.when(begins, key)).drop("_carried_state", "_head", "_last")
    told = told.withColumn("_start", F.last("_begin", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = told.groupBy("_debate", "_chunk").agg(F.max("_begin").alias("_newest"))
    before = Window.partitionBy("_debate").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_debate", "_chunk", F.last("_newest", ignorenulls=True).over(before).alias("_carried"))
    ends, _ = broadcast_if_small(ends)
    told = told.join(ends, ["_debate", "_chunk"], "left").withColumn("_start", F.coalesce("_start", "_carried", key))
    pieces = told.groupBy("_debate", "_chunk", "_start").agg(
        F.min("_seq").alias("first_seq"),
        F.max("_seq").alias("last_seq"),
        F.min_by("_speaker", key).alias("speaker"),
        F.min("_confidence").alias("confidence"),
        F.min_by("_stage", key).alias("is_stage_direction"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_sub", "_text"))), lambda x: x["_text"]), " ").alias("text"),
    )
    # the pieces of a turn that crosses chunks; most turns have one
    crossing = (F.floor(F.col("first_seq") / CHUNK) != F.floor(F.col("_start._seq") / CHUNK)) | F.col("_open")
    newest = F.max("_start").over(Window.partitionBy("_debate", "_chunk"))
    pieces = pieces.withColumn("_open", F.col("_start") == newest)
    whole = pieces.where(~crossing).withColumn("part", F.lit(0).cast("long"))
    size = F.coalesce(F.sum(F.length("text").cast("long")).over(Window.partitionBy("_debate", "_start").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = pieces.where(crossing).withColumn("part", F.floor(size / PART).cast("long")).groupBy("_debate", "_start", "part").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.min_by("speaker", "_chunk").alias("speaker"), F.min("confidence").alias("confidence"), F.min_by("is_stage_direction", "_chunk").alias("is_stage_direction"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    merged = whole.select(joined.columns).unionByName(joined)
    return merged.select(
        F.col("_debate").alias("debate_id"), F.col("_start._seq").alias("turn_seq"), F.col("_start._sub").alias("turn_sub"), "part",
        "first_seq", "last_seq", "speaker", "confidence", "is_stage_direction", "text",
    )
