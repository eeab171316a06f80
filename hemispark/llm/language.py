"""Language of texts and of the segments of mixed ones, by a byte convolutional network.

The network reads windows of ``WINDOW`` bytes: byte embedding, filters of several widths, max pooling, softmax.
It is trained in numpy on a bounded sample of labelled rows; since some labels are wrong and some texts mix
languages, sentences whose label the first network rejects are left out of the second training.
For application the embedding and the filters fold into one table per filter tap, so that a window costs one table
look-up and addition for each byte and tap.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemispark.llm.annotations import _STAMP, _TURN, scrub
from hemispark.llm.characters import normalize_text
from hemispark.llm.furniture import join_lines

WINDOW, STRIDE = 80, 64
WIDTHS, FILTERS, EMBED = (2, 3, 4, 5), 16, 12
#: Labelled rows for each language that training uses at most.
SAMPLE = 1500
#: Shortest sentence (letters) that can be a segment of its own, and least confidence of a second language.
SEGMENT_LETTERS, SURE = 8, 0.75
#: Probability of the text's language in one half of a sentence from which the other half counts as a borrowed phrase.
HALF = 0.95
_SENTENCE = re.compile(r".*?[.!?…]+[”\"»')\]]*(?=\s|$)|.+$", re.DOTALL)
_ABBREVIATION = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Mme|Hon|St|No|p|pp|Col|cf|vs|etc|[A-Z])\.$")
_SOFT_END = re.compile(r"(?:\b[ap]\.?m|\d)\.$")
_CAPITAL = re.compile(r"\s+[\"“«(]?[A-ZÀ-Þ]")
#: Bytes share rows by this rule: lower case, digits alike, other signs alike.
_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 0x20
_FOLD[0x30:0x3A] = 0x30
_FOLD[[*range(1, 0x20), *b"()[]{}<>|/\\*#@_=+~^\"`"]] = 0x20


def clean_for_reading(text: str) -> str:
    """Normalised text without page furniture, marks, sounds, hesitations and labels of further turns."""
    plain = normalize_text(text)
    plain = _STAMP.sub(" ", plain)
    plain = _TURN.sub(lambda m: m.group()[: m.start("label") - m.start()] + " ", plain)
    return scrub(join_lines(plain)[0])[0]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences; abbreviations and initials don't end one, nor do numbers and hours before a small letter."""
    out, start = [], None
    for m in _SENTENCE.finditer(text):
        a, b = m.span()
        if start is None:
            start = a
        if b < len(text) and (_ABBREVIATION.search(text, max(start, b - 12), b) or _SOFT_END.search(text, max(start, b - 12), b) and not _CAPITAL.match(text, b)):
            continue
        out.append((start, b))
        start = None
    if start is not None:
        out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def windows(text: str) -> np.ndarray:
    """All windows of the text, one row each: zero-padded, folded bytes."""
    raw = np.frombuffer((" " + re.sub(r"\s+", " ", text).strip() + " ").encode(), dtype=np.uint8)
    raw = _FOLD[raw].astype(np.uint8)
    count = max(1, -(-(len(raw) - (WINDOW - STRIDE)) // STRIDE))
    grid = np.zeros(((count - 1) * STRIDE + WINDOW,), dtype=np.uint8)
    grid[: min(len(raw), len(grid))] = raw[: len(grid)]
    return np.lib.stride_tricks.sliding_window_view(grid, WINDOW)[::STRIDE]


class ByteNetwork:
    """Byte convolutional network; ``classes`` in alphabetical order."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = sorted(classes)
        self.embed = rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.taps = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(self.classes))).astype(np.float32)
        self.out_bias = np.zeros(len(self.classes), dtype=np.float32)
        self._tables: list[np.ndarray] | None = None

    def _parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.taps, *self.bias, self.out, self.out_bias]

    def fit(self, grid: np.ndarray, labels: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> "ByteNetwork":
        """Adam on cross-entropy, classes weighted alike; deterministic for a seed."""
        rng = np.random.default_rng(seed)
        share = np.bincount(labels, minlength=len(self.classes)) / max(1, len(labels))
        weight = 1 / (len(self.classes) * np.maximum(share, 1e-6))
        params = self._parameters()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            for chosen in np.array_split(rng.permutation(len(grid)), max(1, len(grid) // batch)):
                if not len(chosen):
                    continue
                step += 1
                for i, g in enumerate(self._gradients(grid[chosen], labels[chosen], weight)):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    params[i] -= rate * 0.6**epoch * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                self.embed[0] = 0
        self._tables = None
        return self

    def _gradients(self, grid: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n, x = len(grid), self.embed[grid]
        pooled, where, patches = [], [], []
        for taps, bias, w in zip(self.taps, self.bias, WIDTHS):
            patch = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * EMBED)
            z = patch @ taps.reshape(w * EMBED, FILTERS) + bias
            top = z.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0], 0))
            where.append(top)
            patches.append(patch)
        h = np.concatenate(pooled, 1)
        logits = h @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), labels] -= 1
        d = (p * weight[labels][:, None] / n).astype(np.float32)
        dh = d @ self.out.T
        dembed, dtaps, dbias = np.zeros_like(self.embed), [], []
        for i, w in enumerate(WIDTHS):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS] * (pooled[i] > 0)
            picked = np.take_along_axis(patches[i], where[i][:, :, None], 1)  # n, filters, w * embed
            dtaps.append(np.einsum("nfe,nf->ef", picked, g).reshape(w, EMBED, FILTERS).astype(np.float32))
            dbias.append(g.sum(0).astype(np.float32))
            back = np.einsum("nf,wef->nfwe", g, self.taps[i])
            rows = grid[np.arange(n)[:, None, None], where[i][:, :, None] + np.arange(w)]
            flat, values = rows.reshape(-1), back.reshape(-1, EMBED)
            for k in range(EMBED):
                dembed[:, k] += np.bincount(flat, values[:, k], minlength=256)
        return [dembed, *dtaps, *dbias, h.T @ d, d.sum(0)]

    def _folded(self) -> list[np.ndarray]:
        if self._tables is None:
            self._tables = [np.concatenate([(self.embed @ t[k])[None] for k in range(len(t))]) for t in self.taps]
        return self._tables

    def probabilities(self, grid: np.ndarray, batch: int = 256) -> np.ndarray:
        out = np.empty((len(grid), len(self.classes)), dtype=np.float32)
        for a in range(0, len(grid), batch):
            part = grid[a : a + batch]
            pooled = []
            for table, bias, w in zip(self._folded(), self.bias, WIDTHS):
                z = table[0][part[:, : WINDOW - w + 1]]
                for k in range(1, w):
                    z += table[k][part[:, k : WINDOW - w + 1 + k]]
                pooled.append(np.maximum(z.max(1) + bias, 0))
            logits = np.concatenate(pooled, 1) @ self.out + self.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            out[a : a + batch] = p / p.sum(1, keepdims=True)
        return out

    def read(self, texts: list[str]) -> np.ndarray:
        """Probabilities of each text: the mean of the logs over its windows."""
        if not texts:
            return np.zeros((0, len(self.classes)), dtype=np.float32)
        grids = [windows(t) for t in texts]
        logs = np.log(self.probabilities(np.concatenate(grids)) + 1e-6)
        at = np.cumsum([0, *map(len, grids)])
        mean = np.add.reduceat(logs, at[:-1], axis=0) / np.diff(at)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def labelled_sample(df: DataFrame, text: str, label: str, keys: list[str], languages: list[str], rows: int = SAMPLE) -> list[tuple[str, str]]:
    """At most about ``rows`` (text, label) for each language, chosen by a hash of the keys, from all partitions."""
    known = df.where(F.col(label).isin(languages) & (F.length(text) >= 40)).select(F.col(text).alias("t"), F.col(label).alias("l"), F.pmod(F.xxhash64(*keys), F.lit(1_000_000)).alias("h"))
    counts = {r.l: r.n for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for language, n in counts.items():
        chosen = chosen | ((F.col("l") == language) & (F.col("h") < int(1_000_000 * min(1.0, rows / n))))
    got = known.where(chosen).limit(2 * rows * len(languages)).collect()
    return sorted((r.t, r.l) for r in got)


def train(sample: list[tuple[str, str]], languages: list[str]) -> ByteNetwork | None:
    """Two rounds: the second without sentences whose label the first network, trained without them, rejects."""
    rows = []
    for text, label in sample:
        clean = clean_for_reading(text)
        rows += [(clean[a:b], label) for a, b in sentences(clean) if _letters(clean[a:b]) >= 15]
    classes = sorted({label for _, label in rows} & set(languages))
    if len(classes) < 2:
        return None
    grids, labels, group = [], [], []
    for text, label in rows:
        grid = windows(text)
        grids.append(grid)
        labels += [classes.index(label)] * len(grid)
        group += [zlib.crc32(text.encode()) % 2] * len(grid)
    grid, y, half = np.concatenate(grids), np.array(labels), np.array(group)
    keep = np.ones(len(y), dtype=bool)
    for _ in range(2):
        trusted = np.ones(len(y), dtype=bool)
        for h in (0, 1):
            rest = keep & (half != h)
            if len(set(y[rest])) == len(classes) and (half == h).any():
                p = ByteNetwork(classes).fit(grid[rest], y[rest], epochs=2).probabilities(grid[half == h])
                trusted[half == h] = p[np.arange(len(p)), y[half == h]] > 0.4
        if all((trusted & (y == k)).any() for k in range(len(classes))):
            keep = trusted
    return ByteNetwork(classes).fit(grid[keep], y[keep])


def _halves(cleaned: list[str], spans: list[list[tuple[int, int]]], p: np.ndarray, network: ByteNetwork) -> dict[tuple[int, int], np.ndarray]:
    """For each sentence of a text that seems mixed the larger probability of each language among its two halves.

    A borrowed phrase colours one half of a sentence only; the other half has the language of the text.
    """
    asked, texts, at = [], [], 0
    for i, (c, s) in enumerate(zip(cleaned, spans)):
        best = p[at : at + len(s)].argmax(1)
        at += len(s)
        if len(s) and (best != best[0]).any():
            for j, (a, b) in enumerate(s):
                words = c[a:b].split()
                if len(words) >= 4:
                    asked.append((i, j))
                    texts += [" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])]
    half = network.read(texts)
    return {k: np.maximum(half[2 * n], half[2 * n + 1]) for n, k in enumerate(asked)}


def segments_of(texts: list[str], network: ByteNetwork) -> list[list[tuple[str, float, str]]]:
    """For each text its (language, confidence, words) in order; neighbouring sentences of one language are one segment.

    A sentence too short or too unsure to stand for itself takes the language of the text's other sentences.
    """
    cleaned = [clean_for_reading(t) for t in texts]
    spans = [sentences(c) for c in cleaned]
    probabilities = network.read([c[a:b] for c, s in zip(cleaned, spans) for a, b in s])
    halves = _halves(cleaned, spans, probabilities, network)
    out, at = [], 0
    for i, (c, s) in enumerate(zip(cleaned, spans)):
        p = probabilities[at : at + len(s)]
        at += len(s)
        size = np.array([_letters(c[a:b]) for a, b in s], dtype=float)
        if not size.sum():
            out.append([])
            continue
        total = (p * size[:, None]).sum(0)
        main = int(total.argmax())
        best = p.argmax(1)
        best[(size < SEGMENT_LETTERS) | (p.max(1) < SURE)] = main
        best[[j for j in range(len(s)) if best[j] != main and (i, j) in halves and halves[i, j][main] >= HALF]] = main
        found: list[tuple[str, float, str]] = []
        for k, (a, b), prob, n in zip(best, s, p, size):
            language, confidence, words = network.classes[k], float(prob[k]), c[a:b].strip()
            if found and found[-1][0] == language:
                old = found[-1]
                weight = _letters(old[2])
                found[-1] = (language, (old[1] * weight + confidence * n) / max(1, weight + n), old[2] + " " + words)
            else:
                found.append((language, confidence, words))
        out.append(found)
    return out


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("text", T.StringType())]))


def fit_language(df: DataFrame, text: str, label: str, keys: list[str], languages: list[str], rows: int = SAMPLE) -> ByteNetwork | None:
    """The network trained on a bounded sample of the labelled rows of ``df``; None if fewer than two languages occur."""
    return train(labelled_sample(df, text, label, keys, languages, rows), languages)


def language_segments(df: DataFrame, text: str, network: ByteNetwork | None, out: str = "segments") -> DataFrame:
    """Add array ``out`` of (language, confidence, text). NULL, empty and letterless texts get an empty array, as do all
    texts where there is no network."""
    if network is None:
        return df.withColumn(out, F.array().cast(_SEGMENTS))
    network._folded()
    holder = df.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf(_SEGMENTS)
    def read(texts: pd.Series) -> pd.Series:
        filled = [t or "" for t in texts]
        found = segments_of(filled, holder.value)
        return pd.Series([[{"language": a, "confidence": b, "text": c} for a, b, c in f] for f in found])

    return df.withColumn(out, read(df[text]))


def wrong_languages(df: DataFrame, keys: list[str], text: str, label: str, network: ByteNetwork | None, least: int = 40) -> DataFrame:
    """(keys, language): the right language of each text whose label is missing or wrong, and every language of each mixed text.

    NULL texts, texts under ``least`` characters and texts without letters give no rows; redelivered rows count once. Each
    text is read whole, however long. Columns besides ``keys``, ``text`` and ``label`` are not read.
    """
    rows = df.where(F.length(text) >= least).select(*keys, text, label)
    found = language_segments(rows, text, network).withColumn("_all", F.array_distinct(F.transform("segments", lambda s: s["language"])))
    wrong = (F.size("_all") > 1) | (F.col(label).isNull()) | (F.get("_all", 0) != F.col(label))
    return found.where((F.size("_all") > 0) & wrong).select(*keys, F.explode("_all").alias("language")).distinct()
