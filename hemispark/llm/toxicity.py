"""Abusive, hateful or sexual content by nearest labelled examples.

Examples are the passages (sentences) of a bounded sample of labelled documents. A passage of a new document is compared
with them by exact TF-IDF cosine through an inverted index in blocks: a block's largest weight of each
feature bounds the cosine of all passages in the block; where a passage has many postings, those of blocks whose bound is below the
least similarity that still counts are skipped. The nearest passages vote, weighted by similarity; a document has the score of its worst passage.

A label belongs to a whole document, most of whose passages are harmless. So each passage of a document labelled as
abusive is first rated by the passages of *other* documents; only those rated abusive stay examples of it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemispark.llm.characters import normalize_text

#: Labelled documents that are used at most, chosen by a hash of their ids, abusive ones in their natural share.
EXAMPLES = 3000
NEAREST, FLOOR, POWER, BLOCK = 12, 0.4, 3.0, 32
#: With more postings to read than this the blocks' bounds are asked first.
DENSE = 2000
#: Votes are shrunk as if harmless examples of this weight stood beside them, so that lone, distant neighbours count little.
PRIOR = 0.1
#: Documents that the vote of other passages counts for, beside the further documents with the same passage.
OTHERS = 4
_NEAR = FLOOR * FLOOR - 1e-6
#: A passage of an abusive document stays an example of abuse if other documents agree to this share.
AGREED = 0.65
#: Passages whose score a worker remembers; the store is emptied when full.
MEMORY = 200_000
_SPLIT = re.compile(r"(?<=[.!?…])[”\"»')\]]*\s+|\s*\n\s*")
_LABEL = re.compile(r"^(?:[*•]?\s*[A-Z]{1,2}/\d+\s+|\d{1,3}\.\s+|[A-ZÀ-Þ][^:.!?\n]{1,60}(?:\.[^:.!?\n]{1,40})?:\s+)")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_][\w*@$']*|\*+")
_LEET = str.maketrans("013457@$", "oleastas")
_LEET_I = str.maketrans("013457@$", "oieastas")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_PLAIN = re.compile(r"[a-z0-9']+")
_SINGLES = re.compile(r"(?<![a-z0-9'])[a-z] [a-z] [a-z] [a-z](?![a-z0-9'])")
_LETTERS = re.compile(r"[^0-9']*")


def passages(text: str | None) -> list[str]:
    """Sentences of a document without list numbers and speaker labels."""
    out = []
    for piece in _SPLIT.split(normalize_text(text or "")):
        piece = _LABEL.sub("", piece.strip())
        if piece:
            out.append(piece)
    return out


def tokens(passage: str, repeats: bool = True) -> list[str]:
    """Words without case, accents and disguise: spaced-out letters are joined, signs for letters and long repeats undone.

    ``repeats=False`` is for passages known to have no letter three times in a row.
    """
    low = passage.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    words = _PLAIN.findall(low)
    if _SINGLES.search(" ".join(words)) and _SPACED.search(low):
        low = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()), low)
        words = _PLAIN.findall(low)
    if repeats and _REPEAT.search(low):
        low = _REPEAT.sub(r"\1", low)
        words = _PLAIN.findall(low)
    if "*" in low or "@" in low or "$" in low or not low.isascii():
        words = _TOKEN.findall(low)
    elif _LETTERS.fullmatch(low):
        return words
    out = []
    for w in words:
        if w.isalpha():
            out.append(w)
        elif w.isdigit():
            out.append("0")
        elif "*" in w:
            out += ["*", w[0] + "*"]
        elif w[0].isalpha() and any(c.isdigit() or c in "@$" for c in w):
            out.append(w.translate(_LEET_I))
        else:
            out.append(w.translate(_LEET) if any(map(str.isalpha, w)) else "0")
    return out


def features(words: list[str]) -> dict[str, float]:
    """Sublinear counts of words and neighbouring pairs."""
    counts = Counter(words)
    counts.update(map("{} {}".format, words, words[1:]))
    return {k: 1 + math.log(n) if n > 1 else 1.0 for k, n in counts.items()}


def has_repeats(low: str) -> bool:
    """Whether a letter stands three times in a row."""
    if not low.isascii():
        return bool(_REPEAT.search(low))
    b = np.frombuffer(low.encode(), dtype=np.uint8)
    return bool(((b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (b[2:] >= 97) & (b[2:] <= 122)).any())


class BlockIndex:
    """Inverted index in blocks with exact cosine; abusive examples fill the first blocks."""

    def __init__(self, examples: list[tuple[dict[str, float], float]]):
        count = len(examples)
        self.order = order = sorted(range(count), key=lambda i: (-(examples[i][1] >= 0.5), sorted(examples[i][0])[:6], i))
        self.labels = np.array([examples[i][1] for i in order], dtype=np.float32)
        self.abusive = int((self.labels >= 0.5).sum())
        self.blocks, self.abusive_blocks = -(-count // BLOCK), -(-self.abusive // BLOCK)  # all, and those with abusive examples
        number: dict[str, int] = {}
        feature = np.array([number.setdefault(f, len(number)) for i in order for f in examples[i][0]], dtype=np.int64)
        value = np.array([v for i in order for v in examples[i][0].values()])
        row = np.repeat(np.arange(count), [len(examples[i][0]) for i in order])
        idf = np.log((1 + count) / (0.5 + np.bincount(feature, minlength=len(number))))
        self.unseen = math.log((1 + count) / 0.5)
        weight = value * idf[feature]
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=count))
        weight = (weight / np.where(norm > 0, norm, 1)[row]).astype(np.float32)
        by = np.lexsort((row, feature))
        feature, row, weight = feature[by], row[by].astype(np.int32), weight[by]
        self.rows, self.weights = row, weight
        at = np.searchsorted(feature, np.arange(len(number) + 1))
        mine = np.searchsorted(feature * (count + 1) + row, np.arange(len(number)) * (count + 1) + self.abusive)
        block = row // BLOCK
        heads = np.flatnonzero((np.diff(feature, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.block_of, self.block_top = block[heads], np.maximum.reduceat(weight, heads) if len(heads) else weight
        self.heads_at, self.postings_read = np.append(heads, len(feature)), 0
        head_at = np.searchsorted(heads, at)
        head_mine = np.searchsorted(feature[heads] * (self.blocks + 1) + self.block_of, np.arange(len(number)) * (self.blocks + 1) + self.abusive_blocks)
        #: of each feature: idf, range of its postings, range of its blocks, largest weight
        self.idf = {f: float(idf[k]) for f, k in number.items()}
        most = np.maximum.reduceat(weight, at[:-1]) if len(number) else weight
        self.spans = {f: (int(at[k]), int(at[k + 1]), int(head_at[k]), int(head_at[k + 1]), float(most[k])) for f, k in number.items()}
        #: of each feature of abusive examples: ends of their postings and blocks, and their largest weight
        near = np.flatnonzero(mine > at[:-1])
        names = list(number)
        self.top_abusive = {names[k]: float(weight[at[k] : mine[k]].max()) for k in near}
        self.abusive_spans = {names[k]: (int(at[k]), int(mine[k]), int(head_at[k]), int(head_mine[k])) for k in near}
        self.top_square = {f: v * v for f, v in self.top_abusive.items()}
        #: squared idf of each word, and its most to the product with an abusive example; words that begin such a pair
        self.word = {f: (v * v, v * self.top_abusive.get(f, 0.0)) for f, v in self.idf.items() if " " not in f}
        self.pair = {f: self.idf[f] * v for f, v in self.top_abusive.items() if " " in f}
        self.heads = frozenset(f.split(" ")[0] for f in self.pair)

    def query(self, counts: dict[str, float]) -> tuple[list[tuple[str, float]], float]:
        vector = [(f, v * self.idf.get(f, self.unseen)) for f, v in counts.items()]
        norm = math.sqrt(sum(v * v for _, v in vector)) or 1.0
        return vector, norm

    def far(self, words: list[str]) -> bool:
        """Whether no abusive example can be as near as FLOOR, told from a bound on the product and one on the norm.

        The cosine is at most the root of the sum of the squared largest weights of the features that abusive examples have;
        where that is not small enough, repeated words count more for the product and less for the norm than they do. So the
        answer yes is always right.
        """
        shared = self.top_square.keys() & words
        total = sum(map(self.top_square.__getitem__, shared))
        if total < _NEAR:
            if self.heads.isdisjoint(shared):
                return True
            pairs = {w + " " + v for w, v in zip(words, words[1:]) if w in self.heads}
            if total + sum(map(self.top_square.__getitem__, self.top_square.keys() & pairs)) < _NEAR:
                return True
        product = norm = 0.0
        rare = (self.unseen**2, 0.0)
        word, heads, before = self.word, self.heads, ""
        for w in words:
            square, top = word.get(w, rare)
            norm += square
            product += top
            if before in heads:
                product += self.pair.get(before + " " + w, 0.0)
            before = w
        return product * product < (FLOOR - 1e-6) ** 2 * norm

    def bound(self, vector: list[tuple[str, float]], norm: float) -> float:
        """No abusive example is nearer than this."""
        top = self.top_abusive
        return sum(v * top[f] for f, v in vector if f in top) / norm

    def near_abusive(self, vector: list[tuple[str, float]], norm: float) -> bool:
        """Whether an abusive example has a cosine of FLOOR or more, exactly."""
        known = [(v / norm * self.top_abusive[f], v / norm, *self.abusive_spans[f]) for f, v in vector if f in self.abusive_spans]
        return len(self._reach(known, self.abusive, self.abusive_blocks)[0]) > 0

    def nearest(self, vector: list[tuple[str, float]], norm: float, skip: frozenset[int] | set[int] = frozenset(), k: int = NEAREST) -> list[tuple[int, float]]:
        """The k nearest examples with a cosine of FLOOR or more, exactly; ties by number. ``skip`` are left out."""
        known = [(v / norm * self.spans[f][4], v / norm, *self.spans[f][:4]) for f, v in vector if f in self.spans]
        hits, dots = self._reach(known, len(self.labels), self.blocks)
        if skip and len(hits):
            kept = ~np.isin(hits, list(skip))
            hits, dots = hits[kept], dots[kept]
        best = np.lexsort((hits, -dots))[:k]
        return [(int(hits[i]), float(dots[i])) for i in best]

    def _reach(self, known: list[tuple], count: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers below ``count`` and cosines of all examples with a cosine of FLOOR or more.

        ``known``: (largest product, query weight, range of postings, range of blocks) of each feature. The features with the
        smallest products, which together stay below FLOOR, cannot reach it alone: only the others' postings are read, in the
        blocks whose bound is high enough if these are few, and what stays in reach is completed from the rest.
        """
        known.sort()
        light, total = 0, 0.0
        while light < len(known) and total + known[light][0] < FLOOR - 1e-6:
            total += known[light][0]
            light += 1
        heavy = known[light:]
        none = np.zeros(0, dtype=np.int64)
        if not heavy:
            return none, none.astype(float)
        near = None
        if sum(b - a for _, _, a, b, _, _ in heavy) > DENSE:
            bounds = np.zeros(blocks)
            for _, v, _, _, a, b in known:
                bounds[self.block_of[a:b]] += v * self.block_top[a:b]
            near = bounds >= FLOOR - 1e-6
            if not near.any():
                return none, none.astype(float)
        dots = np.zeros(count)
        for _, v, a, b, c, d in heavy:
            if near is None:
                dots[self.rows[a:b]] += v * self.weights[a:b]
                self.postings_read += b - a
                continue
            # only the postings of near blocks
            kept = np.flatnonzero(near[self.block_of[c:d]]) + c
            sizes = np.minimum(self.heads_at[kept + 1], b) - self.heads_at[kept]
            ids = np.repeat(self.heads_at[kept] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            dots[self.rows[ids]] += v * self.weights[ids]
            self.postings_read += len(ids)
        hits = np.flatnonzero(dots >= max(1e-9, FLOOR - total - 1e-6))
        sums = dots[hits]
        for _, v, a, b, _, _ in known[:light]:
            if not len(hits):
                break
            ids = self.rows[a:b]
            at = np.minimum(np.searchsorted(ids, hits), len(ids) - 1)
            sums += np.where(ids[at] == hits, v * self.weights[a:b][at], 0)
        kept = sums >= FLOOR
        return hits[kept], sums[kept]

    def vote(self, near: list[tuple[int, float]], labels: np.ndarray | None = None) -> float:
        labels = self.labels if labels is None else labels
        weights = [d**POWER for _, d in near]
        return sum(w * float(labels[i]) for (i, _), w in zip(near, weights)) / (sum(weights) + PRIOR) if weights else 0.0


def isotonic(rows: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """(least vote, share) steps of the growing function that fits (vote, label) best in squares."""
    pools: list[list[float]] = []  # least vote, labels, rows
    for vote, label in sorted(rows):
        if pools and pools[-1][0] == vote:
            pools[-1][1] += label
            pools[-1][2] += 1
        else:
            pools.append([vote, float(label), 1.0])
    out: list[list[float]] = []
    for pool in pools:
        out.append(pool)
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            last = out.pop()
            out[-1][1] += last[1]
            out[-1][2] += last[2]
    return [(v, y / n) for v, y, n in out]


class ExampleModel:
    """Examples, their index, the threshold of votes and their calibration."""

    def __init__(self, documents: list[tuple[int, str, int]]):
        owners: dict[tuple[str, ...], dict[int, int]] = {}
        for doc, text, label in sorted(documents, key=lambda d: (d[0], d[1] or "", d[2])):
            for p in passages(text):
                owners.setdefault(tuple(tokens(p)), {})[doc] = label
        owners = {k: v for k, v in owners.items() if k}
        keys = sorted(owners)
        self.threshold, self.index, self.steps = 0.5, None, []
        self._known: dict[str, float] = {}
        if not keys or not any(label for _, _, label in documents):
            return
        vectors = [features(list(k)) for k in keys]
        share = [sum(owners[k].values()) / len(owners[k]) for k in keys]
        rated = BlockIndex(list(zip(vectors, [0.0] * len(keys))))
        soft = np.array([share[i] for i in rated.order], dtype=np.float32)
        place = {i: at for at, i in enumerate(rated.order)}
        by_doc: dict[int, set[int]] = defaultdict(set)
        for i, k in enumerate(keys):
            for doc in owners[k]:
                by_doc[doc].add(place[i])
        labels = [0.0] * len(keys)
        for i, k in enumerate(keys):
            if not any(owners[k].values()):
                continue
            skip = set().union(*(by_doc[d] for d in owners[k]))
            near = rated.nearest(*rated.query(vectors[i]), skip=skip)
            n = len(owners[k]) - 1
            labels[i] = float((n * share[i] + OTHERS * rated.vote(near, soft)) / (n + OTHERS) >= AGREED)
        self.index = BlockIndex(list(zip(vectors, labels)))
        self._calibrate(documents, owners, keys)

    def _calibrate(self, documents, owners, keys) -> None:
        index = self.index
        place = {keys[i]: at for at, i in enumerate(index.order)}
        rows = []
        seen: dict[int, tuple[str, int]] = {doc: (text, label) for doc, text, label in documents}
        for doc, (text, label) in sorted(seen.items()):
            own = {place[t] for p in passages(text) if (t := tuple(tokens(p))) in place and len(owners[t]) == 1}
            rows.append((max([0.0, *(self.score_passage(p, own)[0] for p in passages(text))]), label))
        grid = [x / 20 for x in range(6, 20)]
        rated = []
        for t in grid:
            hit = sum(s >= t and label for s, label in rows)
            rated.append(2 * hit / max(1, sum(s >= t for s, _ in rows) + sum(label for _, label in rows)))
        good = [t for t, r in zip(grid, rated) if r >= max(rated) - 0.005]
        self.threshold = good[len(good) // 2]
        self.rated = max(rated)
        self.steps = isotonic(rows)

    def calibrated(self, vote: float) -> float:
        """Share of abusive documents among those with such a vote, by the held-out votes of the examples."""
        at = bisect_right(self.steps, (vote, 1.0)) - 1
        return self.steps[at][1] if at >= 0 else 0.0

    def score_passage(self, passage: str, skip: frozenset[int] | set[int] = frozenset(), repeats: bool = True) -> tuple[float, list[tuple[int, float]]]:
        index = self.index
        if index is None:
            return 0.0, []
        words = tokens(passage, repeats)
        if index.far(words):
            return 0.0, []
        vector, norm = index.query(features(words))
        if index.bound(vector, norm) < FLOOR or not index.near_abusive(vector, norm):
            return 0.0, []  # no abusive example is near enough to vote
        near = index.nearest(vector, norm, skip)
        return index.vote(near), near

    def score(self, text: str | None) -> tuple[float, str | None]:
        """Score of a document and its worst passage (None if nothing votes for abuse)."""
        worst: tuple[float, str | None] = (0.0, None)
        known = self._known
        repeats = has_repeats((text or "").lower())
        for p in passages(text):
            s = known.get(p)
            if s is None:
                if len(known) >= MEMORY:
                    known.clear()
                s = known[p] = self.score_passage(p, repeats=repeats)[0]
            if s > worst[0]:
                worst = (s, p)
        return worst


_SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("vote", T.DoubleType()), T.StructField("evidence", T.StringType())])


def fit_examples(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> ExampleModel:
    """Model of at most ``examples`` labelled documents. Documents with contradicting labels and NULL labels are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(doc).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a = _b").select(doc, F.col("_b").cast("int").alias("_l"))
    share = min(1.0, examples / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(doc), F.lit(1_000_000)) < int(1_000_000 * share)).limit(examples + examples // 5)
    rows = df.select(doc, F.col(text).alias("_t")).join(F.broadcast(sample), doc).collect()
    return ExampleModel([(r[doc], r._t, r._l) for r in rows])


def abuse_scores(df: DataFrame, model: ExampleModel, text: str = "text", out: str = "abuse") -> DataFrame:
    """Add struct ``out`` (score, vote, evidence): the vote on the worst passage, the calibrated share of abusive documents among such
    votes, and the passage. NULL and empty texts have vote 0 and no evidence."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_SCORE)
    def rate(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        rated = [known.score(t) for t in texts]
        return pd.DataFrame({"score": [known.calibrated(v) for v, _ in rated], "vote": [v for v, _ in rated], "evidence": [e for _, e in rated]})

    return df.withColumn(out, rate(df[text]))


def abuse_rates(scored: DataFrame, threshold: float, source: str = "source", out: str = "abuse") -> DataFrame:
    """(source, documents, abusive, rate); NULL is a source of its own."""
    counts = scored.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col(f"{out}.vote") >= threshold).cast("int")).alias("abusive"))
    return counts.withColumn("rate", F.col("abusive") / F.col("documents"))
