"""Evaluation passages inside a training corpus, by suffix arrays of the training text.

Each shard (a batch of documents in a task) is read into numbers, one for each folded word; words that no test item has
are a separator, since no match can cross them. The shard's suffix array is sorted over ``DEPTH`` words by prefix
doubling. Every suffix of every test item is looked up by binary search, which gives its longest verbatim match and
where it occurs. An item has leaked into a document if

* at least ``RUN`` consecutive words match, or
* the whole item stands in the document with at most one word in eight replaced: then some ``seed`` of consecutive
  words matches exactly, and the words on that diagonal are compared.

Words that are part of set phrases (runs shared by several items of different text, over all items) do not count towards a match on their own.
Test items are a fixed set; their size is checked before they are sent to the executors, and larger sets are handled in blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemispark.llm.characters import normalize_text
from hemispark.session import checkpoint

RUN, EDIT, DEPTH = 20, 8, 32
#: A set phrase has so many words and stands in more than so many different items.
PHRASE, SHARED = 6, 2
#: Test items handled in one pass over the corpus (about 100 words each: some megabytes).
BLOCK = 5_000
_WORDS = re.compile(r"[^\W_]+")
_ACCENTS = {c: unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) > 1}


def words_of(text: str | None) -> list[str]:
    """Words without case, accents, punctuation, layout and unseen characters."""
    text = normalize_text(text or "")
    if "-\n" in text or "- \n" in text:
        text = re.sub(r"(?<=\w)- ?\n(?=\w)", "", text)
    low = text.lower()
    return _WORDS.findall(low if low.isascii() else low.translate(_ACCENTS))


def phrases(words: list[str]) -> set[str]:
    """Runs of ``PHRASE`` words."""
    return {" ".join(words[i : i + PHRASE]) for i in range(len(words) - PHRASE + 1)}


def set_phrases(texts: Iterable[list[str]]) -> set[str]:
    """Runs that stand in more than ``SHARED`` different texts; copies of one text count once."""
    counts = Counter(p for words in {tuple(t) for t in texts} for p in phrases(list(words)))
    return {p for p, n in counts.items() if n > SHARED}


class Items:
    """Test items as numbers. ``shared``: the set phrases, if the items are a part of more; else they are counted here."""

    def __init__(self, items: list[tuple[int, str]], shared: set[str] | None = None):
        self.ids, self.words, texts = [], [], []
        self.number: dict[str, int] = {}
        for item, text in sorted(items, key=lambda x: x[0]):
            words = words_of(text)
            if words:
                self.ids.append(item)
                texts.append(words)
                self.words.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], dtype=np.int32))
        shared = set_phrases(texts) if shared is None else shared
        self.common = []
        for words in texts:
            mark = np.zeros(len(words), dtype=bool)
            for i in range(len(words) - PHRASE + 1):
                if " ".join(words[i : i + PHRASE]) in shared:
                    mark[i : i + PHRASE] = True
            self.common.append(mark)
        self.edits = [len(w) // EDIT for w in self.words]
        #: Words in a row that must match exactly if at most ``edits`` of an item's words are replaced.
        self.seeds = [min(RUN, max(1, -(-(len(w) - e) // (e + 1)))) for w, e in zip(self.words, self.edits)]


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """``starts`` sorted by the ``depth`` numbers from each (zero ends a suffix and sorts first)."""
    rank = text.astype(np.int64)
    size, length = len(text), 1
    while length < depth:
        ahead = np.zeros(size, dtype=np.int64)
        ahead[: size - length] = rank[length:]
        ahead[rank == 0] = 0
        pair = rank * (int(rank.max()) + 1) + ahead
        live = np.flatnonzero(text)
        values, inverse = np.unique(pair[live], return_inverse=True)
        rank = np.zeros(size, dtype=np.int64)
        rank[live] = inverse + 1
        length *= 2
        if len(values) == len(live):
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def _first_words(text: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """Numbers at ``positions`` and the following ``depth - 1``; after a zero only zeros."""
    padded = np.concatenate([text, np.zeros(depth, dtype=text.dtype)])
    rows = padded[positions[:, None] + np.arange(depth)]
    rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0
    return rows


class Shard:
    """Suffix array of some documents. Only suffixes whose first word a test item has are kept: no other can match."""

    def __init__(self, documents: list[list[str]], items: Items):
        get = items.number.get
        flat: list[int] = []
        self.begins = np.zeros(len(documents) + 1, dtype=np.int64)
        for i, words in enumerate(documents):
            flat.extend([get(w, 0) for w in words])
            flat.append(0)
            self.begins[i + 1] = len(flat)
        self.text = np.array(flat, dtype=np.int32)
        self.seed = min(items.seeds, default=1)
        known = self.text != 0
        # a suffix is of use if the shortest seed fits before the next word that no item has
        ends = np.flatnonzero(~known)
        positions = np.flatnonzero(known)
        room = ends[np.searchsorted(ends, positions)] - positions if len(positions) else positions
        starts = positions[room >= self.seed]
        self.array = suffix_array(self.text, starts) if len(starts) else starts
        self.rows = self._keys(_first_words(self.text, self.array, self.seed))

    @staticmethod
    def _keys(rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.astype(">i4")).view([("", "V" + str(4 * rows.shape[1]))]).reshape(-1) if rows.size else np.zeros(0, dtype="V4")

    def matches(self, words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, positions): every diagonal of the shard on which ``seed`` consecutive words of an item match, as the place at which the
        item would start, and a position on it. Found by binary search of every suffix of the item."""
        none = np.zeros(0, dtype=np.int64)
        if len(words) < seed or not len(self.array):
            return none, none
        order = _bytes(self.rows)
        queries = _bytes(self._keys(_first_words(words.astype(np.int32), np.arange(len(words) - seed + 1), self.seed)))
        low, high = np.searchsorted(order, queries, "left"), np.searchsorted(order, queries, "right")
        counts = high - low
        if not counts.any():
            return none, none
        offsets = np.repeat(np.arange(len(words) - seed + 1), counts)
        at = self.array[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        starts, first = np.unique(at - offsets, return_index=True)
        return starts, at[first]

    def found(self, items: Items, rows: int = 20_000) -> dict[tuple[int, int], tuple[int, int]]:
        """(document number, item number) of every leak: (words, word of the document) of its longest verbatim match, the first of equal ones."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for k, words in enumerate(items.words):
            all_starts, all_positions = self.matches(words, items.seeds[k])
            for a in range(0, len(all_starts), rows):
                starts, positions = all_starts[a : a + rows], all_positions[a : a + rows]
                document = np.searchsorted(self.begins, positions, "right") - 1
                begin, end = self.begins[document], self.begins[document + 1] - 1
                size = len(starts)
                run, longest, stop, misses = (np.zeros(size, dtype=np.int64) for _ in range(4))
                own, leaked = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
                inside = (starts >= begin) & (starts + len(words) <= end)
                for j, word in enumerate(words):  # all diagonals at once
                    at = starts + j
                    same = (at >= begin) & (at < end)
                    same[same] = self.text[at[same]] == word
                    run = (run + 1) * same
                    own = (own | (not items.common[k][j])) & same
                    leaked |= (run >= RUN) & own
                    misses += ~same
                    better = run > longest
                    longest[better], stop[better] = run[better], at[better] + 1
                leaked |= inside & (misses <= items.edits[k])
                for i in np.flatnonzero(leaked):
                    key, new = (int(document[i]), k), (int(longest[i]), int(stop[i] - longest[i] - begin[i]))
                    old = out.get(key)
                    if old is None or (-new[0], new[1]) < (-old[0], old[1]):
                        out[key] = new
        return out


def _bytes(keys: np.ndarray) -> np.ndarray:
    return keys.view("S" + str(keys.dtype.itemsize)) if keys.dtype.kind == "V" and keys.dtype.names is None else keys


def leaked_items(df: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc, item, words, at) of every document that holds a test item, each once: the longest verbatim match and where it begins.

    NULL or empty texts never match. Repeated documents and items each give their own row (once per pair of ids).
    """
    wanted = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t")).distinct()
    count = wanted.count()
    corpus = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    schema = f"_doc {df.schema[doc].dataType.simpleString()}, _item {items.schema[item].dataType.simpleString()}, words int, at int"
    out, runs = None, None
    if count > block:

        @F.pandas_udf("struct<text:string,runs:array<string>>")
        def folded(texts: pd.Series) -> pd.DataFrame:
            words = [words_of(t) for t in texts]
            return pd.DataFrame({"text": [" ".join(w) for w in words], "runs": [sorted(phrases(w)) for w in words]})

        # set phrases are those of all items, whatever the blocks
        runs = checkpoint(wanted.select("i", folded("t").alias("f")).select("i", F.col("f.text").alias("text"), F.explode("f.runs").alias("run")))
        common = runs.select("text", "run").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARED)
        runs = checkpoint(runs.join(common, "run", "left_semi").select("i", "run"))
    for part in range(max(1, -(-count // block))):
        rows = wanted if count <= block else wanted.where(F.pmod(F.xxhash64("i"), F.lit(-(-count // block))) == part)
        shared = None if runs is None else {r.run for r in runs.join(rows.select("i"), "i", "left_semi").select("run").distinct().collect()}
        known = df.sparkSession.sparkContext.broadcast(Items([(r.i, r.t) for r in rows.collect()], shared))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids, texts in _shards(batches):
                shard = Shard([words_of(t) for t in texts], known.value)
                pairs = sorted(shard.found(known.value).items())
                yield pd.DataFrame({"_doc": [ids[d] for (d, _), _ in pairs], "_item": [known.value.ids[k] for (_, k), _ in pairs], "words": [w for _, (w, _) in pairs], "at": [p for _, (_, p) in pairs]})

        found = corpus.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("_doc", "_item").agg(F.max(F.struct("words", (-F.col("at")).alias("at"))).alias("m"))
    return best.select(F.col("_doc").alias(doc), F.col("_item").alias(item), F.col("m.words").alias("words"), (-F.col("m.at")).alias("at"))


def _shards(batches: Iterator[pd.DataFrame], characters: int = 8_000_000) -> Iterator[tuple[list, list[str]]]:
    """Documents of some batches together, up to a number of characters; a longer text is a shard of its own."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch["_doc"], batch["_text"]):
            if size and size + len(t) > characters:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def without_leaks(df: DataFrame, found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The documents in which no test item was found."""
    return df.join(found.select(doc).distinct(), doc, "left_anti")
