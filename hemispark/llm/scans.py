"""Text of scanned pages into continuous paragraphs.

Lines are labelled header, body or break by a linear chain over layout features (:mod:`hemispark.llm.furniture`), fitted
to a bounded sample of the pages; among the features is whether other pages of the debate have the line too. By the labels
headers go and cut words are joined. Then misrecognised characters are read back with the counts of all words of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemispark.llm.characters import normalize_text
from hemispark.llm.furniture import RATIO, SIGNED_RATIO, Chain, CountReader, MappedReader, fit_chain, join_lines, line_shape, reversals, search_depth
from hemispark.session import BROADCAST_ROWS, checkpoint, salted_join

#: Texts of several lines that the chain is fitted to at most, chosen by a hash of the text.
SAMPLE = 4_000
#: A line runs along the pages of a debate if so many of its rows have it.
PAGES = 3
_JOINED = T.StructType([T.StructField("text", T.StringType()), T.StructField("header", T.BooleanType()), T.StructField("hyphen", T.BooleanType())])
_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("noises", T.ArrayType(T.StringType()))])
#: A line in which every word of the kind that titles capitalise begins with a capital, and which ends no sentence.
_TITLE_LINE = r"^(?:[^\p{Ll}\s]\S*|of|to|and|the)(?: (?:[^\p{Ll}\s]\S*|of|to|and|the)){0,11}$"


def _title_lines(text: Column) -> Column:
    """Lines of a text that may run along pages, by their shape (numbers alike)."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\d+", "0"), r"\s+", " "))
    return F.array_distinct(F.filter(lines, lambda x: (F.length(x) <= 80) & ~x.rlike(r"[.!?:;,…]$|^[^\p{L}]*$") & x.rlike(_TITLE_LINE)))


def repeated_lines(df: DataFrame, text: str, page: str | None) -> DataFrame:
    """(page, shape) of the title-like lines that at least ``PAGES`` different texts of a page's document (NULL: one document) have."""
    lines = df.select((F.lit(None).cast("string") if page is None else F.col(page).cast("string")).alias("page"), F.xxhash64(text).alias("h"), F.explode(_title_lines(F.col(text))).alias("shape")).distinct()
    return lines.groupBy("page", "shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES).select("page", "shape")


def with_repeated(df: DataFrame, text: str, page: str | None, lines: DataFrame, out: str = "_again") -> DataFrame:
    """Add the shapes of a text's lines that other pages have too; only texts with title-like lines are joined."""
    none = F.array().cast("array<string>")
    marked = df.withColumn("_lines", _title_lines(F.col(text)))
    plain = marked.where(F.coalesce(F.size("_lines"), F.lit(0)) < 1).withColumn(out, none)
    asked = marked.where(F.size("_lines") > 0).withColumn("_page", F.lit(None).cast("string") if page is None else F.col(page).cast("string"))
    # one row for each page and set of lines, as one line may stand on a third of all rows
    sets = asked.select("_page", "_lines").distinct().withColumn("shape", F.explode("_lines"))
    known = sets.join(lines.withColumnRenamed("page", "_of"), F.col("_page").eqNullSafe(F.col("_of")) & (sets["shape"] == lines["shape"])).groupBy("_page", "_lines").agg(F.collect_set(lines["shape"]).alias(out))
    keyed = known.select(F.struct("_page", "_lines").alias("_set"), out)
    found = salted_join(asked.withColumn("_set", F.struct("_page", "_lines")), keyed, ["_set"], "left").withColumn(out, F.coalesce(out, none))
    return plain.drop("_lines").unionByName(found.drop("_set", "_page", "_lines"))


def fitted_chain(df: DataFrame, text: str, sample: int = SAMPLE) -> Chain:
    """The chain fitted to at most ``sample`` different texts of several lines or with a number alone; ``df`` has ``_again``."""
    rows = df.where(F.col(text).rlike(r"\n|^\W*\d+\W*$")).select(F.col(text).alias("t"), F.col("_again").alias("r"), F.xxhash64(text).alias("h"))
    chosen = rows.orderBy("h", "t").limit(2 * sample).distinct().collect()
    return fit_chain([(normalize_text(r.t), frozenset(r.r)) for r in sorted(chosen, key=lambda r: (r.h, r.t))[:sample]])


def joined_lines(df: DataFrame, text: str, page: str | None = None, out: str = "_joined", sample: int = SAMPLE) -> DataFrame:
    """Add struct ``out`` (text, header, hyphen): the text put together by the chain's labels, whether headers and cut words were found.

    NULL gives NULL and false. ``page`` names the column of the document that a row is a page of; headers are repeated within it.
    """
    marked = with_repeated(df, text, page, checkpoint(repeated_lines(df, text, page)))
    chain = df.sparkSession.sparkContext.broadcast(fitted_chain(marked, text, sample))

    @F.pandas_udf(_JOINED)
    def join(texts: pd.Series, again: pd.Series) -> pd.DataFrame:
        rows = [(None, False, False) if t is None else join_lines(normalize_text(t), chain.value, frozenset(r)) for t, r in zip(texts, again)]
        return pd.DataFrame(rows, columns=["text", "header", "hyphen"])

    return marked.withColumn(out, join(text, "_again")).drop("_again")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) of every token over all rows of continuous text, as the readers look them up. NULL and empty texts count nothing."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reader = CountReader()
            for t in batch["t"]:
                if t:
                    reader.scan(t)
            yield pd.DataFrame({"word": pd.Series(list(reader.counts), dtype=object), "n": pd.Series(list(reader.counts.values()), dtype="int64")})

    return df.select(F.col(text).alias("t")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corrections(counts: DataFrame) -> DataFrame:
    """(token, word): every damaged token of the counted texts and the word it stands for, whatever the size of the vocabulary.

    Same result as :func:`hemispark.llm.furniture.damage_search` with the whole lexicon: the forms a token may come from
    join the counts by equality.
    """
    form = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("ratio", T.IntegerType())]))

    @F.pandas_udf(form)
    def forms(tokens: pd.Series) -> pd.Series:
        def of(t: str) -> list[dict]:
            ratio = RATIO if t.isalpha() else SIGNED_RATIO
            return [{"word": w, "depth": k, "ratio": ratio} for k, reached in enumerate(reversals(t, search_depth(t))) for w in sorted(reached) if len(w) > 1 and w.isalpha()]

        return tokens.map(of)

    asked = counts.select(F.col("word").alias("token"), F.col("n").alias("own"), F.explode(forms("word")).alias("f")).select("token", "own", "f.*")
    hits = asked.join(counts, "word").where(F.col("n") >= F.col("ratio") * F.col("own"))
    level = hits.groupBy("token", "depth").agg(F.max(F.struct("n", "word")).alias("best"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("depth", "best"))), lambda x: x["best"])
    chosen = level.groupBy("token").agg(steps.alias("s")).withColumn("s", F.aggregate(F.slice("s", 2, 9), F.get("s", F.lit(0)), lambda kept, x: F.when(x["n"] >= RATIO * kept["n"], x).otherwise(kept)))
    return chosen.select("token", F.col("s.word").alias("word"))


class Repairs(NamedTuple):
    """Corrections of the damaged tokens of a corpus: the table, and a reader for the executors where it proved small enough."""

    table: DataFrame
    reader: object | None


def find_repairs(counts: DataFrame, rows: int = BROADCAST_ROWS) -> Repairs:
    """Corrections of counted words. Up to ``rows`` of them are sent to the executors; more stay a table that texts are joined with."""
    table = checkpoint(corrections(checkpoint(counts)))
    some = table.limit(rows + 1).collect()
    small = len(some) <= rows
    return Repairs(table, table.sparkSession.sparkContext.broadcast(MappedReader({r.token: r.word for r in some})) if small else None)


def with_own_repairs(df: DataFrame, text: str, repairs: Repairs, out: str = "_fixes") -> DataFrame:
    """Add the corrections of a text's own tokens, each as token, tab and word; NULL where the reader holds all."""
    if repairs.reader is not None:
        return df.withColumn(out, F.lit(None).cast("array<string>"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[str]:
            reader = CountReader()
            reader.scan(t or "")
            return sorted(w for w in reader.counts if search_depth(w))

        return texts.map(of)

    # equal texts are looked up once
    asked = df.select(F.xxhash64(text).alias("_h"), F.col(text).alias("_t")).where(F.col(text).isNotNull()).distinct()
    pairs = asked.select("_h", F.explode(tokens("_t")).alias("token")).distinct()
    fixes = salted_join(pairs, repairs.table, ["token"]).groupBy("_h").agg(F.collect_set(F.concat_ws("\t", "token", "word")).alias(out))
    return salted_join(df.withColumn("_h", F.xxhash64(text)), fixes, ["_h"], "left").drop("_h")


def reader_of(held: object | None, fixes: list[str] | None) -> MappedReader:
    """The reader of a text: the broadcast one, or one of the text's own corrections."""
    return held.value if held is not None else MappedReader(dict(f.split("\t") for f in (() if fixes is None else fixes)))


def repair_scans(df: DataFrame, text: str, page: str | None = None, out: str = "_repair", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add struct ``out``: repaired text, and which of header, hyphen and glyph were found.

    NULL text gives NULL and no noises; '' and texts of furniture only give ''. Other columns pass through. The words are
    counted over all rows of ``df``.
    """
    joined = checkpoint(joined_lines(df, text, page))
    repairs = find_repairs(word_counts(joined, "_joined.text"), rows)
    held = repairs.reader  # only this goes to the executors

    @F.pandas_udf(_RESULT)
    def repair(texts: pd.Series, headers: pd.Series, hyphens: pd.Series, fixes: pd.Series) -> pd.DataFrame:
        clean, found = [], []
        for t, header, hyphen, own in zip(texts, headers, hyphens, fixes):
            fixed, glyph = (t, False) if t is None else reader_of(held, own).scan(t)
            clean.append(fixed)
            found.append([n for n, hit in (("header", header), ("hyphen", hyphen), ("glyph", glyph)) if hit])
        return pd.DataFrame({"text": clean, "noises": found})

    ready = with_own_repairs(joined.withColumn("_line", F.col("_joined.text")), "_line", repairs)
    return ready.withColumn(out, repair("_line", "_joined.header", "_joined.hyphen", "_fixes")).drop("_joined", "_line", "_fixes")


def page_noise(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, noise), each case once, even for redelivered rows. NULL and empty texts have none; other columns are not read.

    The first key names the document that a row is a page of.
    """
    found = repair_scans(df.select(*keys, text), text, keys[0])
    return found.select(*keys, F.explode("_repair.noises").alias("noise")).distinct()


def paragraphs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text): the continuous text of each row that has any besides page furniture.

    Redelivered rows with the same keys and text count once, before anything is read.
    """
    once = df.select(*keys, text).dropDuplicates([*keys, text])
    found = repair_scans(once, text, keys[0])
    return found.select(*keys, F.col("_repair.text").alias("text")).where(F.col("text") != "")
