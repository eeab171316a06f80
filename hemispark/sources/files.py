"""Reading and writing of debates, dimensions and results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY = "assembly_term string, surname_key string, full_name string, party string, constituency string, start_date date, end_date date"
ALIGNMENT = "party string, assembly_term string, gov_or_opp string, effective_from date, effective_to date, confidence string, note string"
_PAGES = T.StructType([T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, typed by the schema; empty fields are NULL."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, nullValue="")


def read_tables(spark: SparkSession, path: str, years: list[str] | None = None) -> DataFrame:
    """Parquet, by default of all years; a list of years prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("year").isin(years)) if years else df


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], years: list[str] | None = None, pattern: str = "*.pdf") -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of all files under ``path/<year>/``. A file that cannot be read is a row of errors, never a failed job."""

    @F.udf(_PAGES)
    def pages_of(content: bytes):
        try:
            return ([p or "" for p in extract(bytes(content))], None)
        except Exception as e:  # any fault of one file
            return (None, f"{type(e).__name__}: {e}")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("debate_id"), name.alias("source_file"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("year"), "content")
    if years:
        rows = rows.where(F.col("year").isin(years))
    read = rows.select("debate_id", "source_file", "year", pages_of("content").alias("r"))
    good = read.where(F.col("r.error").isNull()).select("debate_id", "source_file", "year", F.col("r.pages").alias("pages"))
    return good, read.where(F.col("r.error").isNotNull()).select("debate_id", "source_file", "year", F.col("r.error").alias("error"))


def write_parquet(df: DataFrame, path: str, by_year: bool = False) -> None:
    """Overwrite; optionally one directory per year, written by tasks that hold one year each where possible."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("year") if by_year else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def missing_vectors(texts: DataFrame, cache: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows whose vector is not in the cache, which is keyed by the text's hash too, so that changed texts are computed anew."""
    return texts.withColumn("text_hash", F.xxhash64(text)).join(cache.select(*keys, "text_hash"), [*keys, "text_hash"], "left_anti")
