"""Saved pages of an encyclopedia's interface: one JSON file a page of results, read by Spark wherever they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.sources.files import LEAST_EXTRACT

PAGE = "query struct<pages: map<string, struct<title: string, extract: string>>>, error struct<code: string, info: string>, _broken string"


def _place(name: Column) -> Column:
    """Pages in the order of their numbers, with leading zeros or without."""
    return F.struct(F.length(name).alias("n"), name.alias("file"))


def pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """place, results (key -> title and extract) and usable of every file: an answer with an error, without results or that is
    no JSON isn't usable."""
    raw = spark.read.schema(PAGE).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    results = F.col("query.pages")
    good = F.col("error").isNull() & F.col("_broken").isNull() & (F.coalesce(F.size(results), F.lit(0)) > 0)
    return raw.select(_place(F.col("_metadata.file_name")).alias("place"), results.alias("results"), good.alias("usable"))


def saved_extracts(spark: SparkSession, path: str | list[str], least: int = LEAST_EXTRACT, articles: int | None = None) -> DataFrame:
    """page (the file's name), key, title and extract of the results that are long enough, up to the first page that isn't usable;
    with `articles`, the first so many of them by page and key.

    A download that ended with an error thus gives what came before it, whatever was saved afterwards. Null extracts and
    those under `least` characters are skipped and don't count.
    """
    every = pages(spark, path)
    end = every.filter(~F.col("usable")).agg(F.min("place").alias("end"))  # one row
    before = every.crossJoin(F.broadcast(end)).filter(F.col("end").isNull() | (F.col("place") < F.col("end")))
    rows = before.select("place", F.explode("results").alias("key", "x")).select("place", "key", "x.title", "x.extract").filter(F.length("extract") >= least)
    if articles is not None:
        rows = rows.orderBy("place", F.length("key"), "key").limit(articles)
    return rows.select(F.col("place.file").alias("page"), "key", "title", "extract")


def skipped(spark: SparkSession, path: str | list[str], least: int = LEAST_EXTRACT) -> DataFrame:
    """page and how many of its results were kept or were too short, and whether the page was usable."""
    of = lambda long: F.size(F.filter(F.map_values("results"), lambda x: long(F.coalesce(F.length(x["extract"]), F.lit(0)))))
    counts = {"kept": of(lambda n: n >= least), "short": of(lambda n: n < least)}
    return pages(spark, path).select(F.col("place.file").alias("page"), "usable", *(F.when(F.col("usable"), v).otherwise(0).alias(k) for k, v in counts.items()))
