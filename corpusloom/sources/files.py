"""Readers and writers for articles, documents, sitemaps and url lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import fixed
from corpusloom.operators.web import article_text
from corpusloom.sources.sitemaps import fetched_sitemaps, sitemap_pages

DOCUMENT_SCHEMA = (
    "id string, title string, url string, content string, authors array<string>, reviewers array<string>, "
    "`references` array<string>, sections map<string,string>, "
    "metadata struct<title:string,url:string,source:string,language:string>"
)
CHUNK_SCHEMA = "id string, title string, url string, content string"
EMBEDDED_SCHEMA = CHUNK_SCHEMA + ", embedding array<float>"


def read_article_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One row per *.txt file: (readable articles, files that are not valid
    UTF-8). Line ends become newlines. The second table is the report of
    skipped files; nothing is dropped silently."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    raw = raw.select(F.col("_metadata.file_name").alias("file_name"), "value")
    good = raw.filter(F.is_valid_utf8("value")).withColumn("value", F.regexp_replace("value", "\r\n?", "\n"))
    bad = raw.filter(~F.is_valid_utf8("value")).select("file_name", F.lit("not valid UTF-8").alias("reason"))
    return good, bad


def read_json_array(spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """Files that hold one JSON array of objects each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8, nothing escaped, one object per line, one file per partition."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_visited(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string").parquet(path).distinct()


def add_visited(urls: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Append urls that are not in `known` yet; repeats are written once."""
    fresh = urls.select("url").dropDuplicates(["url"])
    if known is not None:
        fresh = fresh.join(known.select("url"), "url", "left_anti")
    fresh.write.mode("append").parquet(path)


def read_sitemap(spark: SparkSession, path: str, part: str = fixed.SITEMAP_PAGE_PART) -> DataFrame:
    """Page urls of sitemap files, filtered by a part of the url."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    return rows.select(F.trim("loc").alias("url")).filter(F.contains("url", F.lit(part)))


def read_sitemap_index(
    spark: SparkSession,
    index_url: str,
    folder: str,
    child_part: str = fixed.SITEMAP_CHILD_PART,
    part: str = fixed.SITEMAP_PAGE_PART,
) -> DataFrame:
    """Page urls of the sitemaps that an index names, through further indexes. `folder` holds
    the fetched files under their hosts and paths."""
    roots = spark.createDataFrame([(index_url,)], "url string")
    return sitemap_pages(fetched_sitemaps(spark, folder), roots, child_part, part)


def write_article_texts(arts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Articles in their text layout, one directory per file stem."""
    text = arts.select(
        "file_stem", article_text(F.col("title"), F.col("url"), F.col("content"), F.col("sections")).alias("value")
    )
    text.write.mode(mode).partitionBy("file_stem").text(path)
