"""Pages that arrive over time: each url is stored once, across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.web import articles, complete
from corpusloom.sources.runs import Runs

PAGE_SCHEMA = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def visited_urls(spark: SparkSession, path: str, buckets: int = 64, fan_in: int = 8) -> Runs:
    return Runs(spark, path, "url", "url string", buckets, fan_in)


def ingest_articles(
    pages: DataFrame, articles_path: str, checkpoint: str, trigger: dict | None = None, visited_path: str | None = None,
    buckets: int = 64, fan_in: int = 8,
) -> StreamingQuery:
    """Parse pages with an unseen url and store the articles; of several pages with a url,
    the one with the smallest id (then html). A url whose page gave no article is tried
    again when it comes back, as only stored pages count as visited.

    Visited urls are a table of their own, by default beside the articles. Its filters tell
    which urls are new for certain, and only folders that may hold one of the others
    are read, so a batch's work does not grow with what was read before. Each batch goes to its
    own sub-folder, which a repeated batch overwrites, and is compared with earlier batches
    only: a batch that is run again after a failure neither loses nor doubles an article."""
    path = visited_path or f"{articles_path.rstrip('/')}_visited"

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        visited = visited_urls(spark, path, buckets, fan_in)
        target = f"{articles_path}/batch={number}"
        first = batch.groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("page")).select("page.page_id", "url", "page.html")
        fresh = visited.without_known(first, before=number)  # before parsing
        complete(articles(fresh)).write.mode("overwrite").parquet(target)
        visited.add(spark.read.schema("url string").parquet(target), number)

    writer = pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def deduplicated(pages: DataFrame, time: str, delay: str) -> DataFrame:
    """First page per url within a delay: bounded state, for sources that repeat
    a url only shortly after it came first."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])
